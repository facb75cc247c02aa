"""Anchored rows, text vectors, leaders and places against plain computations."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.operators import leaders, ranks
from lodestone.operators import text_vectors as tv
from lodestone.operators import vector_search as vs


def test_anchored_rows_of_a_hot_key(spark):  # noqa: ANN001
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 97 == 0 else ("hot" if i % 3 else f"u{i % 7}"), None if i % 89 == 0 else float(t)) for i, t in enumerate(rng.integers(0, 200_000, 3000))]
    e = spark.createDataFrame(rows, "id long, user string, s double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    got = Counter((r["anchor_id"], r["id"], r["offset"]) for r in ev.anchored(e.where("id % 20 = 0"), e, "user", "ts", 900, 600).collect())
    want = Counter((a, b, t - s) for a, u, s in rows if a % 20 == 0 for b, v, t in rows if u is not None and u == v and s is not None and t is not None and s - 900 <= t <= s + 600)
    assert got == want and len(got) > 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = ev.anchored(e.where("id % 20 = 0"), e, "user", "ts", 900, 600).where("user = 'hot'").groupBy(F.spark_partition_id()).count()
        assert tasks.count() == 4  # all of the session's shuffle partitions
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ev.anchored(e.where("false"), e, "user", "ts", 900, 600).count() == 0


def test_text_vectors(spark):  # noqa: ANN001
    texts = ["The cat sat, the CAT sat!", "cat dog_1 and a dog_1", None, "", "über über straße", "x the of", "sat sat sat"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (4, 384):
        model = tv.fit(d, size=size)
        names = {r["idx"]: r["term"] for r in model.vocabulary.collect()}
        got = {r["id"]: {names[x["idx"]]: x["w"] for x in r["vector"]} for r in model.transform(d).collect()}

        def terms(t):  # noqa: ANN001, ANN202
            w = [x for x in re.findall(r"\w{2,}", (t or "").lower()) if x not in tv.STOP_WORDS]
            return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

        total = Counter(x for t in texts for x in terms(t))
        kept = sorted(total, key=lambda x: (-total[x], x))[:size]
        assert sorted(names.values()) == sorted(kept)
        for i, t in enumerate(texts):
            raw = {x: n * (1 + math.log(8 / (1 + sum(x in terms(y) for y in texts)))) for x, n in Counter(terms(t)).items() if x in kept}
            length = math.sqrt(sum(w * w for w in raw.values()))
            assert got[i] == pytest.approx({x: w / length for x, w in raw.items()})
    vectors = model.transform(d)
    query = [(x["idx"], x["w"]) for x in vectors.where("id = 0").first()["vector"]]
    found = tv.most_similar(vectors, query, 3).collect()
    assert found[0]["id"] == 0 and found[0]["score"] == pytest.approx(1)
    pair = vectors.where("id = 0").select(F.col("vector").alias("a")).crossJoin(vectors.where("id = 6").select(F.col("vector").alias("b")))
    assert pair.select(tv.sparse_dot(F.col("a"), F.col("b"))).first()[0] == pytest.approx({r["id"]: r["score"] for r in tv.most_similar(vectors, query, 9).collect()}[6])
    assert tv.most_similar(vectors, [], 2).count() == 2
    nothing = tv.fit(d.where("false"))
    assert nothing.vocabulary.count() == 0 and nothing.transform(d).where("size(vector) > 0").count() == 0


def test_places(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(i, i * 7919 % 1000) for i in range(1000)], "id long, v long").repartition(7)
    assert all(r["pos"] == r["v"] + 1 for r in ranks.placed(rows, [F.col("v")]).collect())
    assert ranks.placed(rows.where("false"), [F.col("v")]).count() == 0


def plain_leaders(vectors, threshold):  # noqa: ANN001, ANN201
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v is not None}
    heads, out = [], {}
    for i, v in vectors:
        if v is None:
            out[i] = i
            continue
        best = max(((float(unit[i] @ unit[j]), -k, j) for k, j in enumerate(heads) if unit[i] @ unit[j] > threshold), default=None)
        out[i] = best[2] if best else i
        if best is None:
            heads.append(i)
    return out


@pytest.mark.parametrize(("settled", "threshold"), [(7, 0.8), (64, 0.5), (2048, 0.7)])
def test_leaders(spark, settled, threshold):  # noqa: ANN001
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8))
    v = [(i, (centres[i * i % 6] + rng.standard_normal(8) * 0.6).astype(np.float32).tolist()) for i in range(150)]
    v += [(150, None), (151, v[0][1]), (152, v[40][1]), (153, v[40][1]), (154, (-centres[0]).astype(np.float32).tolist())]
    got = leaders.lead(spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3), threshold, settled=settled, block_rows=40).collect()
    assert {r["id"]: r["leader"] for r in got} == plain_leaders(v, threshold)
    assert all(r["similarity"] is None if r["id"] == 150 else r["similarity"] > threshold for r in got)


def test_leaders_of_nothing_and_merged_lists(spark):  # noqa: ANN001
    v = spark.createDataFrame([(1, [1.0, 0.0], ["b"], "x"), (2, [0.0, 1.0], ["c"], "y"), (3, [1.0, 0.1], ["a", "b"], "z")], "vec_id long, embedding array<float>, alias array<string>, name string")
    assert leaders.lead(v.where("false")).count() == 0
    rows = leaders.merged(v, leaders.lead(v), "vec_id", ["alias"]).orderBy("vec_id").select("vec_id", "name", "alias", "n_merged").collect()
    assert [tuple(r) for r in rows] == [(1, "x", ["a", "b"], 1), (2, "y", ["c"], 0)]


def test_index_reads_less_of_a_larger_table(spark, tmp_path):  # noqa: ANN001
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((400, 16))
    shares, recalls = [], []
    for n in (1500, 12_000):
        v = (centres[rng.integers(0, 400, n)] + rng.standard_normal((n, 16)) * 0.25).astype(np.float32)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        index = vs.CellIndex(df).write(str(tmp_path / str(n)))
        assert len(index.centres) == int(n**0.5)
        asked = df.where("vec_id % 60 = 0")
        found = {}
        for r in index.search(asked, 10).collect():
            found.setdefault(r["query_id"], set()).add(r["id"])
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        hits = total = 0
        for q in range(0, n, 60):
            score = unit @ unit[q]
            score[q] = -2
            best = set(np.argsort(-score)[:10].tolist())
            hits, total = hits + len(best & found[q]), total + 10
        recalls.append(hits / total)
        shares.append(index.share_read(asked))
    assert min(recalls) >= 0.9 and shares[1] < 0.6 * shares[0] < 0.2


def test_only_runs_of_frequent_words_are_counted(spark):
    """every pair of words was counted; what can't be among the chosen terms is left out, ties and all as by counting all terms."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], p=(p := 1 / np.arange(1, 61)) / p.sum(), size=rng.integers(0, 40))) for _ in range(120)] + [None, "w1"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, grams in ((7, 1), (20, 2), (35, 3), (5000, 2)):
        counts = {}
        for t in texts:
            w = (t or "").split()
            for n in range(1, grams + 1):
                for i in range(len(w) - n + 1):
                    counts[" ".join(w[i : i + n])] = counts.get(" ".join(w[i : i + n]), 0) + 1
        want = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:size])
        model = tv.fit(d, size=size, grams=grams)
        assert [r["term"] for r in model.vocabulary.orderBy("idx").collect()] == want
    frequent = spark.createDataFrame([("w0",), ("w1",)], "word string")
    found = tv._frequent_terms(d, frequent, "doc_id", "text", [], 2)
    assert {r["term"] for r in found.collect()} <= {"w0", "w1", "w0 w0", "w0 w1", "w1 w0", "w1 w1"}
