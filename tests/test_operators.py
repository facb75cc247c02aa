from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.filters import Filter
from lodestone.operators import events as ev
from lodestone.operators import ranking, records, usage
from lodestone.operators import vector_search as vs
from lodestone.sources import files
from lodestone.sources.collections import Collections, CollectionSpec
from lodestone.sources.paged_api import PagedSource
from lodestone.streaming import events as st


def test_run_grouping(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate("AABA")], "p int, pos int, t string")
    found = ev.runs(rows, ["p"], ["pos"], ["t"]).orderBy("run").collect()
    assert [(r["t"], r["n"]) for r in found] == [("A", 2), ("B", 1), ("A", 1)]


def test_hysteresis_and_throttle(spark):  # noqa: ANN001
    values = [0.4, 0.2, 0.4, 0.5, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "u int, i int, v double")
    assert tuple(ev.hysteresis(rows, ["u"], ["i"], "v").first()) == (1, False, 1)
    times = spark.createDataFrame([(1, float(t)) for t in (0, 100, 299, 300, 301, 700)], "u int, t double")
    assert ev.throttled(times, ["u"], ["t"], F.col("t")).first()["fired"] == 3


def test_folds_go_on_over_batches(spark):  # noqa: ANN001
    rng = np.random.default_rng(6)
    rows = [(None if i % 5 == 0 else f"k{i % 3}", int(t), None if i % 11 == 0 else float(x)) for i, (t, x) in enumerate(zip(rng.permutation(300), rng.random(300), strict=True))]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["k"]: r["result"] for r in ev.smoothed(df, ["k"], ["t"], "x", 0.7, 0.1).collect()}
        passed = {r["k"]: r["passed"] for r in ev.rationed(df, ["k"], ["t"], F.when(F.col("x").isNotNull(), F.col("t")), 2.0, 0.05).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (None, "k0", "k1", "k2"):
        own = sorted((t, x) for key, t, x in rows if key == k)
        a = None
        for _, x in own:
            a = x if a is None or x is None else a + max(-0.1, min(0.1, 0.7 * x + 0.3 * a - a))
        assert got[k] == pytest.approx(a) if a is not None else got[k] is None
        n, left, last = 0, 2.0, None
        for t in (t for t, x in own if x is not None):
            left = min(2.0, left + (0 if last is None else t - last) * 0.05)
            n, left, last = (n + 1, left - 1, t) if left >= 1 else (n, left, t)
        assert passed[k] == n
    assert ev.smoothed(df.where("false"), ["k"], ["t"], "x").count() == 0


def test_soft_label(spark):  # noqa: ANN001
    df = spark.createDataFrame([(10.0, 20.0, 5.0), (10.0, 20.0, 12.0), (10.0, 20.0, 21.0), (None, None, 1.0)], "onset double, off double, at double")
    assert [r[0] for r in df.select(ev.soft_label(F.col("onset"), F.col("off"), F.col("at"), 10.0)).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_usage_goldens(spark):  # noqa: ANN001
    df = spark.createDataFrame([(0, 5, None, 3, None)], "input_tokens long, prompt_tokens long, output_tokens long, completion_tokens long, total_tokens long")
    u = usage.token_usage({c: F.col(c) for c in df.columns})
    assert tuple(df.select(*u.values()).first()) == (5, 3, 8, True)
    chats = spark.createDataFrame([("azure", "gpt-4o"), ("AZURE", "GPT-4o"), ("azure", "new")], "provider string, model string")
    p = usage.priced(chats, usage.price_table(spark)).select(usage.cost(F.lit(1e6), F.lit(1e6), F.col("input_price"), F.col("output_price")).alias("c"))
    assert sorted((r[0] for r in p.collect()), key=str) == [12.5, 12.5, None]


def test_tournament(spark):  # noqa: ANN001
    assert [ranking.rounds_for(n) for n in (4, 8, 16, 17)] == [4, 5, 6, 7]
    players = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    found = ranking.tournament(players, lambda p: p.withColumn("winner", F.least("a", "b"))).orderBy("rank").collect()
    assert found[0]["id"] == "a" and sum(r["score"] for r in found) == 6.0
    games = []

    def judge(pairs):  # noqa: ANN001, ANN202
        judged = pairs.withColumn("winner", F.when(F.col("a") == "p07", "nobody").otherwise(F.least("a", "b")))
        games.extend((r["a"], r["b"]) for r in judged.collect())
        return judged

    many = spark.createDataFrame([(f"p{i:02d}",) for i in range(21)] + [(None,), ("p03",)], "id string")
    found = ranking.tournament(many, judge).collect()
    assert len({frozenset(g) for g in games}) == len(games) > 60 and sorted(r["rank"] for r in found) == list(range(1, 22))
    assert ranking.tournament(many.where("false"), judge).count() == 0


def test_levels(spark):  # noqa: ANN001
    tasks = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "zz")], "task string, needs string")
    assert {r["id"]: r["level"] for r in ranking.levels(tasks, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    with pytest.raises(ValueError, match="cycle"):
        ranking.levels(tasks, spark.createDataFrame([("a", "b"), ("b", "a")], "task string, needs string"))


def test_records(spark):  # noqa: ANN001
    old = spark.createDataFrame([("1", "x", "m"), ("2", "y", "m")], "id string, content string, meta string")
    new = spark.createDataFrame([("2", None, None), ("3", "z", "n")], "id string, content string, meta string")
    patched = {r["id"]: (r["content"], r["meta"]) for r in records.patch(old, new, "id", ["meta"]).collect()}
    assert patched == {"1": ("x", "m"), "2": ("y", None), "3": ("z", "n")}
    assert sorted(r["id"] for r in records.delete_content(old, new.where("id = '3'").withColumn("content", F.lit("x"))).collect()) == ["2"]
    assert records.cleared(old).count() == 0
    assert records.update_existing(old, new, ["id"]).orderBy("id").collect() == old.orderBy("id").collect()
    assert records.update_existing(old, new.where("id = '2'"), ["id"]).where("id = '2'").first()["content"] is None
    assert records.canonical_id({"b": 1, "a": "k"}, dedupe_key="a") == "k"
    assert records.canonical_id({"b": 1, "a": [2]}, dedupe_key="a") == '{"a": [2], "b": 1}'


def test_density_and_index(spark, small, tmp_path):  # noqa: ANN001
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [0.3, 0.0])], "vec_id long, embedding array<float>")
    q, c = pts.where("vec_id = 0"), pts.where("vec_id > 0")
    for kind, want in (("average", 1 / 0.15), ("radius", 2 / 0.2)):
        got = vs.density(q, c, k=2, kind=kind, metric="euclidean").first()["density"]
        assert got == pytest.approx(want, rel=1e-5)
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in vs.neighbours(asked, e, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vs.CellIndex(e).write(str(tmp_path / "index")).search(asked, 10, block_rows=5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_missing_vectors(spark):  # noqa: ANN001
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {r["query_id"]: r["density"] is None for r in vs.density(df, df, 2).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False}
    assert {r["query_id"]: r["id"] for r in vs.least_distance(df, df).collect()} == {0: 3, 1: None, 2: 0, 3: 0, 4: 2}
    assert sorted(map(tuple, vs.similar_counts(df, 0.9).collect())) == [(0, 0, 2), (1, 1, 0), (2, 2, 2), (3, 0, 2), (4, 4, 0)]
    assert vs.CellIndex(df, 2, 2).search(df, 1).count() == 4
    nothing = df.where("false")
    assert vs.similar_counts(nothing, 0.9).count() == 0 and vs.CellIndex(nothing).search(df, 1).count() == 0


def test_collections(spark, tmp_path):  # noqa: ANN001
    store = Collections(spark, str(tmp_path))
    store.create(CollectionSpec("my papers", "vector", {"v": 2}))
    with pytest.raises(ValueError, match="dimensions"):
        store.create(CollectionSpec("my papers", "vector", {"v": 3}))
    assert store.create(CollectionSpec("my papers", "vector", {"w": 4})).vector_dims == {"v": 2, "w": 4}
    schema = "id string, attributes string, content string, vector array<float>, ts timestamp_ntz, seq int"
    rows = [("1", '{"k": "a"}', "old", [1.0, 0.0], None, 1), ("1", '{"k": "a"}', "new", [1.0, 0.0], None, 2), ("2", '{"k": "b"}', "b", [0.0, 1.0], None, 1)]
    store.upsert("my papers", spark.createDataFrame(rows, schema), ["seq"])
    assert store.count("my papers") == 2
    assert store.query("my papers", Filter({"eq": {"k": "a"}})).first()["content"] == "new"
    assert store.search("my papers", [1.0, 0.1], 1).first()["id"] == "1"
    assert store.delete("my papers", Filter({"eq": {"k": "a"}})) == 1 and not store.exists("my papers", Filter({"eq": {"k": "a"}}))
    points = spark.sql("SELECT 'hr' AS metric, timestamp_ntz'2025-01-01 00:00:00' AS ts, map('bed', '7') AS tags, '{\"v\": 80}' AS fields")
    store.append_points("my papers", points)
    assert store.points("my papers", "hr", Filter({"eq": {"tags.bed": "7"}})).count() == 1
    assert store.points("my papers", "hr", Filter({"range": {"fields.v": [0, 50]}})).count() == 0
    assert store.points("my papers", "hr", Filter({"contains": {"a": 1}})).count() == 1
    assert store.points("my papers", "hr", Filter(order_by=[("ts", "desc")], offset=1)).count() == 0
    assert store.points("no points", "hr").count() == 0
    n = store.count("my papers")
    store.clear("my papers")
    assert store.count("my papers") == 0 and store.rollback("my papers") and store.count("my papers") == n
    assert store.vacuum("my papers", keep=1) >= 1 and store.count("my papers") == n
    assert store.drop("my papers") and store.describe("my papers") is None


def test_file_sources(spark, tmp_path):  # noqa: ANN001
    events = [{"id": str(i), "event_type": t, "sub_type": "s", "event_content": "c"} for i, t in enumerate("AAB")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/p1.json").write_text(json.dumps({"meta_id": "m", "sequence": events}))
    (tmp_path / "p/bad.json").write_text("{nothing")
    got = files.patient_events(spark, str(tmp_path / "p"))
    assert [(r["patient_id"], r["pos"]) for r in got.orderBy("pos").collect()] == [("p1", 0), ("p1", 1), ("p1", 2)]
    assert files.next_batch(got).count() == 2 and files.next_batch(got, 1).count() == 1
    assert files.unreadable_files(spark, str(tmp_path / "p")).count() == 1
    (tmp_path / "r/2025/08/03").mkdir(parents=True)
    (tmp_path / "r/2025/08/03/x.md").write_text("# head\n### My title\nsee https://arxiv.org/abs/2507.18009v2")
    report = files.reports(spark, str(tmp_path / "r")).first()
    assert (report["day"], report["title"], report["author"]) == ("2025-08-03", "My title", "Unknown Author")
    assert files.paper_ids(files.reports(spark, str(tmp_path / "r"))).first()["id"] == "2507.18009"


def test_paged_source(spark, tmp_path):  # noqa: ANN001
    for page, n in ((1, 2), (2, 2), (3, 1)):
        (tmp_path / f"{page}.json").write_text(json.dumps([{"name": f"r{page}{i}", "stargazers_count": 10 * page, "language": "Python"} for i in range(n)]))
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged").option("url", f"file://{tmp_path}/{{page}}.json").option("page_size", 2).option("pages", 3).load()
    repos = files.decoded_repositories(raw)
    assert repos.count() == 5 and files.starred(repos, "Python", 20).count() == 3
    assert repos.first()["topics"] == []


def test_streams(spark, small, tmp_path):  # noqa: ANN001
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("value") / 100)
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "in")
    assert st.run_available(st.event_files(spark, path).groupBy("event_type").count(), "t_counts", "complete").agg(F.sum("count")).first()[0] == e.count()
    windows = st.run_available(st.windowed_counts(st.event_files(spark, path, 10), late="400 days"), "t_windows", "complete")
    assert windows.agg(F.sum("n")).first()[0] == e.count()
    assert st.run_available(st.first_seen(st.event_files(spark, path, 10), late="400 days"), "t_first").count() == e.select("event_id").distinct().count()
    seen = []
    st.status_changes(st.event_files(spark, path, 10), lambda df, _: seen.extend(df.collect()), "event_type").awaitTermination()
    assert sum(r["n"] for r in seen) == e.count()
    batch = ev.hysteresis(e, ["user_id"], ["ts", "event_id"], "value")
    ons = st.run_available(st.alerts(st.event_files(spark, path, 10)), "t_alerts").where("active").groupBy("user_id").count()
    assert ons.agg(F.sum("count")).first()[0] == batch.agg(F.sum("entries")).first()[0]


def test_neighbours_blocks(spark):  # noqa: ANN001
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vs.neighbours(df, df, 3, block_rows=7).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - n @ n.T
    np.fill_diagonal(d, np.inf)
    assert all(got[(i, k + 1)] == j for i in range(50) for k, j in enumerate(np.argsort(d[i])[:3]))
