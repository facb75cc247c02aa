"""Blocked neighbours against brute force, and how far their shuffle grows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lodestone.operators import vector_search as vs


@pytest.fixture(scope="module")
def odd(spark):  # noqa: ANN001, ANN201
    """Vectors with many copies, near copies, a zero vector, null vectors, null groups and a group without any vector."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[100:300] = x[100]
    x[300:340] = x[300] + rng.normal(scale=1e-6, size=(40, 6)).astype(np.float32)
    x[5] = 0
    rows = [(i, None if i % 97 == 3 or i % 11 == 7 else v.tolist(), None if i % 50 == 1 else i % 11) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows: list, allowed, k: int) -> dict:  # noqa: ANN001
    known = [(i, np.array(v, float), g) for i, v, g in rows if v is not None]
    unit = np.array([v / max(np.linalg.norm(v), vs.EPS) for _, v, _ in known])
    d = 1 - np.clip(unit @ unit.T, -1, 1)
    out = {}
    for a, (i, _, g) in enumerate(known):
        near = sorted(d[a, b] for b, (j, _, h) in enumerate(known) if i != j and allowed(g, h))
        out[i] = near[:k]
    return out


def distances(found) -> dict:  # noqa: ANN001
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["distance"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_strips_find_what_brute_force_finds(spark, odd, metric):  # noqa: ANN001
    rows, df = odd
    got = vs.neighbours(df, df, 5, metric, block_rows=200)
    if metric == "cosine":
        want = brute(rows, lambda g, h: True, 5)
    else:
        known = [(i, np.array(v, float)) for i, v, _ in rows if v is not None]
        want = {i: sorted(np.linalg.norm(v - w) for j, w in known if i != j)[:5] for i, v in known}
    found = distances(got)
    assert set(found) == set(want)
    assert all(np.allclose(found[i], want[i], atol=1e-9) for i in want)


def test_earlier_groups_only(spark, odd):  # noqa: ANN001
    rows, df = odd
    want = {i: d for i, d in brute(rows, lambda g, h: g is not None and h is not None and h < g, 5).items() if d}
    found = distances(vs.neighbours(df, df, 5, before="label", block_rows=200))
    assert set(found) == set(want)
    assert all(np.allclose(found[i], want[i], atol=1e-9) for i in want)


def test_copies_of_one_row_in_the_shuffle_are_bounded():
    """F3, F4, F6, F8: a row was copied once for each 2000 rows of the other side."""
    assert [vs.block_count(n, vs.BLOCK_ROWS) for n in (0, 500, 10_000, 100_000, 600_000)] == [1, 1, 5, 12, 12]
    assert vs.block_count(2_000_000, vs.BLOCK_ROWS) == -(-2_000_000 // vs.LARGEST_BLOCK)


def test_links_at_the_threshold(spark):  # noqa: ANN001
    """F8: pairs that single precision can't tell from the threshold are judged in doubles."""
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(np.arccos(0.3) * np.arange(4) + np.array([0, 1e-9, -1e-9, 3e-9]))] + [(9, [1.0, 0.0]), (10, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in vs.similar_counts(df, 0.3).collect()}
    known = [(i, np.array(v)) for i, v in rows if v]
    unit = {i: v / np.linalg.norm(v) for i, v in known}
    assert got == {i: 0 if v is None else sum(i != j and ((unit[i] == unit[j]).all() or unit[i] @ unit[j] >= 0.3) for j in unit) for i, v in rows}


def test_forward_density_of_all_groups_in_one_pass(spark, odd):  # noqa: ANN001
    """groups of any type that sorts, and one comparison of blocks instead of one for each group."""
    rows, df = odd
    got = {r["name"]: r["forward"] for r in vs.forward_density(df.withColumn("name", F.date_add(F.lit("2024-01-01").cast("date"), F.col("label"))).drop("label"), "name", 5, eps=1e-3).collect()}
    want = {}
    for g in range(11):
        near = brute(rows, lambda a, b, g=g: a is not None and a < g and b == g, 5)
        found = [1 / (1e-3 + np.mean(d)) for d in near.values() if d]
        bare = sum(v is None and h is not None and h < g for _, v, h in rows)
        want[g] = sum(found) / (len(found) + bare) if found else 0.0
    assert len(got) == 11
    assert all(np.isclose(x, want[day.timetuple().tm_yday - 1], rtol=1e-6) for day, x in got.items())
    plan = vs.forward_density(df, "label", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_each_meeting_is_a_task(spark):  # noqa: ANN001
    """F4, F6, F8, F11: meetings were dealt by hash and then put together, so that a few tasks had most of them."""
    df = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [TaskContext.get().partitionId()], "pairs": [len(q) * len(c)]})

    met = vs.meet_blocks(df, df.where("vec_id < 600"), "embedding", "vec_id", [], 200, meet, "task int, pairs long", in_strips=True).collect()
    assert len(met) == len({r["task"] for r in met}) == 15
    assert sum(r["pairs"] for r in met) == 1000 * 600


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_strips_and_tiles_of_a_large_block(metric):  # noqa: ANN001
    """queries of several strips, a block of several tiles, rows that don't count and pairs left out."""
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(600, 7)), rng.normal(size=(2500, 7))
    c[200:900] = c[200]
    q[:50] = c[:50]
    if metric == "cosine":
        q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
    ids, upto, same = rng.permutation(2500), np.sort(rng.integers(0, 2501, 600)), np.column_stack([np.arange(600)] * 2)
    same = same[same[:, 1] < upto]
    rows, columns, found = vs._nearest(q, c, ids, upto, same, 5, metric)
    left_out = set(map(tuple, same.tolist()))
    for i in range(600):
        j = np.array([j for j in range(upto[i]) if (i, j) not in left_out], int)
        d = 1 - np.clip(np.einsum("j,ij->i", q[i], c[j]), -1, 1) if metric == "cosine" else np.sqrt(((q[i] - c[j]) ** 2).sum(1))
        assert np.allclose(found[rows == i], np.sort(d)[:5], atol=1e-12)
        assert len(set(columns[rows == i])) == min(5, len(j))


@pytest.mark.parametrize("above", [False, True])
def test_blocks_of_ranges(spark, above):  # noqa: ANN001
    """all blocks met, also those without a pair that counts, and every block told of every group."""
    rng = np.random.default_rng(7)
    g = [*rng.choice([1.0, 2.0, 3.0, 4.0], 150).tolist(), *[2.0] * 350, *rng.normal(size=100).tolist(), float("-inf"), float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, [float(i)], x) for i, x in enumerate(g)], "vec_id long, embedding array<float>, g double")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        a, b = q.g.to_numpy()[:, None], c.g.to_numpy()[None]
        i, j = np.nonzero(a < b if above else a > b)
        return pd.DataFrame({"q": q.id.to_numpy()[i], "c": c.id.to_numpy()[j], "task": TaskContext.get().partitionId(), "rows": max(len(q), len(c))})

    for left, right in ((df, df), (df.where("vec_id % 5 = 0"), df), (df, df.where("vec_id % 7 = 0")), (df, df.where("false")), (df.where("false"), df)):
        met = vs.meet_blocks(left, right, "embedding", "vec_id", [("g", F.col("g"))], 100, meet, "q long, c long, task int, rows long", in_strips=True, by="g", above=above).toPandas()
        kept = [{r["vec_id"] for r in side.collect() if r["g"] is not None and r["g"] == r["g"]} for side in (left, right)]
        want = {(a, b) for a in kept[0] for b in kept[1] if (g[a] < g[b] if above else g[a] > g[b])}
        assert len(met) == len(want) and set(zip(met.q, met.c, strict=True)) == want
        assert not len(met) or met.rows.max() <= 150

    def tasks(**options: object) -> int:
        told = lambda q, c: pd.DataFrame({"n": [len(q) * len(c)]})
        return vs.meet_blocks(df, df, "embedding", "vec_id", [("g", F.col("g"))], 100, told, "n long", in_strips=True, **options).where("n > 0").count()

    assert tasks(by="g", above=above) < 0.7 * tasks()


def test_a_group_is_told_by_few_blocks(spark, monkeypatch):  # noqa: ANN001
    """each of 12 blocks told the k nearest of every later group, where one block has them all."""
    rng = np.random.default_rng(9)
    rows = [(i, x.tolist(), i % 10) for i, x in enumerate(rng.normal(size=(2400, 4)).astype(np.float32))]
    df, found = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), []

    def kept(*args: object, **options: object):  # noqa: ANN202
        found.append(dealt(*args, **options))
        return found[-1]

    dealt = vs.meet_blocks
    monkeypatch.setattr(vs, "meet_blocks", kept)
    near = vs.neighbours(df, df, 5, per="label", block_rows=200)
    later = sum(9 - g for _, _, g in rows)
    assert near.count() == later * 5 == found[0].count()
