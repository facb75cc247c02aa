"""Merging by similarity: every row joins the most similar earlier leader, or becomes one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranks import placed
from lodestone.operators.vector_search import meet_blocks, neighbours, unit_rows
from lodestone.sources.shared import written

#: Rows that are settled together at first; twice as many follow where few of them are linked.
SETTLED = 2048
FEW_LINKS = 8


def _linked(later: DataFrame, earlier: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(a, b): places of rows of ``later`` and of rows of ``earlier`` ahead of them whose cosine is above the threshold."""

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"a": [], "b": []})
        a, b = q.id.to_numpy(), c.id.to_numpy()
        i, j = np.nonzero((np.clip(unit_rows(q.v) @ unit_rows(c.v).T, -1, 1) > threshold) & (b[None] < a[:, None]))
        return pd.DataFrame({"a": a[i], "b": b[j]})

    return meet_blocks(later, earlier, "v", "pos", [], block_rows, meet, "a long, b long")


def _covered(rows: DataFrame, leaders: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(a): places of rows that a leader ahead of them covers; a block tells each once."""

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"a": []})
        a, b = q.id.to_numpy(), c.id.to_numpy()
        hit = ((np.clip(unit_rows(q.v) @ unit_rows(c.v).T, -1, 1) > threshold) & (b[None] < a[:, None])).any(1)
        return pd.DataFrame({"a": a[hit]})

    return meet_blocks(rows, leaders, "v", "pos", [], block_rows, meet, "a long").distinct()


def _first_free(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows that lead: from the front, each that no leader ahead of it is linked to.

    In a round all rows without an undecided row ahead lead, and rows linked to
    them are decided; every round shortens all chains of links.
    """
    undecided, leaders = rows.select("pos"), rows.select("pos").where(F.lit(False))
    while True:
        leading = written(undecided.join(links.select(F.col("a").alias("pos")).distinct(), "pos", "left_anti"))
        leaders = leaders.unionByName(leading)
        if links.isEmpty():
            return rows.join(leaders, "pos")
        members = written(links.join(leading.select(F.col("pos").alias("b")), "b").select(F.col("a").alias("pos")).distinct())
        undecided = written(undecided.join(leading, "pos", "left_anti").join(members, "pos", "left_anti"))
        open_ = links.join(members.select(F.col("pos").alias("a")), "a", "left_anti").join(members.select(F.col("pos").alias("b")), "b", "left_anti")
        links = written(open_)


def lead(df: DataFrame, threshold: float = 0.7, vector: str = "embedding", id_col: str = "vec_id", order: list[Column] | None = None, settled: int = SETTLED, block_rows: int = 2000) -> DataFrame:
    """(id, leader, similarity) of every row, in the order of arrival (``order``, then the id).

    A row joins the earlier leader with the largest cosine above the threshold,
    of equal ones the earliest; without one it leads itself, with similarity 1.
    A row without a vector leads itself too, with a null similarity.

    The rows that nothing covers yet are settled from the front, a bounded
    number at a time, and what their leaders cover drops out; so no more than
    that number of rows is ever compared pair by pair, and rows meet leaders
    only, in blocks.
    """
    given = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *((c.alias(f"o{i}_") for i, c in enumerate(order or []))))
    rows = written(placed(given.where("v is not null"), [*(F.col(f"o{i}_") for i in range(len(order or []))), F.col("id"), F.xxhash64("v")]).select("id", "v", "pos"))
    left, leaders, n = rows, rows.where(F.lit(False)), settled
    while not left.isEmpty():
        last = left.select("pos").orderBy("pos").limit(n).agg(F.max("pos")).first()[0]
        front = written(left.where(F.col("pos") <= last))
        links = written(_linked(front, front, threshold, block_rows))
        new = written(_first_free(front, links))
        leaders = written(leaders.unionByName(new.select(*leaders.columns)))
        if links.count() <= FEW_LINKS * front.count():
            n *= 2
        rest = left.where(F.col("pos") > last)
        left = written(rest.join(_covered(rest, new, threshold, block_rows).select(F.col("a").alias("pos")), "pos", "left_anti"))
    members = rows.join(leaders.select("pos"), "pos", "left_anti")
    joined = neighbours(members, leaders, 1, vector="v", id_col="pos", before="pos", block_rows=block_rows)
    names = leaders.select(F.col("pos").alias("id"), F.col("id").alias("leader"))
    found = joined.join(names, "id").select(F.col("query_id").alias("pos"), "leader", (1 - F.col("distance")).alias("similarity"))
    told = rows.join(found, "pos", "left").select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    without = given.where("v is null").select("id", F.col("id").alias("leader"), F.lit(None).cast("double").alias("similarity"))
    return told.unionByName(without)


def merged(rows: DataFrame, found: DataFrame, id_col: str, lists: list[str]) -> DataFrame:
    """One row for each leader: its own columns, but in ``lists`` all distinct values of its group, sorted, and how many rows it took in."""
    group = found.select(F.col("id").alias(id_col), "leader")
    together = rows.join(group, id_col).groupBy("leader").agg(*(F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists), (F.count("*") - 1).alias("n_merged"))
    own = rows.drop(*lists).join(found.where(F.col("id") == F.col("leader")).select(F.col("id").alias(id_col)), id_col, "left_semi")
    return own.join(together.withColumnRenamed("leader", id_col), id_col)
