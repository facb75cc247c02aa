"""Record tables as DataFrames: upserts, deletes, existence, batch lookups, shards."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import shard_of
from lodestone.functions.vectors import as_vector, cosine


def _one(rows: DataFrame, keys: list[str], best: Callable[[Column, Column], Column], sequence: list[Column]) -> DataFrame:
    """One whole row for each key; partial aggregation keeps one candidate of each key before the shuffle."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    picked = rows.groupBy(*(F.col(f"`{k}`").alias(f"key_{i}_") for i, k in enumerate(keys))).agg(best(whole, F.struct(*sequence)).alias("row_"))
    return picked.select("row_.*")


def last_wins(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """One row for each key: the last by the sequence columns, null first."""
    return _one(rows, keys, F.max_by, [F.col(c) for c in sequence])


def first_wins(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """One row for each key: the first by the sequence columns, null first."""
    return _one(rows, keys, F.min_by, [F.col(c) for c in sequence])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Stored rows whose key comes in again are replaced by the last incoming one; new keys are added."""
    new = last_wins(incoming, keys, sequence)
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Only keys that aren't stored are added, the first incoming row of each."""
    new = first_wins(incoming, keys, sequence).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new)


def patch(stored: DataFrame, changes: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """Stored rows with the changes' values where those aren't null; ``replaced`` columns are taken even when null.

    A key that isn't stored is added with what the changes say of it, its other
    columns null. The changes have one row for each key.
    """
    c = changes.select(F.col(key).alias("key_"), *(F.col(x).alias(f"new_{x}") for x in changes.columns if x != key))
    joined = stored.join(c, F.col(key) == F.col("key_"), "full")

    def value(name: str) -> Column:
        if name == key:
            return F.coalesce(key, "key_").alias(key)
        if name not in changes.columns:
            return F.col(name)
        if name in replaced:
            return F.when(F.col("key_").isNotNull(), F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
        return F.coalesce(f"new_{name}", name).alias(name)

    return joined.select(*(value(x) for x in stored.columns))


def update_existing(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """All changes or, if any key isn't stored, none."""
    missing = changes.join(stored.select(*keys), keys, "left_anti").agg((F.count("*") > 0).alias("missing_"))
    usable = changes.join(F.broadcast(missing), F.lit(True), "inner").where("not missing_").drop("missing_")
    return stored.join(usable.select(*keys), keys, "left_anti").unionByName(usable)


def delete_where(stored: DataFrame, predicate: Column) -> DataFrame:
    """Rows that the predicate doesn't match, null included."""
    return stored.where(~F.coalesce(predicate, F.lit(False)))


def delete_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def delete_content(stored: DataFrame, contents: DataFrame, column: str = "content") -> DataFrame:
    """Rows without those whose content is one of ``contents``, the same text; null matches nothing."""
    return stored.join(contents.select(F.col(column).alias("content_")).distinct(), F.col(column) == F.col("content_"), "left_anti")


def delete_nearest(stored: DataFrame, vector: list[float], key: str, column: str = "vector", above: float = 0.9) -> DataFrame:
    """Rows without the one nearest to a vector, if its cosine is above the bound."""
    nearest = stored.where(F.col(column).isNotNull()).select(F.col(key).alias("key_"), cosine(F.col(column), as_vector(vector)).alias("score_")).orderBy(F.desc("score_"), "key_").limit(1)
    return stored.join(F.broadcast(nearest.where(F.col("score_") > above)), F.col(key) == F.col("key_"), "left_anti")


def cleared(stored: DataFrame) -> DataFrame:
    """No row, the same columns."""
    return stored.where(F.lit(False))


def exists_flags(asked: DataFrame, stored: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Every asked row with whether its key is stored."""
    known = stored.select(F.col(key).alias("key_")).distinct()
    return asked.join(known, F.col(key) == F.col("key_"), "left").withColumn(name, F.col("key_").isNotNull()).drop("key_")


def fetch_ranked(hits: DataFrame, stored: DataFrame, hit_key: str, key: str, rank: str) -> DataFrame:
    """Hits with their stored records, in the order of their rank; hits without one are left out."""
    return hits.join(stored, hits[hit_key] == stored[key]).orderBy(rank)


def positional(asked: list, stored: DataFrame, key: str) -> DataFrame:
    """(pos, key, ...) for each asked id in order, with nulls where nothing is stored."""
    spark = stored.sparkSession
    kind = stored.schema[key].dataType.simpleString()
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], f"pos int, {key} {kind}")
    return ids.join(stored, key, "left").orderBy("pos")


def canonical_id(row: dict, explicit: str | None = None, dedupe_key: str | None = None) -> str:
    """The id of a record: its own, or its dedupe key's value, or its attributes as JSON with sorted keys."""
    if explicit:
        return explicit
    value = row.get(dedupe_key) if dedupe_key else None
    if isinstance(value, (str, int)):
        return str(value)
    return json.dumps(row, sort_keys=True, ensure_ascii=False)


def content_id(content: Column, metadata: Column | None = None) -> Column:
    """md5 of the content, or of the content and its metadata text on a new line."""
    return F.md5(content.cast("binary")) if metadata is None else F.md5(F.concat_ws("\n", content, metadata).cast("binary"))


def shard_stats(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, n) by the SHA-256 digest of the key."""
    return rows.groupBy(shard_of(F.col(key).cast("string"), shards).alias("shard")).agg(F.count("*").alias("n"))


def keyset_page(rows: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next ``size`` rows after a key, without an offset."""
    found = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return found.orderBy(key).limit(size)
