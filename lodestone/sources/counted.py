"""Writes that count while they write, and tables whose failed rows are set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions.clinical import cleaned, second_cleaned
from lodestone.sources.shared import written
from lodestone.sources.sharded import ShardedTable


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], partition_by: list[str] | None = None, format: str = "parquet") -> dict[str, int]:  # noqa: A002
    """Write rows and say how many there are (``rows``) and how many each condition of ``counts`` holds for, from the pass that writes them.

    A condition that is null doesn't hold. Files are what a reader should trust:
    Spark counts a task again that it ran again after its executor was lost.
    """
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
    (watched.write.partitionBy(*partition_by) if partition_by else watched.write).format(format).save(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def clean_counted(events: DataFrame, path: str, second: bool = False, sub_type: str = "sub_type", content: str = "content") -> dict[str, int]:
    """Write events with their texts cleaned; how many there were and how many changed."""
    clean = (second_cleaned if second else cleaned)(F.col(sub_type), F.col(content))
    changed = ~F.col(content).eqNullSafe(F.col("clean_"))
    rows = events.withColumn("clean_", clean).withColumn("changed", changed).withColumn(content, F.col("clean_")).drop("clean_")
    return write_counted(rows, path, {"changed": F.col("changed")})


def split_failed(df: DataFrame, failed: Column, path: str, id_col: str, counts: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(ok rows, failed ids, counts): one write into two folders, ``failed`` or not, so that the rows are made once."""
    rows = df.withColumn("failed_", F.coalesce(failed, F.lit(True)))
    told = write_counted(rows, path, {"failed": F.col("failed_")} | (counts or {}), ["failed_"])
    back = df.sparkSession.read.schema(rows.schema).parquet(path)
    return back.where(~F.col("failed_")).drop("failed_"), back.where("failed_").select(id_col), told


def embed_many(df: DataFrame, embed: Callable[[Column], Column], text_col: str, id_col: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows with a vector of their text, the ids of those without, and counts; a blank text fails, and so does a null or empty vector.

    ``embed`` turns a text column into a vector column: an expression or a pandas UDF.
    """
    blank = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    rows = df.withColumn("vector", F.when(~blank, embed(F.col(text_col))))
    return split_failed(rows, F.col("vector").isNull() | (F.size("vector") == 0), path, id_col)


def with_cached_vectors(df: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], text_col: str, id_col: str) -> DataFrame:
    """Rows with the cache's vector of their id, and with a new one where it has none; ``from_cache`` tells which."""
    known = cache.select(F.col(id_col).alias("cached_id"), F.col("vector").alias("cached_"))
    joined = df.join(known, F.col(id_col) == F.col("cached_id"), "left")
    vector = F.when(F.col("cached_").isNotNull(), F.col("cached_")).otherwise(embed(F.col(text_col)))
    return joined.withColumn("vector", vector).withColumn("from_cache", F.col("cached_").isNotNull()).drop("cached_", "cached_id")


def backfill(table: ShardedTable, embed: Callable[[Column], Column], text_col: str = "content", all_or_nothing: bool = True) -> dict[str, int]:
    """Give the rows of a table that have none a vector; with ``all_or_nothing`` only if every text that isn't blank gets one.

    Only shards with such rows are rewritten.
    """
    missing = table.read().where(F.col("vector").isNull() | (F.size("vector") == 0))
    blank = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    made = written(missing.withColumn("vector", F.when(~blank, embed(F.col(text_col)))).withColumn("blank_", blank))
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
    told = made.agg(F.count("*").alias("missing"), F.count_if(ok).alias("embedded"), F.count_if("blank_").alias("blank")).first().asDict()
    if told["embedded"] and not (all_or_nothing and told["embedded"] + told["blank"] < told["missing"]):
        table.update(made.where(ok).drop("blank_"), [table.key])
        return told
    return told | {"embedded": 0}
