"""Results of days: one JSON document for each day, its state, runs, and session files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_results(parts: dict[str, DataFrame], day: str, totals: dict[str, tuple[str, str]], version: str = "1.0") -> DataFrame:
    """(day, result): for each day one JSON document with its metadata and, under each name of ``parts``, that part's rows of the day in their order.

    ``totals`` are numbers for the metadata: name to (part, column), summed up,
    or the rows counted for the column ``*``. A day that only some parts have is
    there, with empty lists for the others.
    """
    days = None
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c != day]
        wanted = [(n, c) for n, (p, c) in totals.items() if p == name]
        sums = [(F.count("*") if c == "*" else F.sum(c)).alias(n) for n, c in wanted]
        one = rows.groupBy(F.col(day)).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name), *sums)
        days = one if days is None else days.join(one, day, "full")
    lists = [F.coalesce(F.col(n), F.expr("array()").cast(days.schema[n].dataType)).alias(n) for n in parts]
    meta = F.struct(F.col(day).cast("string").alias("date"), F.lit(version).alias("version"), *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in totals))
    return days.select(F.col(day).alias("day"), F.to_json(F.struct(meta.alias("metadata"), *lists)).alias("result"))


def save_days(results: DataFrame, path: str) -> None:
    """Write days into folders of their year, month and day, each replacing what was there for it and no other."""
    d = F.col("day").cast("date")
    rows = results.withColumns({"year": F.year(d), "month": F.month(d), "day_": F.dayofmonth(d)}).drop("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day_").text(path)


def saved_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, result) of all saved days; a day's filter reaches the folders."""
    rows = spark.read.option("wholetext", True).schema("value string, year int, month int, day_ int").text(path)
    return rows.select(F.make_date("year", "month", "day_").alias("day"), F.rtrim("value").alias("result"), "year", "month", "day_")


def day_of(saved: DataFrame, day: str) -> DataFrame:
    """(day, result) of one day, at most one row; only its folder is read."""
    y, m, d = (int(x) for x in day.split("-"))
    return saved.where((F.col("year") == y) & (F.col("month") == m) & (F.col("day_") == d)).select("day", "result")


def completed(saved: DataFrame, day: str) -> bool:
    return not day_of(saved, day).isEmpty()


def sync_stats(runs: DataFrame, day: str, *sums: str) -> DataFrame:
    """One row: how many runs there were, the sum of each number, and the first and last day; zeros and nulls without runs."""
    return runs.agg(F.count("*").alias("runs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def old_files(spark: SparkSession, path: str, older_than: Column, pattern: str = "*.json") -> DataFrame:
    """(file, modified) of files last changed before a time: what a clean-up of sessions would delete."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified")).where(F.col("modified") < older_than)


def agent_cards(spark: SparkSession, paths: list[str], excluded: list[str]) -> DataFrame:
    """Cards from the first of the paths that has any, without the excluded names; an empty list of paths raises."""
    for path in paths:
        try:
            cards = spark.read.option("multiLine", True).json(path)
        except Exception as error:  # noqa: BLE001 - a path that isn't there, in the reader's own kind
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        if "name" in cards.columns and not cards.isEmpty():
            return cards.where(~F.coalesce(F.col("name").isin(excluded), F.lit(False)))
    raise FileNotFoundError(f"no cards in {paths}")
