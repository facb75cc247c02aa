"""Papers and reports: days and categories, validity, records and rows, capabilities and their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_day(rows: DataFrame, day: Column, ts: str, categories: Sequence[str] = (), column: str = "categories") -> DataFrame:
    """Rows of one day that have any of the categories; no category means all.

    The day is a half-open range of the time itself, so it reaches the scan as a filter.
    """
    start = day.cast("timestamp_ntz")
    found = rows.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))
    return found.where(F.arrays_overlap(column, F.array(*map(F.lit, categories)))) if categories else found


def reported(rows: DataFrame, first: Column, stop: Column, day: str = "day", source: str = "report_source", text: str = "report", wanted: str = "daily") -> DataFrame:
    """Rows with a report of the wanted source that isn't empty, from ``first`` until before ``stop``."""
    filled = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    return rows.where((F.col(source) == wanted) & filled & (F.col(day) >= first) & (F.col(day) < stop))


def closed_range(rows: DataFrame, first: str, last: str, day: str) -> DataFrame:
    """Rows from the first to the last day, both included; none where the first is after the last. Another format than yyyy-MM-dd raises."""
    bounds = [F.to_date(F.lit(x), "yyyy-MM-dd") for x in (first, last)]
    return rows.where(F.col(day).between(*bounds))


def valid_rows(rows: DataFrame, texts: Sequence[str], vector: str | None = None) -> DataFrame:
    """Rows whose texts aren't blank and whose vector, if one is named, has a member."""
    keep = F.lit(True)
    for c in texts:
        keep = keep & (F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0)
    return rows.where(keep & (F.coalesce(F.size(vector), F.lit(0)) > 0) if vector else keep)


def publication_year(published: Column, submitted: Column) -> Column:
    return F.year(F.coalesce(published, submitted))


def primary_category(categories: Column) -> Column:
    """The first category, null without one."""
    return F.try_element_at(categories, F.lit(1))


def to_record(rows: DataFrame, id_col: str, content: str, ts: str) -> DataFrame:
    """Rows as records: id, content and ts by name, all other columns as JSON attributes without nulls."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (id_col, content, ts)]
    return rows.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(*rest)).alias("attributes"), F.col(content).alias("content"), F.col(ts).cast("timestamp_ntz").alias("ts"))


def from_record(records: DataFrame, schema: str) -> DataFrame:
    """Records as rows: the id without its version, and the attributes by their schema."""
    return records.select(F.split_part("id", F.lit("v"), F.lit(1)).alias("id"), "content", "ts", F.from_json("attributes", schema).alias("a")).select("id", "content", "ts", "a.*")


def agents_of(capabilities: DataFrame) -> DataFrame:
    """(capability, name, url) of capabilities (capability, agents)."""
    return capabilities.select("capability", F.explode("agents").alias("a")).select("capability", "a.name", "a.url")


def work_list(capabilities: DataFrame) -> DataFrame:
    """(capability, name, task): each task of a capability (capability, agents, tasks) for each of its agents."""
    return capabilities.select("capability", F.explode("agents").alias("a"), "tasks").select("capability", F.col("a.name").alias("name"), F.explode("tasks").alias("task"))


def merged_capabilities(raw: DataFrame) -> DataFrame:
    """One row for each capability of rows (capability, agent): its distinct agents in order."""
    return raw.groupBy("capability").agg(F.sort_array(F.collect_set("agent")).alias("agents"))


def capabilities_of(capabilities: DataFrame) -> DataFrame:
    """(name, capabilities): each agent's distinct capabilities, in order."""
    return agents_of(capabilities).groupBy("name").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def shared_capabilities(capabilities: DataFrame, least: int = 2) -> DataFrame:
    """Capabilities of at least so many agents, which tasks are made for."""
    return capabilities.where(F.size("agents") >= least)


def task_results(log: DataFrame, known: DataFrame) -> DataFrame:
    """(capability, name, total, success) of results (capability, name, task, ok, at, deleted) of known agents.

    A row with ``deleted`` takes back one result of the same task, outcome and
    time, if there is one; no count falls below zero.
    """
    valid = log.join(known.select("capability", "name").distinct(), ["capability", "name"], "left_semi")
    same = valid.groupBy("capability", "name", "task", "ok", "at").agg((F.count_if(~F.col("deleted")) - F.count_if("deleted")).alias("left"))
    left = F.greatest(F.col("left"), F.lit(0))
    counted = same.groupBy("capability", "name").agg(F.sum(left).alias("total"), F.sum(F.when(F.col("ok"), left).otherwise(0)).alias("success"))
    return counted.where("total > 0")


def responses(papers: DataFrame, id_col: str = "id", title: str = "title", report: str = "report", **columns: str) -> DataFrame:
    """(paper_id, content_id, title, report, ...): what a paper service answers, ids as SHA-256, underscores in titles as spaces, nulls as empty texts and lists."""
    empty = {c: F.expr("array()").cast(papers.schema[c].dataType) if papers.schema[c].dataType.typeName() == "array" else F.lit("") for c in columns.values()}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rest = [F.coalesce(F.col(c), empty[c]).alias(n) for n, c in columns.items()]
    return papers.select(F.sha2(text(id_col), 256).alias("paper_id"), F.sha2(text(report), 256).alias("content_id"), F.replace(text(title), F.lit("_"), F.lit(" ")).alias("title"), text(report).alias("report"), *rest)


def flipped_source(rows: DataFrame, day: Column, first: Column, stop: Column, source: str = "report_source", old: str = "daily", new: str = "agent") -> DataFrame:
    """Rows with ``new`` as the source where it was ``old``, from the first day until before the last; all others as they are."""
    hit = (F.col(source) == old) & (day >= first) & (day < stop)
    return rows.withColumn(source, F.when(hit, new).otherwise(F.col(source)))


def next_best(candidates: DataFrame, failed: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The n best candidates that haven't failed, ties by key."""
    return candidates.join(failed.select(key), key, "left_anti").orderBy(F.desc(score), key).limit(n)
