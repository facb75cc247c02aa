"""States of plans and sessions: guarded changes of tasks, contexts as text, kinds of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an error or a reason says when the day's data isn't there yet.
NOT_YET = ["no papers found", "no papers with valid vectors", "no papers selected", "database not updated", "no data available"]


def task_states(tasks: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """(id, status) of tasks (id) after a log (id, change, order...) of changes start, complete and fail.

    Only a pending task starts, only a started one completes, any task fails,
    for good. What isn't allowed changes nothing, and unknown ids don't count.
    The log is reduced to three values for a task before it is moved.
    """
    at = F.struct(*order)
    when = lambda kind, f: f(F.when(F.col("change") == kind, at))
    found = log.groupBy("id").agg(when("start", F.min).alias("started"), when("complete", F.max).alias("ended"), when("fail", F.max).alias("failed"))
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("ended") > F.col("started"), "completed").when(F.col("started").isNotNull(), "in_progress").otherwise("pending")
    return tasks.select("id").distinct().join(found, "id", "left").select("id", status.alias("status"))


def context_text(summaries: DataFrame, by: str, task: str, summary: str, order: list[str]) -> DataFrame:
    """(by, context): a plan's summaries in order, a paragraph for each."""
    line = F.concat(F.lit("Task "), F.col(task).cast("string"), F.lit(": "), F.col(summary))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line_")))), lambda x: x["line_"])
    return summaries.groupBy(by).agg(F.array_join(lines, "\n\n").alias("context"))


def session_contexts(turns: DataFrame, by: str, order: str, role: str, text: str, tokens: Column, threshold: int) -> DataFrame:
    """(by, context, pairs, total_tokens, should_summarize): a session's questions and answers as text, and whether they are to be summed up."""
    speaker = F.when(F.col(role) == "user", "User: ").otherwise("Assistant: ")
    told = turns.where(F.col(role).isin("user", "assistant"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(speaker, F.coalesce(F.col(text), F.lit(""))).alias("line"))))
    found = told.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"), F.count_if(F.col(role) == "assistant").alias("pairs"), F.sum(tokens).alias("total_tokens"))
    return found.withColumn("should_summarize", F.col("total_tokens") >= threshold)


def retry_class(error: Column, reason: Column) -> Column:
    """``wait`` where the error or the reason says that the data isn't there yet, else ``retry``."""
    said = F.lower(F.concat_ws("\n", error, reason))
    hit = F.lit(False)
    for words in NOT_YET:
        hit = hit | F.contains(said, F.lit(words))
    return F.when(hit, "wait").otherwise("retry")


def progress(states: DataFrame, by: str | None = None) -> DataFrame:
    """(by, total, pending, in_progress, completed, failed, percent) of task states."""
    names = ["pending", "in_progress", "completed", "failed"]
    grouped = states.groupBy(by) if by else states.groupBy()
    counted = grouped.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names))
    return counted.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("completed"), F.col("total")), F.lit(0.0)))
