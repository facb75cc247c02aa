"""Chats, daily states, relations between events, and how well scores predict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranks import running

ENDS = {"complete": "completed", "fail": "failed"}


def chat_states(log: DataFrame, by: str = "trace_id", kind: str = "kind", at: str = "at", order: str = "seq") -> DataFrame:
    """(by, status, started_at, ended_at, duration_ms) of a log of start, complete and fail rows; the last one counts.

    A chat without an end is pending. One without a start has no duration.
    """
    started = F.max(F.when(F.col(kind) == "start", F.col(at))).alias("started_at")
    ended = F.max(F.when(F.col(kind).isin(*ENDS), F.struct(at, order, kind)))
    rows = log.groupBy(by).agg(started, ended.alias("end_"))
    status = F.when(F.col(f"end_.{kind}") == "complete", ENDS["complete"]).when(F.col(f"end_.{kind}") == "fail", ENDS["fail"]).otherwise("pending")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    spent = F.floor((micros(F.col(f"end_.{at}")) - micros(F.col("started_at"))) / 1000)
    return rows.select(by, status.alias("status"), "started_at", F.col(f"end_.{at}").alias("ended_at"), spent.alias("duration_ms"))


def guarded_states(changes: DataFrame, by: str, state: str, order: list[str], final: str = "completed") -> DataFrame:
    """(by, state): the last state of each key, but once it is final it stays so."""
    reached = F.max(F.col(state) == final)
    return changes.groupBy(by).agg(F.when(reached, F.lit(final)).otherwise(F.max(F.struct(*order, state)).getField(state)).alias(state))


def related(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all that edges (a, b), read both ways, reach from seeds (id) in at most ``depth`` steps; seeds have 0."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = seeds.select("id", F.lit(0).alias("distance")).distinct()
    edge = found
    for step in range(1, depth + 1):
        edge = edge.join(both, edge.id == both.a).select(F.col("b").alias("id")).distinct().join(found.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"))
        found = found.unionByName(edge)
    return found


def balance(events: DataFrame, by: list[str], ts: str, amount: str, is_in: Column, is_out: Column, unit: str = "day") -> DataFrame:
    """(by, bucket, taken, given, balance): what went in and out in each unit of time."""
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")
    part = lambda use: F.sum(F.when(use, F.col(amount)).otherwise(F.lit(0.0)))
    rows = events.groupBy(*by, bucket).agg(part(is_in).alias("taken"), part(is_out).alias("given"))
    return rows.withColumn("balance", F.col("taken") - F.col("given"))


def score_metrics(rows: DataFrame, score: str, truth: str, cut: float = 0.5) -> DataFrame:
    """One row (n, brier, recall, precision, auroc, average_precision) of scores from 0 to 1 against a truth of 0 or 1.

    Rows of one score are counted together before they are moved; the curves
    come from running sums over the distinct scores, range by range.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(truth).cast("double").alias("y"))
    groups = known.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    curve = running(groups, [F.desc("s")], ["pos", "neg"])
    over = lambda c: F.sum(F.when(F.col("s") >= cut, F.col(c)).otherwise(0.0))
    return curve.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).cast("long").alias("n"),
        F.try_divide(F.sum(F.col("pos") * (1 - F.col("s")) ** 2 + F.col("neg") * F.col("s") ** 2), F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
        F.try_divide(over("pos"), F.sum("pos")).alias("recall"),
        F.try_divide(over("pos"), over("pos") + over("neg")).alias("precision"),
        F.try_divide(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), F.sum("pos")).alias("average_precision"),
    )


def recall_at(rows: DataFrame, score: str, truth: str, tie: str, ks: list[int]) -> DataFrame:
    """(k, recall): which share of the true rows is among the k with the highest scores, ties by ``tie``; null without a true row."""
    known = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(truth).cast("double").alias("y"), F.col(tie).alias("tie"))
    best = known.orderBy(F.desc("s"), "tie").limit(max(ks)).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("s"), "tie")))
    found = best.agg(*(F.sum(F.when(F.col("pos") <= k, F.col("y"))).alias(f"k{k}") for k in ks))
    told = found.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks))).alias("x")).select("x.*")
    return told.join(F.broadcast(known.agg(F.sum("y").alias("all"))), F.lit(True)).select("k", F.try_divide("hits", "all").alias("recall"))


def lead_times(alerts: DataFrame, onsets: DataFrame, key: str, at: str, onset: str, within_seconds: int) -> DataFrame:
    """(key, onset, lead_seconds): how long ahead of each onset its key's first alert within the reach came; null without one."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    a = alerts.select(F.col(key).alias("key_"), micros(F.col(at)).alias("at_"))
    ahead = (F.col("onset_") - F.col("at_")) / 1_000_000
    met = onsets.withColumn("onset_", micros(F.col(onset))).join(a, (F.col(key) == F.col("key_")) & ahead.between(0, within_seconds), "left")
    return met.groupBy(key, onset).agg(F.max(ahead).alias("lead_seconds"))


def steps(groups: DataFrame, column: str) -> DataFrame:
    """(column, next, done) of the distinct values in order: the one that follows, and whether it is the last. Meant for months or days, which are few."""
    w = Window.orderBy(column)
    return groups.select(column).distinct().withColumns({"next": F.lead(column).over(w), "done": F.lead(column).over(w).isNull()})
