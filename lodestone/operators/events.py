"""Ordered events: runs, latest values, proximity, folds and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.operators.records import last_wins


def runs(events: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """(by, run, same, n, first, last): stretches of consecutive events with the same values."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = events.withColumn("new_", F.when(F.row_number().over(w) == 1, 1).otherwise(changed.cast("int")))
    numbered = marked.withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run", *same).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def latest(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    return last_wins(events, by, order)


def anchored(anchors: DataFrame, events: DataFrame, key: str, ts: str, before_seconds: int, after_seconds: int) -> DataFrame:
    """Every event of an anchor's key from ``before_seconds`` ahead of it to ``after_seconds`` behind it, both included.

    The anchor's columns are named anchor_..., the event's as they are; offset
    is the event's seconds from the anchor. Rows without a key or a time match
    nothing. Time is cut into bins as wide as the reach, so that an anchor looks
    into two bins, or three at most, and a key's long history is as many tasks
    as it has bins.
    """
    reach = max(1, before_seconds + after_seconds) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bin_of = lambda c: F.floor(c / F.lit(reach)).cast("long")
    named = anchors.select(*(F.col(f"`{c}`").alias(f"anchor_{c}") for c in anchors.columns), F.col(key).alias("key_"), micros(ts).alias("at_"))
    low, high = F.col("at_") - before_seconds * 1_000_000, F.col("at_") + after_seconds * 1_000_000
    spread = named.where("key_ is not null and at_ is not null").withColumn("bin_", F.explode(F.sequence(bin_of(low), bin_of(high))))
    dealt = events.withColumn("time_", micros(ts)).withColumn("slot_", bin_of(F.col("time_")))
    met = spread.join(dealt, (F.col("key_") == F.col(key)) & (F.col("bin_") == F.col("slot_")) & F.col("time_").between(low, high))
    return met.withColumn("offset", (F.col("time_") - F.col("at_")) / 1_000_000.0).drop("key_", "at_", "bin_", "time_", "slot_")


def heads(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the order of the columns; Spark keeps n of a key in each task before it moves them."""
    first = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth_", F.row_number().over(first)).where(F.col("nth_") <= n).drop("nth_")


def proximity_counts(events: DataFrame, key: str, ts: str, before_seconds: int, after_seconds: int, name: str = "n") -> DataFrame:
    """Every event with how many events of its key, itself included, lie from ``before_seconds`` ahead of it to ``after_seconds`` behind it; no pair is made."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    near = Window.partitionBy(key).orderBy(micros).rangeBetween(-before_seconds * 1_000_000, after_seconds * 1_000_000)
    return events.withColumn(name, F.count("*").over(near))


def folded(events: DataFrame, by: list[str], order: list[str], value: Column, schema: str, start: tuple, step: Callable, finish: Callable[[tuple], tuple] = tuple) -> DataFrame:
    """(by, schema): a fold over each key's values in order, ties by the value, null first.

    ``step`` takes the state and a value to the next state, ``finish`` the last
    state to the columns. A task goes through its keys one after another, in
    sorted Arrow batches, and holds one state, however long a key's history is;
    that history stays in one task, as each step needs the one before.
    """
    keys, places = [f"k{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    rows = events.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).alias(o) for c, o in zip(order, places, strict=True)), value.alias("v"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *places, "v").select(*keys, "v")
    out = StructType([*dealt.select(*keys).schema.fields, *StructType.fromDDL(schema).fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        current, state, done = None, start, []
        for b in batches:
            for *key, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != current:
                    if current is not None:
                        done.append((*current, *finish(state)))
                    current, state = key, start
                state = step(state, x)
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in done], kinds)
            done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*current, *finish(state)), strict=True))], kinds)

    found = dealt.mapInArrow(walk, out)
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *StructType.fromDDL(schema).names)


def smoothed(events: DataFrame, by: list[str], order: list[str], value: str, alpha: float = 0.7, most_step: float | None = None) -> DataFrame:
    """(by, result): the last exponential average, alpha for the new value, steps clamped if asked for; it starts anew after a null."""

    def step(a: tuple, x: float | None) -> tuple:
        if a[0] is None or x is None:
            return (x,)
        target = alpha * x + (1 - alpha) * a[0]
        return (target if most_step is None else a[0] + max(-most_step, min(most_step, target - a[0])),)

    return folded(events, by, order, F.col(value).cast("double"), "result double", (None,), step)


def token_budget(turns: DataFrame, by: list[str], order: list[str], tokens: Column, limit: int = 1500, summary: int = 200) -> DataFrame:
    """(by, resets, held): a running sum that falls to the summary's size when it reaches the limit; null is 0."""

    def step(a: tuple, x: int | None) -> tuple:
        total = a[1] + (x or 0)
        return (a[0] + 1, summary) if total >= limit else (a[0], total)

    return folded(turns, by, order, tokens.cast("long"), "resets long, held long", (0, 0), step)


def hysteresis(events: DataFrame, by: list[str], order: list[str], value: str, enter: float = 0.35, enter_n: int = 2, leave: float = 0.15, leave_n: int = 3) -> DataFrame:
    """(by, active, entries): on after ``enter_n`` values in a row of at least ``enter``, off after ``leave_n`` of at most ``leave``; a null breaks a row."""

    def step(a: tuple, x: float | None) -> tuple:
        active, entries, ups, downs = a
        ups = ups + 1 if not active and x is not None and x >= enter else 0
        downs = downs + 1 if active and x is not None and x <= leave else 0
        if ups >= enter_n:
            return True, entries + 1, 0, downs
        return (False, entries, ups, 0) if downs >= leave_n else (active, entries, ups, downs)

    return folded(events, by, order, F.col(value).cast("double"), "active boolean, entries int", (False, 0, 0, 0), step, lambda a: a[:2])


def trend(events: DataFrame, by: list[str], order: list[str], value: str, diffs: int = 3) -> DataFrame:
    """Every event with rising, falling or flat by the signs of the last differences."""
    w = Window.partitionBy(*by).orderBy(*order)
    signed = events.withColumn("sign_", F.signum(F.col(value) - F.lag(value).over(w)))
    total = F.sum("sign_").over(w.rowsBetween(1 - diffs, 0))
    return signed.withColumn("trend", F.when(total > 0, "rising").when(total < 0, "falling").otherwise("flat")).drop("sign_")


def throttled(events: DataFrame, by: list[str], order: list[str], seconds: Column, gap: int = 300) -> DataFrame:
    """(by, fired): how many events fire if one may fire only ``gap`` seconds after the last that did; events without a time don't."""

    def step(a: tuple, x: float | None) -> tuple:
        return (a[0] + 1, x) if x is not None and (a[1] is None or x - a[1] >= gap) else a

    return folded(events, by, order, seconds.cast("double"), "fired int", (0, None), step, lambda a: a[:1])


def rationed(events: DataFrame, by: list[str], order: list[str], seconds: Column, size: float = 5.0, per_second: float = 0.01) -> DataFrame:
    """(by, passed): how many events a token bucket of ``size`` lets pass that refills by ``per_second`` and starts full; events without a time don't pass."""

    def step(a: tuple, x: float | None) -> tuple:
        if x is None:
            return a
        passed, left, last = a
        filled = min(float(size), left + (0.0 if last is None else x - last) * per_second)
        return (passed + 1, filled - 1, x) if filled >= 1 else (passed, filled, x)

    return folded(events, by, order, seconds.cast("double"), "passed int", (0, float(size), None), step, lambda a: a[:1])


def important(events: DataFrame, lists: dict[str, list[str]], kind: str, trigger: Column) -> DataFrame:
    """Events with ``pass``: always for white kinds, never for black ones, for all others by a trigger."""
    white, black = F.col(kind).isin(lists.get("white", [])), F.col(kind).isin(lists.get("black", []))
    hit = F.coalesce(trigger, F.lit(False))
    return events.withColumn("pass", F.when(F.coalesce(white, F.lit(False)), True).when(F.coalesce(black, F.lit(False)), False).otherwise(hit))


def decayed(similarity: Column, seconds: Column, tau_seconds: float) -> Column:
    return 0.5 * similarity + 0.2 * F.exp(-F.abs(seconds) / tau_seconds)


def hybrid_score(similarity: Column, seconds: Column, concepts: Column, wanted: Column, rule: Column, tau_seconds: float = 86400.0) -> Column:
    """Similarity, closeness in time, overlap of concepts and rules, at 0.5, 0.2, 0.15 and 0.15."""
    either = F.size(F.array_union(concepts, wanted))
    overlap = F.when(either > 0, F.size(F.array_intersect(concepts, wanted)) / either).otherwise(F.lit(0.0))
    return decayed(similarity, seconds, tau_seconds) + 0.15 * overlap + 0.15 * rule


def additive_score(similarity: Column, seconds: Column, risk: Column, kind_prior: Column, tau_seconds: float = 43_200.0, weights: tuple[float, float, float, float] = (0.5, 0.2, 0.15, 0.15)) -> Column:
    """Similarity, closeness in time, risk and the prior of the two events' kinds, weighted and added; a null part counts as 0."""
    parts = [similarity, F.exp(-F.abs(seconds) / tau_seconds), risk, kind_prior]
    total = F.lit(0.0)
    for weight, part in zip(weights, parts, strict=True):
        total = total + weight * F.coalesce(part.cast("double"), F.lit(0.0))
    return total


def reranked(candidates: DataFrame, similarity: str, seconds: str, concepts: str, wanted: list[str], kind: str, seed_kind: Column, rules: DataFrame, tie: str, n: int = 20, tau_seconds: float = 43_200.0) -> DataFrame:
    """The n best candidates by the hybrid score, with ``score``: the rule table (from_kind, to_kind, boost) says what the two kinds add.

    The table's rows are kinds times kinds; Spark broadcasts it if it is small.
    """
    named = rules.select(F.col("from_kind").alias("from_"), F.col("to_kind").alias("to_"), F.col("boost").alias("boost_"))
    joined = candidates.withColumn("seed_", seed_kind).join(named, (F.col("seed_") == F.col("from_")) & (F.col(kind) == F.col("to_")), "left")
    score = hybrid_score(F.col(similarity), F.col(seconds), F.col(concepts), F.array(*map(F.lit, wanted)), F.coalesce("boost_", F.lit(0.0)), tau_seconds)
    return joined.withColumn("score", score).drop("from_", "to_", "boost_", "seed_").orderBy(F.desc("score"), tie).limit(n)


def gated(events: DataFrame, rules: DataFrame, kind: str, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Events with ``pass`` by a table of rules (kind, list, low, high, rise), a row or none for each kind.

    Kinds of list ``white`` pass and of ``black`` don't. Any other passes where
    its value is outside low ... high, or has risen by at least ``rise`` since
    the key's event of that kind before; a null bound triggers nothing.
    """
    before = F.lag(value).over(Window.partitionBy(*by, kind).orderBy(*order))
    named = rules.select(F.col("kind").alias("kind_"), F.col("list").alias("list_"), F.col("low").alias("low_"), F.col("high").alias("high_"), F.col("rise").alias("rise_"))
    judged = events.withColumn("before_", before).join(named, F.col(kind) == F.col("kind_"), "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    trigger = hit(F.col(value) < F.col("low_")) | hit(F.col(value) > F.col("high_")) | hit(F.col(value) - F.col("before_") >= F.col("rise_"))
    told = F.when(F.col("list_") == "white", True).when(F.col("list_") == "black", False).otherwise(trigger)
    return judged.withColumn("pass", told).drop("before_", "kind_", "list_", "low_", "high_", "rise_")


def soft_label(onset: Column, off: Column, at: Column, horizon: float, kind: str = "linear") -> Column:
    """How near an onset ahead is, from 1 at it to 0 at the horizon (or exponentially); 1 while on, 0 after it is off."""
    ahead = onset - at
    value = F.greatest(1 - ahead / horizon, F.lit(0.0)) if kind == "linear" else F.exp(-ahead / horizon)
    return F.when(onset.isNull() | (off.isNotNull() & (at >= off)), F.lit(0.0)).when(ahead <= 0, F.lit(1.0)).otherwise(value)


def rolling_days(days: DataFrame, day: str, width: int = 7) -> DataFrame:
    """(day, covered): every day with each of the ``width`` days that end there."""
    return days.select(day, F.explode(F.sequence(F.date_sub(day, width - 1), F.col(day))).alias("covered"))


def downsampled(points: DataFrame, ts: str, unit: str, by: list[str], value: str) -> DataFrame:
    """Count, mean, least and greatest value for each key and unit of time."""
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")
    return points.groupBy(bucket, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
