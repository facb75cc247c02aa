"""The life cycle of alerts: smoothing, hysteresis, cool-down, expiry and capacity, one step for batch and stream.

The state of a key is a small dictionary of its risks. ``advanced`` moves it by
one event and says what changed. In batch a task goes through its keys' events
in order and holds one key's state at a time; ``lodestone.streaming.alerts``
keeps the same state between triggers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A risk's state: smoothed value, whether it is on, values in a row that push it up or down, microseconds of its last alert (-1: none) and of its last event.
State = dict[str, tuple[float, bool, int, int, int, int]]
Change = tuple[str, int, str, float]


@dataclass(frozen=True)
class Rules:
    """A risk goes on after ``enter_n`` smoothed values of at least ``enter`` and off after ``leave_n`` of at most ``leave``.

    ``alpha`` weighs the new value, no step is larger than ``most_step``. Within
    ``cool_seconds`` of a risk's last alert it goes on silently; without events
    for ``ttl_seconds`` it is resolved; of more than ``capacity`` risks that are
    on, the one with the smallest value is dropped.
    """

    alpha: float = 0.7
    most_step: float = 0.15
    enter: float = 0.35
    enter_n: int = 2
    leave: float = 0.15
    leave_n: int = 3
    cool_seconds: int = 1800
    ttl_seconds: int = 86_400
    capacity: int = 8


def expired(state: State, now: int, rules: Rules) -> list[Change]:
    """Risks without events for longer than their time leave the state; those that were on are told as resolved."""
    out = []
    for risk in sorted(r for r, s in state.items() if now - s[5] > rules.ttl_seconds * 1_000_000):
        p, on, _, _, _, seen = state.pop(risk)
        if on:
            out.append((risk, seen + rules.ttl_seconds * 1_000_000, "resolved", p))
    return out


def advanced(state: State, risk: str, value: float, now: int, rules: Rules) -> list[Change]:
    """The state after one event, and its changes: (risk, microseconds, alert | quiet | cleared | dropped | resolved, value)."""
    out = expired(state, now, rules)
    if risk in state:
        p, on, ups, downs, alerted, _ = state[risk]
        p = p + max(-rules.most_step, min(rules.most_step, (rules.alpha * value + (1 - rules.alpha) * p) - p))
    else:
        p, on, ups, downs, alerted = value, False, 0, 0, -1
    ups = ups + 1 if not on and p >= rules.enter else 0
    downs = downs + 1 if on and p <= rules.leave else 0
    if ups >= rules.enter_n:
        on, ups = True, 0
        loud = alerted < 0 or now - alerted >= rules.cool_seconds * 1_000_000
        out.append((risk, now, "alert" if loud else "quiet", p))
        alerted = now if loud else alerted
    elif downs >= rules.leave_n:
        on, downs = False, 0
        out.append((risk, now, "cleared", p))
    state[risk] = (p, on, ups, downs, alerted, now)
    active = [(s[0], r) for r, s in state.items() if s[1]]
    if len(active) > rules.capacity:
        p, least = min(active)
        del state[least]
        out.append((least, now, "dropped", p))
    return out


def life_cycle(events: DataFrame, key: str, risk: str, value: str, ts: str, tie: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(key, risk, at, change, p): all changes of all risks, in batch.

    Events are taken by time, ties by ``tie``; without a key, a risk, a value or
    a time they don't count. What is still on at the end is resolved if the
    table's last event is more than its time later. One task goes through a
    key's events, in as many Arrow batches as it takes.
    """
    known = events.where(F.col(key).isNotNull() & F.col(risk).isNotNull() & F.col(value).isNotNull() & F.col(ts).isNotNull())
    rows = known.select(F.col(key).alias("key"), F.col(risk).cast("string").alias("risk"), F.col(value).cast("double").alias("x"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("tie"))
    last = rows.agg(F.max("us")).first()[0]
    kind = rows.schema["key"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, {}, []

        def finish() -> None:
            out.extend((current, *c) for c in expired(state, last, rules))

        for b in batches:
            for k, r, x, us in zip(b.key.tolist(), b.risk, b.x.tolist(), b.us.tolist(), strict=True):
                if k != current:
                    finish()
                    current, state = k, {}
                out.extend((k, *c) for c in advanced(state, r, x, us, rules))
            yield pd.DataFrame(out, columns=["key", "risk", "us", "change", "p"])
            out = []
        finish()
        yield pd.DataFrame(out, columns=["key", "risk", "us", "change", "p"])

    found = rows.repartition("key").sortWithinPartitions("key", "us", "tie").mapInPandas(walk, f"key {kind}, risk string, us long, change string, p double")
    return found.select(F.col("key").alias(key), "risk", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"), "change", "p")


def rising_horizons(*values: str) -> list:
    """The values of growing horizons, each raised to the one before where it is below it; nulls stay."""
    return [F.when(F.col(v).isNotNull(), F.greatest(*(F.col(x) for x in values[: i + 1])) if i else F.col(v)).alias(v) for i, v in enumerate(values)]
