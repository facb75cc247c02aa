"""The alert life cycle on a stream: state between triggers, and timers that resolve silent risks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.operators.alerts import Rules, advanced, expired

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "p double, active boolean, ups int, downs int, alerted long, seen long"


class _LifeCycle(StatefulProcessor):
    """One key's risks as a map state, and a timer for the moment that each expires."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.risks = handle.getMapState("risks", "risk string", STATE)

    def _read(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.risks.iterator()}

    def _keep(self, old: dict, new: dict) -> None:
        for risk in old.keys() - new.keys():
            self.risks.removeKey((risk,))
        for risk, state in new.items():
            if old.get(risk) != state:
                self.risks.updateValue((risk,), state)
        wanted, there = {s[5] // 1000 + self.rules.ttl_seconds * 1000 + 1 for s in new.values()}, set(self.handle.listTimers())
        for timer in there - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - there:
            self.handle.registerTimer(timer)

    def _told(self, key: tuple, changes: list) -> Iterator[pd.DataFrame]:
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=["key", "risk", "us", "change", "p"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = self._read()
        state, changes = dict(old), []
        for r in pd.concat(list(rows)).sort_values(["us", "tie"]).itertuples():
            changes += advanced(state, r.risk, float(r.x), int(r.us), self.rules)
        self._keep(old, state)
        yield from self._told(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = self._read()
        state = dict(old)
        changes = expired(state, expiredTimerInfo.getExpiryTimeInMs() * 1000, self.rules)
        self._keep(old, state)
        yield from self._told(key, changes)


def life_cycle(events: DataFrame, key: str, risk: str, value: str, ts: str, tie: str, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:  # noqa: B008
    """The changes that the batch function of this name gives, as events come in; ``ts`` is a timestamp.

    The session's state store must be RocksDB's (``STORE``). A trigger's events
    of a key are taken in order; a later trigger's should not be earlier.
    """
    known = events.where(F.col(key).isNotNull() & F.col(risk).isNotNull() & F.col(value).isNotNull() & F.col(ts).isNotNull())
    rows = known.select(F.col(key).alias("key"), F.col(risk).cast("string").alias("risk"), F.col(value).cast("double").alias("x"), F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"), F.col(ts).alias("at_")).withWatermark("at_", late)
    kind = rows.schema["key"].dataType.simpleString()
    schema = StructType.fromDDL(f"key {kind}, risk string, us long, change string, p double")
    found = rows.groupBy("key").transformWithStateInPandas(_LifeCycle(rules), schema, "Update", "EventTime")
    return found.select(F.col("key").alias(key), "risk", F.timestamp_micros("us").alias("at"), "change", "p")
