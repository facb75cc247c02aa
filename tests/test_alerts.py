"""The alert life cycle: its steps, and batch and stream side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import alerts
from lodestone.operators.alerts import Rules, advanced
from lodestone.streaming import alerts as stream
from lodestone.streaming import events as st

MINUTE = 60_000_000


def walk(values, rules, risk="r", step=MINUTE):  # noqa: ANN001, ANN201
    state, out = {}, []
    for i, x in enumerate(values):
        out += [(c[0], c[1] // MINUTE, c[2]) for c in advanced(state, risk, x, i * step, rules)]
    return out, state


def test_hysteresis_and_cool_down():
    sharp = Rules(alpha=1.0, most_step=1.0, cool_seconds=600)
    out, _ = walk([0.4, 0.2, 0.4, 0.5, 0.1, 0.1, 0.1, 0.5, 0.5, 0.1, 0.1, 0.1], sharp)
    assert out == [("r", 3, "alert"), ("r", 6, "cleared"), ("r", 8, "quiet"), ("r", 11, "cleared")]
    out, _ = walk([0.4, 0.4, 0.1, 0.1, 0.1, *[0.2] * 10, 0.5, 0.5], sharp)
    assert out == [("r", 1, "alert"), ("r", 4, "cleared"), ("r", 16, "alert")]


def test_smoothing_is_clamped():
    _, state = walk([0.0, 1.0, 1.0], Rules())
    assert abs(state["r"][0] - 0.3) < 1e-12
    _, state = walk([0.5, 0.6], Rules())
    assert abs(state["r"][0] - 0.57) < 1e-12


def test_expiry_and_capacity():
    rules = Rules(alpha=1.0, most_step=1.0, enter_n=1, ttl_seconds=120, capacity=2)
    state: dict = {}
    told = [advanced(state, r, x, t * MINUTE, rules) for r, x, t in (("a", 0.9, 0), ("b", 0.5, 1), ("c", 0.6, 2), ("d", 0.1, 9))]
    assert [[(c[0], c[1] // MINUTE, c[2]) for c in x] for x in told] == [[("a", 0, "alert")], [("b", 1, "alert")], [("c", 2, "alert"), ("b", 2, "dropped")], [("a", 2, "resolved"), ("c", 4, "resolved")]]
    assert set(state) == {"d"}


def test_rising_horizons(spark):  # noqa: ANN001
    df = spark.createDataFrame([(0.3, 0.2, 0.5), (0.1, None, 0.05)], "a double, b double, c double")
    assert [tuple(r) for r in df.select(*alerts.rising_horizons("a", "b", "c")).collect()] == [(0.3, 0.3, 0.5), (0.1, None, 0.1)]


def test_batch_and_stream_agree(spark, small, tmp_path):  # noqa: ANN001
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.least(F.lit(1.0), F.col("value") / 100))
    rules = Rules(ttl_seconds=5 * 86_400, capacity=2)
    want = {(r["user_id"], r["risk"], r["at"], r["change"], round(r["p"], 9)) for r in alerts.life_cycle(e, "user_id", "event_type", "value", "ts", "event_id", rules).withColumn("at", F.col("at").cast("timestamp")).collect()}
    parts = [F.col("ts") < "2024-01-10", (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-20"), F.col("ts") >= "2024-01-20"]
    for part in parts:
        e.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    try:
        found = st.run_available(stream.life_cycle(st.event_files(spark, str(tmp_path / "in")), "user_id", "event_type", "value", "ts", "event_id", rules), "t_cycle", "update")
        got = {(r["user_id"], r["risk"], r["at"], r["change"], round(r["p"], 9)) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want and {x[3] for x in want} >= {"alert", "resolved", "dropped"}


def test_events_that_do_not_count(spark):  # noqa: ANN001
    e = spark.createDataFrame([(1, None, "r", 0.9), (2, 5, None, 0.9), (3, 5, "r", None)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert alerts.life_cycle(e, "user_id", "event_type", "value", "ts", "event_id").count() == 0
