"""Streams whose results and state don't pass through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.plans import source_queries as sq
from lodestone.streaming import events as st


def test_first_seen_rows_are_files_in_the_shared_folder(spark, small, monkeypatch):  # noqa: ANN001
    """rows come from files, each id once, however many files the stream has; it was a table in the driver's memory, from four files."""
    monkeypatch.setattr(sq, "FILE_ROWS", 100)
    found = catalogue.queries()["str_first_seen"](spark, small)
    shared = spark.conf.get("spark.checkpoint.dir")
    assert found.inputFiles() and all(shared in f for f in found.inputFiles())
    ids = sorted(r[0] for r in found.collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{small}/events.parquet").select("event_id").collect())


def test_complete_results_are_those_of_the_last_trigger(spark, small):  # noqa: ANN001
    """sessions of several triggers are told once, from files."""
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = sq._as_stream(spark, events)
    found = st.run_available(st.session_counts(stream, gap="12 hours", late="400 days"), "t_sessions_files", "complete")
    assert found.inputFiles()
    assert found.agg(F.sum("n")).first()[0] == events.count()
    assert found.groupBy("user_id", "session_window").count().where("count > 1").isEmpty()


def test_an_empty_stream_has_no_rows(spark, tmp_path):  # noqa: ANN001
    (tmp_path / "in").mkdir()
    found = st.run_available(st.first_seen(st.event_files(spark, str(tmp_path / "in"))), "t_nothing")
    assert found.count() == 0 and "event_id" in found.columns
