"""Counted writes, embedding runs, daily results, plans and prompts."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import activity, papers
from lodestone.operators import events as ev
from lodestone.operators import plans as pl
from lodestone.sources import counted, daily
from lodestone.sources.sharded import ShardedTable


def test_counts_come_from_the_write(spark, tmp_path):  # noqa: ANN001
    path = str(tmp_path / "rows")
    reads = spark.sparkContext.accumulator(0)

    def touch(batches):  # noqa: ANN001, ANN202
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.createDataFrame([(i, None if i % 4 == 0 else i) for i in range(40)], "id int, x int").mapInPandas(touch, "id int, x int")
    assert counted.write_counted(df, path, {"big": F.col("x") > 20, "none": F.col("x").isNull()}) == {"rows": 40, "big": 15, "none": 10}
    assert reads.value == 40 and spark.read.parquet(path).count() == 40
    assert counted.write_counted(df.where("false"), str(tmp_path / "empty"), {"big": F.col("x") > 20}) == {"rows": 0, "big": 0}
    forms = spark.createDataFrame([("Braden", "压疮_a: 1"), ("Braden", "a: 1"), (None, None)], "sub_type string, content string")
    assert counted.clean_counted(forms, str(tmp_path / "clean")) == {"rows": 3, "changed": 1}
    assert counted.clean_counted(forms, str(tmp_path / "second"), second=True) == {"rows": 3, "changed": 2}


def vector(x):  # noqa: ANN001, ANN201
    return F.when(~F.startswith(x, F.lit("!")), F.array(F.length(x).cast("float")))


def test_embedding_runs(spark, tmp_path):  # noqa: ANN001
    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "!x")], "id int, text string")
    ok, failed, told = counted.embed_many(df, vector, "text", "id", str(tmp_path / "e"))
    assert [(r["id"], r["vector"]) for r in ok.collect()] == [(1, [3.0])] and sorted(r["id"] for r in failed.collect()) == [2, 3, 4]
    assert told == {"rows": 4, "failed": 3}
    rows = [("a", "abc", None), ("b", "", None), ("c", "!x", None), ("d", "dd", [9.0])]
    t = ShardedTable(spark, str(tmp_path / "t"), "id string, content string, vector array<float>", shards=4)
    t.upsert(spark.createDataFrame(rows, t.empty.schema), ["id"])
    assert counted.backfill(t, vector) == {"missing": 3, "embedded": 0, "blank": 1} and t.manifest().version == 1
    assert counted.backfill(t, vector, all_or_nothing=False)["embedded"] == 1
    assert {r["id"]: r["vector"] for r in t.read().collect()} == {"a": [3.0], "b": None, "c": None, "d": [9.0]}
    cached = counted.with_cached_vectors(df, spark.createDataFrame([(1, [7.0])], "id int, vector array<float>"), vector, "text", "id").orderBy("id").collect()
    assert [(r["vector"], r["from_cache"]) for r in cached][:2] == [([7.0], True), ([1.0], False)]


def test_blobs(spark):  # noqa: ANN001
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "i int, v array<float>")
    got = df.select("i", F.hex(vectors.float_bytes("v")).alias("h"), vectors.bytes_vector(vectors.float_bytes("v")).alias("b")).orderBy("i").collect()
    assert [(r["h"], r["b"]) for r in got] == [("0000803F000020C0", [1.0, -2.5]), (None, None), ("", [])]
    assert spark.sql("SELECT X'010203' AS b").select(vectors.bytes_vector("b")).first()[0] is None


def test_daily_results(spark, tmp_path):  # noqa: ANN001
    a = spark.sql("SELECT * FROM VALUES (date'2025-01-01', 2, 'x'), (date'2025-01-01', 1, 'y'), (date'2025-01-02', 3, 'z') t(day, n, s)")
    b = spark.sql("SELECT * FROM VALUES (date'2025-01-03', 'p') t(day, q)")
    path = str(tmp_path / "days")
    daily.save_days(daily.daily_results({"a": a, "b": b}, "day", {"sum": ("a", "n"), "many": ("a", "*")}), path)
    saved = daily.saved_days(spark, path)
    one = json.loads(daily.day_of(saved, "2025-01-01").first()["result"])
    assert one == {"metadata": {"date": "2025-01-01", "version": "1.0", "sum": 3, "many": 2}, "a": [{"n": 1, "s": "y"}, {"n": 2, "s": "x"}], "b": []}
    assert len(daily.day_of(saved, "2025-01-01").inputFiles()) == 3 and "PartitionFilters: [isnotnull(year" in daily.day_of(saved, "2025-01-01")._jdf.queryExecution().executedPlan().toString()
    assert daily.completed(saved, "2025-01-03") and not daily.completed(saved, "2025-01-04")
    daily.save_days(daily.daily_results({"a": a.where("n = 3").withColumn("n", F.lit(30))}, "day", {"sum": ("a", "n")}), path)
    again = {str(r["day"]): json.loads(r["result"])["metadata"]["sum"] for r in daily.saved_days(spark, path).collect()}
    assert again == {"2025-01-01": 3, "2025-01-02": 30, "2025-01-03": 0}
    assert daily.sync_stats(a, "day", "n").first()["n"] == 6 and daily.sync_stats(a.where("false"), "day", "n").first()["runs"] == 0


def test_files_of_sessions_and_cards(spark, tmp_path):  # noqa: ANN001
    for name, when in (("old.json", 1_000_000_000), ("new.json", 2_000_000_000), ("old.txt", 1_000_000_000)):
        (tmp_path / name).write_text('{"name": "a"}')
        os.utime(tmp_path / name, (when, when))
    found = daily.old_files(spark, str(tmp_path), F.lit("2020-01-01").cast("timestamp")).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in found] == ["old.json"]
    (tmp_path / "cards.json").write_text('[{"name": "a", "url": "u"}, {"name": "b", "url": "v"}, {"url": "w"}]')
    cards = daily.agent_cards(spark, [str(tmp_path / "nothing.json"), str(tmp_path / "cards.json")], ["b"])
    assert sorted(r["url"] for r in cards.collect()) == ["u", "w"]
    with pytest.raises(FileNotFoundError):
        daily.agent_cards(spark, [str(tmp_path / "nothing.json")], [])


def test_task_states(spark):  # noqa: ANN001
    log = [("a", "start", 1), ("a", "complete", 2), ("b", "complete", 1), ("b", "start", 2), ("c", "fail", 1), ("c", "start", 2), ("d", "start", 1), ("d", "complete", 2), ("d", "fail", 3), ("zz", "start", 1)]
    tasks = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = pl.task_states(tasks, spark.createDataFrame(log, "id string, change string, n int"), ["n"]).collect()
    assert {r["id"]: r["status"] for r in got} == {"a": "completed", "b": "in_progress", "c": "failed", "d": "failed", "e": "pending"}
    assert pl.progress(spark.createDataFrame(got)).first()["percent"] == 20.0


def test_prompts_and_names(spark):  # noqa: ANN001
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert df.select(text.filled("x {a} y {b} z {c} { d }", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "x {b} y  z {c} { d }"
    templates = {"s": {"user_prompt": {"input_variables": ["a"], "template": "{a}"}}}
    for section, kind, values in (("s", "user", {}), ("s", "system", {"a": F.lit(1)}), ("t", "user", {"a": F.lit(1)})):
        with pytest.raises(ValueError, match="no |missing"):
            text.prompt(templates, section, kind, values)
    names = spark.createDataFrame([("a/b:c*?",), (" .x. ",), ("...",), (None,)], "n string")
    assert [r[0] for r in names.select(text.file_name(F.col("n"))).collect()] == ["a_b_c__", "x", "_", None]
    days = spark.createDataFrame([("2025-08-03",), ("3/8/2025",), ("1754179200",), ("soon",), (None,)], "d string")
    assert [r[0] for r in days.select(text.normal_date(F.col("d"))).collect()] == ["20250803", "20250803", "20250803", "soon", None]


def test_results_taken_back(spark):  # noqa: ANN001
    log = [("c", "n", "t", True, 1, False), ("c", "n", "t", True, 1, True), ("c", "n", "t", False, 2, False), ("c", "n", "u", True, 3, True), ("c", "m", "t", True, 1, False)]
    df = spark.createDataFrame(log, "capability string, name string, task string, ok boolean, at int, deleted boolean")
    known = spark.createDataFrame([("c", "n"), ("c", "n")], "capability string, name string")
    assert [tuple(r) for r in papers.task_results(df, known).collect()] == [("c", "n", 1, 0)]
    assert papers.shared_capabilities(spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"])], "capability string, agents array<string>")).first()["capability"] == "b"


def test_scores(spark):  # noqa: ANN001
    row = spark.createDataFrame([(0.8, 0.0, 0.5, None)], "s double, t double, r double, k double")
    assert row.select(ev.additive_score(*(F.col(c) for c in "strk"))).first()[0] == pytest.approx(0.5 * 0.8 + 0.2 + 0.15 * 0.5)
    rows = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.4, 1), (0.1, 0), (None, 1)], "s double, y int")
    m = activity.score_metrics(rows, "s", "y").first()
    assert (m["n"], m["auroc"], m["recall"], m["precision"]) == (4, 0.625, 0.5, 0.5) and m["average_precision"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert activity.score_metrics(rows.where("false"), "s", "y").first()["n"] == 0
