"""Sharded tables: what a write touches, and writers that meet."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions.filters import Filter
from lodestone.sources import sharded
from lodestone.sources.collections import Collections
from lodestone.sources.sharded import Conflict, Manifest, ShardedTable

SCHEMA = "id string, content string, seq int"


def rows_of(spark, *rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(list(rows), SCHEMA)


def contents(table):  # noqa: ANN001, ANN201
    return {r["id"]: r["content"] for r in table.read().collect()}


def test_upsert_leaves_other_shards_files(spark, tmp_path):  # noqa: ANN001
    t = ShardedTable(spark, str(tmp_path / "t"), SCHEMA, shards=8)
    assert t.upsert(rows_of(spark, *((str(i), f"a{i}", 1) for i in range(100))), ["seq"]) == 1
    first = t.manifest()
    assert sum(first.rows.values()) == 100 and len(first.folders) == 8 and all(first.folders.values())
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    t.upsert(rows_of(spark, ("7", "old", 1), ("7", "new", 3), ("7", "mid", 2), ("x", "added", 1)), ["seq"])
    second = t.manifest()
    changed = [s for s in second.folders if second.folders[s] != first.folders[s]]
    assert 1 <= len(changed) <= 2
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet") if p in files} == files
    new = [p for p in (tmp_path / "t/data").rglob("*.parquet") if p not in files]
    assert {p.parent.name for p in new} == {f"shard_={s}" for s in changed}
    assert contents(t) == {str(i): f"a{i}" for i in range(100)} | {"7": "new", "x": "added"}
    assert t.read(1).count() == 100 and t.stats().count() == 8
    assert sum(r["n"] for r in t.stats().collect()) == 101


def test_lookup_reads_its_shards(spark, tmp_path):  # noqa: ANN001
    t = ShardedTable(spark, str(tmp_path / "t"), SCHEMA, shards=16)
    t.upsert(rows_of(spark, *((str(i), f"a{i}", 1) for i in range(200))), ["seq"])
    found = t.lookup(["3", "none"])
    assert [r["content"] for r in found.collect()] == ["a3"]
    assert len({f.split("/")[-2] for f in found.inputFiles()}) <= 2 < len({f.split("/")[-2] for f in t.read().inputFiles()})
    assert t.lookup([]).count() == 0


def test_other_writes(spark, tmp_path):  # noqa: ANN001
    t = ShardedTable(spark, str(tmp_path / "t"), SCHEMA, shards=4)
    assert t.read().count() == 0 and t.upsert(rows_of(spark), ["seq"]) is None and not t.rollback()
    t.upsert(rows_of(spark, ("a", "1", 1), ("b", "1", 1)), ["seq"])
    assert not t.update(rows_of(spark, ("a", "2", 1), ("zz", "2", 1)), ["seq"]) and contents(t) == {"a": "1", "b": "1"}
    assert t.update(rows_of(spark, ("a", "2", 1)), ["seq"]) and t.update(rows_of(spark), ["seq"])
    t.insert_absent(rows_of(spark, ("a", "3", 1), ("c", "3", 1)), ["seq"])
    assert contents(t) == {"a": "2", "b": "1", "c": "3"}
    t.delete(rows_of(spark, ("a", None, None), ("q", None, None)))
    assert contents(t) == {"b": "1", "c": "3"}
    assert t.delete_where(F.col("content") == "3") == 1 and t.delete_where(F.col("content") == "3") == 0
    assert contents(t) == {"b": "1"}
    t.clear()
    assert contents(t) == {} and t.rollback() and contents(t) == {"b": "1"} and t.rollback() and contents(t) == {"b": "1", "c": "3"}
    assert t.vacuum(keep=1) > 0 and contents(t) == {"b": "1", "c": "3"} and not t.rollback()
    t.upsert(rows_of(spark, (None, "x", 1), ("", "y", 1)), ["seq"])
    assert sorted(contents(t).values()) == ["1", "3", "x", "y"] and None not in contents(t)
    again = ShardedTable(spark, str(tmp_path / "t"), SCHEMA, shards=99)
    assert again.shards == 4 and len(contents(again)) == 4


def test_writers_lose_nothing(spark, tmp_path):  # noqa: ANN001
    path = str(tmp_path / "t")
    ShardedTable(spark, path, SCHEMA, shards=2).upsert(rows_of(spark, ("base", "b", 0)), ["seq"])
    failures = []

    def write(n: int) -> None:
        try:
            ShardedTable(spark, path, SCHEMA, shards=2).upsert(rows_of(spark, *((f"{n}-{i}", "x", 1) for i in range(5))), ["seq"])
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    assert set(contents(ShardedTable(spark, path, SCHEMA))) == {"base"} | {f"{n}-{i}" for n in range(4) for i in range(5)}


def test_second_writer_redoes_or_keeps_its_work(spark, tmp_path, monkeypatch):  # noqa: ANN001
    path = str(tmp_path / "t")
    t = ShardedTable(spark, path, SCHEMA, shards=8)
    t.upsert(rows_of(spark, *((str(i), "a", 1) for i in range(50))), ["seq"])
    other = ShardedTable(spark, path, SCHEMA)
    by_shard: dict = {}
    for r in t.read().select("id", t._shard().alias("s")).collect():
        by_shard.setdefault(r["s"], []).append(r["id"])
    (one, two), (far, *_) = next((x[0], x[1]) for x in by_shard.values() if len(x) > 1), next(iter(list(by_shard.values())[::-1]))
    made = []
    write = ShardedTable._write

    def meddled(self, rows, touched):  # noqa: ANN001, ANN202
        made.append(touched)
        out = write(self, rows, touched)
        if self is t and len(made) == 1:
            other.upsert(rows_of(spark, (two, "other", 1), (far, "other", 1)), ["seq"])
        return out

    monkeypatch.setattr(ShardedTable, "_write", meddled)
    t.upsert(rows_of(spark, (one, "mine", 1)), ["seq"])
    assert contents(t)[one] == "mine" and contents(t)[two] == "other"
    assert len(made) == 3  # mine, the other's, and mine again
    monkeypatch.setattr(ShardedTable, "_write", write)
    monkeypatch.setattr(sharded, "TRIES", 2)
    monkeypatch.setattr(sharded, "WAIT", 0.01)
    (tmp_path / f"t/claims/v{t.manifest().version + 1:08d}").write_text("")
    with pytest.raises(Conflict):
        t.upsert(rows_of(spark, (one, "late", 1)), ["seq"])
    assert t.unfinished() and t.release() and t.upsert(rows_of(spark, (one, "late", 1)), ["seq"])
    assert Manifest(0, 3).folders == {}


def test_variant_attributes(spark, tmp_path):  # noqa: ANN001
    rows = [("1", '{"k": 3.0, "t": ["a", 2], "o": {"x": {"y": true}}}'), ("2", '{"k": 3}'), ("3", '{"k": "3"}'), ("4", '{"k": true}'), ("5", "{nothing"), ("6", None), ("7", '{"k": 12345678901234567890123}'), ("8", '{"k": 2.50}')]
    schema = "id string, attributes string, content string, vector array<float>, ts timestamp_ntz, seq int"
    stores = [Collections(spark, str(tmp_path / name), variant=name == "variant") for name in ("json", "variant")]
    for store in stores:
        store.upsert("c", spark.createDataFrame([(i, a, None, None, None, 1) for i, a in rows], schema), ["seq"])
    filters = [{"eq": {"k": 3}}, {"eq": {"k": "3.0"}}, {"eq": {"k": True}}, {"in": {"k": [3, "true"]}}, {"range": {"k": [2, 4]}}, {"like": {"k": "3%"}}, {"not": {"eq": {"k": 3}}}, {"contains": {"t": ["a", 2]}}, {"contains": {"o": {"x": {"y": True}}}}, {"eq": {"o.x.y": True}}, {"eq": {"k": 12345678901234567890123}}]
    for expr in filters:
        for mode in ("sql", "typed"):
            found = [sorted(r["id"] for r in s.query("c", Filter(expr), mode).collect()) for s in stores]
            assert found[0] == found[1], (expr, mode)
    assert [r["id"] for r in stores[1].query("c", Filter({"eq": {"k": 2.5}}), "typed").collect()] == ["8"]
    plan = stores[1].query("c", Filter({"range": {"k": [2, 4]}}))._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "get_json_object" not in plan and "variant_get" in plan
