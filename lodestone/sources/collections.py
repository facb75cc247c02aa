"""Collections of records and points.

Records are (id, attributes as JSON, content, vector, ts) in a sharded table, so
that a write rewrites only the shards of its ids. Points are (metric, ts, tags,
fields) in files that are only added to. A specification becomes visible with
its ``_SUCCESS`` file, so a failed write changes nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.filters import Fields, Filter, apply_filter, compile_filter, record_field, variant_field
from lodestone.operators import records, vector_search
from lodestone.sources.sharded import ShardedTable

RECORD = "id string, attributes string, content string, vector array<float>, ts timestamp_ntz"
POINT = "metric string, ts timestamp_ntz, tags map<string,string>, fields string"
MODES = ("vector", "timeseries", "general", "mixed")


class PointFields:
    """The fields of a point: ts, tags.x and fields.x; any other is null."""

    def __call__(self, path: str) -> Column:
        if path in ("ts", "timestamp"):
            return F.col("ts")
        kind, _, key = path.partition(".")
        if kind == "tags":
            return F.try_element_at("tags", F.lit(key))
        return F.get_json_object("fields", f"$['{key}']") if kind == "fields" else F.lit(None).cast("string")

    def kind(self, path: str) -> str:
        return "timestamp_ntz" if path in ("ts", "timestamp") else "json"


@dataclass
class CollectionSpec:
    name: str
    mode: str = "general"
    vector_dims: dict[str, int] = field(default_factory=dict)
    metric: str = "cosine"


class Collections:
    """All collections under one folder. With ``variant`` their attributes are parsed when they are written, and filters read typed values."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 16, variant: bool = False):
        self.spark, self.root, self.shards, self.variant = spark, root.rstrip("/"), shards, variant

    @property
    def fields(self) -> Fields:
        return variant_field() if self.variant else record_field()

    def _folder(self, name: str) -> str:
        return f"{self.root}/um_{re.sub(r'[^0-9A-Za-z_]', '_', name)[:60]}"

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str, part: str) -> list[str]:
        fs, p = self._fs(f"{self._folder(name)}/{part}")
        if not fs.exists(p):
            return []
        found = sorted(x.getPath().toString() for x in fs.listStatus(p))
        return [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]

    def _write(self, df: DataFrame, name: str, part: str) -> None:
        """A new version; of two writers that take the same number the later one fails instead of replacing the other's."""
        found = self._versions(name, part)
        number = int(found[-1].rsplit("/v", 1)[1]) + 1 if found else 0
        df.write.mode("errorifexists").parquet(f"{self._folder(name)}/{part}/v{number:08d}")

    def table(self, name: str) -> ShardedTable:
        """The records' table."""
        return ShardedTable(self.spark, f"{self._folder(name)}/records", RECORD.replace("attributes string", "attributes variant") if self.variant else RECORD, "id", self.shards)

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete the files that the last ``keep`` versions don't use, which nothing may be reading; how many folders went."""
        return self.table(name).vacuum(keep)

    def rollback(self, name: str) -> bool:
        """Make the version before the last current; whether there was one."""
        return self.table(name).rollback()

    def clear(self, name: str) -> None:
        """A version without any record."""
        self.table(name).clear()

    def _read(self, name: str, part: str, schema: str) -> DataFrame:
        found = self._versions(name, part)
        return self.spark.read.schema(schema).parquet(found[-1]) if found else self.spark.createDataFrame([], schema)

    def create(self, spec: CollectionSpec) -> CollectionSpec:
        """Make a collection, or merge new vector columns into one of the same mode; known dimensions can't change."""
        if spec.mode not in MODES:
            raise ValueError(f"unknown mode {spec.mode}")
        old = self.describe(spec.name)
        if old:
            if old.mode != spec.mode or (old.vector_dims and old.metric != spec.metric):
                raise ValueError("the collection exists with another mode or metric")
            if any(old.vector_dims.get(k, v) != v for k, v in spec.vector_dims.items()):
                raise ValueError("vector dimensions can't change")
            spec = CollectionSpec(spec.name, old.mode, old.vector_dims | spec.vector_dims, spec.metric)
        self._write(self.spark.createDataFrame([(json.dumps(asdict(spec)),)], "spec string"), spec.name, "spec")
        return spec

    def describe(self, name: str) -> CollectionSpec | None:
        found = self._read(name, "spec", "spec string").first()
        return CollectionSpec(**json.loads(found[0])) if found else None

    def drop(self, name: str) -> bool:
        fs, p = self._fs(self._folder(name))
        return fs.delete(p, True)

    def records(self, name: str) -> DataFrame:
        return self.table(name).read()

    def upsert(self, name: str, rows: DataFrame, sequence: list[str]) -> None:
        """Records by id, the last of the sequence columns wins; those without an id get one. Vectors must have the collection's dimension."""
        spec = self.describe(name) or CollectionSpec(name)
        dims = set(spec.vector_dims.values())
        if dims:
            bad = F.col("vector").isNotNull() & ~F.size("vector").isin(*dims)
            rows = rows.withColumn("vector", F.when(bad, F.raise_error(F.lit("vector of another dimension"))).otherwise(F.col("vector")))
        if self.variant and rows.schema["attributes"].dataType.simpleString() == "string":
            rows = rows.withColumn("attributes", F.try_parse_json("attributes"))
        self.table(name).upsert(rows, sequence)

    def scan(self, name: str, *columns: str) -> DataFrame:
        """Some columns of all records: ids, contents, vectors; the files' other columns aren't read."""
        return self.records(name).select(*columns)

    def lookup(self, name: str, ids: list[str]) -> DataFrame:
        """The records of some ids, from their shards alone."""
        return self.table(name).lookup(ids)

    def delete(self, name: str, spec: Filter) -> int:
        """Delete what a filter matches; how many records went."""
        return self.table(name).delete_where(compile_filter(spec.expr, self.fields))

    def query(self, name: str, spec: Filter, mode: str = "sql") -> DataFrame:
        return apply_filter(self.records(name), spec, self.fields, mode)

    def count(self, name: str, spec: Filter | None = None) -> int:
        return self.query(name, Filter(expr=spec.expr if spec else {})).count()

    def exists(self, name: str, spec: Filter) -> bool:
        return not self.query(name, Filter(expr=spec.expr)).isEmpty()

    def search(self, name: str, vector: list[float], k: int = 10, spec: Filter | None = None, threshold: float | None = None) -> DataFrame:
        """Nearest records of those that a filter matches, by the collection's metric, with ``score`` falling and ``distance`` rising."""
        metric = (self.describe(name) or CollectionSpec(name)).metric
        where = compile_filter(spec.expr, self.fields) if spec else None
        found = vector_search.top_k(self.records(name).where("vector is not null"), vector, k, metric, "vector", "id", where, threshold)
        return found.withColumn("distance", 1 - F.col("score") if metric != "l2" else 0.0 - F.col("score"))

    def append_points(self, name: str, points: DataFrame) -> None:
        points.select("metric", "ts", "tags", "fields").write.mode("append").partitionBy("metric").parquet(f"{self._folder(name)}/points")

    def points(self, name: str, metric: str, spec: Filter | None = None) -> DataFrame:
        """Points of a metric that a filter on ts, tags.x and fields.x matches, in its order or else in time order.

        ``contains`` is always true here. A collection without points gives none.
        """
        fs, p = self._fs(f"{self._folder(name)}/points")
        stored = self.spark.read.schema(POINT).parquet(p.toString()) if fs.exists(p) else self.spark.createDataFrame([], POINT)
        rows = stored.where(F.col("metric") == metric)
        spec = spec or Filter()
        ordered = Filter(spec.expr, spec.order_by or [("ts", "asc")], spec.limit, spec.offset)
        return apply_filter(rows, ordered, PointFields(), attributes=None, tie="ts")

    def stats(self, name: str) -> DataFrame:
        """One row: records, those with a vector, and the latest time."""
        return self.records(name).agg(F.count("*").alias("n"), F.count_if(F.size("vector") > 0).alias("with_vector"), F.max("ts").alias("latest"))
