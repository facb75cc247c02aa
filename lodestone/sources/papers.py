"""A database of papers on a sharded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import clean_paper_id
from lodestone.operators.papers import on_day
from lodestone.operators.records import exists_flags, positional
from lodestone.operators.vector_search import top_k
from lodestone.sources.sharded import ShardedTable

PAPER = "id string, version string, title string, authors array<string>, categories array<string>, summary string, published timestamp_ntz, submitted timestamp_ntz, pdf_url string, doi string, journal_ref string, comment string, metadata map<string,string>, vector array<float>"


class Papers:
    """Papers by their id without a version; the latest version of a batch counts."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 16):
        self.spark, self.table = spark, ShardedTable(spark, root, PAPER, "id", shards)

    def _rows(self, papers: DataFrame, vectors: DataFrame | None) -> DataFrame:
        """Papers with all columns, missing ones null, ids cleaned, and vectors (id, vector) if given; another type of a column raises."""
        want = {f.name: f.dataType for f in self.table.empty.schema.fields}
        for f in papers.schema.fields:
            if f.name in want and f.dataType.simpleString() not in (want[f.name].simpleString(), "void"):
                raise TypeError(f"{f.name} is {f.dataType.simpleString()}, not {want[f.name].simpleString()}")
        if "id" not in papers.columns:
            raise TypeError("papers need an id")
        full = papers.select(*((F.col(c) if c in papers.columns else F.lit(None)).cast(t).alias(c) for c, t in want.items()))
        clean = full.withColumns({"id": clean_paper_id(F.col("id")), "version": F.coalesce("version", F.nullif(F.regexp_extract("id", r"(v\d+)$", 1), F.lit("")))})
        if vectors is None:
            return clean
        given = vectors.select(clean_paper_id(F.col("id")).alias("vector_id"), F.col("vector").alias("given"))
        return clean.join(given, F.col("id") == F.col("vector_id"), "left").withColumn("vector", F.coalesce("given", "vector")).drop("vector_id", "given")

    def _newest(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        return rows.withColumn("order_", F.coalesce(F.regexp_extract("version", r"v(\d+)", 1).try_cast("int"), F.lit(0))), ["order_", "published", "title"]

    def add(self, papers: DataFrame, vectors: DataFrame | None = None) -> int | None:
        """Add or replace papers, with vectors (id, vector) if given; the table's new version, None without papers."""
        return self.table.upsert(*self._newest(self._rows(papers, vectors)))

    def update(self, papers: DataFrame, vectors: DataFrame | None = None) -> bool:
        """Replace papers that are all there; if any isn't, none is replaced. A paper without a new vector keeps its old one."""
        rows = self._rows(papers, vectors)
        old = self.table.read().select(F.col("id").alias("old_id"), F.col("vector").alias("old_vector"))
        kept = rows.join(old, F.col("id") == F.col("old_id"), "left").withColumn("vector", F.coalesce("vector", "old_vector")).drop("old_id", "old_vector")
        return self.table.update(*self._newest(kept))

    def delete(self, ids: DataFrame) -> int | None:
        return self.table.delete(ids.select(clean_paper_id(F.col("id")).alias("id")))

    def clear(self) -> int:
        return self.table.clear()

    def read(self) -> DataFrame:
        return self.table.read()

    def get(self, ids: Sequence[str]) -> DataFrame:
        """(pos, id, ...) of some papers in the order asked for, nulls where there is none; only their shards are read."""
        clean = [r[0] for r in self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, x string").orderBy("pos").select(clean_paper_id(F.col("x"))).collect()] if ids else []
        return positional(clean, self.table.lookup(clean), "id") if ids else self.table.empty.select(F.lit(0).alias("pos"), "*")

    def exists(self, ids: DataFrame) -> DataFrame:
        """The asked ids (id) with ``found``."""
        return exists_flags(ids.select(clean_paper_id(F.col("id")).alias("id")), self.table.read(), "id")

    def has_vector(self, ids: DataFrame) -> DataFrame:
        """The asked ids (id) with ``found``: whether the paper is there and has a vector."""
        return exists_flags(ids.select(clean_paper_id(F.col("id")).alias("id")), self.table.read().where("size(vector) > 0"), "id")

    def of_day(self, day: Column, categories: Sequence[str] = ()) -> DataFrame:
        """Papers published on a day that have any of the categories."""
        return on_day(self.table.read(), day, "published", categories)

    def similar(self, vector: list[float], k: int = 10, day: Column | None = None, categories: Sequence[str] = ()) -> DataFrame:
        """The k nearest papers, of a day and categories if given, with ``score`` and ``distance``."""
        rows = self.table.read() if day is None else self.of_day(day, categories)
        return top_k(rows.where("size(vector) > 0"), vector, k, vector="vector", tie="id").withColumn("distance", 1 - F.col("score"))

    def without_vector(self) -> DataFrame:
        return self.table.read().where("vector is null or size(vector) = 0")
