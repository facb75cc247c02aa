"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that survive lost executors. The files go
    when the application ends. After a job with large shuffles ``tidy`` lets
    Spark's cleaner drop the shuffle files whose plans are gone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if tidy:
        for _ in range(2):  # what the first collection finds only lets the second one reach the shuffles
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; the remainder 2 is held out from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def lowest_hashes(rows: DataFrame, hash_col: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows of the lowest hashes out of ``total``; only about 1.5 n of them are sorted, whatever the input."""
    share = F.shiftrightunsigned(hash_col, 11) / F.lit(float(1 << 53))
    # Hashes are ordered as unsigned numbers, as the share is.
    return rows.where(share < (1.5 * n + 100) / max(1, total)).orderBy(share, hash_col).limit(n)


def slices(texts: list, most_chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``most_chars`` characters each, a longer text alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text)
        if i > first and held + size > most_chars:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def give_back() -> None:
    """Return what a Python worker has freed to the system; Spark keeps idle workers beside later jobs' heaps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def worker_path(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
