"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is set, a temporary one in local mode only (tests)."""
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


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the application ends."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jpath)
    files.deleteOnExit(jpath)
    return path


@contextmanager
def exact_variants(spark: SparkSession) -> Iterator[None]:
    """Files written here keep each VARIANT value's own type; a column split up by type would turn 3 into 3.0 beside larger decimals."""
    name = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: its lineage ends there, and the files survive lost executors."""
    path = f"{new_folder(df.sparkSession, 'steps')}/rows"
    with exact_variants(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
