"""File sources: patient sequences, event files, reports, papers' links and dated folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

EVENT = StructType([StructField(x, StringType()) for x in ("id", "timestamp", "event_type", "sub_type", "event_content", "risks", "flag", "metadata")])
PATIENT = StructType([StructField("meta_id", StringType()), StructField("sequence", ArrayType(EVENT)), StructField("_corrupt_record", StringType())])
#: Patients of a packed file.
PACKED = 10_000
PAPER_URL = r"https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/([0-9]+\.[0-9]+)"


def patient_events(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, meta_id, pos, event fields) of JSON files with a ``sequence``; files that can't be read are left out.

    The patient is named by the file, and events keep their order in it.
    """
    files = spark.read.schema(PATIENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return _sequences(files.select(stem.alias("patient_id"), "meta_id", "sequence", "_corrupt_record"))


def _sequences(documents: DataFrame) -> DataFrame:
    rows = documents.where("_corrupt_record is null and sequence is not null")
    return rows.select("patient_id", "meta_id", F.posexplode("sequence").alias("pos", "e")).select("patient_id", "meta_id", "pos", "e.*")


def pack_patients(documents: DataFrame, path: str, rows_per_file: int = PACKED) -> None:
    """Write (patient_id, value), a JSON document of each patient, into shared files of many patients.

    A file of its own for each patient costs a listing, an opening and a task's
    share of each; packed, the number of files grows with the rows by
    ``rows_per_file``. A row keeps the name that its file would have had.
    """
    documents.select("patient_id", "value").write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def packed_patient_events(spark: SparkSession, path: str) -> DataFrame:
    """What ``patient_events`` gives for the same documents, of packed files."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = spark.read.schema("patient_id string, value string").parquet(path).withColumn("d", F.from_json("value", PATIENT, options))
    return _sequences(read.select("patient_id", "d.meta_id", "d.sequence", "d._corrupt_record"))


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of patient files without a readable sequence."""
    files = spark.read.schema(PATIENT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "sequence", "_corrupt_record")
    return files.where("_corrupt_record is not null or sequence is null").select("file")


def next_batch(events: DataFrame, after: int = -1) -> DataFrame:
    """For each patient the next run of events of one type and sub-type after a position."""
    later = events.where(F.col("pos") > after)
    w = Window.partitionBy("patient_id").orderBy("pos")
    first = lambda c: F.first(c).over(w)
    same = F.col("event_type").eqNullSafe(first("event_type")) & F.col("sub_type").eqNullSafe(first("sub_type"))
    broken = F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return later.withColumn("broken_", broken).where("broken_ = 0").drop("broken_")


def reports(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """(day, title, author, text) of Markdown reports under year/month/day; metadata (day, title, author) wins over the text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    day = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}/\d{2}/\d{2})", 1), "/", "-")
    rows = files.select(day.alias("day"), F.nullif(F.regexp_extract("value", r"(?m)^### +(.+)$", 1), F.lit("")).alias("own_title"), F.col("value").alias("text"))
    if metadata is None:
        metadata = spark.createDataFrame([], "day string, title string, author string")
    joined = rows.join(metadata, "day", "left")
    return joined.select("day", F.coalesce("title", "own_title", F.lit("Untitled")).alias("title"), F.coalesce("author", F.lit("Unknown Author")).alias("author"), "text")


def paper_ids(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct paper ids of the links in texts."""
    return texts.select(F.explode(F.regexp_extract_all(column, F.lit(PAPER_URL), F.lit(1))).alias("id")).distinct()


def dated(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of Parquet under year=/month=/day= from the first to the last day, both included, by partition pruning."""
    day = F.make_date("year", "month", "day")
    return spark.read.parquet(path).where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def decoded_repositories(rows: DataFrame, column: str = "value") -> DataFrame:
    """Repository API rows from JSON text; missing topics are an empty list."""
    schema = "id long, name string, full_name string, description string, html_url string, clone_url string, ssh_url string, language string, stargazers_count long, forks_count long, watchers_count long, open_issues_count long, created_at string, updated_at string, pushed_at string, size long, topics array<string>, owner struct<login: string, id: long>, private boolean, archived boolean, disabled boolean"
    r = rows.select(F.from_json(column, schema).alias("r")).select("r.*")
    times = {c: F.try_to_timestamp(c) for c in ("created_at", "updated_at", "pushed_at")}
    return r.withColumns({**times, "topics": F.coalesce("topics", F.array().cast("array<string>"))})


def starred(repositories: DataFrame, language: str, least: int) -> DataFrame:
    return repositories.where((F.col("language") == language) & (F.col("stargazers_count") >= least))


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, links) of Word documents: a line for each paragraph, and the targets of their hyperlinks, in order; a file that isn't one has nulls."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(file, *_docx(content)) for file, content in zip(b.path, b.content, strict=True)]
            yield pd.DataFrame(rows, columns=["file", "text", "links"])

    return raw.select("path", "content").mapInPandas(read, "file string, text string, links array<string>")


def _docx(content: bytes) -> tuple[str | None, list[str] | None]:
    """Text and link targets of one document's parts."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            body = ElementTree.fromstring(parts.read("word/document.xml"))
            name = "word/_rels/document.xml.rels"
            targets = ElementTree.fromstring(parts.read(name)) if name in parts.namelist() else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, None
    lines = ["".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.iter(f"{word}p")]
    return "\n".join(lines), [t.get("Target", "") for t in targets if t.get("Type", "").endswith("/hyperlink")]


def random_weekdays(spark: SparkSession, first: str, last: str, n: int, seed: int = 0) -> DataFrame:
    """(day): ``n`` days from Monday to Friday of a range, both ends included, that the seed chooses."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("day").cast("string")).cast("binary"))).limit(n)
