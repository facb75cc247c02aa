"""Patients' documents in shared files."""

from __future__ import annotations

import glob
import json
from itertools import groupby

from pyspark.sql import functions as F

from lodestone.plans import catalogue
from lodestone.plans import source_queries as sq
from lodestone.sources import files


def test_packed_documents_read_as_files_of_their_own_do(spark, tmp_path):  # noqa: ANN001
    """a folder and a file for each patient; now files are as many as the rows fill."""
    documents = {f"p{i}": json.dumps({"meta_id": f"m{i}", "sequence": [{"id": f"{i}-{k}", "event_type": t, "sub_type": "s\n"} for k, t in enumerate("AAB"[: i % 4])]}) for i in range(40)}
    documents |= {"broken": "{nothing", "bare": '{"meta_id": "x"}', "empty": '{"meta_id": "y", "sequence": []}'}
    (tmp_path / "own").mkdir()
    for name, text in documents.items():
        (tmp_path / f"own/{name}.json").write_text(text)
    rows = spark.createDataFrame(list(documents.items()), "patient_id string, value string").coalesce(1)
    files.pack_patients(rows, str(tmp_path / "packed"), 20)
    assert len(glob.glob(str(tmp_path / "packed/*.parquet"))) == 3
    own, packed = files.patient_events(spark, str(tmp_path / "own")), files.packed_patient_events(spark, str(tmp_path / "packed"))
    assert packed.dtypes == own.dtypes
    assert sorted(packed.collect(), key=repr) == sorted(own.collect(), key=repr)


def test_the_query_has_no_file_for_each_patient(spark, small, monkeypatch):  # noqa: ANN001
    """both read what one step has written."""
    read = []
    monkeypatch.setattr(files, "packed_patient_events", lambda s, path, f=files.packed_patient_events: read.append(path) or f(s, path))
    found = sq._patients(spark, small)
    assert len(spark.read.parquet(read[0]).inputFiles()) <= 4 < found.select("meta_id").distinct().count()


def test_patients_hold_every_event(spark, small):  # noqa: ANN001
    """F5 of round 4: only every fourth event got into the documents."""
    found = catalogue.queries()["src_patient_files"](spark, small).select(F.col("id").cast("long")).collect()
    assert sorted(r[0] for r in found) == sorted(r[0] for r in spark.read.parquet(f"{small}/events.parquet").select("event_id").collect())


def test_next_batches_count_all_events_up_to_another_type(spark, small):  # noqa: ANN001
    """F4 of round 4: runs were those of every fourth event."""
    runs: dict[str, list[str]] = {}
    for r in sorted(spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()):
        runs.setdefault(str(r["user_id"]), []).append(r["event_type"])
    want = {user: len(list(next(groupby(types))[1])) for user, types in runs.items()}
    found = catalogue.queries()["src_next_batches"](spark, small).collect()
    assert len(found) == len(want) and {r["meta_id"]: r["n"] for r in found} == want
