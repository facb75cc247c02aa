"""Steps of the second cleaning are computed once for each text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import clinical


def test_second_cleaning_reads_its_text_once(spark):  # noqa: ANN001
    """the text and what became of it stood in the expression again for each use."""
    cases = {
        ("Braden", None): None,
        ("Braden", ""): "",
        ("其他", "a: 1; b: 2a: 1; b: 2"): "a: 1; b: 2",
        ("其他", "p, a, b, c, d, a, b, c, d, q"): "p,  a,  b,  c,  d,  q",
        ("其他", "a,, b"): "a,, b",
    }
    df = spark.createDataFrame(list(cases), "sub_type string, content string")
    found = df.select("sub_type", "content", clinical.second_cleaned(F.col("sub_type"), F.col("content")).alias("cleaned"))
    assert found._jdf.queryExecution().analyzed().toString().count("trim(content") == 1
    assert {(r[0], r[1]): r[2] and r[2].replace("  ", " ") for r in found.collect()} == {k: v and v.replace("  ", " ") for k, v in cases.items()}
