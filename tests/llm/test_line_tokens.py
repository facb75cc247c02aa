"""Tokens of line dedup against plain windows of words."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.llm import line_dedup
from lodestone.llm.text_sets import SHINGLE_WORDS, shingles_of


def test_tokens_cannot_be_null(spark):  # noqa: ANN001
    """op6: tokens were of a type that may hold nulls, so that each was boxed to be sorted."""
    lines = ["A b c d e", "a b c d e f a b c d e", "one", "", "  x\ty  ", "é b c d e f g"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    classes = F.array(*(F.lit((b % 7) << line_dedup.HASH_BITS) for b in range(line_dedup.BUCKETS)))
    got = df.select("i", line_dedup.ordered_tokens(F.col("line"), classes).alias("tokens"))
    assert not got.schema["tokens"].dataType.containsNull
    sizes = {r["i"]: len(r["tokens"]) for r in got.collect()}
    split = [x.split() for x in lines]
    want = [len({tuple(w[k : k + SHINGLE_WORDS]) for k in range(max(1, len(w) - SHINGLE_WORDS + 1))}) if w else 0 for w in (list(map(str.lower, w)) for w in split)]
    assert sizes == dict(enumerate(want))
    assert not spark.range(1).select(shingles_of(F.array(F.lit("a"))).alias("s")).schema["s"].dataType.containsNull


def test_tokens_that_stand_once_go_before_the_window(spark):  # noqa: ANN001
    """op6: a window started anew at each token, though most stand once; now they go, and what stays needs no other shuffle or sort."""
    same_bin = [5, 5 + line_dedup.BINS, 5 + 2 * line_dedup.BINS, -1, -1 - line_dedup.BINS]
    rows = [(token, i, 0, k) for token, times in zip([*same_bin, 7, 0], [1, 3, 1, 2, 1, 1, 4], strict=True) for i in range(times) for k in range(1 + (token == 0))]
    df = spark.createDataFrame(rows, "token long, id long, th long, line_no int")
    found = line_dedup.standing_again(df)
    times = Counter(r[0] for r in rows)
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(r for r in rows if times[r[0]] > 1)
    here = Window.partitionBy("bin", "token").orderBy(*line_dedup.AT)
    ranked = found.select("*", F.row_number().over(here).alias("rank"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort [") == 1
