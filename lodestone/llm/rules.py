"""Operator 10, quality rules by distribution divergence, with DataFrame functions alone.

Every document gets counts of its character classes and of common words. The
mean histograms of the documents of a language that pass the base rules are
the language's reference; a document is dropped where its Jensen-Shannon
distance from the reference of its language is too large, unless it is too
short to tell. How far common words can be from a reference at most depends on
how many of them the language's documents hold, so that limit is a share of
the distance of a document without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, text_of

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20

# Common function words of the languages with their own references.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as with",
    "de": "der die und in den von zu das mit sich des ist",
    "fr": "de la le et les des en un du une que est",
    "es": "de la que el en y a los se del las un",
}

#: Distance from 0 (same histogram) to 1 (nothing shared) of the character classes beyond which a document is dropped.
MOST_CLASS_DISTANCE = 0.3
#: A document is dropped where its common words are this near to having none: the share of the distance that a document
#: without a common word has from its language's reference, while its share of common words is under this part of the
#: reference's. A language whose own documents hold fewer common words than the last share has no such rule.
MOST_WORD_SHARE = 0.9
LEAST_COMMON_PART = 0.25
LEAST_COMMON_SHARE = 0.05
#: Documents of fewer words pass: their histograms say too little.
GUARD_WORDS = 50


def bind(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that the array holds at least twice."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.when(F.size(w) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def twice(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return bind(bind(pairs, marked), covered)

    return bind(bind(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice(h))).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts of each row: the base rules' numbers, character classes and common words."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    common = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    found = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(common))
    counts = bind(found, lambda f: F.transform(F.array(*map(F.lit, common)), lambda w: F.size(F.filter(f, lambda x: x == w))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length("text").alias("chars"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"),
        F.regexp_count("text", F.lit(r"\p{Nd}")).alias("digits"),
        counts.alias("common"),
    )
    space = F.col("chars") - F.col("word_chars")
    other = F.col("chars") - F.col("letters") - F.col("digits") - F.col("n_symbols") - space
    classes = F.array(*(x.cast("int") for x in (F.col("upper"), F.col("letters") - F.col("upper"), F.col("digits"), F.col("n_symbols"), space, F.greatest(other, F.lit(0)))))
    rest = F.col("n_words").cast("int") - F.aggregate("common", F.lit(0), lambda a, x: a + x)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), classes.alias("classes"), F.concat("common", F.array(rest)).alias("common"))


def shares(counts: Column) -> Column:
    """The histogram as shares of its sum (zeros where the sum is zero)."""
    return bind(F.aggregate(counts, F.lit(0), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance with base 2 logarithms, from 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        side = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(F.lit(0.0))
        return (side(a) + side(b)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)))


def distance_without(rest: Column) -> Column:
    """The distance of a document of other words alone from a histogram whose share of other words is ``rest``."""
    side = F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(F.lit(0.0))
    return F.sqrt(((1 - rest) + F.log2(2 / (1 + rest)) + side) / 2)


def references(counted: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): mean shares over the documents of a language that pass the base rules."""
    sizes = {"classes": 6, "common": len({w for x in COMMON_WORDS.values() for w in x.split()}) + 1}
    usable = counted.where(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    usable = usable.select("lang", *(shares(F.col(c)).alias(c) for c in sizes))
    means = [F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    found = usable.groupBy("lang").agg(*means)
    return found.select(F.col("lang").alias("ref_lang"), *(F.array(*(f"{c}{i}" for i in range(n))).alias(f"ref_{c}") for c, n in sizes.items()))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept), a row for each row.

    Null texts count as empty and fail the base rules. Documents without a
    language are compared with each other. Where a language has no document
    to refer to, or the document is below the guards, the distances don't
    count. Repeated rows get the same verdict; other columns are not read.
    """
    counted = durable(features(docs, id_col, text_col, lang_col))
    joined = counted.join(references(counted), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    distance = lambda c: divergence(shares(F.col(c)), F.col(f"ref_{c}"))
    found = joined.withColumns({"class_distance": distance("classes"), "word_distance": distance("common")})
    long = F.col("n_words") >= GUARD_WORDS
    far = long & (F.col("class_distance") > MOST_CLASS_DISTANCE)
    rest = lambda c: F.element_at(c, -1)
    own, usual = 1 - rest(shares(F.col("common"))), 1 - rest(F.col("ref_common"))
    odd = long & (usual >= LEAST_COMMON_SHARE) & (own < LEAST_COMMON_PART * usual) & (F.col("word_distance") > MOST_WORD_SHARE * distance_without(1 - usual))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_distance",
        "word_distance",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False)) & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )
