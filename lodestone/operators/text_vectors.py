"""Text vectors by TF-IDF over a vocabulary that the whole table gives, sparse and of unit length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import bound
from lodestone.sources.shared import written

#: Frequent English function words; any other set can be given.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does down during each for from had has have he her here him his how if in into is it its "
    "just may me might more most must my no not of off on one only or other our out over own same she should since so some such than that the their them then there these they this those through to too "
    "under until up us very was we were what when where which while who whom why will with would you your"
).split()
#: Distinct terms up to which a vocabulary is broadcast by hint.
MOST_BROADCAST = 1 << 16


def words_of(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of two letters, digits or underscores or more, in lower case and without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: ~w.isin(stop_words))


def terms_of(text: Column, stop_words: list[str] = STOP_WORDS, grams: int = 2) -> Column:
    """The words of a text and runs of up to ``grams`` of them."""
    words = words_of(text, stop_words)

    def both(w: Column) -> Column:
        runs = [w]
        for n in range(2, grams + 1):
            # Each run is the one before, without its last, and the word that follows it.
            longer = F.zip_with(F.slice(runs[-1], F.lit(1), F.greatest(F.size(runs[-1]) - 1, F.lit(0))), F.slice(w, F.lit(n), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
            runs.append(longer)
        return F.flatten(F.array(*runs))

    return bound(words, both)


@dataclass
class TextVectors:
    """A fitted vocabulary: (term, idx, idf), as many rows as the vectors have dimensions."""

    vocabulary: DataFrame
    size: int
    stop_words: list[str]
    grams: int

    def _matched(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, idx, tf): how often each text holds each term."""
        terms = texts.select(F.col(id_col).alias("id"), F.explode(terms_of(F.col(text_col), self.stop_words, self.grams)).alias("term"))
        known = self.vocabulary.select("term", "idx")
        return terms.join(F.broadcast(known) if self.size <= MOST_BROADCAST else known, "term").groupBy("id", "idx").agg(F.count("*").alias("tf"))

    def _vectors(self, matched: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
        known = self.vocabulary.select(F.col("idx").alias("of"), "idf")
        weighed = matched.join(F.broadcast(known) if self.size <= MOST_BROADCAST else known, F.col("idx") == F.col("of")).select("id", "idx", (F.col("tf") * F.col("idf")).alias("w"))
        vectors = weighed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("raw"))
        length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        unit = vectors.select("id", bound(length, lambda of: F.transform("raw", lambda x: F.struct(x["idx"].alias("idx"), (x["w"] / of).alias("w")))).alias("vector"))
        none = F.array().cast("array<struct<idx:int,w:double>>")
        return texts.select(F.col(id_col).alias("id")).distinct().join(unit, "id", "left").select("id", F.coalesce("vector", none).alias("vector"))

    def transform(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, vector) of every text: the vector is an array of (idx, weight), by idx, of unit length; empty without a known term.

        Ids are taken to be unique: texts of one id are one text. The words of a
        text are counted where it is read, so what is shuffled has a row for each
        known term of a text.
        """
        return self._vectors(self._matched(texts, id_col, text_col), texts, id_col)


def _frequent_terms(texts: DataFrame, frequent: DataFrame, id_col: str, text_col: str, stop_words: list[str], grams: int) -> DataFrame:
    """(id, term, tf): how often each text holds each frequent word and each run of up to ``grams`` of these."""
    small = frequent.count() <= MOST_BROADCAST
    words = texts.select(F.col(id_col).alias("id"), words_of(F.col(text_col), stop_words).alias("w"))
    shifted = [F.slice("w", F.lit(n), F.greatest(F.size("w") - (n - 1), F.lit(0))).alias(f"w{n}") for n in range(2, grams + 1)]
    rows = words.select("id", F.explode(F.arrays_zip(F.col("w").alias("w1"), *shifted)).alias("x")).select("id", "x.*")
    terms, run = [], F.lit(True)
    for n in range(1, grams + 1):
        known = frequent.select(F.col("word").alias(f"f{n}"))
        rows = rows.join(F.broadcast(known) if small else known, F.col(f"w{n}") == F.col(f"f{n}"), "inner" if n == 1 else "left")
        run = run & F.col(f"f{n}").isNotNull()
        terms.append(F.when(run, F.concat_ws(" ", *(f"w{i}" for i in range(1, n + 1)))))
    return rows.select("id", F.explode(F.array(*terms)).alias("term")).where("term is not null").groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit_transform(texts: DataFrame, text_col: str = "text", size: int = 384, stop_words: list[str] = STOP_WORDS, grams: int = 2, id_col: str = "doc_id") -> tuple[TextVectors, DataFrame]:
    """A vocabulary of the texts, and their vectors by it.

    The vocabulary are the ``size`` terms with most occurrences in all texts,
    ties in the order of the alphabet, with idf = 1 + ln((1 + texts) / (1 +
    texts that hold it)). The texts are read twice: once for the words alone,
    and once for the terms of each text. A run comes no more often than any of
    its words, so only runs of words that come as often as the ``size``-th word
    can be chosen, and no others are counted.
    """
    spark = texts.sparkSession
    counts = written(texts.select(F.explode(words_of(F.col(text_col), stop_words)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    most = counts.orderBy(F.desc("n"), "word").limit(size).agg(F.count("*").alias("words"), F.min("n").alias("least")).first()
    frequent = counts.where(F.col("n") >= (most["least"] if most["words"] == size and size else 0)).select("word")
    candidates = written(_frequent_terms(texts, frequent, id_col, text_col, stop_words, grams))
    best = candidates.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    # At most ``size`` rows come to the driver.
    chosen = [(t, i) for i, t in enumerate(sorted(r["term"] for r in best.collect()))]
    known = spark.createDataFrame(chosen, "term string, idx int")
    matched = candidates.join(F.broadcast(known) if size <= MOST_BROADCAST else known, "term").select("id", "idx", "tf")
    held = {r["idx"]: r["df"] for r in matched.groupBy("idx").agg(F.count("*").alias("df")).collect()}
    n = texts.count()
    ready = spark.createDataFrame([(t, i, n, int(held.get(i, 0))) for t, i in chosen], "term string, idx int, n long, df long")
    idf = 1 + F.log((1 + F.col("n")).cast("double") / (1 + F.col("df")).cast("double"))
    model = TextVectors(ready.select("term", "idx", idf.alias("idf")), size, stop_words, grams)
    return model, model._vectors(matched, texts, id_col)


def fit(texts: DataFrame, text_col: str = "text", size: int = 384, stop_words: list[str] = STOP_WORDS, grams: int = 2, id_col: str = "doc_id") -> TextVectors:
    """The vocabulary of ``fit_transform``, for other texts."""
    return fit_transform(texts, text_col, size, stop_words, grams, id_col)[0]


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two sparse vectors; of unit vectors the cosine."""
    there = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(there, x["idx"]), F.lit(0.0)))


def most_similar(vectors: DataFrame, query: list[tuple[int, float]], k: int = 5) -> DataFrame:
    """(id, score) of the k texts nearest to a sparse query vector, by cosine, ties by id."""
    weights = dict(query)
    lookup = F.create_map(*(F.lit(x) for idx, w in weights.items() for x in (idx, float(w)))) if weights else F.lit(None).cast("map<int,double>")
    score = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(lookup, x["idx"]), F.lit(0.0)))
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
