"""Operator 12, importance resampling: documents that look like a target's texts are drawn more often.

Hashed n-gram counts of all documents and of the target give each bucket a gain,
the rounded-down log ratio of its smoothed shares. A document's weight is the sum
of its features' gains; Gumbel noise by its id makes the highest scores a draw
without replacement. All of it is Spark SQL functions: arrays of n-grams,
grouped counts, a broadcast table of as many rows as there are buckets, and a
distributed sort whose ranks are places in a partition plus the partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, text_of
from lodestone.llm.text_sets import bind

BUCKETS = 10_000
NGRAMS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: A gain table of more rows is not broadcast by hint.
MOST_BROADCAST = 1 << 20
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII; A to Z count as lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, NO_WORD), "")


def ngrams_of(words: Column, sizes: tuple[int, int] = NGRAMS) -> Column:
    """All runs of ``sizes[0]`` to ``sizes[1]`` words, joined by a space, repeats kept."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        at = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*(runs(n) for n in range(sizes[0], sizes[1] + 1)))) if sizes != (1, 1) else words


def bucketed(texts: DataFrame, text_col: str, buckets: int, sizes: tuple[int, int], *columns: Column) -> DataFrame:
    """(columns, n_words, found): the buckets of each text's features as one array."""

    def both(words: Column) -> Column:
        found = F.transform(ngrams_of(words, sizes), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
        return F.struct(F.size(words).cast("long").alias("n_words"), found.alias("found"))

    return texts.select(*columns, bind(words_of(text_of(f"`{text_col}`")), both).alias("f")).select("*", "f.n_words", "f.found").drop("f")


def bucket_counts(found: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how many features each bucket holds."""
    return found.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(found: DataFrame, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: how much likelier it is in ``wanted`` than in ``found``, as floor(1000 ln ratio) with one added to each count."""
    s, t = durable(bucket_counts(found, "s")), durable(bucket_counts(wanted, "t"))
    total = s.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0], t.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    both = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    up = (F.col("t") + 1).cast("double") * F.lit(float(total[0] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total[1] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 times standard Gumbel noise) that an id and the seed fix; a null id counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in the order of the columns; no task gets more than a range of it."""
    spot = F.monotonically_increasing_id()
    dealt = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot_", spot))
    part = F.shiftright("spot_", 33)
    sizes = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    # One row for each partition of the sort.
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    place = F.col("before_") + F.col("spot_").bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn("part_", part).join(F.broadcast(before), "part_").withColumn(name, place).drop("part_", "spot_", "n_", "before_")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, sizes: tuple[int, int] = NGRAMS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank counts the drawn rows from 1 and is null for all others.

    Null texts have no word; a text without features weighs 0. Of the rows with
    ``least_words`` words, ``percent`` in a hundred are drawn, rounded down, by
    falling score, ties by id, null first. Repeated rows are drawn each. Without
    documents there is no row; without target texts all gains follow from the
    documents alone. Other columns are not read.
    """
    found = bucketed(docs, text_col, buckets, sizes, F.col(f"`{id_col}`").alias("id"))
    # The rows' numbers are fixed by this table.
    table = durable(found.withColumn("row", F.monotonically_increasing_id()))
    gain = gains(table, bucketed(target, target_col, buckets, sizes), buckets)
    gain = F.broadcast(gain) if buckets <= MOST_BROADCAST else gain
    features = table.select("row", "id", "n_words", F.size("found").cast("long").alias("n_features"), F.explode_outer("found").alias("bucket"))
    weighed = features.join(gain, "bucket", "left").groupBy("row", "id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = durable(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    may = scored.where(F.col("n_words") >= least_words)
    drawn = may.count() * percent // 100
    order = ranked(may, [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("row")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words)
    return order.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
