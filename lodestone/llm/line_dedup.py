"""Operator 6, line dedup by an exact set-similarity join, with DataFrame functions alone.

A line's tokens are its five-word shingles. Lines with the same token set form
one class, which its first line represents; further copies are later matches
without any comparison. Between classes, the tokens of each set are put in one
global order, rare ones first, so that two sets of a Jaccard similarity of at
least the threshold share a token in short prefixes. Classes meet at these
prefix tokens, under length and positional filters, first each with the
earliest class at its token, and only those that this leaves standing with all
earlier ones, where a bitmap of each set bounds how much two can share. The
survivors of the filters are verified exactly.

A line goes if an earlier line (by document id, then line number) has at least
the threshold's similarity to it; all lines are judged on the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, text_of
from lodestone.llm.text_sets import SHINGLE_WORDS, WORD, bind, shingles_of, words_of

THRESHOLD = 0.8
#: Words are counted in so many hash buckets. A token is as rare as the bucket of its first word.
BUCKETS = 4096
HASH_BITS = 56
#: Tokens are put in so many bins to find those that stand more than once, some thousand rows of a bin at 30 GB.
BINS = 1 << 19
AT = ("id", "th", "line_no")


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, th, text, keep): rows with equal id and text are one document; th tells texts of one id apart, if any id has two rows."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"), kept.alias("keep"))
    again = not rows.groupBy("id").count().where("count > 1").isEmpty()
    th = F.xxhash64("text") if again else F.lit(0).cast("long")
    return rows.select("id", th.alias("th"), "text", "keep")


def _lines(keyed: DataFrame) -> DataFrame:
    exploded = keyed.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(WORD))


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity_classes(keyed: DataFrame) -> Column:
    """For each bucket the rounded-up logarithm of its words' count over all texts, as an array of BUCKETS numbers, each above HASH_BITS."""
    counted = keyed.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).groupBy(_bucket(F.col("word")).alias("bucket"))
    classes = counted.agg(F.ceil(4 * F.log2(F.count("*") + 1)).cast("int").alias("class")).collect()  # at most BUCKETS rows
    found = {r["bucket"]: r["class"] for r in classes}
    return F.split(F.lit(",".join(str(found.get(b, 0) << HASH_BITS) for b in range(BUCKETS))), ",").cast("array<bigint>")


def _each_shingle(line: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each shingle of a line, given as the hashes of its first word and of all its words; of fewer words ``shingles_of`` them."""

    def many(h: Column) -> Column:
        firsts = F.slice(h, F.lit(1), F.size(h) - (SHINGLE_WORDS - 1))
        return F.transform(firsts, lambda x, i: of(x, F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE_WORDS)))))

    def keyed(w: Column) -> Column:
        return F.when(F.size(w) >= SHINGLE_WORDS, bind(F.transform(w, lambda x: F.xxhash64(x)), many)).otherwise(shingles_of(w))

    return bind(words_of(line), keyed)


def ordered_tokens(line: Column, classes: Column) -> Column:
    """The line's distinct tokens in the global order: rare classes first, then by hash."""
    mask = F.lit((1 << HASH_BITS) - 1)
    rarity = lambda first: F.coalesce(classes[first.bitwiseAND(F.lit(BUCKETS - 1))], F.lit(0).cast("long"))
    # Arrays that can't hold nulls are sorted as plain numbers.
    return F.sort_array(F.array_distinct(_each_shingle(line, lambda first, whole: rarity(first).bitwiseOR(whole.bitwiseAND(mask)))))


def _least_common(nx: Column, ny: Column, threshold: float) -> Column:
    """Tokens that sets of these sizes share at least when they reach the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (nx + ny) - 1e-9)


def _may_match(x: str, y: str, threshold: float) -> Column:
    """Length filter, and positional filter for the first token that both prefixes share."""
    nx, ny, jx, jy = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.j"), F.col(f"{y}.j")
    return (nx >= threshold * ny - 1e-9) & (ny >= threshold * nx - 1e-9) & (F.least(nx - jx, ny - jy) >= _least_common(nx, ny, threshold))


def bitmap(hashes: Column) -> tuple[Column, Column]:
    """128 bits, each the parity of how many of the hashes fall on it, as two numbers."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    bits = lambda half: F.aggregate(half, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    half = lambda side: F.filter(hashes, lambda h: h.bitwiseAND(64) == side)
    return bits(half(0)).alias("even"), bits(half(64)).alias("odd")


def _bits_allow(x: str, y: str, threshold: float) -> Column:
    """Bitmap filter: the sets differ in at least as many tokens as their bitmaps in bits."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("even", "odd")), F.lit(0))
    return nx + ny - differ >= 2 * _least_common(nx, ny, threshold)


def standing_again(at_token: DataFrame) -> DataFrame:
    """The rows whose token another row has too, and their bin; dealt by bin and sorted by token and place in it.

    Most tokens stand once. To start a window anew at each of them costs more
    than the row itself, so this looks at the rows beside, a bin of tokens at a time.
    """
    beside = Window.partitionBy("bin").orderBy("token", *AT)
    binned = at_token.select("*", F.col("token").bitwiseAND(F.lit(BINS - 1)).alias("bin"))
    both = binned.select("*", F.lag("token").over(beside).alias("before"), F.lead("token").over(beside).alias("after"))
    return both.where("before = token or after = token").drop("before", "after")


def standing_lines(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The lines that stay, (id, th, line_no), among those with a word."""
    classes = rarity_classes(keyed)
    sets = _lines(keyed).select(*AT, ordered_tokens(F.col("line"), classes).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - F.ceil(threshold * n - 1e-9).cast("int") + 1)
    by_set = sets.select(F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(7), "tokens").alias("k2"), F.struct(*AT, n.alias("n"), F.when(n > 1, prefix).alias("prefix")).alias("first"))
    # A class is known by the place of its first line.
    firsts = durable(by_set.groupBy("k1", "k2").agg(F.min("first").alias("f")).select("f.*"), tidy=True)

    at_token = firsts.select(F.posexplode("prefix").alias("j", "token"), *AT, "n")
    again = standing_again(at_token)
    here = Window.partitionBy("bin", "token").orderBy(*AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # dealt and sorted already
    leader = [F.first(c).over(here).alias(f"first_{c}") for c in (*AT, "n", "j")]  # plain columns: a struct would be shuffled beside them
    ranked = again.select("token", *AT, "n", "j", F.row_number().over(here).alias("rank"), *leader).where("rank > 1")
    met = durable(ranked.select("token", "rank", F.struct(F.struct(*AT).alias("at"), "n", "j").alias("y"), F.struct(F.struct(*(F.col(f"first_{c}").alias(c) for c in AT)).alias("at"), F.col("first_n").alias("n"), F.col("first_j").alias("j")).alias("x")), tidy=True)

    ends = met.select(F.explode(F.array("x.at", "y.at")).alias("at")).distinct()
    by_doc = ends.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list("at").alias("wanted"))
    of_wanted = lambda lines: F.transform("wanted", lambda at: F.struct(at.alias("at"), F.get(lines, at["line_no"]).alias("line")))
    texts = _with_text(by_doc, keyed, "inner").select(F.inline(bind(F.split("text", "\n"), of_wanted)))  # one split for all lines of a text
    hashed = texts.select("at", F.array_distinct(_each_shingle(F.col("line"), lambda _, whole: whole)).alias("hashes"))
    lines = durable(hashed.select("at", "hashes", *bitmap(F.col("hashes"))), tidy=True)

    def verified(pairs: DataFrame) -> DataFrame:
        """(at) of the later lines of those pairs (y, x) that reach the threshold."""
        of = lambda c: lines.select(F.col("at").alias(c), F.col("hashes").alias(f"of_{c}"))
        both = pairs.distinct().join(of("y"), "y").join(of("x"), "x")
        sized = both.select("y", F.size("of_x").alias("nx"), F.size("of_y").alias("ny"), F.size(F.array_intersect("of_x", "of_y")).alias("shared"))
        return sized.where(F.col("shared") >= threshold * (F.col("nx") + F.col("ny") - F.col("shared")) - 1e-9).select(F.col("y").alias("at")).distinct()

    with_leader = met.where(_may_match("x", "y", threshold)).select(F.col("y.at").alias("y"), F.col("x.at").alias("x"))
    first_removed = durable(verified(with_leader), tidy=True)
    marked = first_removed.select("at", F.lit(True).alias("gone"))
    members = met.select("token", "rank", "y.*").join(lines.select("at", "even", "odd").hint("shuffle_hash"), "at").join(marked.hint("shuffle_hash"), "at", "left")
    members = members.select("token", "rank", "gone", F.struct("at", "n", "j", "even", "odd").alias("y"))
    later = members.where(F.col("gone").isNull() & (F.col("rank") > 2)).select("token", "rank", "y")
    earlier = members.select("token", F.col("rank").alias("earlier"), F.col("y").alias("x"))
    met_later = later.join(earlier, "token").where((F.col("earlier") < F.col("rank")) & _may_match("x", "y", threshold) & _bits_allow("x", "y", threshold))
    last_removed = durable(verified(met_later.select(F.col("y.at").alias("y"), F.col("x.at").alias("x"))), tidy=True)
    gone = first_removed.unionByName(last_removed)
    return firsts.select(F.struct(*AT).alias("at")).join(gone.hint("shuffle_hash"), "at", "left_anti").select("at.*")


def _with_text(by_doc: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    right = keyed.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "text")
    return by_doc.hint("shuffle_hash").join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), how)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, n_lines, n_removed, *keep) of every row, the text without the lines that go.

    Lines without a word stay and are no matches. Null texts count as empty.
    Rows with equal id and text are one document: each gets the same text. An
    empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col, keep)
    by_doc = standing_lines(keyed, threshold).groupBy("id", "th").agg(F.collect_set("line_no").alias("stay"))
    right = by_doc.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "stay")
    joined = keyed.join(right.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    lines = joined.select("id", "keep", F.split("text", "\n").alias("lines"), F.coalesce("stay", F.array().cast("array<int>")).alias("stay"))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    kept = lines.select("id", "keep", "lines", F.sort_array(F.array_union("stay", blank)).alias("kept"))
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    return kept.select(F.col("id").alias(id_col), text.alias(text_col), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"), *(F.col("keep").getField(c).alias(c) for c in keep))
