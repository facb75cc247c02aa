"""Operator 8, near-duplicates by BagMinHash over multisets of five-word shingles.

Documents with equal shingles are one text from the start. Each text gets a
BagMinHash signature, cut into bands; texts that share a band, directly or by
way of others, form a cluster of candidates. A large cluster is dealt into
blocks of bounded size. They meet a few of its texts first; blocks of what these
join needn't meet each other, all others do, every two in one place: there
signatures tell which pairs may reach the threshold, and those are verified exactly by their
multisets, the likeliest first, unless verified links join them already. So
every link between candidates counts, while only a forest of them is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestone.llm import bagminhash
from lodestone.llm.common import durable, small_batches, text_of
from lodestone.llm.components import components
from lodestone.llm.text_sets import shingles

THRESHOLD = 0.8
SLOTS = 125
BAND_ROWS = 5
#: Standard errors below the threshold at which a signature's estimate still counts as possible.
SLACK = 4.0
#: Texts of a cluster that one block holds.
BLOCK_ROWS = 512
#: Texts of a larger cluster that all its texts meet first, at most.
HUBS = 8
#: Shingles that one step of a signature task handles.
STEP = 1 << 18


def _signed(docs: DataFrame) -> DataFrame:
    """(id, th, k, n, bands, sketch) of rows (id, text)."""
    small_batches(docs.sparkSession)
    grams = docs.select("id", F.xxhash64("text").alias("th"), shingles(F.col("text")).alias("grams"))
    keyed = grams.select("id", "th", F.struct(F.xxhash64("grams").alias("k1"), F.xxhash64(F.lit(7), "grams").alias("k2")).alias("k"), "grams")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            grams = b.column("grams")
            values = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sig = bagminhash.signatures(*bagminhash.weighted(values, np.repeat(np.arange(len(n)), n)), len(n), SLOTS)
            cut = bagminhash.bands(sig, BAND_ROWS).view(np.int64)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * cut.shape[1])
            sketch = sig.astype(np.uint16)
            return pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), b.column("k"), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(cut.ravel())), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["id", "th", "k", "n", "bands", "sketch"],
            )

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("grams").flatten())
            if size >= STEP:
                yield run(held)
                held, size = [], 0
        if any(len(x) for x in held):
            yield run(held)

    schema = keyed.drop("grams").schema.add("n", "long").add("bands", ArrayType(LongType())).add("sketch", "binary")
    return keyed.mapInArrow(sign, schema)


def _numbered(values: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: each value with how often it came before."""
    v = np.sort(values)
    new = np.append(True, v[1:] != v[:-1])
    nth = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    return np.sort(v.view(np.uint64) ^ bagminhash.mixed(nth.astype(np.uint64)))


def _forest(sketch: np.ndarray, block: np.ndarray, across: bool, grams: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Verified links that join all texts which links of the threshold join; ``across`` leaves out pairs within a block."""
    n, least = len(sketch), threshold - SLACK * np.sqrt(threshold * (1 - threshold) / SLOTS)
    estimate, left, right = [], [], []
    for i in range(n - 1):
        agree = (sketch[i + 1 :] == sketch[i]).mean(1)
        at = np.flatnonzero((agree >= least) & (block[i + 1 :] != block[i]) if across else agree >= least)
        estimate.append(agree[at])
        left.append(np.full(len(at), i))
        right.append(at + i + 1)
    if not left:
        return []
    a, b = np.concatenate(left), np.concatenate(right)
    by = np.argsort(-np.concatenate(estimate), kind="stable")
    parent, sets, out = list(range(n)), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a[by].tolist(), b[by].tolist(), strict=True):
        ri, rj = root(i), root(j)
        if ri == rj:
            continue
        for x in (i, j):
            if x not in sets:
                sets[x] = _numbered(grams[x])
        x, y = sets[i], sets[j]
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if shared >= threshold * (len(x) + len(y) - shared) - 1e-9:
            parent[ri] = rj
            out.append((i, j))
    return out


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) that join what all links of a cluster join; ``members`` has (cluster, size, k, sketch, text).

    A cluster of more than BLOCK_ROWS texts is dealt into blocks. Every block
    meets a few of the cluster's texts first; what that joins is one part, whose
    blocks needn't meet each other. Blocks of the remaining texts meet all.
    """
    keys = [F.col("cluster.k1").alias("c1"), F.col("cluster.k2").alias("c2")]
    row = ["block", "k", "sketch", "text"]
    met = members.where(F.col("size") <= BLOCK_ROWS).select(*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), *row[1:])
    large = members.where(F.col("size") > BLOCK_ROWS)
    if large.isEmpty():
        return _compared(met, threshold)

    n_blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    some = large.groupBy("cluster", "size", F.pmod(F.xxhash64("k", F.lit(11)), F.lit(HUBS)).alias("hub")).agg(F.min(F.struct("k", "sketch", "text")).alias("h")).select("cluster", "size", "h.*")
    own = large.select(*keys, F.pmod(F.xxhash64("k"), n_blocks).cast("int").alias("i"), F.lit(-1).alias("j"), "k", "sketch", "text").withColumn("block", F.col("i"))
    hubs = some.select(*keys, F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("block"), *row[1:])
    columns = ["c1", "c2", "i", "j", *row]
    first = durable(_compared(met.select(*columns).unionByName(own.select(*columns)).unionByName(hubs.select(*columns)), threshold), tidy=True)

    # Parts of a cluster: what the first links join, if that is much, and all other texts together.
    named = durable(large.select("cluster", "k").join(components(first).withColumnRenamed("node", "k"), "k", "left"))
    sizes = named.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    kept = F.when(F.col("n") >= BLOCK_ROWS, F.col("component"))
    parts = sizes.groupBy("cluster", kept.alias("part")).agg(F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    # At most one part for each hub and one more in a cluster.
    listed = parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("part", "blocks"))).alias("parts"))
    start = F.transform("parts", lambda p, at: F.struct(p["part"].alias("part"), p["blocks"].alias("blocks"), F.aggregate(F.slice("parts", F.lit(1), at), F.lit(0), lambda a, q: a + q["blocks"]).alias("start")))
    placed = listed.select(F.col("cluster").alias("of"), start.alias("parts"))
    sized = sizes.select(F.col("cluster").alias("of"), F.col("component").alias("c"), "n")
    part_of = named.join(sized, (F.col("cluster") == F.col("of")) & F.col("component").eqNullSafe(F.col("c"))).select(F.col("k").alias("of_k"), kept.alias("part"))
    joined = large.join(part_of, F.col("k") == F.col("of_k")).join(placed, F.col("cluster") == F.col("of"))
    mine = F.get(F.filter("parts", lambda p: p["part"].eqNullSafe(F.col("part"))), F.lit(0))
    block = mine["start"] + F.pmod(F.xxhash64("k"), mine["blocks"]).cast("int")
    blocks_of = lambda p: F.sequence(p["start"], p["start"] + p["blocks"] - 1)
    others = F.flatten(F.transform(F.filter("parts", lambda p: p["part"].isNull() | F.col("part").isNull() | (p["part"] != F.col("part"))), blocks_of))
    dealt = joined.select("cluster", block.alias("block"), F.explode(others).alias("other"), *row[1:])
    rest = dealt.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *row)
    return first.unionByName(_compared(rest, threshold))


def _compared(met: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) of rows (c1, c2, i, j, block, k, sketch, text): within each group (c1, c2, i, j), of different blocks only where i and j differ."""
    dealt = met.repartition("c1", "c2", "i", "j").sortWithinPartitions("c1", "c2", "i", "j").select("c1", "c2", "i", "j", "block", "k", "sketch", shingles(F.col("text")).alias("grams"))
    keys = ["c1", "c2", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            block = t.column("block").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
            lists = t.column("grams").combine_chunks()
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            a, b = [], []
            for start, stop in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                grams = [values[ends[r - 1] if r else 0 : ends[r]] for r in range(start, stop)]
                for x, y in _forest(sketch[start:stop], block[start:stop], key[start, 2] != key[start, 3], grams, threshold):
                    a.append(start + x)
                    b.append(start + y)
            k = t.column("k").combine_chunks()
            return pa.RecordBatch.from_arrays([k.take(pa.array(a, pa.int64())), k.take(pa.array(b, pa.int64()))], ["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys], 1)
                cut = int(np.argmax((key == key[-1]).all(1)))
                if cut:  # the last group may go on
                    yield run(t.slice(0, cut).combine_chunks())
                held, rows = t.slice(cut).to_batches(), len(t) - cut
        if rows:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(compare, met.select(F.col("k").alias("a"), F.col("k").alias("b")).schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, class_id, class_th) of every row: its class's first document, by id and then text hash.

    Documents of a class are linked by similarities of at least the threshold.
    A document without a word (empty or null text) is a class of its own, and
    rows with equal id and text are one document. An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    signed = durable(_signed(rows), tidy=True)
    worded = signed.where("n > 0")
    nodes = durable(worded.groupBy("k").agg(F.min(F.struct("id", "th", "bands", "sketch")).alias("f")).select("k", "f.*"), tidy=True)

    in_band = nodes.select("k", F.explode("bands").alias("band"))
    centres = in_band.groupBy("band").agg(F.min("k").alias("a"), F.count("*").alias("size")).where("size > 1").select("band", "a")
    clusters = components(in_band.join(centres, "band").where("k != a").select("a", F.col("k").alias("b")))
    sized = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("size")), "component").select(F.col("node").alias("k"), F.col("component").alias("cluster"), "size")

    right = rows.select(F.col("id").alias("id2"), F.xxhash64("text").alias("th2"), "text")
    wanted = nodes.join(sized, "k").select("k", "id", "th", "sketch", "cluster", "size")
    matched = wanted.join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
    members = durable(matched.groupBy("k", "cluster", "size", "sketch").agg(F.any_value("text").alias("text")), tidy=True)
    found = components(_links(members, threshold))

    classes = worded.select("id", "th", "k").join(found.withColumnRenamed("node", "k"), "k", "left").select("id", "th", F.coalesce("component", "k").alias("class"))
    first = classes.groupBy("class").agg(F.min(F.struct("id", "th")).alias("first"))
    named = classes.join(first, "class").select("id", "th", "first")
    alone = signed.where("n = 0").select("id", "th", F.struct("id", "th").alias("first"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), "th", F.col("first.id").alias("class_id"), F.col("first.th").alias("class_th"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each class; all columns stay, whatever their names.

    Of rows with equal id and text one stays. Null texts and texts without a
    word are classes of their own; a null id comes first. An empty table gives
    an empty one.
    """
    same = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))
    first = near_duplicates(docs, id_col, text_col, threshold).where(same).select(F.col(id_col).alias("id"), "th")
    # The caller's columns travel in one struct, so that no name of theirs meets one of these.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(text_of(f"`{text_col}`")).alias("own_th"), whole.alias("row"))
    kept = keyed.join(first, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_th"]).select("row.*")
