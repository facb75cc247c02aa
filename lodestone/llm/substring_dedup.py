"""Operator 9, suffix-array dedup: every byte of a repeated string of LENGTH bytes goes.

Every string of LENGTH bytes holds an anchor, the KMER bytes with the smallest
hash in it, so that equal strings have equal anchors at equal places. Spark
counts the anchors by their bytes. Anchors with the same bytes and the same
surroundings repeat with all strings around them; anchors with the same bytes
but other surroundings are sorted by the suffixes that start at them and by the
reversed prefixes that end there, both by deep-shallow sorting. The common
prefixes of neighbours in the two orders then tell exactly which strings around
an anchor occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, small_batches, text_of
from lodestone.llm.suffix_sort import common_prefixes, sorted_rows

LENGTH = 400
KMER = 100
#: Bytes that one step of the anchor search handles, and surroundings that one step of the sort handles.
STEP_BYTES = 1 << 20
STEP_ROWS = 8192
#: Anchors with more different surroundings are compared by the hashes of their strings, which Spark deals out.
MOST_SURROUNDINGS = 50_000
BASE = 0x9E3779B97F4A7C15


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each position, built by doubling."""
    known: dict[int, np.ndarray] = {1: data.astype(np.uint64) + np.uint64(1)}
    m = 1
    while 2 * m <= k:
        h = known[m]
        known[2 * m] = h[:-m] * np.uint64(pow(BASE, m, 1 << 64)) + h[m:]
        m *= 2
    n, done, out = len(data) - k + 1, 0, None
    for m in sorted(known, reverse=True):
        if k - done >= m:
            part = known[m][done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, m, 1 << 64)) + part
            done += m
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    m = 1
    while 2 * m <= width:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    rest = width - m
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH, k: int = KMER) -> np.ndarray:
    """Positions of the anchors of all strings of ``length`` bytes that lie within one of the texts that end at ``ends``."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < length:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    key = (kmer_hashes(raw, k) & ~low) | np.arange(len(raw) - k + 1, dtype=np.uint64)
    least = (window_minima(key, length - k + 1) & low).astype(np.int64)
    inside = np.zeros(len(least), bool)
    for a, z in zip(np.append(0, ends[:-1]), ends, strict=True):
        inside[a : max(a, z - length + 1)] = True
    return np.unique(least[inside])


def text_anchors(texts: list[bytes], length: int = LENGTH, k: int = KMER) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, positions) of the texts' anchors."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= STEP_BYTES):
            size += len(texts[last])
            last += 1
        if last == first + 1:  # perhaps a very long text: in overlapping parts
            text = texts[first]
            parts = [a + anchors(text[a : a + 8 * STEP_BYTES + length - 1], np.array([min(len(text) - a, 8 * STEP_BYTES + length - 1)]), length, k) for a in range(0, len(text), 8 * STEP_BYTES)]
            yield first, np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        else:
            ends = np.cumsum([len(x) for x in texts[first:last]])
            found = anchors(b"".join(texts[first:last]), ends, length, k)
            cut = np.searchsorted(found, np.append(0, ends))
            for i in range(last - first):
                yield first + i, found[cut[i] : cut[i + 1]] - (ends[i - 1] if i else 0)
        first = last


def repeated_offsets(left: list[bytes], right: list[bytes], group: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and the most bytes before it in a string of ``length`` that another anchor's surroundings hold too; -1 if none.

    ``left`` are the bytes before, reversed, at most length - k; ``right`` the
    bytes from the anchor on, at most ``length``; equal anchors have one group.
    """
    n, span = len(left), length - k
    least, most = np.full(n, -1), np.full(n, -1)
    classes = []
    for side, width, skip in ((right, length, k // 8), (left, span, 0)):
        width = -(-width // 8) * 8
        matrix = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in side), np.uint8).reshape(n, width)
        size = np.array([len(x) for x in side])
        order = sorted_rows(matrix, group, skip)
        classes.append((order, common_prefixes(matrix, size, order, group), size))
    (r_order, r_common, r_size), (l_order, l_common, l_size) = classes
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(span + 1):
        after = length - before
        valid = np.flatnonzero((l_size >= before) & (r_size >= after))
        if len(valid) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < after)
        l_class[l_order] = np.cumsum(l_common < before)
        key = r_class[valid] * (n + 1) + l_class[valid]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = valid[by[np.append(same, False) | np.append(False, same)]]
        most[hit] = before
        least[hit] = np.where(least[hit] < 0, before, least[hit])
    return least, most


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, k: int = KMER) -> DataFrame:
    """(t, start, stop): ranges of bytes to remove from the distinct ``texts`` (t, text); they may overlap."""
    span = length - k

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode() for x in b.column("text").to_pylist()]
            row, pos, h, ctx = [], [], [], []
            for i, found in text_anchors(raw, length, k):
                text = raw[i]
                for p in found.tolist():
                    row.append(i)
                    pos.append(p)
                    h.append(xxhash.xxh3_64_intdigest(text[p : p + k]))
                    ctx.append(xxhash.xxh3_64_intdigest(text[max(0, p - span) : p + length], min(p, span)))
            yield pa.RecordBatch.from_arrays(
                [b.column("t").take(pa.array(row, pa.int32())), pa.array(pos, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64))], ["t", "pos", "h", "ctx"]
            )

    long = texts.where(F.octet_length("text") >= length)
    found = durable(long.select("t", "text").mapInArrow(find, long.select("t").schema.add("pos", "integer").add("h", "long").add("ctx", "long")))
    by_ctx = durable(found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("t", "pos")).alias("one")))
    by_h = by_ctx.groupBy("h").agg(F.count("*").alias("different"), F.count_if(F.col("n") == 1).alias("single"))
    whole = found.join(by_ctx.where("n > 1").select("h", "ctx"), ["h", "ctx"]).select("t", F.greatest(F.lit(0), F.col("pos") - span).alias("start"), (F.col("pos") + length).alias("stop"))

    # One anchor for each surroundings; those that stand there twice are partners only.
    open_ = by_ctx.join(by_h.where("different > 1 and single > 0"), "h").select("one.t", "one.pos", "h", "different", (F.col("n") == 1).alias("single"))
    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, at) in enumerate(zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True)):
                raw = text.encode()
                own = b.column("t").take(pa.array([i] * len(at), pa.int32()))
                part = [pa.array([x[c] for x in at], kind) for c, kind in (("pos", pa.int32()), ("h", pa.int64()), ("different", pa.int64()), ("single", pa.bool_()))]
                left = [raw[max(0, x["pos"] - span) : x["pos"]][::-1] for x in at]
                right = [raw[x["pos"] : x["pos"] + length] for x in at]
                yield pa.RecordBatch.from_arrays([own, *part, pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["t", "pos", "h", "different", "single", "left", "right"])

    schema = texts.select("t").schema.add("pos", "integer").add("h", "long").add("different", "long").add("single", "boolean").add("left", "binary").add("right", "binary")

    def around(some: DataFrame) -> DataFrame:
        by_text = some.groupBy("t").agg(F.collect_list(F.struct("pos", "h", "different", "single")).alias("at"))
        return by_text.join(texts.select("t", "text"), "t").mapInArrow(surround, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
            # Equal hashes of different bytes part here.
            own = np.array([xxhash.xxh64_intdigest(x[:k]) for x in right], np.uint64)
            group = np.unique(np.stack([t.column("h").to_numpy().view(np.uint64), own], 1), axis=0, return_inverse=True)[1].ravel()
            least, most = repeated_offsets(left, right, group, length, k)
            pos = t.column("pos").to_numpy().astype(np.int64)
            hit = np.flatnonzero((most >= 0) & t.column("single").to_numpy(zero_copy_only=False))
            keys = t.column("t").combine_chunks().take(pa.array(hit))
            return pa.RecordBatch.from_arrays([keys, pa.array((pos - most)[hit].astype(np.int32)), pa.array((pos - least + length)[hit].astype(np.int32))], ["t", "start", "stop"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(len(x) for x in held) >= STEP_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(-(h != h[-1]).astype(int), 0)) if h[0] != h[-1] else 0
                if cut:  # the last group may go on
                    yield run(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if sum(len(x) for x in held):
            yield run(pa.Table.from_batches(held))

    ranges = texts.select("t").schema.add("start", "integer").add("stop", "integer")
    usual = around(open_.where(F.col("different") <= MOST_SURROUNDINGS)).repartition("h").sortWithinPartitions("h").mapInArrow(compare, ranges)
    found_ranges = whole.unionByName(usual)
    if by_h.where(F.col("different") > MOST_SURROUNDINGS).isEmpty():
        return found_ranges
    return found_ranges.unionByName(_by_string_hash(around(open_.where(F.col("different") > MOST_SURROUNDINGS)), length, k))


def _by_string_hash(around: DataFrame, length: int, k: int) -> DataFrame:
    """The same ranges for anchors with very many surroundings: every string around them is a row, and Spark counts them."""
    span = length - k

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (left, right) in enumerate(zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True)):
                raw = left[::-1] + right
                befores = range(max(0, length - len(right)), min(span, len(left)) + 1)
                d = [xxhash.xxh3_128_digest(raw[len(left) - o : len(left) - o + length]) for o in befores]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array([i] * len(d), pa.int32())) for c in ("t", "pos", "single")), pa.array(list(befores), pa.int32()), pa.array(d, pa.binary())], ["t", "pos", "single", "before", "digest"])

    rows = around.mapInArrow(strings, around.select("t", "pos", "single").schema.add("before", "integer").add("digest", "binary"))
    twice = rows.groupBy("digest", "before").agg(F.count("*").alias("n")).where("n > 1").select("digest", "before")
    hit = rows.where("single").join(twice, ["digest", "before"]).groupBy("t", "pos").agg(F.min("before").alias("least"), F.max("before").alias("most"))
    return hit.select("t", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + length).cast("int").alias("stop"))


def merged(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, that cover the same bytes; ranges that touch are one."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        z = min(z, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        elif a < z:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KMER, keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with kept, the bytes that stay, if asked for.

    Null texts count as empty. Texts under ``length`` bytes lose nothing. A
    text that stands in two rows, with equal ids or not, goes as a whole if it
    is long enough. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    keyed = rows.select(_text_key(F.col("text")).alias("key"), "text")
    distinct = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    # Numbers, fixed by this table, stand for the texts in all that is shuffled: they are half as wide as keys, and rows of one text compress.
    texts = durable(distinct.select(F.monotonically_increasing_id().alias("t"), "key", "copies", "text"), tidy=True)
    ranges = durable(repeated_ranges(texts.select("t", "text"), length, k).groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), tidy=True)
    joined = texts.join(ranges, "t", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copies, found in zip(b.column("text").to_pylist(), b.column("copies").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw = text.encode()
                size = len(raw)
                gone = [(0, size)] if copies > 1 and size >= length else merged([(x["start"], x["stop"]) for x in found or ()], size)
                edges = [0, *(e for r in gone for e in r), size]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else raw
                out.append((size, size - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = texts.select("key").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    done = joined.select("key", "text", "copies", "ranges").mapInArrow(cut, schema)
    ids = rows.select("id", _text_key(F.col("text")).alias("key"))
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
    return ids.join(done, "key").select(F.col("id").alias(id_col), *columns)
