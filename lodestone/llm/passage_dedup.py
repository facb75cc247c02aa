"""Operator 13, substring dedup by words: windows of SIZE words that also start earlier lose their words.

A generalised suffix tree of all texts, cut off at SIZE words, is split by
prefixes into groups that fit into memory. Only suffixes that can repeat enter
it: every window of SIZE words has an anchor, the KMER words in it with the
smallest hash, and one whose anchor stands nowhere else can't repeat. Suffixes
around one anchor travel as one run of words and are dealt by the anchor; where
more than GROUP anchors are alike, the prefix that deals a suffix grows to the
whole window, so that a group holds GROUP anchors or a single deep node. Each
task builds its subtrees from the top: all nodes split at once by their next
words, and a suffix alone in its node leaves. What is left are the internal
nodes of depth SIZE, the repeats; all their leaves but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, small_batches, text_of
from lodestone.llm.word_windows import Words, mixed, parts, window_anchors

SIZE = 20
KMER = 8
#: Anchors alike up to which their suffixes share a group, and suffixes that one step of the tree building handles.
GROUP = 4096
STEP_SUFFIXES = 1 << 17
#: Words on an edge of a subtree.
EDGE = 4


def deep_nodes(codes: np.ndarray, start: np.ndarray, group: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, nodes): the suffixes that share ``size`` words with another of their group, and their nodes.

    ``codes`` are the words of all suffixes, which start at ``start``. Nodes are
    split from the top, level by level, all at once; leaves drop out.
    """
    left, node = np.arange(len(start)), group.astype(np.int64)
    for depth in range(0, size, EDGE):
        counts = np.unique(node, return_inverse=True, return_counts=True)
        shared = counts[2][counts[1]] > 1
        left, node = left[shared], counts[1][shared]
        if not len(left):
            break
        label = [codes[start[left] + d] for d in range(depth, min(depth + EDGE, size))]
        by = np.lexsort((*label, node))
        split = np.zeros(len(by), bool)
        for part in (*label, node):
            split[1:] |= part[by][1:] != part[by][:-1]
        left, node = left[by], np.cumsum(split)
    counts = np.unique(node, return_inverse=True, return_counts=True)
    shared = counts[2][counts[1]] > 1 if len(node) else np.zeros(0, bool)
    return left[shared], node[shared]


class Runs:
    """Runs of words, each with consecutive suffixes: ``n`` of ``size`` words from its first word on."""

    def __init__(self, column: pa.Array, n: np.ndarray, size: int):
        self.words, self.size = Words(column), size
        self.codes = self.words.hashes()
        self.run = np.repeat(np.arange(len(n)), n)
        self.nth = np.arange(len(self.run)) - np.repeat(np.cumsum(n) - n, n)
        self.start = self.words.first[self.run] + self.nth
        self.raw = self.words.data.tobytes()

    def bytes_of(self, x: int) -> bytes:
        """The words of a suffix; those of a run stand one space apart."""
        a = self.start[x]
        return self.raw[self.words.start[a] : self.words.stop[a + self.size - 1]]

    def same(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether all pairs of suffixes are the same bytes."""
        return all(self.bytes_of(x) == self.bytes_of(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def earliest(suffix: np.ndarray, node: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): for each leaf of a node that is later than its earliest one, this one and the leaf."""
    by = np.lexsort((start[suffix], rank[suffix], node))
    suffix, node = suffix[by], node[by]
    lead = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    first = np.repeat(suffix[lead], np.diff(np.append(lead, len(node))))
    later = (rank[first] != rank[suffix]) | (start[first] != start[suffix])
    return first[later], suffix[later]


def text_keys(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, t1, t2, ...): the row's id and a 128-bit hash of its text."""
    text = text_of(f"`{text_col}`")
    extra = [text.alias("text")] if "text" in more else []
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), *extra)


def repeated_anchors(keyed: DataFrame, size: int = SIZE, k: int = KMER, group: int = GROUP) -> DataFrame:
    """(t1, at): for each text the places, from 1, of the anchors that stand elsewhere too; negative where more than ``group`` are alike.

    Copies of a text count once. Places are word numbers within the text.
    """

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(batch.column("text"))
        anchors, hashes, _, _ = window_anchors(words.hashes(), words, size, k)
        row = words.row[anchors]
        return hashes.view(np.int64), batch.column("t1").to_numpy()[row], (anchors - words.first[row]).astype(np.int32)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            h, t, at = places(b)
            mark = t * np.int64(1_000_003) + at
            by = np.lexsort((mark, h))
            h, mark = h[by], mark[by]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            end = np.append(cut[1:], len(h))[: len(cut)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[cut], mark[cut], mark[end - 1], end - cut)], ["h", "low", "high", "n"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in places(b)], ["h", "t1", "at"])

    texts = keyed.select("t1", "text").where(F.length("text") >= 2 * size - 1)
    counts = texts.mapInArrow(counted, "h long, low long, high long, n long").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    repeated = durable(counts.where("low != high").select("h", (F.col("n") > group).alias("many")), tidy=True)
    found = texts.mapInArrow(listed, "h long, t1 long, at int").join(repeated, "h")
    place = F.when(F.col("many"), -1 - F.col("at")).otherwise(F.col("at") + 1)
    return found.select("t1", place.alias("at")).groupBy("t1").agg(F.collect_set("at").alias("at"))


def _ranks(ids: pa.Array) -> np.ndarray:
    """The order of ids, null first; equal ids have one rank."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _suffix_runs(size: int, k: int):  # noqa: ANN202
    """A function over (id, t1, t2, text, at) that gives the runs of the anchors at ``at``: the first suffix, how many, and the words.

    Of equal runs of a batch only the earliest keeps its words; the suffixes of
    the others are settled, and come out without.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            words = Words(b.column("text"))
            codes = words.hashes()
            anchors, hashes, first, last = window_anchors(codes, words, size, k)
            at = b.column("at")
            value = at.flatten().to_numpy()
            wanted = words.first[np.repeat(np.arange(len(b)), np.asarray(at.value_lengths()))] + np.abs(value) - 1
            by = np.argsort(wanted)
            wanted, many = np.append(wanted[by], -1), np.append(value[by] < 0, False)
            spot = np.searchsorted(wanted[:-1], anchors)
            hit = np.flatnonzero(wanted[spot] == anchors)
            many, first, last, hashes = many[spot[hit]], first[hit], last[hit], hashes[hit]
            # Where many are alike, each window is a run of its own, dealt by all its words.
            pieces = np.where(many, last - first + 1, 1)
            run = np.repeat(np.arange(len(hit)), pieces)
            s = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.where(many[run], 1, last[run] - s + 1)
            whole = words.windows(codes, size)[0]
            key = np.where(many[run], whole[s] if len(s) else 0, hashes[run]).view(np.int64)
            raw = words.data.tobytes()
            text = [b" ".join(raw[a:z].split()) for a, z in zip(words.start[s].tolist(), words.stop[s + n + size - 2].tolist(), strict=True)]
            row = words.row[s]
            place, rank = s - words.first[row], _ranks(b.column("id"))[row]
            seen: dict = {}
            settled = np.zeros(len(s), bool)
            for i in np.lexsort((place, rank)).tolist():
                own = (rank[i], place[i])
                settled[i] = seen.setdefault((key[i], n[i], text[i]), own) != own
            keep = pa.array([None if gone else x for gone, x in zip(settled.tolist(), text, strict=True)], pa.binary())
            # Settled runs meet no others: they are dealt by where they are, not by a key that many share.
            spread = mixed(b.column("t1").to_numpy().view(np.uint64)[row] + place.astype(np.uint64)).view(np.int64)
            key, take = np.where(settled, spread, key), pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "t1", "t2")), pa.array(key), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), keep], ["id", "t1", "t2", "key", "start", "n", "run"])

    return make


def _repeats(size: int):  # noqa: ANN202
    """A function over runs in the order of (key, id, start) that gives the (id, t1, t2, start, n) of windows that an earlier one holds.

    Groups are finished one after another, so that about STEP_SUFFIXES suffixes are held; a group of whole windows is one node, of which the earliest leaf is held.
    """

    def judge(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ids, t1, t2, key, place, n, run = (t.column(c).combine_chunks() for c in ("id", "t1", "t2", "key", "start", "n", "run"))
        runs = Runs(run, n.to_numpy(), size)
        group = np.unique(key.to_numpy(), return_inverse=True)[1][runs.run]
        rank, start = _ranks(ids)[runs.run], place.to_numpy()[runs.run] + runs.nth
        suffix, node = deep_nodes(runs.codes, runs.start, group, size)
        first, later = earliest(suffix, node, rank, start)
        if not runs.same(first, later):  # words of one hash: nodes are split by the bytes
            node = np.unique(np.array([runs.bytes_of(x) for x in suffix.tolist()], object), return_inverse=True)[1]
            first, later = earliest(suffix, node, rank, start)
        take = pa.array(runs.run[later])
        return pa.RecordBatch.from_arrays([ids.take(take), t1.take(take), t2.take(take), pa.array(start[later].astype(np.int32)), pa.array(np.ones(len(later), np.int32))], ["id", "t1", "t2", "start", "n"])

    columns = ["id", "t1", "t2", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size_held = 0
        for b in batches:
            settled = np.asarray(b.column("run").is_null())
            if settled.any():
                gone = b.filter(pa.array(settled))
                yield pa.RecordBatch.from_arrays([gone.column(c) for c in columns], columns)
                b = b.filter(pa.array(~settled))
            if not len(b):
                continue
            held.append(b)
            size_held += int(np.asarray(b.column("n")).sum())
            if size_held >= STEP_SUFFIXES:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut:  # the last group may go on
                    yield judge(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                else:  # one group of whole windows: its first row stands for all before
                    yield judge(t)
                    held = t.slice(0, 1).to_batches()
                size_held = sum(int(np.asarray(x.column("n")).sum()) for x in held)
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = KMER, group: int = GROUP, keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, with kept, the words that stay, if asked for.

    A word goes if a window of ``size`` words that covers it also starts
    earlier: in a row of a smaller id, null being the smallest, or in the same
    row further ahead. Rows of one id don't precede each other, so repeated rows
    share a result. Null texts have no word, and texts under ``size`` words lose
    none. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    keyed = text_keys(docs, id_col, text_col, "text")
    # Only the first row of equal texts is searched: all windows of the others start earlier.
    firsts = text_keys(docs, id_col, text_col).groupBy("t1", "t2").agg(F.min(F.struct("id")).alias("first"))
    at = durable(firsts.join(repeated_anchors(keyed, size, k, group), "t1").select("t1", "t2", F.col("first.id").alias("id"), "at"), tidy=True)
    named = at.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("id").alias("a_id"), "at")
    searched = keyed.join(named, (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2")) & F.col("id").eqNullSafe(F.col("a_id"))).select("id", "t1", "t2", "text", "at")
    own = keyed.select("id", "t1", "t2").schema
    runs = searched.mapInArrow(_suffix_runs(size, k), own.add("key", "long").add("start", "integer").add("n", "integer").add("run", "binary"))
    own = keyed.select("id", "t1", "t2").schema
    found = runs.repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(_repeats(size), own.add("start", "integer").add("n", "integer"))
    gone = durable(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n")).alias("gone")), tidy=True)
    judged = firsts.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), "first").join(gone.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), "gone"), ["a1", "a2"], "left")
    joined = keyed.join(judged, (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2")), "left").select("id", "text", F.col("first.id").eqNullSafe(F.col("id")).alias("leads"), "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = []
            for text, leads, ranges in zip(b.column("text").to_pylist(), b.column("leads").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = text.encode().split()  # at the same six bytes
                total = len(words)
                if not leads and total >= size:
                    words = []
                elif ranges and leads:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, [r["start"] for r in ranges], 1)
                    np.add.at(edge, [r["start"] + r["n"] + size - 1 for r in ranges], -1)
                    words = [w for w, over in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not over]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            cols = zip(*out, strict=True) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = keyed.select("id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    done = joined.mapInArrow(cut, schema)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text)
