"""Operator 1, best-fit packing by large-item matching.

Every text becomes pieces of at most ``capacity`` tokens. How many pieces have
each length is all that a packing depends on, and this histogram has at most
``capacity`` rows whatever the input, so the plan is made from it on the
driver: pieces above one third of the capacity (at most two fit together) are
matched greedily, the longest with the longest that still fits, and smaller
pieces then fill the tightest gaps, longest first. Spark ranks the pieces of
each length in parallel and joins them with the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, small_batches, text_of
from lodestone.llm.encoders import encoder

CAPACITY = 2048
SEPARATOR_ID = 0


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text's ids and a closing separator, cut at the capacity."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer), SEPARATOR_ID.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = memoryview(enc.packed(text) + end)
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names
            )

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first_rank, n, per_sequence, first_sequence, offset).

    The pieces of a length with ranks first_rank ... first_rank + n - 1 go, per_sequence
    to each, into consecutive sequences from first_sequence, in each one from offset on.
    """
    left, ranks, plan = dict(counts), dict.fromkeys(counts, 0), []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, how many)
    order: list[int] = []  # the gaps, ascending
    opened = 0

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        plan.append((length, ranks[length], n, each, first, offset))
        ranks[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            mate = next((b for b in reversed(large[: bisect.bisect_right(large, min(a, capacity - a))]) if left[b] >= 1 + (b == a)), None)
            first = opened
            if mate is None:
                n = left[a]
                put(a, n, 1, first, 0)
                used = a
            elif mate == a:
                n = left[a] // 2
                put(a, 2 * n, 2, first, 0)
                used = 2 * a
            else:
                n = min(left[a], left[mate])
                put(a, n, 1, first, 0)
                put(mate, n, 1, first, a)
                used = a + mate
            opened += n
            keep(capacity - used, first, n)
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect.bisect_left(order, x)
            if at == len(order):  # no gap holds it: open what the rest needs
                n = ceil(left[x] / (capacity // x))
                keep(capacity, opened, n)
                opened += n
                at = bisect.bisect_left(order, x)
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = min(gap // x, left[x])
            used = min(n, left[x] // each)
            put(x, used * each, each, first, capacity - gap)
            keep(gap - each * x, first, used)
            keep(gap, first + used, n - used)
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, rows_per_salt: int = 2_000) -> DataFrame:
    """Pack all texts: (id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A null or empty text is one piece with the separator alone. Repeated rows
    are packed each for itself; an empty table gives no row. Extra columns are
    not read. Sequences are gapless from offset 0.
    """
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, id_col, text_col, tokenizer, capacity))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(packing_plan(counts, capacity), "length long, first_rank long, n long, each long, first_sequence long, at long")

    # A frequent length is ranked in many parts, so that no task gets more than about rows_per_salt of its pieces.
    salts = spark.createDataFrame([(x, 1 + n // rows_per_salt) for x, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    per_salt = salted.groupBy("length", "salt").count()
    before = per_salt.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")))
    rank = F.col("before") + F.col("nth") - 1
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", rank)
    placed = placed.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
