"""Operator 7, token counts: huge documents are encoded in overlapping chunks and spliced.

A document of over ``chunk_chars`` characters becomes rows of overlapping
chunks, which Spark spreads over its tasks. Each chunk reports, inside its two
overlaps, the positions at which a token starts right after white space, with
the number of tokens before each. The word tokenizer never joins characters
across white space, so these positions are boundaries in every encoding that
sees the white space: where two neighbours report the same one, they can be
cut there. An overlap without such a position is widened until it has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, text_of
from lodestone.llm.encoders import encoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
WORD_AFTER_SPACE = re.compile(r"\s(?=\S)")


def chunk_bounds(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks that cover the text; each reaches into the next until they share a word start."""
    bounds, start, size = [], 0, len(text)
    while True:
        end = start + chunk_chars
        if end >= size:
            bounds.append((start, size))
            return bounds
        width = overlap
        while end + width < size and not WORD_AFTER_SPACE.search(text, end, end + width):
            width *= 2
        bounds.append((start, min(size, end + width)))
        if end + width >= size:
            return bounds
        start = end


def boundaries(text: str, start: int, starts: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Positions in [low, high) of the document where a token starts after white space, and the tokens before each."""
    where, before = [], []
    for k, a in enumerate(starts):
        p = start + a
        if low < p < high and a and text[a - 1].isspace() and (k == 0 or starts[k - 1] < a):
            where.append(p)
            before.append(k)
    return where, before


def spliced(chunks: list[dict]) -> int | None:
    """Tokens of a document from its chunks, in order; None where two neighbours share no boundary."""
    total, done = 0, 0
    for this, after in zip(chunks, [*chunks[1:], None], strict=True):
        if after is None:
            return total + this["n_tokens"] - done
        ahead = dict(zip(after["head_at"], after["head_before"], strict=True))
        cut = next(((b, ahead[p]) for p, b in zip(this["tail_at"], this["tail_before"], strict=True) if p in ahead), None)
        if cut is None:
            return None
        total += cut[0] - done
        done = cut[1]
    return total


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    limit: int = 2048,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text: (id, n_bytes, n_tokens, over_limit), one row for each row.

    Null texts count as empty: no bytes, no tokens. Repeated rows each get a
    row; huge texts are encoded once for each distinct text. Other columns of
    ``docs`` are not read. Tokenizers whose words can't be encoded one by one
    encode each text whole.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    long = F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            counts = [enc.count(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    id_type = rows.schema["id"].dataType.simpleString()
    plain = f"id {id_type}, n_bytes long, n_tokens long"
    if not encoder(tokenizer).splits_words:
        counted = rows.select("id", "text", n_bytes).mapInArrow(whole, plain)
    else:
        short = rows.where(~long).select("id", "text", n_bytes).mapInArrow(whole, plain)
        huge = rows.where(long).select("id", n_bytes, "text", F.sha2("text", 256).alias("key"))
        counts = _huge_counts(huge, tokenizer, chunk_chars, overlap)
        counted = short.unionByName(huge.drop("text").join(counts, "key").select("id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _huge_counts(huge: DataFrame, tokenizer: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of the distinct huge texts."""
    texts = huge.groupBy("key").agg(F.any_value("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                bounds = chunk_bounds(text, chunk_chars, overlap)
                for k, (a, z) in enumerate(bounds):
                    head = bounds[k - 1][1] if k else a
                    tail = bounds[k + 1][0] if k + 1 < len(bounds) else z
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "start": a, "head": head, "tail": tail, "stop": z, "text": text[a:z]}], schema=chunk_schema)

    chunk_schema = pa.schema([("key", pa.string()), *((x, pa.int64()) for x in ("k", "start", "head", "tail", "stop")), ("text", pa.string())])
    part_schema = pa.schema([("key", pa.string()), ("k", pa.int64()), ("n_tokens", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("head_at", "head_before", "tail_at", "tail_before"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for r in b.to_pylist():
                starts = enc.token_starts(r["text"])
                head_at, head_before = boundaries(r["text"], r["start"], starts, r["start"], r["head"])
                tail_at, tail_before = boundaries(r["text"], r["start"], starts, r["tail"], r["stop"])
                out.append({"key": r["key"], "k": r["k"], "n_tokens": len(starts), "head_at": head_at, "head_before": head_before, "tail_at": tail_at, "tail_before": tail_before})
            yield pa.RecordBatch.from_pylist(out, schema=part_schema)

    chunks = texts.mapInArrow(cut, "key string, k long, start long, head long, tail long, stop long, text string")
    arrays = ", ".join(f"{x} array<long>" for x in ("head_at", "head_before", "tail_at", "tail_before"))
    # A chunk is dear to encode and small to move, so the count of tasks is fixed instead of following the bytes.
    tasks = max(int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * huge.sparkSession.sparkContext.defaultParallelism)
    parts = chunks.repartition(tasks, "key", "k").mapInArrow(encode, f"key string, k long, n_tokens long, {arrays}")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = [spliced(sorted(x, key=lambda r: r["k"])) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(totals, pa.int64())], ["key", "n_tokens"])

    by_text = parts.groupBy("key").agg(F.collect_list(F.struct("k", "n_tokens", "head_at", "head_before", "tail_at", "tail_before")).alias("parts"))
    found = by_text.mapInArrow(splice, "key string, n_tokens long")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            totals = [enc.count(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(totals, pa.int64())], ["key", "n_tokens"])

    # Widened to the whole text: chunks that share no boundary, though their overlap had a word start.
    failed = texts.join(found.where("n_tokens is null").select("key"), "key", "left_semi").mapInArrow(again, "key string, n_tokens long")
    return found.where("n_tokens is not null").unionByName(failed)
