"""Operator 3, quality by compression: two zstandard dictionaries and one calibrated difference.

One dictionary is built from good and one from bad labelled texts. Each text is
compressed with both in blocks of BLOCK bytes, so that the dictionaries count
as much at a long text's end as at its start. The normalised difference of the
two sizes goes through a logistic curve that is fitted on other labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lowest_hashes, small_batches, text_of

BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: Labelled texts of each class that the fit reads at most, of at most so many characters each.
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 20_000
THRESHOLD = 0.7


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "compressors"):
            self.compressors = []
            for raw in (self.bad, self.good):
                data = zstandard.ZstdCompressionDict(raw)
                data.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
        return self.compressors

    def difference(self, text: str) -> float:
        """(size by the bad dictionary - size by the good one) / their sum; 0 for an empty text."""
        bad, good = self._compressors()
        raw = memoryview(text.encode())
        blocks = [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
        b, g = sum(len(bad.compress(x)) for x in blocks), sum(len(good.compress(x)) for x in blocks)
        return (b - g) / (b + g) if blocks else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        d = np.array([self.difference(x) for x in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.offset, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> CompressionClassifier:
    """A classifier from the ``docs`` that have a text and a label, 1 for good or 0 for bad, in ``labels``.

    It reads at most ``sample_rows`` rows of each class, of at most
    ``sample_chars`` characters each, those of the lowest id hashes (equal
    hashes by text): odd ranks for the dictionaries, which see all their
    blocks, even ones for the logistic curve, weighted by the classes' shares
    of all labelled rows. With one class alone or none, as in an empty table,
    every score is the share of label 1 (0.5 where nothing is known). Repeated
    rows of an id each count; rows without a text or a label don't.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.length(F.col(text_col).cast("string")).alias("chars")).where("chars is not null")
    labelled = sizes.join(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)"), "id")
    labelled = labelled.select("id", "y", F.xxhash64("id", F.lit(3)).alias("h"), F.col("chars").between(1, sample_chars).alias("fits"))
    tally = labelled.groupBy("y").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).collect()
    share, texts = {r["y"]: r["n"] for r in tally}, {0: [], 1: []}
    for r in tally:
        ids = lowest_hashes(labelled.where((F.col("y") == r["y"]) & F.col("fits")), "h", sample_rows, r["fit"]).select("id", "h")
        got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, sample_chars))
        got = got.join(F.broadcast(ids.dropDuplicates(["id"])), "id").orderBy("h", "text").limit(sample_rows)
        texts[r["y"]] = [x["text"] for x in got.select("text").collect()]
    prior = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
    model = CompressionClassifier(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    if min(len(texts[0]), len(texts[1])) < 2:
        return model
    model.good, model.bad = (_dictionary(texts[y][::2]) for y in (1, 0))
    d = np.array([model.difference(x) for y in (0, 1) for x in texts[y][1::2]])
    y = np.repeat([0.0, 1.0], [len(texts[0][1::2]), len(texts[1][1::2])])
    weight = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum()))
    model.slope, model.offset = _logistic(d, y, weight / weight.mean())
    return model


def _dictionary(texts: list[str]) -> bytes:
    raw = [x.encode() for x in texts]
    blocks = [x[a : a + BLOCK] for x in raw for a in range(0, len(x), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its own bytes serve as the dictionary
        return b"".join(raw)[-DICTIONARY_BYTES:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic regression on one feature, by Newton steps on the scaled feature."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(2), gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of each row with score (0 to 1) and predicted (1 from the threshold on).

    Null texts count as empty; an empty text has no difference and gets the
    curve's value at 0. Repeated rows get the same score; an empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    data = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(f"`{text_col}`").alias("judged_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column("judged_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    scored = data.mapInArrow(judge, data.drop("judged_text").schema.add("score", "double"))
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
