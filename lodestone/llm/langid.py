"""Operator 2, language ID by interpolated Kneser-Ney character models.

Spark counts the character 4-grams of all labelled training texts by language.
From those counts each language gets an interpolated Kneser-Ney model; the
models are arrays sorted by n-gram hash, for each order one with probabilities
and one with the back-off weights of its contexts. All n-grams of all languages
are kept: a language's distinct character 4-grams are far fewer than its
characters and saturate as a corpus grows. A text gets
the language of the lowest cross-entropy per character; it is rejected where
even that is far above what the language's own training texts show.

White space, digits and symbols count as one word boundary, combining marks are
parts of words, and letter case is ignored; a text without letters has no
language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable, give_back, small_batches, text_of

ORDER = 4
NO_LETTER = "und"
#: The calibration scores at most so many training texts of each language, those of the lowest id hashes.
CALIBRATION_ROWS = 4000
#: A language with fewer calibration texts takes the spread around its median from all languages.
OWN_ROWS = 20
#: A text is rejected where its cross-entropy is this many times that of the worst unseen texts of its language.
CEILING_MARGIN = 1.4
#: A table of at most so many languages is broadcast; a larger one is joined by a shuffle.
BROADCAST_LANGS = 10_000
#: Distinct counts that a counting task holds before it passes them on.
HELD_GRAMS = 1_000_000
DISCOUNT = 0.75
PAD = "\U0010ffff"


#: Code points without a character of their own in 16 bits, which stand for the letters beyond.
SPARE, SPARES = 0xD800, 0xF900 - 0xD800


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for all but letters and the marks on them, 1 for the pad, else the lower-case letter.

    Letters beyond 16 bits take the place of surrogates and private characters,
    in turns, so that those of one script all differ.
    """
    table = np.zeros(sys.maxunicode + 1, np.uint64)
    for c in range(sys.maxunicode):
        if (x := chr(c)).isalpha() or unicodedata.category(x)[0] == "M":
            low = ord(x.lower()[0])
            table[c] = low if low < 1 << 16 else SPARE + low % SPARES
    table[sys.maxunicode] = 1
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, three pads before each and one after the last, and where each text's first pad stands."""
    pads = PAD * (ORDER - 1)
    joined = "".join(pads + (x.replace(PAD, " ") if PAD in x else x) for x in texts) + pads[:1]
    s = symbol_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    pad = np.flatnonzero(s == 1)
    return s, pad[: len(texts) * (ORDER - 1)][:: ORDER - 1]


def grams(s: np.ndarray) -> np.ndarray:
    """The packed 4-gram that ends at each symbol from the fourth on."""
    g = s[: -ORDER + 1].copy()
    for k in range(1, ORDER):
        g <<= np.uint64(16)
        g |= s[k : len(s) - ORDER + 1 + k]
    return g


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of packed n-grams."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): added up within the task, as far as it can hold them."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        g, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return g, np.bincount(at, np.concatenate([n for _, n in parts]).astype(float)).astype(np.int64)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = merged(parts)
            for a in range(0, len(g), 50_000):
                part = g[a : a + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[a : a + 50_000])], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
        for lang in set(langs):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            size = 0
            first = 0
            for i, x in enumerate(own):
                size += len(x)
                if size >= 1 << 20 or i == len(own) - 1:
                    s, _ = symbols(own[first : i + 1])
                    g = grams(s)
                    held.setdefault(lang, []).append(np.unique(g[(s[ORDER - 1 :] != 1)], return_counts=True))
                    if len(held[lang]) >= 8:
                        held[lang] = [merged(held[lang])]
                    first, size = i + 1, 0
        if sum(len(p[0]) for x in held.values() for p in x) > HELD_GRAMS:
            yield from passed_on()
    yield from passed_on()
    give_back()


@dataclass
class KneserNey:
    """One language: for each order the sorted n-gram hashes with probabilities, and the sorted context hashes with back-off weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    probs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-6

    @classmethod
    def of(cls, top: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the sorted 4-grams and their counts; lower orders count the distinct characters before them."""
        by_order = {ORDER: (top, counts.astype(float))}
        for k in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << 16 * k) - 1)
            by_order[k] = tuple(x.astype(t) for x, t in zip(np.unique(by_order[k + 1][0] & mask, return_counts=True), (np.uint64, float), strict=True))
        model = cls(floor=1.0 / (len(by_order[1][0]) + 1))
        for k in range(1, ORDER + 1):
            g, c = by_order[k]
            ctx, start, seen = np.unique(g >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(c, start)
            discount = np.minimum(DISCOUNT, c)
            lost = np.add.reduceat(discount, start) / total
            own = np.repeat(np.arange(len(ctx)), seen)
            lower = model.floor if k == 1 else model.prob(k - 1, g & np.uint64((1 << 16 * (k - 1)) - 1))
            for keys, values, into, beside in ((ctx, lost, model.contexts, model.weights), (g, (c - discount) / total[own] + lost[own] * lower, model.grams, model.probs)):
                hashes = mixed(keys)
                order = np.argsort(hashes)
                into.append(hashes[order])
                beside.append(values[order])
        return model

    def prob(self, k: int, g: np.ndarray) -> np.ndarray:
        """Interpolated probability of the last character of each packed k-gram."""
        if k == 0:
            return np.full(len(g), self.floor)
        h = mixed(g)
        at = np.minimum(np.searchsorted(self.grams[k - 1], h), len(self.grams[k - 1]) - 1)
        p = self.probs[k - 1][at]
        missing = np.flatnonzero(self.grams[k - 1][at] != h)
        if len(missing):
            rest = g[missing]
            ctx = mixed(rest >> np.uint64(16))
            at = np.minimum(np.searchsorted(self.contexts[k - 1], ctx), len(self.contexts[k - 1]) - 1)
            weight = np.where(self.contexts[k - 1][at] == ctx, self.weights[k - 1][at], 1.0)
            p[missing] = weight * self.prob(k - 1, rest & np.uint64((1 << 16 * (k - 1)) - 1))
        return p


@dataclass
class LanguageModels:
    """All languages."""

    langs: list[str]
    models: list[KneserNey]
    sharpness: float = 1.0
    ceilings: np.ndarray | None = None

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
        langs = sorted(counts)
        return cls(langs, [KneserNey.of(*counts[x]) for x in langs])

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) nats per symbol over the whole text, and the number of letters of each text."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        first, size = 0, 0
        step = max(1 << 14, (1 << 20) // max(4, len(self.langs)))  # so many symbols at once, each with a number for each language
        for i, x in enumerate(texts):
            size += len(x)
            if size >= step or i == len(texts) - 1:
                s, starts = symbols(texts[first : i + 1])
                g = grams(s)
                known, at = np.unique(g, return_inverse=True)  # each distinct n-gram is looked up once
                real = s[ORDER - 1 :] != 1
                n = np.maximum(np.add.reduceat(real.astype(np.int64), starts), 1)
                for k, model in enumerate(self.models):
                    logs = np.log(model.prob(ORDER, known))[at]
                    logs[~real] = 0
                    out[first : i + 1, k] = -np.add.reduceat(logs, starts) / n
                letters[first : i + 1] = np.add.reduceat((s[ORDER - 1 :] > 1).astype(np.int64), starts) * [any(map(str.isalpha, x)) for x in texts[first : i + 1]]  # marks alone are no letters
                first, size = i + 1, 0
        return out, letters

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy of the best language, and whether it is rejected."""
        if not self.langs:
            return [NO_LETTER] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        ce, letters = self.cross_entropies(texts)
        best = ce.argmin(1)
        z = -self.sharpness * np.minimum(letters, 200)[:, None] * (ce - ce.min(1, keepdims=True))
        score = 1 / np.exp(z).sum(1)
        low = ce.min(1)
        ceiling = self.ceilings[best] if self.ceilings is not None else np.full(len(texts), np.inf)
        # A short text's cross-entropy spreads more widely around its language's own.
        rejected = (letters == 0) | (low > ceiling * (1 + 2 / np.sqrt(np.maximum(letters, 1))))
        return [self.langs[b] if k else NO_LETTER for b, k in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0), low, rejected


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModels:
    """Models of the languages of ``labelled``, from all its rows with a text and a language.

    The 4-gram counts cover every row, and every distinct 4-gram enters the
    model of its language. Up to CALIBRATION_ROWS rows of each language fix
    the score's sharpness and the language's ceiling for rejection, judged by
    models without the counts of these rows. Repeated rows count as often as
    they stand there; rows without a text or a language teach nothing, and
    without any row there is no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    counted = durable(rows.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sample = durable(_calibration_sample(rows))
    seen = sample.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("m"))
    found = counted.join(seen, ["lang", "gram"], "left").select("lang", "gram", "n", (F.col("n") - F.coalesce("m", F.lit(0))).alias("rest")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    lang_of = names.indices.to_numpy(zero_copy_only=False)
    g, n, rest = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy(), found.column("rest").to_numpy()
    counts, unseen = {}, {}
    for i, lang in enumerate(names.dictionary.to_pylist()):
        own = np.flatnonzero(lang_of == i)
        own = own[np.argsort(g[own])]
        counts[lang] = (g[own], n[own])
        own = own[rest[own] > 0]
        if len(own):
            unseen[lang] = (g[own], rest[own])
    models = LanguageModels.of(counts)
    if counts:
        _calibrate(models, LanguageModels.of(unseen), sample)
    return models


def _calibration_sample(rows: DataFrame) -> DataFrame:
    """(lang, text, weight): of each language a tenth of its rows, OWN_ROWS at least unless that is over half, CALIBRATION_ROWS at most.

    The weight is the number of rows that a row of the sample stands for.
    """
    sizes = rows.groupBy("lang").agg(F.count("*").alias("total"))
    wanted = F.least(F.lit(CALIBRATION_ROWS), F.greatest(F.floor(F.col("total") / 10), F.least(F.lit(OWN_ROWS), F.floor(F.col("total") / 2))))
    sizes = sizes.withColumn("wanted", wanted).where("wanted > 0")
    hashed = rows.withColumn("h", F.xxhash64("id", F.length("text"))).withColumn("share", F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    # About 1.5 times the wanted rows are sorted, whatever the input.
    few = sizes.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    low = hashed.join(F.broadcast(sizes) if few else sizes, "lang").where(F.col("share") < (1.5 * F.col("wanted") + 100) / F.col("total"))
    first = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("share", "h"))).where(F.col("k") <= F.col("wanted"))
    return first.select("lang", "text", (F.col("total") / F.col("wanted")).alias("weight"))


def _calibrate(models: LanguageModels, judges: LanguageModels, sample: DataFrame) -> None:
    """Sharpness and ceilings from the sample, which the judges haven't seen."""
    steps = 2.0 ** np.arange(-8, 2)
    shared = sample.sparkSession.sparkContext.broadcast(judges)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(shared.value.langs)}
        for b in batches:
            at = np.array([index.get(x, -1) for x in b.column("lang").to_pylist()], int)
            ce, letters = shared.value.cross_entropies(b.column("text").to_pylist())
            use = np.flatnonzero((at >= 0) & (letters > 0))
            ce, letters, own = ce[use], letters[use], ce[use, at[use]]
            losses = np.zeros((len(use), len(steps)))
            for k, sharpness in enumerate(steps):
                z = -sharpness * np.minimum(letters, 200)[:, None] * (ce - ce.min(1, keepdims=True))
                losses[:, k] = -np.maximum(z[np.arange(len(use)), at[use]] - np.log(np.exp(z).sum(1)), -50)
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(use)), pa.array(own), pa.array(list(losses), pa.list_(pa.float64())), b.column("weight").take(pa.array(use))], ["lang", "own", "losses", "weight"])
        give_back()

    # Where no row could be held back, random letters are the ceiling.
    models.ceilings = np.array([-np.log(m.floor) for m in models.models])
    if not judges.langs:
        return
    got = sample.mapInArrow(score, "lang string, own double, losses array<double>, weight double").toArrow()
    shared.destroy()
    if not len(got):
        return
    langs, own = np.array(got.column("lang").to_pylist(), object), got.column("own").to_numpy()
    losses = np.array(got.column("losses").to_pylist()).reshape(-1, len(steps))
    models.sharpness = float(steps[np.average(losses, 0, got.column("weight").to_numpy()).argmin()])
    found = {x: own[langs == x] for x in set(langs)}
    large = [x for x in found.values() if len(x) >= OWN_ROWS] or list(found.values())
    spread = np.quantile(np.concatenate([x / np.median(x) for x in large]), 0.999)
    worst = {k: np.quantile(x, 0.999) if len(x) >= OWN_ROWS else np.median(x) * spread for k, x in found.items()}
    models.ceilings = CEILING_MARGIN * np.array([worst.get(x, max(worst.values())) for x in models.langs])


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred, score, cross_entropy and rejected.

    A null text, or one without a letter, is ``und`` with score 0, rejected.
    Ties go to the language that sorts first. Rows are judged one by one, so
    repeated rows get the same result and an empty table gives none.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    data = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(f"`{text_col}`").alias("judged_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, low, rejected = shared.value.decide(b.column("judged_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], [*b.schema.names[:-1], *names])
        give_back()

    schema = data.drop("judged_text").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return data.mapInArrow(judge, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *names)
