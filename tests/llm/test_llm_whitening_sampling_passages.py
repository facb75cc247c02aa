"""Whitening, importance resampling and passage dedup against plain computations."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import importance, passage_dedup, whitening, word_windows

VECTORS = "vec_id long, embedding array<float>, id int, v int, n string, component int"


def vectors(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS)


def test_whitening_is_exact(spark):  # noqa: ANN001
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 12)) * [100, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1e-2] + rng.standard_normal((300, 12)) * 0.01
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(base)]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [math.nan] * 12), (904, [math.inf] + [0.0] * 11), (905, [1.0, 2.0]), (906, [3e38] * 12), (None, rows[0][1]), (3, rows[3][1])]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    used = [v for _, v in rows] + [rows[0][1], rows[3][1]]
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert Counter(r["vec_id"] for r in got if r["component"] == 1) == Counter([i for i, _ in rows] + [None, 3])
    assert {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=False)}
    assert all(r["deviation"] == want[r["vec_id"]] and r["deviation_wide"] is None for r in got if r["vec_id"] is not None)
    cov = np.array([[float(sum(Fraction(n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in x) / n**3) for j in range(12)] for i in range(12)])
    values = np.linalg.eigvalsh(cov)[::-1]
    assert [r["explained"] for r in got[:8]] == pytest.approx((values / values.sum())[:8], rel=1e-9)
    assert got[0]["identity_error"] < 1e-9
    w = np.array([[r["whitened"] for r in got if r["component"] == k] for k in range(1, 9)])
    assert np.abs(np.cov(w, bias=True) - np.eye(8)).max() < 1e-9
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    by_row = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for k in range(8):
        plain = (centred @ axes[:, k] / np.sqrt(values[k]))[:300]
        own = np.array([by_row[(i, k + 1)] for i in range(300)])
        assert min(np.abs(own - plain).max(), np.abs(own + plain).max()) < 1e-6


def test_whitening_of_few_and_of_wide_vectors(spark):  # noqa: ANN001
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns[0] == "vec_id"
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, None, None)] * 4
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and flat[0]["identity_error"] < 1e-9
    huge = whitening.whiten(vectors(spark, [(i, [float(i) * 2**40, 1.0]) for i in range(40)])).where("component = 1").collect()
    x = [i * 2**50 + 100000 for i in range(40)]
    assert [(r["deviation"], r["deviation_wide"]) for r in sorted(huge, key=lambda r: r["vec_id"])][3] == (None, (40 * x[3] - sum(x)) ** 2)


def test_remainders():
    moduli = whitening.primes(4)
    assert len(set(moduli)) == 4 and all(p < 1 << 21 and all(p % d for d in range(2, 1500)) for p in moduli)
    for value in (0, 1, -1, 10**24, -(10**24), -123456789123456789):
        assert whitening.remaindered([value % p for p in moduli], moduli) == value


def plain_sample(rows, target, sizes, percent, least):  # noqa: ANN001, ANN201
    def features(text):  # noqa: ANN001, ANN202
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]

    def bucket(f):  # noqa: ANN001, ANN202
        return zlib.crc32(f.encode()) % 10000

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, x in found for f in x), Counter(bucket(f) for x in target for f in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())

    def gain(b):  # noqa: ANN001, ANN202
        return math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))

    out = []
    for i, n, x in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3)])
def test_importance(spark, docs_of, words, sizes):  # noqa: ANN001
    rows = [(i, " ".join(words(15 + i % 30, i)) + "! É-Straße ΣΑΣ 7up\x00A_B") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "ONE two"), (103, "w " * 60_000), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]
    target = [None, "", " ".join(words(200, 3))]
    aims = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs_of(rows), aims, sizes=sizes, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_sample(rows, target, sizes, 30, 20)
    assert importance.resample(docs_of([]), aims).count() == 0
    assert Counter(map(tuple, importance.resample(docs_of(rows[:30]), aims.where("false")).collect())) == plain_sample(rows[:30], [], (1, 1), 10, 20)


def plain_passages(rows, size):  # noqa: ANN001, ANN201
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, split, strict=True):
        for s in range(len(w) - size + 1):
            key, own = tuple(w[s : s + size]), (i is not None, i or 0, s)
            first[key] = min(first.get(key, own), own)
    out = Counter()
    for (i, _), w in zip(rows, split, strict=True):
        gone = {x for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < (i is not None, i or 0, s) for x in range(s, s + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("size", "k", "group"), [(20, 8, 4096), (6, 3, 2), (6, 2, 10**6)])
def test_passages(spark, docs_of, words, size, k, group, monkeypatch):  # noqa: ANN001
    shared = [" ".join(words(30, 100 + j)) for j in range(4)]
    rows = [(i, " ".join(words(25, i)) + (" \n" if i % 2 else "\t\x0b") + shared[i % 4] + "\r\n" + " ".join(words(9, 50 + i))) for i in range(40)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "w " * 5000), (64, " x y" * 300 + " z"), (65, "Ünïcode \x00 日本 " * 12), (66, "Ünïcode \x00  日本 " * 12), (67, "long" * 300_000 + " " + shared[0])]
    rows += [(90, rows[3][1]), (2, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (7, rows[8][1]), (None, rows[9][1]), (None, shared[1])]
    monkeypatch.setattr(passage_dedup, "STEP_SUFFIXES", 64)
    got = passage_dedup.remove_passages(docs_of(rows), size=size, k=k, group=group)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_passages(rows, size)
    assert passage_dedup.remove_passages(docs_of([])).count() == 0


def test_passages_on_documents(spark):  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, passage_dedup.remove_passages(docs).collect())) == plain_passages(rows, 20)


def test_texts_of_megabytes(spark, docs_of, words):  # noqa: ANN001
    many = words(300_000, 9)
    rows = [(1, " ".join(many)), (2, "\n".join([*words(10, 3), *many[100_000:100_050], *words(10, 4)])), (3, " ".join(many[:25]) + " end")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passage_dedup.remove_passages(docs_of(rows)).collect()}
    assert got == {1: (300_000, 0), 2: (70, 50), 3: (26, 25)}
    weighed = importance.resample(docs_of(rows), docs_of(rows).where("doc_id = 3"), percent=50).collect()
    assert {r["doc_id"]: r["n_features"] for r in weighed} == {1: 300_000, 2: 70, 3: 26} and sum(r["rank"] is not None for r in weighed) == 1


def test_subtrees():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2, 4000).astype(np.uint64)
    start, group = np.arange(3990), rng.integers(0, 3, 3990)
    suffix, node = passage_dedup.deep_nodes(codes, start, group, 10)
    alike: dict = {}
    for i in range(3990):
        alike.setdefault((group[i], *codes[i : i + 10].tolist()), set()).add(i)
    found: dict = {}
    for i, x in zip(suffix.tolist(), node.tolist(), strict=True):
        found.setdefault(x, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in alike.values() if len(x) > 1)


def test_words_of_a_batch(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(word_windows, "STEP_BYTES", 16)
    texts = ["", "a", " a b\n", "", "b\x0ba", "x" * 100 + " a", "é a"]
    w = word_windows.Words(pa.array(texts))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert w.row.tolist() == [i for i, x in enumerate(split) for _ in x]
    assert [w.data.tobytes()[a:z].decode() for a, z in zip(w.start, w.stop, strict=True)] == sum(split, [])
    by = dict(zip(sum(split, []), w.hashes().tolist(), strict=True))
    assert w.hashes().tolist() == [by[x] for x in sum(split, [])] and len(set(by.values())) == len(by)
    pieces = list(word_windows.parts([pa.record_batch([pa.array(texts)], ["text"])]))
    assert [x for p in pieces for x in p.column("text").to_pylist()] == texts and len(pieces) > 1
