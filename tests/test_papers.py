"""The paper database, documents, prices and exploration rewards."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import usage
from lodestone.operators import vector_search as vs
from lodestone.sources import files
from lodestone.sources.collections import Collections, CollectionSpec
from lodestone.sources.paged_api import PagedSource
from lodestone.sources.papers import Papers


def papers_of(spark, *rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(list(rows), "id string, title string, categories array<string>, published timestamp_ntz")


def test_paper_database(spark, tmp_path):  # noqa: ANN001
    from datetime import datetime

    store = Papers(spark, str(tmp_path / "p"), shards=4)
    one, two = datetime(2025, 8, 3, 5), datetime(2025, 8, 4)
    rows = [("2507_18009v1", "old", ["cs.AI"], one), ("2507.18009v3", "new", ["cs.AI"], one), ("2508.00001", "b", ["cs.LG"], two), ("2508.00002v1", "c", ["cs.CL", "cs.AI"], one)]
    vectors = spark.createDataFrame([("2507.18009", [1.0, 0.0]), ("2508.00002", [0.0, 1.0])], "id string, vector array<float>")
    assert store.add(papers_of(spark), vectors) is None and store.add(papers_of(spark, *rows), vectors) == 1
    got = {r["id"]: (r["version"], r["title"], r["vector"]) for r in store.read().collect()}
    assert got == {"2507.18009": ("v3", "new", [1.0, 0.0]), "2508.00001": (None, "b", None), "2508.00002": ("v1", "c", [0.0, 1.0])}
    assert [(r["pos"], r["title"]) for r in store.get(["2508_00001", "none", "2507.18009v9"]).collect()] == [(0, "b"), (1, None), (2, "new")]
    assert store.get([]).count() == 0
    asked = spark.createDataFrame([("2507_18009v1",), ("2508.00001",), ("x",)], "id string")
    assert {r["id"]: r["found"] for r in store.exists(asked).collect()} == {"2507.18009": True, "2508.00001": True, "x": False}
    assert {r["id"]: r["found"] for r in store.has_vector(asked).collect()} == {"2507.18009": True, "2508.00001": False, "x": False}
    assert not store.update(papers_of(spark, ("2508.00001", "z", None, None), ("nothing", "z", None, None)))
    assert store.update(papers_of(spark, ("2507.18009v4", "newer", ["cs.CV"], one)))
    after = store.get(["2507.18009"]).first()
    assert (after["title"], after["version"], after["vector"]) == ("newer", "v4", [1.0, 0.0])
    assert [r["id"] for r in store.of_day(F.lit("2025-08-03").cast("date"), ["cs.CL"]).collect()] == ["2508.00002"]
    near = store.similar([0.1, 1.0], 1, F.lit("2025-08-03").cast("date")).first()
    assert near["id"] == "2508.00002" and near["distance"] == pytest.approx(1 - near["score"])
    assert [r["id"] for r in store.without_vector().collect()] == ["2508.00001"]
    for wrong in (spark.createDataFrame([(1, "x")], "id int, title string"), spark.createDataFrame([("x",)], "title string")):
        with pytest.raises(TypeError):
            store.add(wrong)
    store.delete(asked)
    assert [r["id"] for r in store.read().collect()] == ["2508.00002"] and store.clear() and store.read().count() == 0


def test_word_documents(spark, tmp_path):  # noqa: ANN001
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {space}><w:body><w:p><w:r><w:t>See </w:t></w:r><w:r><w:t>this</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>"
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/hyperlink" Target="https://arxiv.org/abs/2507.18009v2"/><Relationship Id="r2" Type="http://x/styles" Target="styles.xml"/></Relationships>'
    for name, parts in (("a", {"word/document.xml": body, "word/_rels/document.xml.rels": links}), ("b", {"word/document.xml": body}), ("c", {"other.xml": "x"})):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            for part, text in parts.items():
                z.writestr(part, text)
    (tmp_path / "d.docx").write_text("no archive")
    got = {r["file"][-6:-5]: (r["text"], r["links"]) for r in files.docx_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": ("See this\n\nend", ["https://arxiv.org/abs/2507.18009v2"]), "b": ("See this\n\nend", []), "c": (None, None), "d": (None, None)}
    found = files.paper_ids(files.docx_texts(spark, str(tmp_path)).select(F.explode("links").alias("text")))
    assert [r["id"] for r in found.collect()] == ["2507.18009"]


def test_most_results_of_a_search(spark, tmp_path):  # noqa: ANN001
    for start in range(0, 12, 4):
        (tmp_path / f"cat%3Acs.AI-{start}.json").write_text(json.dumps([{"id": start + i} for i in range(4)]))
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").option("url", f"file://{tmp_path}/{{query}}-{{start}}.json").option("query", "cat%3Acs.AI").option("page_size", 4).option("pages_per_partition", 1)
    assert read.option("max_results", 6).load().count() == 6
    assert read.option("max_results", 12).load().count() == 12


def test_prices(spark, tmp_path):  # noqa: ANN001
    path = str(tmp_path / "prices.json")
    usual = usage.price_table(spark)
    assert usage.loaded_prices(spark, path).count() == usual.count()
    (tmp_path / "prices.json").write_text('{"azure": {"gpt-4o": {"input": 1.0, "output": 2.0}, "own \\"x\\"": {"input": 3.0, "output": 4.0}}, "bad": {"m": {"input": 1.0}}}')
    loaded = usage.loaded_prices(spark, path)
    prices = {(r["provider"], r["model"]): (r["input"], r["output"]) for r in loaded.collect()}
    assert prices[("azure", "gpt-4o")] == (1.0, 2.0) and prices[("azure", 'own "x"')] == (3.0, 4.0) and len(prices) == usual.count() + 1
    usage.save_prices(loaded, str(tmp_path / "saved"))
    again = usage.loaded_prices(spark, str(tmp_path / "saved"))
    assert {(r["provider"], r["model"]): (r["input"], r["output"]) for r in again.collect()} == prices


def test_weekdays(spark):  # noqa: ANN001
    days = [r["day"] for r in files.random_weekdays(spark, "2025-08-01", "2025-08-31", 9, 1).collect()]
    assert len(set(days)) == 9 and all(d.weekday() < 5 for d in days)
    assert days == [r["day"] for r in files.random_weekdays(spark, "2025-08-01", "2025-08-31", 9, 1).collect()] != [r["day"] for r in files.random_weekdays(spark, "2025-08-01", "2025-08-31", 9, 2).collect()]


def test_exploration_reward(spark):  # noqa: ANN001
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist(), i // 6) for i in range(18)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, month int")

    def unit(v):  # noqa: ANN001, ANN202
        return np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))

    def density(v, others, k=2):  # noqa: ANN001, ANN202
        return 1 / (1e-12 + np.mean(sorted(1 - unit(v) @ unit(o) for o in others)[:k]))

    got = {r["month"]: r for r in vs.exploration_reward(df, "month", 2).collect()}
    for m in range(3):
        own, past = [v for _, v, g in rows if g == m], [v for _, v, g in rows if g < m]
        forward = np.mean([density(p, own) for p in past]) if past else 0
        novelty = 1 / (1e-12 + np.mean([density(v, past) for v in own])) if past else 0
        assert got[m]["forward"] == pytest.approx(forward) and got[m]["novelty"] == pytest.approx(novelty) and got[m]["reward"] == pytest.approx((forward + novelty) / 2)


def test_scans_and_distances(spark, tmp_path):  # noqa: ANN001
    store = Collections(spark, str(tmp_path))
    store.create(CollectionSpec("c", "vector", {"v": 2}, "l2"))
    store.upsert("c", spark.createDataFrame([("a", None, "x", [0.0, 3.0], None, 1), ("b", None, "y", [0.0, 1.0], None, 1)], "id string, attributes string, content string, vector array<float>, ts timestamp_ntz, seq int"), ["seq"])
    assert [(r["id"], r["distance"]) for r in store.search("c", [0.0, 0.0], 2).collect()] == [("b", 1.0), ("a", 3.0)]
    assert sorted(r["content"] for r in store.scan("c", "content").collect()) == ["x", "y"] and store.scan("c", "id", "vector").columns == ["id", "vector"]
    assert sorted(r["id"] for r in store.lookup("c", ["b", "z"]).collect()) == ["b"]
