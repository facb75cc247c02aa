"""Record, lookup and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.operators import vector_search as vs
from lodestone.plans.registry import query, table
from lodestone.sources.shared import new_folder
from lodestone.sources.sharded import ShardedTable


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def rec_exists_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.exists_flags(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def rec_anti_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def rec_upsert_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return records.upsert(e.where("false"), e, ["user_id"], ["event_id"])


@query(
    "WITH w AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 WHEN user_id % 5 = 0 THEN 2 END AS write FROM events) "
    "SELECT user_id::VARCHAR AS id, event_type AS content, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY write DESC, event_id DESC) AS k FROM w WHERE write IS NOT NULL AND user_id % 7 <> 0) WHERE k = 1"
)
def rec_sharded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event in a sharded table: even events are written first, the odd ones of every fifth user upserted, every seventh user deleted."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"), "user_id")
    store = ShardedTable(spark, new_folder(spark, "sharded"), "id string, content string, seq long")
    store.upsert(e.where("seq % 2 = 0"), ["seq"])
    store.upsert(e.where("seq % 2 = 1 and user_id % 5 = 0"), ["seq"])
    store.delete(e.where("user_id % 7 = 0").select("id").distinct())
    return store.read()


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0 AND c_mktsegment = 'UPDATED') AS updated FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer)")
def rec_sharded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of customers that are all there take effect; a batch with one that isn't changes nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    store = ShardedTable(spark, new_folder(spark, "sharded"), "c_custkey long, c_mktsegment string", "c_custkey")
    store.insert_absent(c, ["c_custkey"])
    store.update(c.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("UPDATED")), ["c_custkey"])
    store.update(c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("LOST").alias("c_mktsegment")), ["c_custkey"])
    return store.read().agg(F.count("*").alias("n"), F.count_if((F.col("c_custkey") % 10 == 0) & (F.col("c_mktsegment") == "UPDATED")).alias("updated"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def rec_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return records.insert_absent(e.where("false"), e, ["user_id"], ["event_id"])


@query(
    "SELECT c.c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'Patched' END, c_name) AS c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer c "
    "UNION ALL SELECT -c_custkey - 1, 'Patched', NULL, NULL FROM customer WHERE c_custkey % 10 = 0"
)
def rec_partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of half the customers, with a new one for each tenth."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    of = lambda key, where: c.where(where).select(key.alias("c_custkey"), F.lit("Patched").alias("c_name"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    changes = of(F.col("c_custkey"), "c_custkey % 2 = 0").unionByName(of(-F.col("c_custkey") - 1, "c_custkey % 10 = 0"))
    return records.patch(c, changes, "c_custkey", ["c_mktsegment"])


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 1)")
def rec_delete_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return records.delete_nearest(e, q, "vec_id", "embedding").select("vec_id")


@query("SELECT doc_id FROM documents d WHERE text IS NULL OR text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND text IS NOT NULL)")
def rec_delete_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    bad = d.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    return records.delete_content(d, bad, "text").select("doc_id")


@query("SELECT md5(text) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def rec_dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(records.content_id(F.col("text")).alias("content_id"), "doc_id")
    return d.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice BETWEEN 0 AND 100000, false)")
def rec_delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.delete_where(table(spark, sf_dir, "orders"), F.col("o_totalprice").between(0, 100000)).select("o_orderkey")


HITS = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10"


@query(f"WITH h AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS hit_rank FROM ({HITS})) SELECT h.hit_rank, d.doc_id, d.source FROM h JOIN documents d ON d.doc_id = h.vec_id")
def rec_fetch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    hits = vs.top_k(e, q, 10).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("h"))
    ranked = hits.select(F.posexplode("h").alias("p", "x")).select((F.col("p") + 1).alias("hit_rank"), "x.vec_id")
    return records.fetch_ranked(ranked, table(spark, sf_dir, "documents"), "vec_id", "doc_id", "hit_rank").select("hit_rank", "doc_id", "source")


@query("SELECT (('0x' || right(sha256(doc_id::VARCHAR), 4))::BIGINT % 8)::INT AS shard, count(*) AS n FROM documents GROUP BY 1")
def rec_shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.shard_stats(table(spark, sf_dir, "documents"), "doc_id", 8)


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (3, 5, 8, 1000000)")
def rec_get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id").isin(3, 5, 8, 1000000)).select("doc_id", "source", "n_chars")


@query("SELECT p.pos, p.vec_id, e.label FROM (VALUES (0, 7), (1, 999999), (2, 3)) p(pos, vec_id) LEFT JOIN embeddings e ON e.vec_id = p.vec_id")
def rec_positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.positional([7, 999999, 3], table(spark, sf_dir, "embeddings"), "vec_id").select("pos", "vec_id", "label")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 10")
def rec_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").offset(10).limit(25).select("event_id", "ts", "user_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def rec_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keyset_page(table(spark, sf_dir, "documents"), "doc_id", 100, 25).select("doc_id", "source")


@query("SELECT coalesce(max(vec_id), -1) + 1 AS next_label FROM embeddings")
def rec_next_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg((F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).alias("next_label"))


@query("SELECT d.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def rec_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def rec_outer_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").withColumn("state", F.lit("labelled"))  # noqa: E741
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("state", F.lit("unlabelled")).alias("state"))


@query("SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def set_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT vec_id FROM embeddings WHERE label = 2")
def set_recall_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").where("label = 2").select(F.col("vec_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def set_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))
