"""Vector search over ``embeddings``; vector 0 is the query where one is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import shard_of
from lodestone.functions.vectors import cosine, norm
from lodestone.operators import leaders
from lodestone.operators import vector_search as vs
from lodestone.plans.registry import query, table

Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {Q})"
PAIR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _query_vector(df: DataFrame) -> list[float]:
    return [float(x) for x in df.where("vec_id = 0").select("embedding").first()[0]]


def _ids(found: DataFrame, digits: int = 6) -> DataFrame:
    return found.select("vec_id", "label", F.round("score", digits).alias("score"))


@query(f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {COS} DESC, vec_id LIMIT 10")
def vec_cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.top_k(e, _query_vector(e), 10, where=F.col("label").isin(1, 2, 3)))


@query(f"SELECT vec_id, label, round(0 - list_distance(embedding::DOUBLE[], {Q}), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {Q}), vec_id LIMIT 10")
def vec_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.top_k(e, _query_vector(e), 10, "l2"))


@query(f"SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], {Q}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {Q}) DESC, vec_id LIMIT 10")
def vec_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.top_k(e, _query_vector(e), 10, "ip"))


@query(f"WITH t AS (SELECT vec_id, label, {COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, label, round(s, 6) AS score FROM t WHERE s >= 0.1 AND 1 - s > 0.001")
def vec_threshold_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.post_filtered(e, _query_vector(e), 50, threshold=0.1, near_dup_delta=0.001))


@query(f"WITH t AS (SELECT vec_id, label, {COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, label, round(s, 6) AS score FROM t WHERE label = 3")
def vec_postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.post_filtered(e, _query_vector(e), 50, where=F.col("label") == 3))


@query(f"WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - {PAIR} AS d FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0), m AS (SELECT query_id, min(d) AS d FROM d GROUP BY query_id) SELECT query_id, round(d, 6) AS distance FROM m ORDER BY d, query_id LIMIT 16")
def vec_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = vs.least_distance(e.where("label <> 0"), e.where("label = 0"))
    return found.orderBy("distance", "query_id").limit(16).select("query_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def vec_shard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.sharded_top_k(e, _query_vector(e), 10, shard_of(F.col("vec_id").cast("string"), 8)))


NEAR = f"WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - least(1, greatest(-1, {PAIR})) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS k FROM d)"


@query(f"{NEAR} SELECT query_id, round(1 / (1e-12 + avg(d)), 5) AS density FROM r WHERE k <= 5 GROUP BY query_id")
def vec_density_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vs.density(e, e).select("query_id", F.round("density", 5).alias("density"))


@query(f"{NEAR} SELECT query_id, round(count(*) / (1e-12 + max(d)), 5) AS density FROM r WHERE k <= 5 GROUP BY query_id")
def vec_density_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vs.density(e, e, kind="radius").select("query_id", F.round("density", 5).alias("density"))


@query(
    f"WITH d AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label, 1 - least(1, greatest(-1, {PAIR})) AS d FROM embeddings a JOIN embeddings b ON b.label < a.label), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS k FROM d), "
    "n AS (SELECT q, label, 1 / (1e-12 + avg(d)) AS density FROM r WHERE k <= 5 GROUP BY q, label) "
    "SELECT e.label, round(CASE WHEN count(n.density) = 0 THEN 0 ELSE 1 / (1e-12 + avg(coalesce(n.density, 0))) END, 5) AS novelty FROM embeddings e LEFT JOIN n ON n.q = e.vec_id GROUP BY e.label"
)
def vec_novelty_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vs.novelty(e, "label").select("label", F.round("novelty", 5).alias("novelty"))


def _asked(df: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 20."""
    return df.where(F.col("vec_id") % 20 == 0)


@query()
def vec_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vs.CellIndex(e).search(_asked(e), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vec_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries there are, and whether the index finds at least 0.9 of what brute force finds for them."""
    e = table(spark, sf_dir, "embeddings")
    exact = vs.neighbours(_asked(e), e, 10).select("query_id", "id")
    found = vs.CellIndex(e).search(_asked(e), 10).select("query_id", "id", F.lit(1).alias("hit"))
    met = exact.join(found, ["query_id", "id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


CENTROIDS = "WITH u AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)"


@query(
    f"{CENTROIDS}, s AS (SELECT e.vec_id, c.label AS best_label, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS s FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, best_label) AS k FROM s) "
    "SELECT vec_id, best_label, round(s, 6) AS score FROM r WHERE k = 1 AND s > 0.1"
)
def vec_label_centroid_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.transform("c", lambda p: p["x"]).alias("v"))
    named = centroids.select(F.col("label").cast("long").alias("vec_id"), F.transform("v", lambda x: x.cast("double")).alias("embedding"))
    found = vs.neighbours(e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), named, 1, exclude_self=False)
    return found.where("distance < 0.9").select(F.col("query_id").alias("vec_id"), F.col("id").cast("int").alias("best_label"), F.round(1 - F.col("distance"), 6).alias("score"))


@query(f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 5")
def vec_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.rerank(e, _query_vector(e), 5, position="vec_id"))


@query(f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings WHERE {COS} > 0.9 ORDER BY {COS} DESC, vec_id LIMIT 1")
def vec_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return _ids(vs.top_k(e, _query_vector(e), 1).where("score > 0.9"))


@query("SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings WHERE len(embedding) = 64")
def vec_dimension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return e.select("vec_id", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 6).alias("length"))


@query(
    f"WITH c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings), l AS (SELECT a.vec_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.embedding = b.embedding OR {PAIR} >= 0.3 GROUP BY a.vec_id) "
    "SELECT c.vec_id AS id, c.class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM c LEFT JOIN l USING (vec_id)"
)
def vec_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.similar_counts(table(spark, sf_dir, "embeddings"), 0.3)


@query(
    f"WITH RECURSIVE o AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings), p AS (SELECT a.pos AS a, b.pos AS b, {PAIR} AS s FROM o a JOIN o b ON b.pos < a.pos AND {PAIR} > 0.3), "
    "near AS (SELECT o.pos, list(p.b) FILTER (p.b IS NOT NULL) AS near FROM o LEFT JOIN p ON p.a = o.pos GROUP BY o.pos), "
    "f AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS leaders UNION ALL SELECT near.pos, CASE WHEN list_has_any(coalesce(near.near, []), f.leaders) THEN f.leaders ELSE list_append(f.leaders, near.pos) END FROM f JOIN near ON near.pos = f.pos + 1), "
    "l AS (SELECT unnest(leaders) AS pos FROM (SELECT leaders FROM f ORDER BY pos DESC LIMIT 1)), "
    "m AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p WHERE b IN (SELECT pos FROM l) AND a NOT IN (SELECT pos FROM l)) "
    "SELECT o.vec_id AS id, coalesce(x.vec_id, o.vec_id) AS leader, round(coalesce(m.s, 1), 6) AS similarity FROM o LEFT JOIN m ON m.a = o.pos AND m.k = 1 LEFT JOIN o x ON x.pos = m.b"
)
def vec_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors merged in the order of their ids into the most similar earlier leader."""
    found = leaders.lead(table(spark, sf_dir, "embeddings"), 0.3)
    return found.withColumn("similarity", F.round("similarity", 6))
