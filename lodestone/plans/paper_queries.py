"""Queries of papers, capabilities, chats, relations and evaluations, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import activity, papers
from lodestone.operators import events as ev
from lodestone.plans.event_queries import _fold_sql
from lodestone.plans.registry import query, table

DAY = "(SELECT min(ts)::DATE FROM events)"


@query(f"SELECT event_id, event_type FROM events WHERE ts::DATE = {DAY} + 2 AND event_type IN ('click', 'purchase')")
def pap_day_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("categories", F.array("event_type"))
    day = F.date_add(F.lit(e.agg(F.min(F.col("ts").cast("date"))).first()[0]), 2)
    return papers.on_day(e, day, "ts", ["click", "purchase"]).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' AND trim(o_orderpriority) <> ''")
def pap_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first, stop = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1996-01-01"))
    return papers.reported(o, first, stop, "o_orderdate", "o_orderstatus", "o_orderpriority", "F").select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def pap_closed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return papers.closed_range(o, "1995-03-01", "1995-03-31", "day").select("o_orderkey", "day")


@query("SELECT d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE trim(coalesce(d.text, '')) <> '' AND trim(coalesce(d.lang, '')) <> '' AND len(e.embedding) > 0")
def pap_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return papers.valid_rows(d.join(e, d.doc_id == e.vec_id), ["text", "lang"], "embedding").select("doc_id")


@query("SELECT o_orderkey, year(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, o_orderdate + INTERVAL 400 DAY))::INT AS year, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS category FROM orders")
def pap_year_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    published = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    categories = F.when(F.col("o_orderkey") % 5 > 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", papers.publication_year(published, F.col("o_orderdate") + F.expr("interval 400 days")).alias("year"), papers.primary_category(categories).alias("category"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS content, p_brand, p_size FROM part")
def pap_record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("v3")).alias("key"), "p_name", "p_brand", "p_size", F.lit("2025-01-01").alias("at"))
    return papers.from_record(papers.to_record(p, "key", "p_name", "at"), "p_brand string, p_size int").drop("ts")


@query("SELECT o_orderkey, strftime(date_trunc('week', o_orderdate) - INTERVAL 7 DAY, '%Y%m%d') || '-' || strftime(date_trunc('week', o_orderdate) - INTERVAL 1 DAY, '%Y%m%d') AS week FROM orders")
def txt_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.last_week(F.col("o_orderdate")).alias("week"))


@query("SELECT o_orderkey, 'cat:' || o_orderstatus || ' AND submittedDate:[' || strftime(o_orderdate, '%Y%m%d') || ' TO 20991231]' AS query FROM orders")
def txt_rewrite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("cat:"), F.col("o_orderstatus"), F.lit(" AND submittedDate:[20200101 TO 20200201]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.with_range(asked, F.date_format("o_orderdate", "yyyyMMdd"), F.lit("20991231")).alias("query"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_name), 'a') THEN 'x' END, CASE WHEN contains(lower(p_name), 'e') OR contains(lower(p_name), 'o') THEN 'y' END, CASE WHEN contains(lower(p_name), 'i') THEN 'z' END], lambda t: t IS NOT NULL)[:2], ',') AS topics FROM part")
def txt_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.topics(F.col("p_name"), {"x": ["A"], "y": ["e", "o"], "z": ["i"]})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("topics"))


@query("SELECT vec_id, len(embedding)::INT AS dims, true AS same FROM embeddings")
def vec_literal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = text.literal_vector(text.vector_literal(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(back).alias("dims"), (back == F.col("embedding")).alias("same"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def agg_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as capabilities, their nations as agents, and market segments as tasks."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    agent = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("http://"), F.lower("n_name")).alias("url"))
    merged = papers.merged_capabilities(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("capability"), agent.alias("agent")))
    return merged.join(F.broadcast(c.select("c_mktsegment").distinct().agg(F.sort_array(F.collect_set("c_mktsegment")).alias("tasks"))))


@query("SELECT r_name AS capability, n_name AS name, 'http://' || lower(n_name) AS url FROM nation JOIN region ON n_regionkey = r_regionkey")
def cap_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.agents_of(_capabilities(spark, sf_dir))


@query("SELECT r_name AS capability, n_name AS name, s.task FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT DISTINCT c_mktsegment AS task FROM customer) s")
def cap_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.work_list(_capabilities(spark, sf_dir))


@query(
    "WITH l AS (SELECT r_name AS capability, n_name AS name, o_orderpriority AS task, o_orderstatus = 'F' AS ok, year(o_orderdate) AS moment, c_acctbal < 0 AS deleted FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3), "
    "s AS (SELECT capability, name, task, ok, moment, greatest(count_if(NOT deleted) - count_if(deleted), 0) AS n FROM l GROUP BY ALL) "
    "SELECT capability, name, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS success FROM s GROUP BY ALL HAVING sum(n) > 0"
)
def cap_task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all agents but one, where orders of customers in debt take results back."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    log = joined.select(F.col("r_name").alias("capability"), F.col("n_name").alias("name"), F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").alias("ok"), F.year("o_orderdate").alias("at"), (F.col("c_acctbal") < 0).alias("deleted"))
    known = n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey != 3").select(F.col("r_name").alias("capability"), F.col("n_name").alias("name"))
    return papers.task_results(log, known)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY n_chars DESC, doc_id LIMIT 8")
def pap_next_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "labels").where("quality = 0")
    return papers.next_best(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), failed, "doc_id", "n_chars", 8)


@query("WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders) SELECT month, lead(month) OVER (ORDER BY month) AS next, lead(month) OVER (ORDER BY month) IS NULL AS done FROM m")
def ts_month_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.steps(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month")), "month")


KINDS = "CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END"


@query(
    f"WITH l AS (SELECT user_id AS trace_id, {KINDS} AS kind, ts AS moment, event_id FROM events), s AS (SELECT trace_id, max(moment) AS started_at FROM l WHERE kind = 'start' GROUP BY 1), "
    "e AS (SELECT trace_id, kind, moment FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY moment DESC, event_id DESC) AS k FROM l WHERE kind IN ('complete', 'fail')) WHERE k = 1) "
    "SELECT u.trace_id, CASE e.kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS status, s.started_at, e.moment AS ended_at, floor((epoch_us(e.moment) - epoch_us(s.started_at)) / 1000)::BIGINT AS duration_ms "
    "FROM (SELECT DISTINCT trace_id FROM l WHERE kind IS NOT NULL) u LEFT JOIN s USING (trace_id) LEFT JOIN e USING (trace_id)"
)
def use_chat_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq")).where("kind is not null")
    return activity.chat_states(log)


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE arg_max(o_orderstatus, o_orderkey) END AS o_orderstatus FROM orders GROUP BY o_custkey")
def use_guarded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.guarded_states(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["o_orderkey"], "P")


@query(
    "WITH e AS (SELECT o_orderkey AS a, -o_custkey - 1 AS b FROM orders UNION SELECT -o_custkey - 1, o_orderkey FROM orders), s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)), "
    "x AS (SELECT DISTINCT b AS id FROM s JOIN e ON a = id), y AS (SELECT DISTINCT b AS id FROM x JOIN e ON a = id) "
    "SELECT id, min(distance)::INT AS distance FROM (SELECT id, 0 AS distance FROM s UNION ALL SELECT id, 1 FROM x UNION ALL SELECT id, 2 FROM y) GROUP BY id"
)
def ev_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first day's orders over their customers to these customers' other orders."""
    o = table(spark, sf_dir, "orders")
    first = o.agg(F.min("o_orderdate")).first()[0]
    edges = o.select(F.col("o_orderkey").alias("a"), (-F.col("o_custkey") - 1).alias("b"))
    return activity.related(o.where(F.col("o_orderdate") == F.lit(first)).select(F.col("o_orderkey").alias("id")), edges, 2)


@query(
    "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) AS taken, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS given, "
    "round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) - sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS balance FROM events GROUP BY 1, 2"
)
def ev_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity.balance(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", F.col("event_type") == "view", F.col("event_type") == "click")
    return found.withColumns({c: F.round(c, 6) for c in ("taken", "given", "balance")})


@query(
    "WITH r AS (SELECT least(1::DOUBLE, n_chars / 5000::DOUBLE) AS s, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), a AS (SELECT sum((s - y) * (s - y)) / count(*) AS brier, count(*) AS n, sum(CASE WHEN s >= 0.5 THEN y END) / sum(y) AS recall, avg(CASE WHEN s >= 0.5 THEN y END) AS precision FROM r), "
    "p AS (SELECT avg(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS auroc FROM r x, r z WHERE x.y = 1 AND z.y = 0), "
    "t AS (SELECT x.s, (SELECT sum(y) / count(*) FROM r z WHERE z.s >= x.s) AS share FROM r x WHERE x.y = 1) "
    "SELECT n, round(brier, 6) AS brier, round(recall, 6) AS recall, round(precision, 6) AS precision, round(auroc, 6) AS auroc, round((SELECT avg(share) FROM t), 6) AS average_precision FROM a, p"
)
def use_score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 5000))
    found = activity.score_metrics(rows, "score", "quality")
    return found.withColumns({c: F.round(c, 6) for c in ("brier", "recall", "precision", "auroc", "average_precision")})


@query(
    "WITH r AS (SELECT doc_id, least(1::DOUBLE, n_chars / 5000::DOUBLE) AS s, quality AS y FROM labels JOIN documents USING (doc_id)), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS k FROM r) "
    "SELECT k.k, sum(CASE WHEN o.k <= k.k THEN y END) / sum(y) AS recall FROM o, (VALUES (10), (50), (100)) k(k) GROUP BY k.k"
)
def use_recall_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 5000))
    return activity.recall_at(rows, "score", "quality", "doc_id", [10, 50, 100])


@query(
    "SELECT o.user_id, o.ts AS onset, max(epoch_us(o.ts) - epoch_us(a.ts)) / 1000000::DOUBLE AS lead_seconds FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') o "
    "LEFT JOIN events a ON a.user_id = o.user_id AND a.event_type = 'signup' AND a.ts BETWEEN o.ts - INTERVAL 24 HOUR AND o.ts GROUP BY 1, 2"
)
def ev_lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before each error its user's first sign-up of the day before it came."""
    e = table(spark, sf_dir, "events")
    onsets = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("onset")).distinct()
    return activity.lead_times(e.where("event_type = 'signup'"), onsets, "user_id", "ts", "onset", 86_400)


FILLED = 'least(5.0, "left" + coalesce(t.x - "last", 0) * 0.0001)'


@query(_fold_sql("epoch_us(ts) / 1e6", '0 AS passed, 5.0::DOUBLE AS "left", NULL::DOUBLE AS "last"', f"passed + CASE WHEN {FILLED} >= 1 THEN 1 ELSE 0 END, {FILLED} - CASE WHEN {FILLED} >= 1 THEN 1 ELSE 0 END, t.x", "max(passed) AS passed"))
def ev_rationed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.rationed(e, ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 5.0, 0.0001)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'view' THEN false ELSE value > 100 END AS pass FROM events")
def ev_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.important(e, {"white": ["error"], "black": ["view"]}, "event_type", F.col("value") > 100).select("event_id", "pass")
