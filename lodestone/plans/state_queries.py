"""Queries of counted writes, embedding runs, plans, sessions, daily results and prompts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.functions.filters import compile_filter, table_field
from lodestone.functions.text import token_estimate
from lodestone.operators import events as ev
from lodestone.operators import papers, records, usage
from lodestone.operators import plans as pl
from lodestone.operators import vector_search as vs
from lodestone.plans.registry import query, table
from lodestone.plans.text_queries import CLEANED, FORMS, _filled, _forms
from lodestone.sources import counted, daily, files
from lodestone.sources.shared import new_folder
from lodestone.sources.sharded import ShardedTable

CONTENT = " ".join(f"WHEN {i} THEN {_filled(raw)}" for i, (_, raw, _) in enumerate(FORMS))


@query(f"SELECT count(*) AS rows, count_if(raw <> cleaned) AS changed FROM (SELECT CASE event_id % {len(FORMS)} {CONTENT} END AS raw, CASE event_id % {len(FORMS)} {CLEANED} END AS cleaned FROM events)")
def use_counted_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms a cleaning wrote and changed, counted by the pass that wrote them."""
    told = counted.clean_counted(_forms(spark, sf_dir), f"{new_folder(spark, 'cleaned')}/rows")
    return spark.createDataFrame([(told["rows"], told["changed"])], "rows long, changed long")


def _embed(x: Column) -> Column:
    """A small vector of a text: its length, and how many a's and e's it has."""
    low = F.lower(x)
    count = lambda c: (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float")
    return F.when(~x.startswith("!"), F.array(F.length(x).cast("float"), count("a"), count("e")))


EMBEDDED = "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN '!' || text ELSE text END AS text FROM documents"


@query(
    f"WITH d AS ({EMBEDDED}) SELECT doc_id, CASE WHEN ok THEN length(text)::FLOAT END AS chars, CASE WHEN ok THEN (length(lower(text)) - length(replace(lower(text), 'a', '')))::FLOAT END AS a, ok FROM (SELECT *, trim(text) <> '' AND NOT starts_with(text, '!') AS ok FROM d)"
)
def rec_embed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector, and the ids of blank ones and of those whose embedding failed, from one write."""
    spelled = F.when(F.col("doc_id") % 9 == 0, " ").when(F.col("doc_id") % 9 == 1, F.concat(F.lit("!"), F.col("text"))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", spelled.alias("text"))
    ok, failed, _ = counted.embed_many(docs, _embed, "text", "doc_id", f"{new_folder(spark, 'embedded')}/rows")
    none = F.lit(None).cast("float")
    told = ok.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("a"), F.lit(True).alias("ok"))
    return told.unionByName(failed.select("doc_id", none.alias("chars"), none.alias("a"), F.lit(False).alias("ok")))


@query("SELECT count(*) AS n, count_if(trim(text) <> '') AS with_vector FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents)")
def rec_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the rows of a sharded table that have none; blank texts stay without."""
    content = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text"))
    vector = F.when(F.col("doc_id") % 2 == 0, _embed(content))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), content.alias("content"), F.when(F.col("doc_id") % 9 != 0, vector).alias("vector"))
    store = ShardedTable(spark, new_folder(spark, "backfill"), "id string, content string, vector array<float>")
    store.upsert(rows, ["id"])
    counted.backfill(store, _embed)
    return store.read().agg(F.count("*").alias("n"), F.count_if(F.size("vector") > 0).alias("with_vector"))


@query("SELECT doc_id, doc_id % 3 = 0 AS from_cache, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE length(text) END::FLOAT AS first FROM documents")
def rec_cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select("doc_id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    plain = lambda x: F.array(F.length(x).cast("float"))
    return counted.with_cached_vectors(d, cache, plain, "text", "doc_id").select("doc_id", "from_cache", F.col("vector")[0].alias("first"))


@query("SELECT vec_id, 4 * len(embedding)::INT AS n_bytes, true AS same FROM embeddings")
def vec_blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes of 32-bit floats, and back."""
    e = table(spark, sf_dir, "embeddings").withColumn("blob", vectors.float_bytes("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("n_bytes"), (vectors.bytes_vector("blob") == F.col("embedding")).alias("same"))


@query(
    "WITH l AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS change, ts, event_id FROM events WHERE event_type <> 'error' OR user_id % 3 = 0), "
    "t AS (SELECT id, min((ts, event_id)) FILTER (change = 'start') AS s, max((ts, event_id)) FILTER (change = 'complete') AS c, count_if(change = 'fail') AS f FROM l GROUP BY id) "
    "SELECT id, CASE WHEN f > 0 THEN 'failed' WHEN c > s THEN 'completed' WHEN s IS NOT NULL THEN 'in_progress' ELSE 'pending' END AS status FROM t"
)
def use_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks: views start them, purchases complete them, errors of every third fail them."""
    change = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail")
    e = table(spark, sf_dir, "events").where("event_type != 'error' or user_id % 3 = 0").select(F.col("user_id").alias("id"), change.alias("change"), "ts", "event_id")
    return pl.task_states(e.select("id"), e, ["ts", "event_id"])


@query(
    "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '')) AS context, count_if(role = 'assistant') AS pairs, "
    "sum(length(text) // 4)::BIGINT AS total_tokens, sum(length(text) // 4) >= 300 AS should_summarize FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"
)
def use_session_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.session_contexts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", token_estimate(F.col("text")), 300)


@query("SELECT o_custkey AS plan, string_agg('Task ' || o_orderkey || ': ' || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderdate, o_orderkey) AS context FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def use_plan_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "plan")
    return pl.context_text(o, "plan", "o_orderkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey AS plan, count(*) AS total, count_if(o_orderstatus = 'O') AS pending, count_if(o_orderstatus = 'P') AS in_progress, count_if(o_orderstatus = 'F') AS completed, 0::BIGINT AS failed, 100.0::DOUBLE * count_if(o_orderstatus = 'F') / count(*) AS percent FROM orders GROUP BY o_custkey")
def use_plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    return pl.progress(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), status.alias("status")), "plan")


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'wait' ELSE 'retry' END AS kind FROM events")
def use_retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", "Failed: No papers FOUND for the day").otherwise("timeout")
    reason = F.when(F.col("event_type") == "signup", "the database not updated yet")
    return table(spark, sf_dir, "events").select("event_id", pl.retry_class(error, reason).alias("kind"))


@query(
    "SELECT ts::DATE AS day, count_if(event_type = 'view') AS seen, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS paid, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'view' AND user_id = 7) AS of_user FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1"
)
def use_daily_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each day, saved in its folder and read back."""
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    part = lambda kind: e.where(F.col("event_type") == kind).select("day", "event_id", "user_id", "value")
    made = daily.daily_results({"views": part("view"), "purchases": part("purchase")}, "day", {"seen": ("views", "*"), "paid": ("purchases", "value")})
    path = f"{new_folder(spark, 'days')}/results"
    daily.save_days(made, path)
    back = daily.saved_days(spark, path).select("day", F.from_json("result", "metadata struct<seen: long, paid: double>, views array<struct<user_id: long>>, purchases array<struct<event_id: long>>").alias("r"))
    mine = F.size(F.filter("r.views", lambda x: x["user_id"] == 7)).cast("long")
    return back.select("day", F.col("r.metadata.seen").alias("seen"), F.round("r.metadata.paid", 4).alias("paid"), F.size("r.purchases").cast("long").alias("purchases"), mine.alias("of_user"))


@query("SELECT count(*) AS runs, sum(n)::BIGINT AS n, sum(bought)::BIGINT AS bought, min(day) AS first_day, max(day) AS last_day FROM (SELECT ts::DATE AS day, count(*) AS n, count_if(event_type = 'purchase') AS bought FROM events GROUP BY 1)")
def use_sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return daily.sync_stats(runs, "day", "n", "bought")


@query(
    "WITH l AS (SELECT source, doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents) "
    "SELECT source, count(*) AS files, sum(lines)::BIGINT AS lines, round(avg(lines), 4) AS mean, min(lines)::INT AS least, max(lines)::INT AS most, list_transform(list(row(-lines, doc_id) ORDER BY -lines, doc_id)[:10], lambda x: x[2])::VARCHAR AS top FROM l GROUP BY source"
)
def txt_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source's texts, and its ten longest."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    return text.line_stats(d, "source", "lines", "doc_id").withColumn("mean", F.round("mean", 4)).withColumn("top", F.concat(F.lit("["), F.array_join(F.col("top").cast("array<string>"), ", "), F.lit("]")))


@query("SELECT doc_id, 'Summarise ' || source || ' (' || lang || '): ' || left(text, 40) || ' {unknown}' AS prompt FROM documents")
def txt_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = {"summary": {"user_prompt": {"input_variables": ["source", "text"], "template": "Summarise {source} ({lang}): {text} {unknown}"}}}
    values = {"source": F.col("source"), "lang": F.col("lang"), "text": F.left("text", F.lit(40))}
    return table(spark, sf_dir, "documents").select("doc_id", text.prompt(templates, "summary", "user", values).alias("prompt"))


@query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[:10], lambda x: trim(x)), lambda x: length(x) > 10 AND length(x) < 200)[1] AS title, left(text, 50000) AS body FROM documents")
def txt_first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's title by the rule for extracted pages, and the part of it that is read."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_title(F.col("text")).alias("title"), F.left("text", F.lit(50_000)).alias("body"))


@query("SELECT p_partkey, regexp_replace(p_name, ' ', ':') AS old, regexp_replace(p_name, ' ', '_') AS name FROM part")
def txt_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.regexp_replace("p_name", "^([^ ]*) ", "$1:")
    return table(spark, sf_dir, "part").select("p_partkey", old.alias("old"), text.file_name(F.concat(F.lit(" ."), old, F.lit(". "))).alias("name"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'some day' ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders")
def txt_normal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    spelled = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy年MM月dd日")).otherwise(F.lit("some day"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normal_date(spelled).alias("day"))


@query("SELECT n_name AS name, [r_name]::VARCHAR AS capabilities FROM nation JOIN region ON n_regionkey = r_regionkey")
def cap_of_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    agents = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("capability"), F.struct(F.col("n_name").alias("name"), F.lit("u").alias("url")).alias("agent"))
    found = papers.capabilities_of(papers.merged_capabilities(agents))
    return found.select("name", F.concat(F.lit("["), F.array_join("capabilities", ", "), F.lit("]")).alias("capabilities"))


@query("SELECT sha256(p_partkey::VARCHAR) AS paper_id, sha256(p_name) AS content_id, replace(replace(p_name, ' ', '_'), '_', ' ') AS title, p_name AS report, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS brand FROM part")
def pap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.replace("p_name", F.lit(" "), F.lit("_")).alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("p_brand"))
    return papers.responses(p, "p_partkey", "title", "p_name", brand="p_brand")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' THEN 'agent' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def pap_flipped_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, stop = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1997-01-01"))
    return papers.flipped_source(table(spark, sf_dir, "orders"), F.col("o_orderdate"), first, stop, "o_orderstatus", "O", "agent").select("o_orderkey", "o_orderstatus")


RULES = [("error", "click", 0.6), ("error", "view", 0.3), ("signup", "purchase", 0.5)]
HYBRID = "0.5::DOUBLE * (value / 500) + 0.2::DOUBLE * exp(-abs(s) / 43200::DOUBLE) + 0.15::DOUBLE * CASE event_type WHEN 'click' THEN 0.5::DOUBLE ELSE 0 END + 0.15::DOUBLE * CASE event_type WHEN 'click' THEN 0.6::DOUBLE WHEN 'view' THEN 0.3::DOUBLE ELSE 0 END"


@query(
    "WITH a AS (SELECT user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1), c AS (SELECT event_id, event_type, value, (epoch_us(events.ts) - epoch_us(a.ts)) / 1000000::DOUBLE AS s FROM events, a) "
    f"SELECT event_id, round({HYBRID}, 6) AS score FROM c ORDER BY {HYBRID} DESC, event_id LIMIT 20"
)
def ev_hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events nearest to the first error by value, time, concept and the rules of the two kinds."""
    e = table(spark, sf_dir, "events")
    seed = e.where("event_type = 'error'").orderBy("ts", "event_id").first()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.col("ts")) - micros(F.lit(seed["ts"]).cast("timestamp_ntz"))) / 1_000_000
    candidates = e.select("event_id", "event_type", (F.col("value") / 500).alias("similarity"), seconds.alias("seconds"), F.array("event_type").alias("concepts"))
    rules = spark.createDataFrame(RULES, "from_kind string, to_kind string, boost double")
    found = ev.reranked(candidates, "similarity", "seconds", "concepts", ["click", "click-through"], "event_type", F.lit(seed["event_type"]), rules, "event_id")
    return found.select("event_id", F.round("score", 6).alias("score"))


@query(
    "WITH b AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rise FROM events) SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'view' THEN false "
    "WHEN 'click' THEN coalesce(value > 150, false) OR coalesce(rise >= 60, false) WHEN 'purchase' THEN value < 5 ELSE false END AS pass FROM b"
)
def ev_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a table of rules lets pass: kinds that always or never do, bounds, and a rise."""
    rows = [("error", "white", None, None, None), ("view", "black", None, None, None), ("click", None, None, 150.0, 60.0), ("purchase", None, 5.0, None, None)]
    rules = spark.createDataFrame(rows, "kind string, list string, low double, high double, rise double")
    return ev.gated(table(spark, sf_dir, "events"), rules, "event_type", "value", ["user_id"], ["ts", "event_id"]).select("event_id", "pass")


@query(
    "SELECT source, CASE WHEN 100.0 * count_if(length(trim(coalesce(text, ''))) < 200) / count(*) >= 50 THEN 'critical' WHEN 100.0 * count_if(n_chars < 1000) / count(*) >= 30 OR count_if(length(trim(coalesce(text, ''))) < 200) > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM documents GROUP BY source"
)
def use_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a store, whose very short texts are broken shards and whose short ones are degraded."""
    broken = F.length(F.trim(F.coalesce("text", F.lit("")))) < 200
    percent = lambda c: 100.0 * F.count_if(c) / F.count("*")
    shares = table(spark, sf_dir, "documents").groupBy("source").agg(percent(broken).alias("critical"), percent(F.col("n_chars") < 1000).alias("degraded"))
    return shares.select("source", usage.health(F.lit("healthy"), F.col("critical"), F.col("degraded")).alias("health"))


@query("SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def rec_full_row_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")).dropDuplicates()


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def rec_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history without what is older than a week."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    return records.delete_where(e, F.col("ts") < F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days")).select("event_id")


@query("SELECT user_id, event_id FROM events WHERE ts::DATE BETWEEN (SELECT min(ts)::DATE + 3 FROM events) AND (SELECT min(ts)::DATE + 6 FROM events)")
def ts_dated_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in folders of their own, of which a range is read."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min(F.col("ts").cast("date"))).first()[0]
    path = f"{new_folder(spark, 'dated')}/rows"
    day = F.col("ts").cast("date")
    e.select("user_id", "event_id", F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day")).write.partitionBy("year", "month", "day").parquet(path)
    return files.dated(spark, path, str(first + timedelta(days=3)), str(first + timedelta(days=6))).select("user_id", "event_id")


@query(
    "SELECT vec_id, event_type, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings JOIN events ON event_id = vec_id WHERE ts::DATE = (SELECT min(ts)::DATE + 1 FROM events) "
    "ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5"
)
def vec_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of one day that are nearest to the first vector."""
    e, v = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    day = F.date_add(F.lit(e.agg(F.min(F.col("ts").cast("date"))).first()[0]), 1)
    asked = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    rows = papers.on_day(e, day, "ts").join(v, F.col("event_id") == F.col("vec_id"))
    return vs.top_k(rows, asked, 5).select("vec_id", "event_type", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month FROM (SELECT *, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m') ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 20")
def ts_month_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders of each month."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    return ev.heads(o, ["month"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderkey", "month")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, event_type AS kind, 'x' AS extra FROM events")
def rec_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under an event's own properties, and one key that only the later map has."""
    own = F.map_from_arrays(F.array(F.lit("kind")), F.array("event_type"))
    props = F.from_json("props", "map<string,string>")
    merged = text.merged_maps(F.create_map(F.lit("k"), F.lit("0"), F.lit("extra"), F.lit("x")), props, own)
    at = lambda k: F.try_element_at(merged, F.lit(k)).alias(k)
    return table(spark, sf_dir, "events").select("event_id", at("k"), at("kind"), at("extra"))


@query("SELECT conv_id, max_ts AS latest, CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS preview FROM (SELECT conv_id, max(turn) AS max_ts, arg_max(text, (turn, text)) AS t FROM conversations GROUP BY conv_id) ORDER BY latest DESC, conv_id LIMIT 30")
def use_newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that went furthest, with a preview of their last turn."""
    last = records.last_wins(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"])
    t = F.col("text")
    preview = F.when(F.length(t) > 100, F.concat(F.left(t, F.lit(100)), F.lit("..."))).otherwise(t)
    return last.select("conv_id", F.col("turn").alias("latest"), preview.alias("preview")).orderBy(F.desc("latest"), "conv_id").limit(30)


@query("SELECT event_id, event_type AS status, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND user_id = 7 AND contains(lower(props), '\"k\"')")
def use_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a status and a user whose content holds a text, whatever its case; their content as values."""
    expr = {"and": [{"eq": {"event_type": "error"}}, {"eq": {"user_id": 7}}]}
    t = table(spark, sf_dir, "events")
    found = t.where(compile_filter(expr, table_field(t))).where(F.contains(F.lower("props"), F.lit('"K"'.lower())))
    return found.select("event_id", F.col("event_type").alias("status"), F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT day, dayname(day) AS name FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, min(o_orderdate)::DATE + 400, INTERVAL 1 DAY))::DATE AS day FROM orders) WHERE isodow(day) < 6 ORDER BY md5('7:' || day::VARCHAR) LIMIT 12")
def ts_random_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve weekdays of the first orders' year, by a seed."""
    first = table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date"))).first()[0]
    days = files.random_weekdays(spark, str(first), str(first + timedelta(days=400)), 12, 7)
    return days.select("day", F.date_format("day", "EEEE").alias("name"))


@query(
    "WITH p AS (SELECT a.label AS l, a.vec_id, b.label AS bl, b.vec_id AS bid, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label < b.label), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, bl ORDER BY d, bid) AS k FROM p), s AS (SELECT bl, vec_id, 1 / (1e-12::DOUBLE + avg(d)) AS density FROM k WHERE k <= 5 GROUP BY bl, vec_id) "
    "SELECT l.label, round(coalesce(avg(density), 0), 6) AS forward FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN s ON s.bl = l.label GROUP BY l.label"
)
def vec_forward_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close all earlier labels' vectors are to each label's own."""
    found = vs.forward_density(table(spark, sf_dir, "embeddings"), "label", 5)
    return found.withColumn("forward", F.round("forward", 6))
