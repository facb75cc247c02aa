"""Event, time-series, usage and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators import alerts
from lodestone.operators import events as ev
from lodestone.operators import ranking, usage
from lodestone.plans.registry import query, table


@query("SELECT event_id, ts, value FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY ORDER BY ts DESC, event_id LIMIT 100")
def ts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    low = e.agg(F.min("ts")).first()[0]
    found = e.where(F.col("ts").between(F.lit(low) + F.expr("interval 1 day"), F.lit(low) + F.expr("interval 3 days")))
    return found.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "value")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 2 DAY AND ts < (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 3 DAY")
def ts_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = e.agg(F.min(F.col("ts").cast("date"))).first()[0]
    start = F.date_add(F.lit(day), 2).cast("timestamp_ntz")
    return e.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day"))).select("event_id", "ts")


@query("SELECT strftime(ts, '%Y%m') AS month, count(*) AS n FROM events GROUP BY 1")
def ts_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyyMM").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def ts_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.downsampled(table(spark, sf_dir, "events"), "ts", "day", ["event_type"], "value")
    return found.withColumn("mean", F.round("mean", 6))


@query(
    "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) "
    "SELECT d.day, sum(c.n)::BIGINT AS n FROM d JOIN c ON c.day BETWEEN d.day - 6 AND d.day GROUP BY d.day"
)
def ts_rolling7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("covered")).agg(F.count("*").alias("n"))
    days = ev.rolling_days(counts.select(F.col("covered").alias("day")), "day")
    return days.join(counts, "covered").groupBy("day").agg(F.sum("n").alias("n"))


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def ts_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.coalesce(F.col("ts") - F.lag("ts").over(w) < F.expr("interval 6 hours"), F.lit(False))
    marked = table(spark, sf_dir, "events").withColumn("new", (~near).cast("long"))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(
    "WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m) "
    'SELECT user_id, run, event_type, count(*) AS n, min(ts) AS "first", max(ts) AS "last" FROM r GROUP BY user_id, run, event_type'
)
def ev_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def ev_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT a.event_id AS anchor_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts + INTERVAL 24 HOUR GROUP BY 1")
def ev_anchor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.proximity_counts(table(spark, sf_dir, "events"), "user_id", "ts", 86400, 86400)
    return found.select(F.col("event_id").alias("anchor_id"), "n")


@query(
    "SELECT a.event_id AS anchor_event_id, e.event_id, e.event_type, ((epoch_us(e.ts) - epoch_us(a.ts)) / 1000000.0::DOUBLE) AS seconds FROM events a JOIN events e ON a.user_id = e.user_id AND e.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 12 HOUR "
    "WHERE a.event_type = 'error'"
)
def ev_anchored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each error's user did from six hours before to twelve after it."""
    e = table(spark, sf_dir, "events")
    found = ev.anchored(e.where("event_type = 'error'"), e, "user_id", "ts", 6 * 3600, 12 * 3600)
    return found.select("anchor_event_id", "event_id", "event_type", F.col("offset").alias("seconds"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.7 * x + 0.3 * a), 6) AS ema FROM events GROUP BY user_id")
def ev_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.smoothed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.select("user_id", F.round("result", 6).alias("ema"))


@query(
    "WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), text) AS k, length(text) // 4 AS x FROM conversations), "
    "f AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS resets, 0::BIGINT AS held FROM t GROUP BY conv_id UNION ALL "
    "SELECT f.conv_id, t.k, f.resets + CASE WHEN f.held + t.x >= 300 THEN 1 ELSE 0 END, CASE WHEN f.held + t.x >= 300 THEN 50 ELSE f.held + t.x END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1) "
    "SELECT conv_id, arg_max(resets, k) AS resets, arg_max(held, k) AS held FROM f GROUP BY conv_id"
)
def ev_token_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return ev.token_budget(c, ["conv_id"], ["turn", "chars", "text"], token_estimate(F.col("text")), 300, 50)


def _fold_sql(value: str, start: str, step: str, last: str) -> str:
    """SQL of a fold over each user's events in order: t has (user_id, k, x), f the state."""
    return (
        f"WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {value} AS x FROM events), "
        f"f AS (SELECT user_id, 0::BIGINT AS k, {start} FROM t GROUP BY user_id UNION ALL SELECT f.user_id, t.k, {step} FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1) "
        f"SELECT user_id, {last} FROM f GROUP BY user_id"
    )


UPS, DOWNS = "CASE WHEN NOT active AND t.x >= 0.35 THEN ups + 1 ELSE 0 END", "CASE WHEN active AND t.x <= 0.15 THEN downs + 1 ELSE 0 END"


@query(
    _fold_sql(
        "value / (SELECT max(value) FROM events)",
        "false AS active, 0 AS ups, 0 AS downs, 0 AS entries",
        f"CASE WHEN {UPS} >= 2 THEN true WHEN {DOWNS} >= 3 THEN false ELSE active END, CASE WHEN {UPS} >= 2 THEN 0 ELSE {UPS} END, CASE WHEN {DOWNS} >= 3 THEN 0 ELSE {DOWNS} END, entries + CASE WHEN {UPS} >= 2 THEN 1 ELSE 0 END",
        "arg_max(active, k) AS active, max(entries) AS entries",
    )
)
def ev_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value").alias("top"))
    scaled = e.join(F.broadcast(top)).withColumn("p", F.col("value") / F.col("top"))
    return ev.hysteresis(scaled, ["user_id"], ["ts", "event_id"], "p")


@query(
    "WITH s AS (SELECT *, sign(value - lag(value) OVER w) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS t FROM s) "
    "SELECT event_id, CASE WHEN t > 0 THEN 'rising' WHEN t < 0 THEN 'falling' ELSE 'flat' END AS trend FROM t"
)
def ev_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.trend(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "trend")


GO = '("last" IS NULL OR t.x - "last" >= 3600)'


@query(_fold_sql("epoch_us(ts) / 1e6", '0 AS fired, NULL::DOUBLE AS "last"', f'fired + CASE WHEN {GO} THEN 1 ELSE 0 END, CASE WHEN {GO} THEN t.x ELSE "last" END', "max(fired) AS fired"))
def ev_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.throttled(e, ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600)


@query(
    "WITH a AS (SELECT max(ts) AS t FROM events) SELECT event_id, round(0.5 * value / 1000 + 0.2 * exp(-(epoch_us(a.t) - epoch_us(ts)) / 1e6 / 86400), 6) AS score FROM events, a ORDER BY 0.5 * value / 1000 + 0.2 * exp(-(epoch_us(a.t) - epoch_us(ts)) / 1e6 / 86400) DESC, event_id LIMIT 20"
)
def ev_time_decay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    last = F.lit(e.agg(F.max(micros(F.col("ts")))).first()[0])
    score = ev.decayed(F.col("value") / 1000, (last - micros(F.col("ts"))) / 1e6, 86400.0)
    return e.withColumn("score", score).orderBy(F.desc("score"), "event_id").limit(20).select("event_id", F.round("score", 6).alias("score"))


@query("SELECT coalesce(nullif(trim(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END), ''), '_missing') AS value, count(*) AS n FROM events GROUP BY 1")
def ev_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")))
    return usage.frequency(e, "kind")


@query("SELECT user_id, count(*) AS total, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') / count(*) AS rate FROM events GROUP BY user_id")
def use_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.status_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["purchase", "click"])


CHATS = (
    "c AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Azure' ELSE 'azure' END AS provider, CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'O3' WHEN 2 THEN 'o4-mini' ELSE 'other' END AS model, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (user_id * 3)::BIGINT END AS input_tokens, (user_id + 7)::BIGINT AS output_tokens FROM events), "
    "p AS (SELECT * FROM (VALUES ('gpt-4o', 2.5::DOUBLE, 10.0::DOUBLE), ('gpt-4o-mini', 0.15, 0.6), ('o3', 2.0, 8.0), ('o3-mini', 1.1, 4.4), ('o4-mini', 1.1, 4.4)) v(m, i, o))"
)


@query(
    f"WITH {CHATS} SELECT provider, model, count(*) AS chats, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(coalesce(sum(input_tokens / 1e6 * i + output_tokens / 1e6 * o), 0), 8) AS cost, count_if(i IS NULL)::BIGINT AS unpriced "
    "FROM c LEFT JOIN p ON lower(c.model) = p.m GROUP BY ROLLUP (provider, model) HAVING provider IS NOT NULL OR model IS NOT NULL"
)
def use_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    models = F.element_at(F.array(*map(F.lit, ["gpt-4o", "O3", "o4-mini", "other"])), (F.col("event_id") % 4 + 1).cast("int"))
    chats = e.select(F.when(F.col("user_id") % 2 == 0, "Azure").otherwise("azure").alias("provider"), models.alias("model"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("user_id") * 3).cast("long").alias("input_tokens"), (F.col("user_id") + 7).cast("long").alias("output_tokens"))
    known = chats.withColumn("known", (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0))
    return usage.usage_rollup(usage.priced(known, usage.price_table(spark)), 8)  # costs are multiples of 1e-8, so no tie is rounded


@query("SELECT d.source, count(*) AS total, count_if(l.quality = 1) AS good, coalesce(count_if(l.quality = 1) / count(*), 0) AS rate FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source")
def use_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("state", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return usage.status_counts(rows, ["source"], "state", ["good"])


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id HAVING count_if(contains(lower(text), 'the')) > 0 ORDER BY last_turn DESC, conv_id LIMIT 50")
def use_session_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count_if(F.contains(F.lower("text"), F.lit("the"))).alias("hits"))
    return c.where("hits > 0").drop("hits").orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("SELECT d.source, count(*) AS n, count(e.vec_id) AS with_vector, count(e.vec_id) / count(*) AS coverage FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def cov_vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count("vec_id").alias("with_vector"), (F.count("vec_id") / F.count("*")).alias("coverage"))


@query("SELECT r_name, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 6) AS percent, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def use_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6).alias("percent"), F.count("*").alias("n"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def ts_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 9).alias("mean"))


@query(
    "WITH g AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b, n_chars AS x, lead(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM documents), "
    "p AS (SELECT a AS id, CASE WHEN x > y THEN 1.0 WHEN x < y THEN 0.0 ELSE 0.5 END AS s FROM g WHERE b IS NOT NULL UNION ALL SELECT b, CASE WHEN y > x THEN 1.0 WHEN y < x THEN 0.0 ELSE 0.5 END FROM g WHERE b IS NOT NULL), "
    "t AS (SELECT id, sum(s)::DOUBLE AS score FROM p GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM t ORDER BY rank LIMIT 30"
)
def rank_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    games = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), F.lead("doc_id").over(w).alias("b"), F.col("n_chars").alias("x"), F.lead("n_chars").over(w).alias("y")).where("b is not null")
    results = games.select("a", "b", F.when(F.col("x") > F.col("y"), F.col("a")).when(F.col("y") > F.col("x"), F.col("b")).alias("winner"))
    top = ranking.points(results).orderBy(F.desc("score"), "id").limit(30)
    return ranking.ranked(top)


#: Seven rounds of three tries each; in a try the players without a pair are ranked, and neighbours that haven't met are paired.
TOURNAMENT = """
WITH RECURSIVE f AS (
  SELECT doc_id::VARCHAR AS id, coalesce(n_chars, 0) AS x, 0::DOUBLE AS score, []::VARCHAR[] AS met, false AS paired, 0 AS step FROM documents
  UNION ALL
  SELECT id, x, score + CASE WHEN NOT ok THEN 0 WHEN x > y THEN 1 WHEN x = y THEN 0.5 ELSE 0 END, CASE WHEN ok THEN list_append(met, rival) ELSE met END, step % 3 < 2 AND (paired OR ok), step + 1
  FROM (SELECT *, NOT paired AND rival IS NOT NULL AND NOT list_contains(met, rival) AS ok
  FROM (SELECT *, coalesce(lead(id) OVER w, lag(id) OVER w) AS rival, coalesce(lead(x) OVER w, lag(x) OVER w) AS y
  FROM (SELECT *, (row_number() OVER (PARTITION BY paired ORDER BY score DESC, id) + (step % 3 + 1) % 2) // 2 AS k FROM f WHERE step < 21)
  WINDOW w AS (PARTITION BY paired, k ORDER BY score DESC, id))))
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f WHERE step = 21"""


@query(TOURNAMENT)
def rank_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Swiss tournament of all documents; the longer text wins."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    of = lambda c: d.select(F.col("id").alias(c), F.col("n_chars").alias(f"n_{c}"))

    def judge(pairs: DataFrame) -> DataFrame:
        known = pairs.join(of("a"), "a").join(of("b"), "b")
        return known.select("round", "a", "b", F.when(F.col("n_a") > F.col("n_b"), F.col("a")).when(F.col("n_b") > F.col("n_a"), F.col("b")).alias("winner"))

    return ranking.tournament(d, judge, rounds=7)


#: The life cycle as a recursion over each user's events, the state a list of risks.
LIFE_CYCLE = """
WITH RECURSIVE e AS (SELECT user_id, event_type AS r, least(1::DOUBLE, value / 100::DOUBLE) AS x, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS k, []::STRUCT(r VARCHAR, p DOUBLE, active BOOLEAN, ups INT, downs INT, alerted BIGINT, seen BIGINT)[] AS st, []::STRUCT(r VARCHAR, us BIGINT, change VARCHAR, p DOUBLE)[] AS ch FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, k, CASE WHEN over THEN list_filter(st2, lambda s: s.r <> low.r) ELSE st2 END, CASE WHEN over THEN list_append(ch2, {'r': low.r, 'us': us, 'change': 'dropped', 'p': low.p}) ELSE ch2 END
  FROM (SELECT *, len(list_filter(st2, lambda s: s.active)) > 2 AS over, list_sort(list_transform(list_filter(st2, lambda s: s.active), lambda s: {'p': s.p, 'r': s.r}))[1] AS low
  FROM (SELECT *, list_append(list_filter(live, lambda s: s.r <> r), {'r': r, 'p': p, 'active': CASE WHEN up THEN true WHEN down THEN false ELSE was END, 'ups': CASE WHEN up THEN 0 ELSE ups END::INT, 'downs': CASE WHEN down THEN 0 ELSE downs END::INT,
      'alerted': CASE WHEN up AND loud THEN us ELSE last END, 'seen': us}) AS st2,
    CASE WHEN up THEN list_append(ch1, {'r': r, 'us': us, 'change': CASE WHEN loud THEN 'alert' ELSE 'quiet' END, 'p': p}) WHEN down THEN list_append(ch1, {'r': r, 'us': us, 'change': 'cleared', 'p': p}) ELSE ch1 END AS ch2
  FROM (SELECT *, ups >= 2 AS up, ups < 2 AND downs >= 3 AS down, last < 0 OR us - last >= 1800000000 AS loud
  FROM (SELECT *, CASE WHEN NOT was AND p >= 0.35::DOUBLE THEN coalesce(old.ups, 0) + 1 ELSE 0 END AS ups, CASE WHEN was AND p <= 0.15::DOUBLE THEN coalesce(old.downs, 0) + 1 ELSE 0 END AS downs
  FROM (SELECT *, coalesce(old.active, false) AS was, coalesce(old.alerted, -1) AS last,
    CASE WHEN old IS NULL THEN x ELSE old.p + greatest(-0.15::DOUBLE, least(0.15::DOUBLE, (0.7::DOUBLE * x + (1 - 0.7::DOUBLE) * old.p) - old.p)) END AS p
  FROM (SELECT *, list_filter(live, lambda s: s.r = r)[1] AS old, list_transform(list_filter(st, lambda s: us - s.seen > 86400000000 AND s.active), lambda s: {'r': s.r, 'us': s.seen + 86400000000, 'change': 'resolved', 'p': s.p}) AS ch1
  FROM (SELECT f.user_id, e.k, f.st, e.r, e.x, e.us, list_filter(f.st, lambda s: e.us - s.seen <= 86400000000) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))))))),
c AS (SELECT user_id, unnest(ch) AS c FROM f UNION ALL
  SELECT user_id, {'r': s.r, 'us': s.seen + 86400000000, 'change': 'resolved', 'p': s.p} FROM (SELECT user_id, unnest(st) AS s FROM (SELECT user_id, arg_max(st, k) AS st FROM f GROUP BY user_id)) WHERE s.active AND (SELECT max(us) FROM e) - s.seen > 86400000000)
SELECT user_id, c.r AS risk, make_timestamp(c.us) AS at, c.change AS change, round(c.p, 6) AS p FROM c"""


@query(LIFE_CYCLE)
def ev_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of all users, with cool-down, expiry after a day and two risks at a time."""
    e = table(spark, sf_dir, "events").withColumn("value", F.least(F.lit(1.0), F.col("value") / 100))
    found = alerts.life_cycle(e, "user_id", "event_type", "value", "ts", "event_id", alerts.Rules(capacity=2))
    return found.withColumn("p", F.round("p", 6))


#: Every part needs the parts with half and a third of its key, where there are such; key 0 is nobody's.
NEEDS = "e AS (SELECT p_partkey AS task, p_partkey // 2 AS needs FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    tasks = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "pending").when(F.col("p_partkey") < 1000, "completed").otherwise("running").alias("status"))
    edge = lambda n: p.select(F.col("p_partkey").alias("task"), F.floor(F.col("p_partkey") / n).alias("needs"))
    return tasks, edge(2).unionByName(edge(3)).where("task != needs")


@query(
    f"WITH RECURSIVE {NEEDS}, k AS (SELECT task, needs FROM e WHERE task <> needs AND needs IN (SELECT p_partkey FROM part)), "
    "l AS (SELECT p_partkey AS id, 0 AS level FROM part UNION SELECT k.task, l.level + 1 FROM l JOIN k ON k.needs = l.id) SELECT id, max(level) AS level FROM l GROUP BY id"
)
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, edges = _parts(spark, sf_dir)
    return ranking.levels(tasks, edges)


@query(
    f"WITH {NEEDS}, t AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'pending' WHEN p_partkey < 1000 THEN 'completed' ELSE 'running' END AS status FROM part) "
    "SELECT id FROM t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM e JOIN t n ON n.id = e.needs WHERE e.task = t.id AND e.needs <> e.task AND n.status <> 'completed')"
)
def dag_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, edges = _parts(spark, sf_dir)
    return ranking.ready_tasks(tasks, edges).select("id")


@query("SELECT event_id, CASE WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS level, s AS score FROM (SELECT event_id, trunc(least(greatest(30 + CASE WHEN value > 100 THEN 10 ELSE 0 END + CASE WHEN value > 38 THEN 15 ELSE 0 END + (user_id % 90 - 50) / 30.0 * 20, 10), 95))::INT AS s FROM events)")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lit(0.0)
    s = ranking.risk_score(F.lit(30), F.col("user_id") % 90, F.col("value"), F.col("value"), low, low)
    return table(spark, sf_dir, "events").select("event_id", ranking.risk_level(s).alias("level"), s.alias("score"))
