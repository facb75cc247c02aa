"""Text, id and page queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import clinical, text
from lodestone.operators import text_vectors as tv
from lodestone.plans.registry import query, table


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def txt_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, CASE WHEN length(s) > 0 THEN upper(substr(s, 1, 1)) || lower(substr(s, 2)) ELSE 'Untitled' END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^\\w\\s]', '', 'g'), '\\s+', '_', 'g') AS s FROM part)")
def txt_title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.title_slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, regexp_replace(replace(p_name, ' ', '，'), '\\s*[,，](\\s*[,，])*\\s*', ', ', 'g') AS tidy FROM part")
def txt_comma_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.tidy_commas(F.replace(F.col("p_name"), F.lit(" "), F.lit("，"))).alias("tidy"))


@query("SELECT page_id, nullif(regexp_extract(url, '(\\d+)', 1), '') AS number, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def txt_url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", number.alias("number"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages")
def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def txt_hashes_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    preview = F.when(F.length(t) > 100, F.concat(F.left(t, F.lit(100)), F.lit("..."))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("md5"), F.sha2(t, 256).alias("sha256"), preview.alias("preview"))


@query("SELECT s_suppkey, substr(regexp_replace(s_name, '[^\\p{L}\\p{N}_]', '_', 'g'), 1, 63) AS name FROM supplier")
def txt_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.table_name(F.col("s_name")).alias("name"))


@query("SELECT doc_id, '2507.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS id, CASE WHEN doc_id % 3 <> 1 THEN 'v' || (doc_id % 13 + 1) END AS version FROM documents")
def txt_paper_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper ids in the spellings that sources use, one for each document."""
    number = F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0")
    version = F.concat(F.lit("v"), (F.col("doc_id") % 13 + 1).cast("string"))
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2507_"), number, version)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" 2507."), number, F.lit(" "))).otherwise(F.concat(F.lit("2507."), number, version))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_paper_id(spelled).alias("id"), text.paper_version(spelled).alias("version"))


@query("SELECT o_orderkey, (['周一', '周二', '周三', '周四', '周五', '周六', '周日'])[isodow(o_orderdate)] AS weekday FROM orders")
def txt_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.weekday_name(F.col("o_orderdate").cast("date")).alias("weekday"))


@query("SELECT event_id, coalesce(nullif(k, 0), nullif(user_id, 0), 0)::BIGINT AS tokens FROM (SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def txt_token_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", text.first_filled(k, F.col("user_id")).cast("long").alias("tokens"))


#: A form of each kind of step: its type, its text with places for two numbers, and the cleaned text, with their sum.
FORMS = [
    ("改良早期预警评分表MEWS", "MEWS-心率: {a}, MEWS-体温: {b}", "心率: {a}, 体温: {b}"),
    ("医院获得性肺炎风险因素评估表", "肺炎_年龄: {a}分, 肺炎_卧床: {b}分, 性别: 1, 肺炎总分: 99分（高风险）, 总分: 7", "年龄: {a}分, 卧床: {b}分, 性别: 1, 肺炎总分: {sum}分（高风险）, 总分: 7"),
    ("谵妄评估单", "措施: 1，{a}, 结果: {b}", "措施: 健康教育, {a}, 结果: {b}"),
    ("Barthel指数量表", "进食1: 自理({a}分), 洗澡2: 依赖({b}分), 压疮_总分: 60分", "进食: 自理({a}分), 洗澡: 依赖({b}分), 总分: {sum}分"),
    ("住院病人昏迷评定记录单", "睁眼-自动: {a}, 运动-遵嘱: {b}, 其他: 5", "睁眼-自动: {a}, 运动-遵嘱: {b}, 其他: 5, 昏迷评分: {sum}"),
    ("危重护理记录单", "a: {a}, b: {b}, a: {a}, b: {b}", "a: {a}, b: {b}"),
    ("Caprini血栓风险评估单", "压疮_年龄3: 9, 压疮_病史: {a}, 压疮_手术: {b}分, 总分: 1 低危", "年龄: 9, 病史: {a}, 手术: {b}分, 总分: {sum} 低危"),
    ("导尿管伴随性尿路感染风险监控", "尿路_留置: {a}天, 尿路_年龄: {b}, 护理措施: 3", "留置: {a}天, 年龄: {b}, 护理措施: 3, 导尿管感染总分: {sum}"),
    ("Braden", "压疮_感觉: {a}, 压疮_营养: {b}", "感觉: {a}, 营养: {b}"),
    ("约束护理记录单", "约束_部位: {a}, 松紧: {b}", "部位: {a}, 松紧: {b}"),
    ("重症疼痛观察量表CPOT", "CPOT_面部: {a}, CPOT_肌肉: {b}", "面部: {a}, 肌肉: {b}"),
    ("其他", "a: {a}，b: {b}", "a: {a}，b: {b}"),
]
A, B = "(user_id % 40)::VARCHAR", "(event_id % 23)::VARCHAR"


def _filled(template: str) -> str:
    """SQL that puts the numbers of an event into a template."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in (("{a}", A), ("{b}", B), ("{sum}", "(user_id % 40 + event_id % 23)::VARCHAR")):
        out = f"replace({out}, '{name}', {value})"
    return out


CLEANED = " ".join(f"WHEN {i} THEN {_filled(clean)}" for i, (_, _, clean) in enumerate(FORMS))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sub_type, content): one form of some type for each event."""
    kind = F.col("event_id") % len(FORMS)
    numbers = {"{a}": (F.col("user_id") % 40).cast("string"), "{b}": (F.col("event_id") % 23).cast("string")}

    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for k, form in enumerate(FORMS):
            out = F.when(kind == k, F.lit(form[i])).otherwise(out)
        return out

    content = pick(1)
    for name, value in numbers.items():
        content = F.replace(content, F.lit(name), value)
    return table(spark, sf_dir, "events").select("event_id", pick(0).alias("sub_type"), content.alias("content"))


@query(f"SELECT event_id, CASE event_id % {len(FORMS)} {CLEANED} END AS cleaned FROM events")
def txt_clean_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("event_id", clinical.cleaned(F.col("sub_type"), F.col("content")).alias("cleaned"))


@query("SELECT event_id, 'x: ' || (event_id % 90) || CASE event_id % 3 WHEN 0 THEN '分（高风险）, 性别: 1' WHEN 1 THEN '分 重点防护' ELSE '分, y: -2, z: 37.0' END AS scored FROM events")
def txt_score_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = (F.col("event_id") % 90).cast("string"), F.col("event_id") % 3
    content = F.concat(F.lit("x: "), n, F.when(kind == 0, "（高风险）, 性别: 1").when(kind == 1, " 重点防护").otherwise(", y: -2, z: 37.0"))
    return table(spark, sf_dir, "events").select("event_id", clinical.scored(F.lit("Braden"), content).alias("scored"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'p: 1, a' || user_id || ', b, c, d, q, r, s, t, u, r, s, t, u, v' WHEN 1 THEN 'a: 1; b: 2' WHEN 2 THEN 'a, b, c, d, e' || user_id || ', z' ELSE 'morse: ' || (event_id % 70) || '分' END AS cleaned FROM events"
)
def txt_strong_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second cleaning: of two repeats the earlier goes, halves, blocks but for spaces, and the prefix and unit of fall forms."""
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    block = F.concat(F.lit("a"), u, F.lit(", b, c, d"))
    early = F.concat(F.lit("p: 1, "), block, F.lit(", "), block, F.lit(", q, r, s, t, u, r, s, t, u, v"))
    near = F.concat(F.lit("a, b, c, d, e"), u, F.lit(", a, b, c, d, e "), u, F.lit(", z"))
    content = F.when(kind == 0, early).when(kind == 1, "a: 1; b: 2a: 1; b: 2").when(kind == 2, near).otherwise(F.concat(F.lit("morse_morse: "), (F.col("event_id") % 70).cast("string")))
    sub_type = F.when(kind == 3, "跌倒/坠床风险评估表").otherwise("危重护理记录单")
    return table(spark, sf_dir, "events").select("event_id", clinical.second_cleaned(sub_type, content).alias("cleaned"))


NOTE_NAMES = {"heart rate": ["hr", "pulse"], "temperature": ["temp"], "glucose": []}
NOTE_UNITS = {"heart rate": {"bpm": 1.0, "/min": 1.0}, "temperature": {"c": 1.0}, "glucose": {"mmol/l": 1.0, "mg/dl": 0.0555}}


@query(
    "WITH n AS (SELECT event_id, 40 + user_id % 100 AS hr, round(35 + (event_id % 60) / 10.0, 1)::DOUBLE AS t, 60 + event_id % 200 AS g, event_type FROM events) "
    "SELECT event_id, 'heart rate' AS name, hr::DOUBLE AS value, 'bpm' AS unit, (length(event_type) + 8)::INT AS place FROM n UNION ALL "
    "SELECT event_id, 'temperature', t, 'c', (length(event_type) + 8 + length(hr::VARCHAR) + 11)::INT FROM n UNION ALL "
    "SELECT event_id, 'glucose', round(g * 0.0555::DOUBLE, 6), 'mmol/l', (length(event_type) + 8 + length(hr::VARCHAR) + 11 + length(t::VARCHAR) + 14)::INT FROM n"
)
def txt_note_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a note for each event, with aliases and units, and where they stand."""
    hr, g = (F.col("user_id") % 100 + 40).cast("string"), (F.col("event_id") % 200 + 60).cast("string")
    t = F.round(F.lit(35.0) + (F.col("event_id") % 60) / 10.0, 1).cast("string")
    note = F.concat(F.col("event_type"), F.lit(": HR = "), hr, F.lit(" bpm, temp："), t, F.lit("C; glucose is "), g, F.lit(" mg/dl, hrx 5"))
    notes = table(spark, sf_dir, "events").select("event_id", note.alias("note"))
    return clinical.extracted(notes, "note", NOTE_NAMES, NOTE_UNITS, ["event_id"]).withColumn("value", F.round("value", 6))


STOPS = ", ".join(f"'{w}'" for w in tv.STOP_WORDS)
#: TF-IDF weights of unit length of all documents, as (doc_id, term, w).
TFIDF = f"""
d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOPS})) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS term FROM d),
v AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 384),
c AS (SELECT doc_id, term, count(*) AS tf FROM g JOIN v USING (term) GROUP BY ALL),
i AS (SELECT term, 1 + ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))::DOUBLE) AS idf FROM c GROUP BY term),
r AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term)),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r)"""


@query(f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS weight FROM u")
def txt_tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse vector of every document, a row for each of its terms."""
    d = table(spark, sf_dir, "documents")
    model, vectors = tv.fit_transform(d)
    rows = vectors.select(F.col("id").alias("doc_id"), F.explode("vector").alias("x"))
    return rows.join(F.broadcast(model.vocabulary), F.col("x.idx") == F.col("idx")).select("doc_id", "term", F.round("x.w", 6).alias("weight"))


@query(f"WITH {TFIDF}, q AS (SELECT term, w FROM u WHERE doc_id = (SELECT min(doc_id) FROM documents)) SELECT doc_id AS id, round(sum(u.w * q.w), 6) AS score FROM u JOIN q USING (term) GROUP BY doc_id ORDER BY sum(u.w * q.w) DESC, doc_id LIMIT 20")
def txt_tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents most like the first one."""
    d = table(spark, sf_dir, "documents")
    _, vectors = tv.fit_transform(d)
    first = d.agg(F.min("doc_id")).first()[0]
    query_vector = [(x["idx"], x["w"]) for x in vectors.where(F.col("id") == first).first()["vector"]]
    return tv.most_similar(vectors, query_vector, 20).select("id", F.round("score", 6).alias("score"))
