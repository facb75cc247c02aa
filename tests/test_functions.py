from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import clinical, text, vectors
from lodestone.functions.filters import Filter, apply_filter, compile_filter, record_field


def one(spark, column, **values):  # noqa: ANN001, ANN003, ANN201
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("2507_18009v3", "2507.18009"), ("2507.18009", "2507.18009")])
def test_clean_paper_id(spark, given, want):  # noqa: ANN001
    assert one(spark, text.clean_paper_id(F.col("a")), a=given) == want


@pytest.mark.parametrize("given", ["2507_18009", "2507-18009", "2507.18009"])
def test_normal_paper_id(spark, given):  # noqa: ANN001
    assert one(spark, text.normal_paper_id(F.col("a")), a=given) == "2507.18009"


@pytest.mark.parametrize(("given", "want"), [("60（高风险）", "60分（高风险）"), ("50 重点防护", "50分 重点防护"), ("11", "11分"), ("-2", "-2"), ("37.0", "37.0"), ("5分", "5分")])
def test_score_unit(spark, given, want):  # noqa: ANN001
    assert one(spark, text.with_score_unit(F.col("a")), a=given) == want


def test_key_values(spark):  # noqa: ANN001
    found = one(spark, text.key_values(F.col("a")), a="a: 1, b, c: x:y")
    assert [tuple(x) for x in found] == [("a", "1"), (None, "b"), ("c", "x:y")]
    assert one(spark, text.join_key_values(text.key_values(F.col("a"))), a="a: 1， b,, c: x:y") == "a: 1, b, c: x:y"


def test_half_duplicate_and_prefix(spark):  # noqa: ANN001
    assert one(spark, clinical.drop_repeated_text(F.col("a")), a="a: 1, b: 2, a: 1, b: 2") == "a: 1, b: 2"
    assert one(spark, clinical.cleaned(F.col("s"), F.col("a")), s="改良早期预警评分表MEWS", a="MEWS-心率: 51-100") == "心率: 51-100"


def test_repeated_block(spark):  # noqa: ANN001
    df = spark.createDataFrame([(list("xabcdabcdz"),), (list("abc"),), ([],)], "p array<string>")
    assert [r[0] for r in df.select(clinical.drop_repeated_block(F.col("p"))).collect()] == [list("xabcdz"), list("abc"), []]


@pytest.mark.parametrize(("given", "want"), [("2025-08-03", "周日"), ("20250803", "周日"), ("2025年8月4日", "周一"), ("3/8/2025", "周日"), ("nonsense", "未知")])
def test_weekday(spark, given, want):  # noqa: ANN001
    assert one(spark, text.weekday_name(text.parsed_date(F.col("a"))), a=given) == want


def test_title_slug_and_name(spark):  # noqa: ANN001
    assert one(spark, text.title_slug(F.col("a")), a="Hello,  World of AI!") == "Hello_world_of_ai"
    assert one(spark, text.title_slug(F.col("a")), a="!!") == "Untitled"
    assert one(spark, text.table_name(F.col("a")), a="a b-ç" * 20) == ("a_b_ç" * 20)[:63]


def test_shard_is_sha256_modulo(spark):  # noqa: ANN001
    import hashlib

    for x in ("a", "doc-17"):
        assert one(spark, text.shard_of(F.col("a"), 7), a=x) == int(hashlib.sha256(x.encode()).hexdigest(), 16) % 7


def test_cosine_edges(spark):  # noqa: ANN001
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[1:3] == [0.0, 0.0]
    assert math.isclose(got[0], 1.0) and math.isclose(got[3], -1.0)


ROWS = [("1", '{"k": 5, "a": {"b": "x", "t": ["p", "q"]}}', "Alpha"), ("2", '{"k": 12}', None), ("3", None, "beta%")]


@pytest.mark.parametrize(
    ("expr", "mode", "want"),
    [
        ({}, "sql", "123"),
        ({"eq": {"a.b": "x"}}, "sql", "1"),
        ({"not": {"eq": {"a.b": "x"}}}, "sql", ""),
        ({"not": {"eq": {"a.b": "x"}}}, "typed", "23"),
        ({"range": {"k": [6, 20]}}, "sql", "2"),
        ({"contains": {"a": {"t": ["q"]}}}, "sql", "1"),
        ({"contains": {"a": {"t": ["z"]}}}, "sql", ""),
        ({"and": []}, "sql", "123"),
        ({"or": []}, "sql", ""),
        ({"like": {"content": "%a%"}}, "sql", "13"),
        ({"like": {"content": "_eta%"}}, "sql", "3"),
        ({"like": {"content": "_eta"}}, "typed", ""),
        ({"eq": {"content": None}}, "typed", "2"),
        ({"in": {"id": []}}, "sql", ""),
    ],
)
def test_filter(spark, expr, mode, want):  # noqa: ANN001
    df = spark.createDataFrame(ROWS, "id string, attributes string, content string")
    resolve = record_field()
    assert "".join(sorted(r["id"] for r in df.where(compile_filter(expr, resolve, mode)).collect())) == want


def test_filter_order_and_errors(spark):  # noqa: ANN001
    df = spark.createDataFrame(ROWS, "id string, attributes string, content string")
    resolve = record_field()
    assert [r["id"] for r in apply_filter(df, Filter(order_by=[("content", "desc")], limit=2), resolve).collect()] == ["2", "3"]
    with pytest.raises(ValueError, match="one field"):
        compile_filter({"range": {"a": [1, 2], "b": [1, 2]}}, resolve)


def test_strong_block_dedupe(spark):  # noqa: ANN001
    cases = {
        "p,a,b,c,d,a,b,c,d,q,r,s,t,u,v,r,s,t,u,v": "p, a, b, c, d, q, r, s, t, u, v, r, s, t, u, v",
        "a,b,c,d,e,f,a,b,c,d,e,f,z": "a, b, c, d, e, f, z",
        "a,a,a,a,a,a,a,a,a": "a, a, a, a, a",
        "x yx y": "x y",
        "a,,b": "a,,b",
        "a,b,c,d,e,,f": "a,b,c,d,e, f",
        "a b,c,d,e,f,ab,c,d,e,f,q": "a b, c, d, e, f, q",
        "": "",
        " ": "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    assert [(r[0], r[1]) for r in rows.select(clinical.drop_repeated_strongly(F.col("t")), "want").collect() if r[0] != r[1]] == []


def test_all_forms(spark):  # noqa: ANN001
    plain = ("a: 1, b: 2, a: 1, b: 2", "a: 1, b: 2")
    cases = {
        "导管观察及护理记录": plain, "疼痛评估及记录单": plain, "皮肤观察及护理记录单": plain, "跌倒/坠床风险评估表": plain, "压力性损伤观察及护理记录单": plain, "内科血栓风险评估表": plain, "危重护理记录单": plain, "肌力等级评估表": plain,
        "谵妄评估单": ("措施: 11, x: 1", "措施: 遵医嘱药物治疗, x: 1"),
        "约束护理记录单": ("约束_部位: 手, 约束_a: 1", "部位: 手, a: 1"),
        "医院获得性肺炎风险因素评估表": ("肺炎_a: 2分, 总分: 9, 肺炎总分: 8分高", "a: 2分, 总分: 2, 肺炎总分: 8分高"),
        "Caprini血栓风险评估单": ("压疮_年龄61: 2, 压疮_病史: 3, 手术: -1, 其他: 9", "年龄: 2, 病史: 3, 手术: -1, 其他: 9, 总分: 2"),
        "导尿管伴随性尿路感染风险监控": ("尿路_a: 1, 尿路_b: 2, 性别: 5, 导尿管感染总分: 9", "a: 1, b: 2, 性别: 5, 导尿管感染总分: 3"),
        "Braden": ("压疮_a: 1", "a: 1"),
        "Barthel指数量表": ("进食1: 自理（10分）, 洗澡: 5, 压疮_自理能力等级: x(3分)", "进食: 自理（10分）, 洗澡: 5, 自理能力等级: x(3分), 总分: 10"),
        "重症疼痛观察量表CPOT": ("CPOT_a: 1", "a: 1"),
        "改良早期预警评分表MEWS": ("MEWS-心率: 51-100", "心率: 51-100"),
        "住院病人昏迷评定记录单": ("睁眼-a: 4, 运动-b: 6, 言语-c: 5, 昏迷评分: 3 分", "睁眼-a: 4, 运动-b: 6, 言语-c: 5, 昏迷评分: 15 分"),
    }
    assert set(cases) == set(clinical.FORMS) and len(cases) == 18
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in cases.items()], "s string, t string, want string")
    assert [tuple(r) for r in rows.select("s", clinical.cleaned(F.col("s"), F.col("t")).alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_values_from_notes(spark):  # noqa: ANN001
    names, units = {"heart rate": ["hr"], "glucose": ["glu"]}, {"heart rate": {"bpm": 1.0}, "glucose": {"mmol/L": 1.0, "mg/dL": 0.0555}}
    notes = ["HR: 80, glu 5.5 mmol/l, later hr=90bpm; glucose is 100 mg/dL", "through 5 thr 7 hrs 9", None, "", "Heart rate -3 kg. hr 12.", "血糖 hr：70bpm，glu:6"]
    got = sorted(map(tuple, clinical.extracted(spark.createDataFrame(list(enumerate(notes)), "i int, t string"), "t", names, units, ["i"]).collect()))
    want = [(0, "glucose", 5.5, "mmol/L", 13), (0, "glucose", pytest.approx(5.55), "mmol/L", 52), (0, "heart rate", 80.0, "bpm", 5), (0, "heart rate", 90.0, "bpm", 34), (4, "heart rate", -3.0, "bpm", 12), (4, "heart rate", 12.0, "bpm", 22), (5, "glucose", 6.0, "mmol/L", 17), (5, "heart rate", 70.0, "bpm", 7)]
    assert got == want
    assert all(notes[i][place - 1 :].startswith(str(value).removesuffix(".0")) for i, _, value, _, place in got if value != 5.55 and (i, place) != (0, 52))
