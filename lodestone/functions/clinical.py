"""Cleaning of clinical form texts (``key: value, key: value, ...``) as column expressions.

Every form type has one row in FORMS that says which steps apply; the steps
themselves are ordinary expressions on arrays of (k, v), so that a whole table
of forms is cleaned in one projection. ``extracted`` finds the values of named
measures in running text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import bound, drop_second_half, join_key_values, key_values, strip_key_prefix, with_score_unit

# Measure codes and their labels, and the keys that carry no score.
MEASURES = {1: "健康教育", 2: "心理疏导", 3: "充足氧供", 4: "早期活动", 5: "疼痛控制", 6: "修养环境管理", 7: "水分营养摄入", 8: "预防并发症", 9: "增加家属探视", 10: "规范使用约束带", 11: "遵医嘱药物治疗"}
NO_SCORE = ["性别", "年龄", "入院时间", "护理措施", "措施", "审阅", "分型结果"]
SCORED = ["医院获得性肺炎风险因素评估表", "Caprini血栓风险评估单", "导尿管伴随性尿路感染风险监控", "Braden", "跌倒/坠床风险评估表", "Barthel指数量表", "内科血栓风险评估表", "重症疼痛观察量表CPOT", "改良早期预警评分表MEWS", "住院病人昏迷评定记录单", "谵妄评估单"]
NO_SCORE_MEWS = ["心率", "收缩压", "呼吸频率", "体温", "意识", "风险分级"]


@dataclass(frozen=True)
class Form:
    """The steps of one form type.

    ``prefixes`` go from keys. ``totals`` are the keys of the total: it becomes
    the sum of ``parts`` (by key, by key prefix, or of all keys but ``skipped``),
    the whole number of each value, or for ``bracketed`` the points in brackets.
    """

    prefixes: tuple[str, ...] = ()
    totals: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    part_prefixes: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    bracketed: bool = False
    trim_key_digits: str = ""
    measures: bool = False


# The form types.
FORMS = {
    "导管观察及护理记录": Form(),
    "谵妄评估单": Form(measures=True),
    "约束护理记录单": Form(prefixes=("约束_",)),
    "医院获得性肺炎风险因素评估表": Form(prefixes=("肺炎_",), totals=("肺炎总分", "总分"), skipped=("护理措施", "性别")),
    "Caprini血栓风险评估单": Form(prefixes=("压疮_",), totals=("总分",), parts=("病史", "实验室检查", "手术"), trim_key_digits="^(年龄)[0-9]+$"),
    "疼痛评估及记录单": Form(),
    "导尿管伴随性尿路感染风险监控": Form(prefixes=("尿路_",), totals=("导尿管感染总分",), skipped=("护理措施", "性别")),
    "Braden": Form(prefixes=("压疮_",)),
    "皮肤观察及护理记录单": Form(),
    "跌倒/坠床风险评估表": Form(),
    "压力性损伤观察及护理记录单": Form(),
    "Barthel指数量表": Form(prefixes=("压疮_",), totals=("总分",), skipped=("自理能力等级", "性别"), bracketed=True, trim_key_digits="^(.*?)[0-9]+$"),
    "内科血栓风险评估表": Form(),
    "重症疼痛观察量表CPOT": Form(prefixes=("CPOT_",)),
    "改良早期预警评分表MEWS": Form(prefixes=("MEWS-",)),
    "住院病人昏迷评定记录单": Form(totals=("昏迷评分",), part_prefixes=("睁眼-", "运动-", "言语-")),
    "危重护理记录单": Form(),
    "肌力等级评估表": Form(),
}


def drop_repeated_text(text: Column) -> Column:
    """The text once where its two halves say the same, as characters or as comma-separated parts."""
    edge = lambda c: F.regexp_replace(c, r"^[ ,\n]+|[ ,\n]+$", "")

    def by_parts(s: Column, parts: Column, first: Column) -> Column:
        tidy = F.regexp_replace(s, r"([,，])(?:\s*\1)+", "$1 ")
        return F.when(F.size(first) < F.size(parts), F.array_join(first, ", ")).otherwise(tidy)

    def whole(s: Column) -> Column:
        half = (F.length(s) / 2).cast("int")
        left, right = F.substr(s, F.lit(1), half), F.substr(s, half + 1)
        by_character = (F.length(s) % 2 == 0) & (edge(left) != "") & (edge(left) == edge(right))
        parts = F.filter(F.transform(F.split(F.regexp_replace(s, "，", ","), ","), lambda p: F.trim(p)), lambda p: p != "")
        return F.when(by_character, edge(left)).otherwise(bound(parts, lambda p: bound(drop_second_half(p), lambda first: by_parts(s, p, first))))

    return bound(F.trim(text), whole)


def measure_labels(pairs: Column, field: str = "措施") -> Column:
    """Code numbers of a field's value as labels joined by ``；``; unknown codes stay."""
    labels = F.create_map(*(F.lit(x) for k, v in MEASURES.items() for x in (str(k), v)))
    codes = lambda v: F.regexp_extract_all(v, F.lit("([0-9]+)"), F.lit(1))
    named = lambda v: F.array_join(F.transform(codes(v), lambda n: F.coalesce(F.try_element_at(labels, n), n)), "；")
    return F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.when(F.equal_null(p["k"], F.lit(field)) & (F.size(codes(p["v"])) > 0), named(p["v"])).otherwise(p["v"]).alias("v")))


def _starts(prefixes: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(f"\\Q{p}\\E" for p in prefixes) + ")"


def new_total(pairs: Column, form: Form) -> Column:
    """The pairs with the total put right: the first total's number replaced, its suffix kept; appended where there is none."""
    number = r"[（(]\s*([0-9]+)\s*分[）)]" if form.bracketed else r"(-?[0-9]+)"

    def counts(p: Column) -> Column:
        k = p["k"]
        use = k.isNotNull() & ~k.isin(*form.totals)
        if form.parts:
            return use & k.isin(*form.parts)
        if form.part_prefixes:
            return use & k.rlike(_starts(form.part_prefixes))
        return use & ~k.rlike(_starts(form.skipped))

    points = F.transform(F.filter(pairs, counts), lambda p: F.coalesce(F.regexp_extract(p["v"], number, 1).try_cast("int"), F.lit(0)))
    total = F.aggregate(points, F.lit(0), lambda a, x: a + x).cast("string")
    is_total = lambda p: F.coalesce(p["k"].isin(*form.totals), F.lit(False))
    suffix = lambda v: F.when(v.rlike(r"^\s*[0-9]"), F.regexp_extract(v, r"^\s*[0-9]+(.*)$", 1)).otherwise(F.lit(""))
    first = F.array_position(F.transform(pairs, is_total), F.lit(True))
    replaced = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), F.when(i + 1 == first, F.concat(total, suffix(p["v"]))).otherwise(p["v"]).alias("v")))
    appended = F.concat(pairs, F.array(F.struct(F.lit(form.totals[0]).alias("k"), total.alias("v"))))
    return F.when(F.exists(pairs, is_total), replaced).otherwise(appended)


def cleaned_form(sub_type: str, text: Column) -> Column:
    """A text of one form type after its steps; other types keep their text."""
    form = FORMS.get(sub_type)
    if form is None:
        return text
    once = drop_repeated_text(text)
    if form == Form():
        return once
    pairs = key_values(once)
    if form.prefixes:
        pairs = strip_key_prefix(pairs, list(form.prefixes))
    if form.trim_key_digits:
        pairs = F.transform(pairs, lambda p: F.struct(F.regexp_replace(p["k"], form.trim_key_digits, "$1").alias("k"), p["v"].alias("v")))
    if form.measures:
        pairs = measure_labels(pairs)
    if form.totals:
        pairs = bound(pairs, lambda p: new_total(p, form))
    return join_key_values(pairs)


def cleaned(sub_type: Column, text: Column) -> Column:
    """Texts of any form types, by the type in ``sub_type``."""
    out = text
    for name in FORMS:
        out = F.when(sub_type == name, cleaned_form(name, text)).otherwise(out)
    return out


def scored(sub_type: Column, text: Column) -> Column:
    """Scores with their unit: every value with a number, except of keys that carry no score."""
    mews = F.coalesce(sub_type == "改良早期预警评分表MEWS", F.lit(False))
    delirium = F.coalesce(sub_type == "谵妄评估单", F.lit(False))

    def unit(p: Column) -> Column:
        plain = p["k"].isNull() | p["k"].isin(*NO_SCORE) | (mews & p["k"].isin(*NO_SCORE_MEWS)) | (delirium & F.contains(p["k"], F.lit("RASS评分")))
        return F.struct(p["k"].alias("k"), F.when(plain, p["v"]).otherwise(with_score_unit(p["v"])).alias("v"))

    return join_key_values(F.transform(key_values(text), unit))


def drop_repeated_block(parts: Column, least: int = 4) -> Column:
    """An array without the second of two equal neighbouring blocks of at least ``least`` members: of those that start first the longest."""
    n = F.size(parts)
    starts = F.when(n >= 2 * least, F.sequence(F.lit(1), n - (2 * least - 1))).otherwise(F.array().cast("array<int>"))
    sizes = lambda i: F.reverse(F.sequence(F.lit(least), ((n - i + 1) / 2).cast("int")))
    found = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes(i), lambda s: F.slice(parts, i, s) == F.slice(parts, i + s, s)), lambda s: F.struct(i.alias("i"), s.alias("s")))))
    kept = lambda first: F.concat(F.slice(parts, F.lit(1), first["i"] + first["s"] - 1), F.slice(parts, first["i"] + 2 * first["s"], F.greatest(F.lit(0), n - first["i"] - 2 * first["s"] + 1)))
    return bound(F.get(found, F.lit(0)), lambda first: F.when(first.isNotNull(), kept(first)).otherwise(parts))


def drop_repeated_strongly(text: Column, least: int = 4) -> Column:
    """A text without a repeated block of comma-separated parts.

    The text once, where its halves are the same; else, from six parts on,
    without the first block that comes twice in a row; else without a first
    block of more than ``least`` parts that comes again but for white space;
    else the text with its doubled commas as one.
    """

    def whole(s: Column) -> Column:
        return bound(F.regexp_replace(s, r"^[ ,\n]+|[ ,\n]+$", ""), lambda bare: by_halves(s, bare))

    def by_halves(s: Column, bare: Column) -> Column:
        half = (F.length(bare) / 2).cast("int")
        halves = (F.length(bare) > 0) & (F.length(bare) % 2 == 0) & (F.substr(bare, F.lit(1), half) == F.substr(bare, half + 1))
        parts = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(s, "，", ", "), r"\s{2,}", " "), ","), lambda p: F.trim(p)), lambda p: p != "")
        return F.when(halves, F.substr(bare, F.lit(1), half)).otherwise(bound(parts, lambda p: F.when(F.size(p) < 6, s).otherwise(bound(drop_repeated_block(p, least), lambda exact: by_blocks(s, p, exact)))))

    def by_blocks(s: Column, p: Column, exact: Column) -> Column:
        bare_parts = F.transform(p, lambda x: F.regexp_replace(x, r"\s+", ""))
        sizes = F.when(F.size(p) >= 2 * least + 2, F.reverse(F.sequence(F.lit(least + 1), (F.size(p) / 2).cast("int")))).otherwise(F.array().cast("array<int>"))
        near = bound(bare_parts, lambda plain: F.get(F.filter(sizes, lambda j: F.slice(plain, F.lit(1), j) == F.slice(plain, j + 1, j)), F.lit(0)))
        loose = lambda n: F.concat(F.slice(p, F.lit(1), n), F.slice(p, 2 * n + 1, F.size(p)))
        tidy = F.regexp_replace(s, r"([,，])\s*\1+", "$1 ")
        return F.when(F.size(exact) < F.size(p), F.array_join(exact, ", ")).otherwise(bound(near, lambda n: F.when(n.isNotNull(), F.array_join(loose(n), ", ")).otherwise(tidy)))

    return bound(F.trim(text), whole)


def second_cleaned(sub_type: Column, text: Column) -> Column:
    """A text after its first cleaning: repeated blocks go, the keys of fall forms lose their prefix, and scores of scored forms get their unit."""
    fall = lambda once: F.when(sub_type == "跌倒/坠床风险评估表", join_key_values(strip_key_prefix(key_values(once), ["morse_"]))).otherwise(once)
    unit = lambda plain: F.when(sub_type.isin(SCORED), scored(sub_type, plain)).otherwise(plain)
    return bound(drop_repeated_strongly(text), lambda once: bound(fall(once), unit))


def extracted(notes: DataFrame, text_col: str, names: dict[str, list[str]], units: dict[str, dict[str, float]], keep: list[str]) -> DataFrame:
    """(keep, name, value, unit, place): the values that texts tell of named measures.

    ``names`` has the spellings of each measure, longer ones first where one
    begins another; ``units`` has for each measure its units and what a value in
    it is multiplied by to be in the first one. A value is a number after a
    spelling and at most ``:``, ``=``, ``is`` or white space, with a unit of the
    measure or none; one without a unit is in the first. Place is the number's
    first character, from 1. Letters of either case are the same. All measures
    are found in one pass, by one pattern.
    """
    known = {x.lower(): n for n, spellings in names.items() for x in (n, *spellings)}
    factor = {(n, u.lower()): (list(of)[0], f) for n, of in units.items() for u, f in of.items()}
    spelled = "|".join(f"\\Q{x}\\E" for x in sorted(known, key=lambda x: (-len(x), x)))
    marks = "|".join(f"\\Q{u}\\E" for u in sorted({u for _, u in factor}, key=lambda u: (-len(u), u)))
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])({spelled})(\s*(?:[:：=]|\bis\b)?\s*)(-?[0-9]+(?:\.[0-9]+)?)(?:\s*({marks}))?(?![\p{{L}}\p{{N}}])"
    hits = F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))
    # Where each hit starts: what was before it, found from the end of the one before.
    at = F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")), lambda a, h: _after(a, h, F.col(text_col)))["all"]
    rows = notes.select(*keep, F.explode(F.arrays_zip(hits.alias("h"), at.alias("at"))).alias("x")).select(*keep, F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    part = lambda i: F.regexp_extract("h", pattern, i)
    name_of = F.create_map(*(F.lit(x) for k, n in known.items() for x in (k, n)))
    told = rows.select(*keep, F.try_element_at(name_of, F.lower(part(1))).alias("name"), part(3).try_cast("double").alias("raw"), F.lower(part(4)).alias("told"), (F.col("at") + F.length(part(1)) + F.length(part(2))).alias("place"))
    firsts = F.create_map(*(F.lit(x) for n, of in units.items() for x in (n, list(of)[0])))
    factors = F.create_map(*(F.lit(x) for (n, u), (_, f) in factor.items() for x in (f"{n}\t{u}", float(f))))
    by = F.when(F.col("told") == "", F.lit(1.0)).otherwise(F.try_element_at(factors, F.concat_ws("\t", "name", "told")))
    return told.select(*keep, "name", (F.col("raw") * by).alias("value"), F.try_element_at(firsts, F.col("name")).alias("unit"), "place").where("value is not null")


def _after(a: Column, hit: Column, text: Column) -> Column:
    """The place of the next hit after the last one's end, added to the places."""
    at = F.call_function("locate", hit, text, a["end"] + 1)
    return F.struct((at + F.length(hit) - 1).cast("int").alias("end"), F.concat(a["all"], F.array(at.cast("int"))).alias("all"))
