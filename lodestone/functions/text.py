"""Ids, names, dates and token strings as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]  # fixed values


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def paper_version(x: Column) -> Column:
    """``v3`` of ``2507_18009v3``; null without one."""
    return F.nullif(F.regexp_extract(x, r"(v\d+)$", 1), F.lit(""))


def clean_paper_id(x: Column) -> Column:
    """The id without its version, underscores as dots."""
    return F.replace(F.regexp_replace(F.trim(x), r"v\d+$", ""), F.lit("_"), F.lit("."))


def normal_paper_id(x: Column) -> Column:
    """``2507.18009`` of ids written with ``_``, ``-`` or ``.``: the first two parts."""
    parts = F.split(F.regexp_replace(F.trim(x), r"[_-]", "."), r"\.")
    return F.when(F.length(F.trim(x)) > 0, F.array_join(F.slice(parts, 1, 2), "."))


def title_slug(x: Column, default: str = "Untitled") -> Column:
    """Word characters only, spaces as underscores, the first letter upper-case and the rest lower-case."""
    plain = F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    capital = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 30)))
    return F.when(F.length(plain) > 0, capital).otherwise(F.lit(default))


def table_name(x: Column) -> Column:
    """Letters, digits and underscores, at most 63 characters."""
    return F.left(F.regexp_replace(x, r"[^\p{L}\p{N}_]", "_"), F.lit(63))


def file_name(x: Column, most: int = 200) -> Column:
    """A name that any file system takes: separators, quotes, wildcards and control characters as underscores, no blanks or dots at the ends; ``_`` where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(x, r"[\\/:*?\"<>|\p{Cntrl}]", "_"), r"^[\s.]+|[\s.]+$", "")
    return F.when(F.length(plain) > 0, F.left(plain, F.lit(most))).when(x.isNotNull(), F.lit("_"))


def first_title(x: Column, lines: int = 10, least: int = 10, most: int = 200) -> Column:
    """The first of the first ``lines`` lines whose trimmed length is between the bounds, without them; null without one."""
    tried = F.transform(F.slice(F.split(x, "\n"), 1, lines), lambda line: F.trim(line))
    return F.get(F.filter(tried, lambda line: (F.length(line) > least) & (F.length(line) < most)), F.lit(0))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with each ``{name}`` replaced by a column's text, null as nothing; names without a column stay.

    One pass over the template, so that a value that holds ``{name}`` is left alone.
    """
    out, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        if m[1] in values:
            out += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def prompt(templates: dict, section: str, kind: str, values: dict[str, Column]) -> Column:
    """The filled template of a section and kind; ValueError where there is none or a required variable has no column."""
    found = (templates.get(section) or {}).get(f"{kind}_prompt")
    if not found:
        raise ValueError(f"no {kind} prompt in section {section}")
    missing = [v for v in found.get("input_variables", []) if v not in values]
    if missing:
        raise ValueError(f"missing variables: {missing}")
    return filled(found["template"], values)


def shard_of(x: Column, shards: int) -> Column:
    """The SHA-256 digest of the text as a number, modulo the number of shards."""
    digits = F.transform(F.filter(F.split(F.sha2(x, 256), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % shards)


def tidy_commas(x: Column) -> Column:
    """Full-width commas as ``, `` and repeated ones as one."""
    return F.regexp_replace(x, r"\s*[,，](?:\s*[,，])*\s*", ", ")


def key_values(x: Column) -> Column:
    """``a: 1, b`` as an array of (k, v): the key ends at the first colon, a part without one has a null key."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(x, "，", ","), ","), lambda p: F.trim(p)), lambda p: p != "")

    def pair(p: Column, at: Column) -> Column:
        key = F.when(at > 0, F.trim(F.substr(p, F.lit(1), at - 1)))
        return F.struct(key.alias("k"), F.when(at > 0, F.trim(F.substr(p, at + 1))).otherwise(p).alias("v"))

    return F.transform(parts, lambda p: bound(F.regexp_instr(p, F.lit("[:：]")), lambda at: pair(p, at)))


def join_key_values(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.when(p["k"].isNull(), p["v"]).otherwise(F.concat_ws(": ", p["k"], p["v"]))), ", ")


def drop_second_half(pairs: Column) -> Column:
    """The first half of an array whose second half repeats it; else the array."""

    def once(p: Column) -> Column:
        half = (F.size(p) / 2).cast("int")
        first, second = F.slice(p, F.lit(1), half), F.slice(p, half + 1, half)
        return F.when((F.size(p) > 0) & (F.size(p) % 2 == 0) & (first == second), first).otherwise(p)

    return bound(pairs, once)


def strip_key_prefix(pairs: Column, prefixes: list[str]) -> Column:
    """Keys without any of the prefixes."""
    pattern = "^(?:" + "|".join(f"\\Q{p}\\E" for p in prefixes) + ")"
    return F.transform(pairs, lambda p: F.struct(F.regexp_replace(p["k"], pattern, "").alias("k"), p["v"].alias("v")))


def with_score_unit(x: Column) -> Column:
    """``60（高）`` as ``60分（高）``: a leading whole number without a unit gets one; negatives and decimals stay."""
    return F.regexp_replace(x, r"^(\s*\d+)(?![\d.分])(?=\s|$|[（(])", "$1分")


def weekday_name(day: Column) -> Column:
    """Chinese weekday of a date, 未知 for null."""
    return F.when(day.isNull(), F.lit("未知")).otherwise(F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day)))


def parsed_date(x: Column) -> Column:
    """A date from the usual spellings, day before month where both fit; null if none does."""
    epoch = F.when(x.rlike(r"^\d{10}$"), F.timestamp_seconds(x.try_cast("bigint"))).when(x.rlike(r"^\d{13}$"), F.timestamp_millis(x.try_cast("bigint")))
    formats = ["yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd", "yyyy年M月d日", "d/M/yyyy", "M/d/yyyy"]
    return F.coalesce(epoch.cast("date"), *(F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats))


def normal_date(x: Column) -> Column:
    """``yyyyMMdd`` of a date in any of the usual spellings; any other text stays as it is."""
    return F.coalesce(F.date_format(parsed_date(x), "yyyyMMdd"), x)


def last_week(day: Column) -> Column:
    """``yyyyMMdd-yyyyMMdd`` of the Monday and Sunday of the week before a date's."""
    monday = F.date_sub(F.date_trunc("week", day.cast("timestamp")).cast("date"), 7)
    return F.concat_ws("-", F.date_format(monday, "yyyyMMdd"), F.date_format(F.date_add(monday, 6), "yyyyMMdd"))


def with_range(query: Column, first: Column, last: Column) -> Column:
    """A query text with each ``[a TO b]`` replaced by ``[first TO last]``."""
    return F.regexp_replace(query, F.lit(r"\[[^\[\]]*? TO [^\[\]]*?\]"), F.concat(F.lit("["), first, F.lit(" TO "), last, F.lit("]")))


def topics(text: Column, keywords: dict[str, list[str]], most: int = 2) -> Column:
    """The first ``most`` topics, in their order, of which the text holds a keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = [F.when(F.greatest(F.lit(False), *(F.contains(low, F.lit(w.lower())) for w in words)), F.lit(topic)) for topic, words in keywords.items()]
    return F.slice(F.array_compact(F.array(*held)), 1, most)


def vector_literal(vector: Column) -> Column:
    """``[1.0,2.5]`` of a vector, and null of null."""
    return F.when(vector.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")))


def literal_vector(text: Column) -> Column:
    """The vector of a literal; null where it can't be read."""
    return F.from_json(text, "array<float>")


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, the estimate where no tokenizer is at hand."""
    return (F.char_length(F.coalesce(x, F.lit(""))) / 4).cast("long")


def first_filled(*counts: Column) -> Column:
    """The first count that is neither null nor zero, else zero."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in counts), F.lit(0))


def merged_maps(*maps: Column) -> Column:
    """One map of all keys; of a key that several maps have the last one's value counts, and null maps are empty."""
    entries = [F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]
    all_entries = F.concat(*entries)
    last = lambda k: F.element_at(F.filter(all_entries, lambda e: e["key"] == k), -1)["value"]
    keys = F.array_distinct(F.transform(all_entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, last))


def line_stats(rows: DataFrame, by: str, lines: str, name: str, top: int = 10) -> DataFrame:
    """(by, files, lines, mean, least, most, top) of rows with a number of lines; top are the names of the longest, ties by name."""
    best = Window.partitionBy(by).orderBy(F.desc(lines), name)
    longest = rows.withColumn("k_", F.row_number().over(best)).where(F.col("k_") <= top).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k_", name))), lambda x: x[name]).alias("top"))
    told = rows.groupBy(by).agg(F.count("*").alias("files"), F.sum(lines).alias("lines"), F.avg(lines).alias("mean"), F.min(lines).alias("least"), F.max(lines).alias("most"))
    return told.withColumnRenamed(by, "by_").join(longest.withColumnRenamed(by, "top_by_"), F.col("by_").eqNullSafe(F.col("top_by_"))).drop("top_by_").withColumnRenamed("by_", by)
