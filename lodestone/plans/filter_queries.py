"""The filter language over the business tables and the events' JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.filters import Filter, VariantFields, apply_filter, compile_filter, table_field
from lodestone.plans.registry import query, table
from lodestone.sources.shared import new_folder
from lodestone.sources.sharded import ShardedTable


def _where(spark: SparkSession, sf_dir: str, name: str, expr: dict, *columns: str, mode: str = "sql") -> DataFrame:
    t = table(spark, sf_dir, name)
    return t.where(compile_filter(expr, table_field(t), mode)).select(*columns)


def _events(spark: SparkSession, sf_dir: str, expr: dict, mode: str = "sql") -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.where(compile_filter(expr, table_field(t, "props"), mode, "props")).select("event_id", "event_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def dsl_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "orders", {"eq": {"o_orderstatus": "F"}}, "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
def dsl_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "part", {"in": {"p_size": [1, 5, 9]}}, "p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE false")
def dsl_in_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "part", {"in": {"p_size": []}}, "p_partkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 2500.5")
def dsl_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "customer", {"range": {"c_acctbal": [100, 2500.5]}}, "c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
def dsl_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "part", {"like": {"p_name": "%a_e%"}}, "p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')")
def dsl_like_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "part", {"like": {"p_name": "%a%"}}, "p_partkey", "p_name", mode="typed")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def dsl_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "customer", {"not": {"eq": {"c_mktsegment": "BUILDING"}}}, "c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice BETWEEN 1000 AND 90000 OR o_orderpriority LIKE '1%')")
def dsl_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = {"and": [{"eq": {"o_orderstatus": "O"}}, {"or": [{"range": {"o_totalprice": [1000, 90000]}}, {"like": {"o_orderpriority": "1%"}}]}]}
    return _where(spark, sf_dir, "orders", expr, "o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '3'")
def dsl_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, {"eq": {"attributes.k": "3"}})


@query("SELECT event_id, event_type FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 2 AND 11")
def dsl_json_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, {"range": {"k": [2, 11]}})


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '5'")
def dsl_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, {"contains": {"k": 5}})


@query("SELECT event_id, event_type FROM events WHERE NOT coalesce(json_extract_string(props, '$.none') = '1', false)")
def dsl_not_missing_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, {"not": {"eq": {"none": "1"}}}, mode="typed")


@query("SELECT event_id, event_type FROM events WHERE NOT (json_extract_string(props, '$.none') = '1')")
def dsl_not_missing_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, {"not": {"eq": {"none": "1"}}})


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
def dsl_order_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    spec = Filter({"eq": {"o_orderstatus": "F"}}, [("o_orderdate", "desc"), ("o_totalprice", "asc")], 20, 5)
    return apply_filter(t, spec, tie="o_orderkey").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20")
def dsl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = {"and": [{"eq": {"l_returnflag": "R"}}, {"range": {"l_quantity": [10, 20]}}]}
    return _where(spark, sf_dir, "lineitem", expr, "l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity BETWEEN 49 AND 50) AS found")
def dsl_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _where(spark, sf_dir, "lineitem", {"range": {"l_quantity": [49, 50]}}, "l_orderkey").limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


@query("SELECT count(*) AS n FROM region")
def dsl_empty_is_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, "region", {}, "r_regionkey").agg(F.count("*").alias("n"))


#: Events whose attribute k is a number, text or missing, by the row.
MIXED = "m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"k\": \"abc\"}' WHEN 1 THEN '{\"k\": 3.0}' WHEN 2 THEN '{}' ELSE props END AS props FROM events), x AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM m)"


def _mixed(spark: SparkSession, sf_dir: str, expr: dict, mode: str = "sql", *columns: str) -> DataFrame:
    kind = F.col("event_id") % 4
    props = F.when(kind == 0, '{"k": "abc"}').when(kind == 1, '{"k": 3.0}').when(kind == 2, "{}").otherwise(F.col("props"))
    t = table(spark, sf_dir, "events").select("event_id", props.alias("props"))
    return t.where(compile_filter(expr, table_field(t, "props"), mode, "props")).select(*(columns or ["event_id"]))


def _variant(spark: SparkSession, sf_dir: str, expr: dict, mode: str = "sql") -> DataFrame:
    """The same over a collection whose attributes were parsed once, when they were written."""
    rows = _mixed(spark, sf_dir, {}, "sql", "event_id", "props")
    store = ShardedTable(spark, new_folder(spark, "variant"), "event_id long, props variant", "event_id")
    store.upsert(rows.withColumn("props", F.try_parse_json("props")), ["event_id"])
    t = store.read()
    return t.where(compile_filter(expr, VariantFields(table_field(t).kinds | {"props": "variant"}, "props"), mode, "props")).select("event_id")


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k = '3'")
def dsl_eq_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"eq": ["k", 3]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE TRY_CAST(k AS DOUBLE) = 3")
def dsl_eq_variant_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"eq": ["k", 3]}, mode="typed")


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k IN ('abc', '3.0', '7')")
def dsl_in_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"in": ["attributes.k", ["abc", "3.0", 7]]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE NOT coalesce(TRY_CAST(k AS DOUBLE) BETWEEN 2 AND 11, false)")
def dsl_range_variant_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"not": {"range": {"k": [2, 11]}}}, mode="typed")


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k LIKE '%b%' OR k LIKE '3'")
def dsl_like_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"or": [{"like": ["k", "%b%"]}, {"like": ["k", 3]}]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k = '5' OR k = 'abc'")
def dsl_contains_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variant(spark, sf_dir, {"or": [{"contains": {"k": 5}}, {"contains": {"k": "abc"}}]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k = '3'")
def dsl_eq_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, {"eq": ["k", 3]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE TRY_CAST(k AS DOUBLE) = 3")
def dsl_eq_mixed_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, {"eq": ["k", 3]}, mode="typed")


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k IN ('abc', '3.0', '7')")
def dsl_in_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, {"in": ["attributes.k", ["abc", "3.0", 7]]})


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE NOT coalesce(TRY_CAST(k AS DOUBLE) BETWEEN 2 AND 11, false)")
def dsl_range_mixed_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, {"not": {"range": {"k": [2, 11]}}}, mode="typed")


@query(f"WITH {MIXED} SELECT event_id FROM x WHERE k LIKE '%b%' OR k LIKE '3'")
def dsl_like_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, {"or": [{"like": ["k", "%b%"]}, {"like": ["k", 3]}]})
