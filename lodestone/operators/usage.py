"""Usage and success accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import first_filled

# USD for a million tokens, (provider, model, input, output).
PRICES = [
    ("azure", "gpt-4o", 2.50, 10.00),
    ("azure", "gpt-4o-mini", 0.15, 0.60),
    ("azure", "o3", 2.00, 8.00),
    ("azure", "o3-mini", 1.10, 4.40),
    ("azure", "o4-mini", 1.10, 4.40),
]


BROADCAST_ROWS = 10_000


def price_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(PRICES, "provider string, model string, input double, output double")


def loaded_prices(spark: SparkSession, path: str) -> DataFrame:
    """The fixed prices, with those of a JSON file (provider to model to input and output) in their place; without a readable file the fixed ones."""
    files = spark.read.text(path, wholetext=True) if _exists(spark, path) else spark.createDataFrame([], "value string")
    nested = files.select(F.from_json("value", "map<string, map<string, struct<input: double, output: double>>>").alias("m"))
    own = nested.select(F.explode("m").alias("provider", "models")).select("provider", F.explode("models").alias("model", "p")).select("provider", "model", "p.input", "p.output").where("input is not null and output is not null")
    return price_table(spark).join(own.select("provider", "model"), ["provider", "model"], "left_anti").unionByName(own)


def save_prices(prices: DataFrame, path: str) -> None:
    """Prices as one JSON document of that form; one row for each model."""
    by_model = prices.groupBy("provider").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.struct("input", "output"))))).alias("models"))
    parts = by_model.agg(F.sort_array(F.collect_list(F.struct("provider", F.to_json("models").alias("j")))).alias("all"))
    named = lambda x: F.concat(F.lit('"'), F.replace(x["provider"], F.lit('"'), F.lit('\\"')), F.lit('": '), x["j"])
    text = F.concat(F.lit("{"), F.array_join(F.transform("all", named), ", "), F.lit("}"))
    parts.select(text.alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_usage(usage: dict[str, Column]) -> dict[str, Column]:
    """Input, output and total tokens with their fallbacks, and whether the parts are known."""
    inp = first_filled(usage["input_tokens"], usage["prompt_tokens"])
    out = first_filled(usage["output_tokens"], usage["completion_tokens"])
    total = first_filled(usage["total_tokens"], inp + out)
    return {"input": inp, "output": out, "total": total, "known": (inp > 0) | (out > 0)}


def priced(chats: DataFrame, prices: DataFrame) -> DataFrame:
    """Chats with unit prices: the exact model name, else the same name in other letter case; null if unknown.

    A price table of at most BROADCAST_ROWS rows is broadcast; a larger one is joined by a shuffle.
    """
    small = prices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    p = prices.select(F.lower("provider").alias("p_"), F.col("model").alias("m_"), F.col("input").alias("in_"), F.col("output").alias("out_"))
    folded = prices.groupBy(F.lower("provider").alias("q_"), F.lower("model").alias("n_")).agg(F.min_by("input", "model").alias("in2_"), F.min_by("output", "model").alias("out2_"))
    found = chats.join(sent(p), (F.lower("provider") == F.col("p_")) & (F.col("model") == F.col("m_")), "left").join(sent(folded), (F.lower("provider") == F.col("q_")) & (F.lower("model") == F.col("n_")), "left")
    return found.withColumns({"input_price": F.coalesce("in_", "in2_"), "output_price": F.coalesce("out_", "out2_")}).drop("p_", "m_", "in_", "out_", "q_", "n_", "in2_", "out2_")


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    return input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price


def usage_rollup(priced_chats: DataFrame, digits: int = 6) -> DataFrame:
    """Chats, tokens and cost of each provider and model, with a total row of each provider (model null)."""
    usd = F.when(F.col("known"), cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price")))
    rows = priced_chats.withColumn("usd_", usd)
    return rows.rollup("provider", "model").agg(
        F.count("*").alias("chats"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.coalesce(F.sum("usd_"), F.lit(0.0)), digits).alias("cost"),
        F.count_if(F.col("input_price").isNull()).alias("unpriced"),
        F.grouping_id().alias("level_"),
    ).where("level_ < 3").drop("level_")


def status_counts(rows: DataFrame, by: list[str], status: str, names: list[str]) -> DataFrame:
    """Total, a count for each status, and the share of the first, for each key."""
    counts = [F.count_if(F.col(status) == n).alias(n) for n in names]
    share = F.coalesce(F.try_divide(F.count_if(F.col(status) == names[0]), F.count("*")), F.lit(0.0)).alias("rate")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *counts, share)


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) with blanks as ``_missing``, the most frequent first."""
    value = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("_missing")).alias("value")
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def health(status: Column, critical_percent: Column, degraded_percent: Column) -> Column:
    """Severity of a store from the shares of its shards."""
    return F.when(critical_percent >= 50, "critical").when((degraded_percent >= 30) | (critical_percent > 0), "degraded").otherwise(status)
