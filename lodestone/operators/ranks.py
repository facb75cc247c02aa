"""Places in a total order, without a task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def placed(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows with their place, from 1, in the order of the columns, which should tell all rows apart.

    Spark deals the rows out by ranges of the order and sorts each range; a
    row's place is the one in its range plus the sizes of the ranges before.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot_", F.monotonically_increasing_id()))
    part = F.shiftright("spot_", 33)
    sizes = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    # One row for each range.
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    place = F.col("before_") + F.col("spot_").bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn("part_", part).join(F.broadcast(before), "part_").withColumn(name, place).drop("part_", "spot_", "before_")


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Rows with cum_... of each column of ``sums``: its sum over the rows up to this one, in the order of the columns, which should tell all rows apart.

    Each range of the order sums up its own rows; what the ranges before hold
    is added.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("spot_", 33)))
    totals = dealt.groupBy("part_").agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
    up_to = Window.orderBy("part_")
    before = totals.select("part_", *((F.sum(f"all_{c}").over(up_to) - F.col(f"all_{c}")).alias(f"before_{c}") for c in sums))
    within = Window.partitionBy("part_").orderBy("spot_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"cum_{c}": F.sum(c).over(within) for c in sums})
    told = summed.join(F.broadcast(before), "part_")
    return told.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"before_{c}") for c in sums}).drop("part_", "spot_", *(f"before_{c}" for c in sums))
