"""Positions and running totals over a whole table without bringing it into one task.

The table is dealt out by range and cut, so that both passes see the same partitions; the first counts each partition, one small row
each, and the second adds what lies before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.tables import cut


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """Cut, with part (ranges in order) and line (its place there, gapless from 1)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return cut(placed.select("*", F.shiftright("at", 33).cast("int").alias("part"), (F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("line")).drop("at"))


def _before(per_part: DataFrame, amount: str) -> DataFrame:
    """For each partition, the amount of those before it; as many rows as there are partitions."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select("part", F.coalesce(F.sum(amount).over(w), F.lit(0)).alias("before")))


def with_position(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df with each row's place, from 1, in the order, which should be total."""
    dealt = _dealt(df, list(order))
    counts = dealt.groupBy("part").agg(F.max("line").alias("n"))
    return dealt.join(_before(counts, "n"), "part").select(*df.columns, (F.col("line") + F.col("before")).cast("int").alias(name))


def running_total(df: DataFrame, order: str, amount: str, name: str = "total") -> DataFrame:
    """df with the sum of amount over all rows up to and with the row's value of order; equal values share it."""
    sums = _dealt(df.groupBy(order).agg(F.sum(amount).alias("amount")), [F.col(order)])
    parts = sums.groupBy("part").agg(F.sum("amount").alias("n"))
    w = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("within", F.sum("amount").over(w)).join(_before(parts, "n"), "part").select(F.col(order).alias("key"), (F.col("within") + F.col("before")).alias(name))
    return df.join(run, df[order].eqNullSafe(run["key"])).select(*df.columns, name)
