"""Global ranks, and chains of pointers between them, without a task that holds a whole key.

Rows are dealt over ranges of the full sort order, so a key with a third of all rows is spread like any other. What is
known of each range alone (its number of rows, its last value) is a table of as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.graph import _checkpoint

#: monotonically_increasing_id holds the partition above these bits and the place in it below.
_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the 0-based place in the order over all rows, and ``range``, the part of the order that a row lies in.

    The ranges are materialized: equal rows keep the places that they got."""
    dealt = _checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("_at", 33))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("_n"))
    before = sizes.select("range", (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(before), "range").withColumn("rank", (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_PLACE))).cast("long")).drop("_at", "_before")


def carried(df: DataFrame, value: Column) -> DataFrame:
    """Adds ``carried``, the last value that is not null at or before each row of a table with rank and range."""
    here = df.withColumn("_v", value).withColumn("_last", F.last("_v", ignorenulls=True).over(Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.withColumn("_v", value).groupBy("range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("rank"))).alias("_v"))
    earlier = ends.select("range", F.last("_v", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))  # a row for each range
    return here.join(F.broadcast(earlier), "range").withColumn("carried", F.coalesce("_last", "_earlier")).drop("_v", "_last", "_earlier")


def reached(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The ranks that chains of ``pointers`` (rank, next) reach from ``starts`` (rank), these included. A chain ends at a rank without a pointer;
    chains of different starts must not meet.

    Pointer jumping: each round follows all pointers at once and then doubles them, so chains of n steps take log2(n)
    rounds; pointers whose chain ends within the next jump leave the table."""
    jumps, found = _checkpoint(pointers.select("rank", "next")), starts.select("rank")
    while not jumps.isEmpty():
        met = found.join(jumps, "rank").select(F.col("next").alias("rank"))
        found = _checkpoint(found.unionByName(met))
        onward = jumps.select(F.col("rank").alias("next"), F.col("next").alias("_beyond"))
        jumps = _checkpoint(jumps.join(onward, "next").select("rank", F.col("_beyond").alias("next")))
    return found
