"""Numbers in a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: A row's id holds the number of its partition above so many bits, and its place in the partition below.
PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 0, in the given order (which should be total).

    Rows are dealt by ranges of the order and sorted there, so a row's number is its place in its range after the rows of the ranges before: only these counts, one a
    range, meet in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered").withColumn("__range", F.shiftright("__id", PLACE_BITS))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return dealt.join(F.broadcast(ranges), "__range").withColumn(name, (F.col("__before") + place).cast("long")).drop("__id", "__range", "__before")
