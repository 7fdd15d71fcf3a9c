"""Numbers 1 to n in an order over a whole table, without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: monotonically_increasing_id() counts a partition's rows below this bit and partitions above it.
_BIT = 33


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with `name`, 1 to n in the given order (columns or names; rows equal in all of them follow in any order).

    Rows are dealt out by ranges of the order and sorted there; a row's number is its place in its range and the
    length of the ranges before it. What reaches the driver is one count a range. Pass narrow rows with a unique last
    column of the order: they are written once, and no range can then grow beyond its share. An empty table stays so.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _BIT)
    counts = sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect()))
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "__part long, __start long")
    out = placed.join(F.broadcast(offsets), part == F.col("__part"))
    at = F.col("__at").bitwiseAND(F.lit((1 << _BIT) - 1))
    return out.withColumn(name, F.col("__start") + at + 1).drop("__at", "__part", "__start")
