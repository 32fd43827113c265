"""Running numbers over a whole order without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import written

_LOW_BITS = (1 << 33) - 1


def running_numbers(df: DataFrame, order: list[Column | str], column: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``column``: each row's place in the order, from 1.

    The rows are dealt by ranges of the order, sorted within each range and written with their
    place in it; the ranges' sizes, one number a range, give what to add. Rows that tie go by a
    hash of the columns ``ties`` (all, if not given), which also lets many equal keys be split.
    """
    columns = ties if ties is not None else [c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    keys = [*order, F.xxhash64(*columns)]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND(_LOW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg((F.max(at) + 1).alias("n")).collect()  # one row a range
    start, starts = 0, []
    for p, n in sorted(map(tuple, sizes)):
        starts.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(column, F.col("__start") + at + 1).drop("__place", "__part", "__start")
