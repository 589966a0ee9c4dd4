"""Operators that need the one order of all rows, without bringing them into one task.

Rows are cut into ranges of the order (``buckets`` of them, by default as many as the input's bytes call for; their borders are sampled
by Spark, so that they hold about as many rows each);
work inside a range is a window over it, and only one row per range is looked at across ranges.
The order must be total (add tie-breaking columns): ties alone could put a third of all rows into one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, parts


def ordered_ranges(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``__range``, which grows along the order. It is written out, so that all later steps see the same borders."""
    return cut(df.repartitionByRange(buckets or parts(df), *order).withColumn("__range", F.spark_partition_id()))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "seq", after: int = 0, buckets: int | None = None) -> DataFrame:
    """``df`` with a column ``name``: after + 1, after + 2, ... along the order, without gaps. Empty tables stay empty; nulls come first."""
    r = ordered_ranges(df, order, buckets)
    sizes = r.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    starts = sizes.select("__range", before.alias("__before"))
    nth = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return r.withColumn("__nth", nth).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__before") + F.col("__nth") + after).cast("long")).drop("__range", "__nth", "__before")


def with_previous(df: DataFrame, order: Sequence[str], value: str, name: str = "previous", buckets: int | None = None) -> DataFrame:
    """``df`` with the ``value`` of the row before in the order; null for the first row."""
    r = ordered_ranges(df, order, buckets)
    ends = r.groupBy("__range").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    # at most ``buckets`` rows
    ends = ends.select("__range", F.lag("__end").over(W.orderBy("__range")).alias("__before"))
    w = W.partitionBy("__range").orderBy(*order)
    prev = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(value).over(w))
    return r.join(F.broadcast(ends), "__range").withColumn(name, prev).drop("__range", "__before")


def monotonic_violations(df: DataFrame, order: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Rows whose ``value`` is not greater than that of the row before in the order, with ``previous``."""
    return with_previous(df, order, value, "previous", buckets).where(F.col(value) <= F.col("previous"))
