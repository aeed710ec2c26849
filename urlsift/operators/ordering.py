"""Global order without a global window: running sums and numbered pages over range partitions.

Rows are dealt by range of the order columns and stored; every range's total is one number, so the driver holds as many
numbers as there are ranges. Within a range a window runs over that range only.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsift.session import written

PAGE_ROWS = 100


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (integral) over all rows that sort before by ``order``. ``order`` should be unique
    per row; equal rows lie in one range and are numbered in any order."""
    spark = df.sparkSession
    ranges = written(df.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    offset, offsets = 0, []
    for k, n in sorted((r["_range"], r["n"] or 0) for r in ranges.groupBy("_range").agg(F.sum("_value").alias("n")).collect()):
        offsets.append((k, offset))
        offset += n
    start = F.broadcast(spark.createDataFrame(offsets, "_range int, _offset long"))  # one row per range
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(start, "_range").withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return out.drop("_range", "_value", "_offset")


def page_index(df: DataFrame, order: Sequence[str], size: int = PAGE_ROWS) -> DataFrame:
    """``page`` (from 1) and the order columns of its first row: the index that pages are read by."""
    keys = running_total(df.select(*order), order, F.lit(1), "at")
    return written(keys.where(F.col("at") % size == 0).select((F.col("at") / size + 1).cast("long").alias("page"), *order), "page-index")


def read_page(df: DataFrame, order: Sequence[str], index: DataFrame, page: int) -> DataFrame:
    """the rows of one page by a range condition on the order columns, however far it lies behind the first."""
    ends = {r["page"]: r for r in index.where(F.col("page").isin(page, page + 1)).collect()}  # two rows at most
    if page not in ends:
        return df.limit(0)
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    kinds = {f.name: f.dataType for f in df.select(*order).schema.fields}
    bound = lambda r: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) if len(order) > 1 else F.lit(r[order[0]]).cast(kinds[order[0]])
    rows = df.where(key >= bound(ends[page]))
    return rows.where(key < bound(ends[page + 1])) if page + 1 in ends else rows
