"""Size-checked broadcasting.

A side is broadcast only when a bounded probe proves it small: ``limit(max_rows + 1).count()`` stops reading as
soon as the bound is exceeded, so the check costs at most ``max_rows + 1`` rows even on a huge input. Above the
bound the plain DataFrame is returned and AQE plans a shuffle join (splitting skewed partitions as needed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsift.session import written

BROADCAST_MAX_ROWS = 2_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


HOT_ROWS = 1_000_000


def skew_left_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` left-joined to ``right`` (unique by ``key``), however many rows of ``left`` have no key or the same key.

    Rows without a key meet nothing and are not shuffled. Keys with more than ``hot_rows`` rows are counted first (with
    partial aggregation); there are at most rows / ``hot_rows`` of them, and their rows of ``right`` go to the rows of ``left``
    where these lie. All others are joined as usual."""
    cols = [key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key]]
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key)
    hot = written(hot, "hot-keys")
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key])
    keyed = left.where(F.col(key).isNotNull())
    if hot.isEmpty():
        return keyed.join(right, key, "left").select(*cols).unionByName(none.select(*cols))
    few = F.broadcast(hot)  # at most rows / hot_rows keys
    hot_right = F.broadcast(right.join(few, key, "left_semi"))
    there = keyed.join(few, key, "left_semi").join(hot_right, key, "left")
    rest = keyed.join(few, key, "left_anti").join(right, key, "left")
    return rest.select(*cols).unionByName(there.select(*cols)).unionByName(none.select(*cols))
