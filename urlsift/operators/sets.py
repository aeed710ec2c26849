"""Set operations and row partitioning (inventory G1-G5)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*dfs: DataFrame) -> DataFrame:
    """G1: concatenate the results of several searches (by column name; missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_keep_last(df: DataFrame, cols: Sequence[str], seq: str = "seq") -> DataFrame:
    """Drop equal records (equal on ``cols``), keeping the last occurrence; its ``seq`` is kept so the
    last-occurrence order can be restored. One partial aggregation — a record repeated a billion times is
    reduced map-side."""
    return df.groupBy(*cols).agg(F.max(seq).alias(seq))


def split_outcomes(df: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(ok, err) — rows without / with an error."""
    return df.where(F.col(error_col).isNull()), df.where(F.col(error_col).isNotNull())


def http_outcome(success: str = "success", status: str = "status"):
    """G4 as one column: 'ok' when the fetch succeeded, '404' for status 404, else 'error' (null status →
    error)."""
    return (F.when(F.col(success), F.lit("ok"))
            .when(F.col(status).isNotNull() & (F.col(status) == 404), F.lit("404"))
            .otherwise(F.lit("error")))


def split_http_outcomes(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ok, not_found, error) partition of fetch answers."""
    tagged = df.withColumn("_o", http_outcome())
    return tuple(tagged.where(F.col("_o") == v).drop("_o") for v in ("ok", "404", "error"))  # type: ignore


def agency_set_diff(existing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(add, remove) links per URL. ``add`` = wanted ∖ existing; ``remove`` = existing ∖ wanted, only for URLs
    whose wanted set is non-empty (an empty decision leaves the existing links alone). Compared by agency_id
    (K3)."""
    keys = ["url_id", "agency_id"]
    e = existing.select(*keys).distinct()
    w = wanted.select(*keys).where(F.col("agency_id").isNotNull()).distinct()
    add = w.join(e, keys, "left_anti")
    remove = e.join(w, keys, "left_anti").join(w.select("url_id").distinct(), "url_id", "left_semi")
    return add, remove
