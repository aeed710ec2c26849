"""Stored tables in buckets of a key: a join or aggregation by that key reads them where they lie and moves the other side only.

Parquet files do not say how they are dealt, so a plan learns it from a table of the session's catalogue. Such tables are
named for a while only (``forget``); their files lie outside the warehouse and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from urlsift.session import RELEASE

# buckets are read as such in every plan, so that what is made of them row by row lies in them too
IN_BUCKETS = {**RELEASE, "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def bucket_count(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that a shuffled side meets them without moving again."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One file a bucket where ``df`` is dealt by ``key`` already (as behind a join or aggregation by it); right in any case."""
    table = f"urlsift_{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(table)
    forget(df.sparkSession, table)


def bucketed(spark: SparkSession, path: str, like: DataFrame, key: str, buckets: int) -> tuple[str, DataFrame]:
    """The table stored by ``write_bucketed`` with the columns of ``like``: its name in the catalogue, its rows."""
    table, quoted = f"urlsift_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in like.schema.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return table, spark.table(table)


def forget(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
