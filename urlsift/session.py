"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``get_session`` only fills in settings that are unset,
and ``checkpoint_dir`` always prefers ``spark.checkpoint.dir`` from the running session so lineage cuts land
in the shared folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on: UTC wall clock (timestamps are compared with an ``as_of``
# parameter, never with ``now()``), adaptive execution for runtime coalescing and skew-join splitting, and
# Arrow for the two pandas UDF paths (HTML parsing, pluggable scorers).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "urlsift") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder: ``spark.checkpoint.dir`` if the cluster sets it, else a scratch folder
    created here (local runs and tests only)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="urlsift-ckpt-", dir=os.environ.get("URLSIFT_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


# shuffle files are deleted when the statement that made them ends, not when the driver happens to collect its plan
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the statements run inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: what several results are made from is
    computed once, and a lost executor costs tasks, not the lineage. The shuffle files of the write serve nothing else and
    go with it. ``folder``: where a caller that deletes its tables wants them."""
    spark = df.sparkSession
    path = f"{folder or checkpoint_dir(spark).rstrip('/') + '/urlsift-tables'}/{tag}-{uuid.uuid4().hex}"
    with settings(spark, RELEASE):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
