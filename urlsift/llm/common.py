"""Helpers shared by the training-data operators: stored intermediates, input columns, Arrow mapping.

Conventions that hold for every operator here:

* a null text counts as the empty text; the id column may hold nulls and repeated values;
* operators read only the id and text columns they are given, so further columns of the input, whatever their
  names, cannot clash with the columns an operator works with;
* intermediates are Parquet tables in the shared folder (``spark.checkpoint.dir``), so a lost executor costs a
  re-run of single tasks and never a re-run of the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsift.session import checkpoint_dir

# the six ASCII white-space characters of the text contracts
SPACE_CHARS = " \t\n\x0b\x0c\r"
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, keeps column pruning."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/urlsift-llm/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")  # the shuffle files of this write serve nothing else
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


BATCH_ROWS = 1000  # rows of an Arrow batch; whole texts are wide, and a worker holds a few batches


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` (never raise it): it bounds what JVM and Python hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``id`` (its own type) and ``text`` (never null)."""
    narrow_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: inside a lambda, an outer expression is worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_az(col: Column) -> Column:
    """Lower-case the letters A-Z only."""
    return F.translate(col, UPPER_AZ, UPPER_AZ.lower())


def lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, letters A-Z lowered, in UTF-8: both are what ``bytes`` methods do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def partitions_for(rows: int, rows_per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // rows_per_partition))


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``. ``str.split()`` knows more white space than that, so it serves only when
    the text holds none of the extra characters."""
    words = text.split()
    if sum(map(len, words)) + _space_count(text) == len(text):
        return words
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _space_count(text: str) -> int:
    return sum(text.count(c) for c in SPACE_CHARS)
