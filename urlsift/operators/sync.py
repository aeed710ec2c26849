"""Agency sync with a stored cursor (J12): runs that go on where the last one ended.

``target`` holds one folder per run: ``agencies/run=K`` (the snapshot after the run) and ``state/run=K`` (the cursor row),
the cursor last. A run that dies before its cursor is written did not happen: the next one reads the cursor before it and
writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from urlsift.operators.tasks import agency_sync

MAX_PAGES = 30
STATE = ("run int, last_page int, current_page int, missing_page int, current_cutoff_date date, last_full_sync_at timestamp_ntz")


def sync_state(spark: SparkSession, target: str) -> Row | None:
    """The cursor row of the last finished run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state/run=*")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return None
    return spark.read.schema(STATE).parquet(f"{target}/state").orderBy(F.desc("run")).first()


def run_agency_sync(agencies: DataFrame, pages: DataFrame, target: str, as_of: str, max_pages: int | None = MAX_PAGES) -> Row:
    """One run. Pages are applied from the cursor's page on (page 1 first), without a gap, ``max_pages`` at most; the
    last writer (page, then updated_at) of an agency wins. ``agencies`` is the base of the first run. The new cursor:

    * pages beyond the last one applied are there: ``current_page`` is the next page; if that page is not there while later
      ones are, it is also ``missing_page``, and the next run waits for it;
    * no page beyond: a full sync, ``last_full_sync_at`` = ``as_of``, cutoff the day before, ``current_page`` null."""
    spark = pages.sparkSession
    before = sync_state(spark, target)
    run = 0 if before is None else before.run + 1
    start = (before.current_page if before is not None else None) or 1
    base = agencies if before is None else spark.read.parquet(f"{target}/agencies/run={before.run}")
    present = pages.where(F.col("page") >= start).select("page").distinct()
    # pages without a successor: the smallest of them ends the stretch that starts at the first page
    ends = present.join(present.select((F.col("page") - 1).alias("page")), "page", "left_anti")
    seen = present.agg(F.min("page").alias("first"), F.max("page").alias("final")).crossJoin(ends.agg(F.min("page").alias("end"))).first()
    last = start - 1 if seen.first is None or seen.first != start else seen.end
    if max_pages is not None:
        last = min(last, start + max_pages - 1)
    done = seen.final is None or last >= seen.final
    missing = None if done or last < (seen.end if seen.first == start else start - 1) else last + 1
    after = agency_sync(base, pages, start, last - start + 1)
    after.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/agencies/run={run}")
    kept = None if before is None else before.last_full_sync_at, None if before is None else before.current_cutoff_date
    stamp = F.lit(as_of).cast("timestamp_ntz")
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.lit(last).cast("int").alias("last_page"), F.lit(None if done else last + 1).cast("int").alias("current_page"),
        F.lit(missing).cast("int").alias("missing_page"), (F.date_sub(stamp.cast("date"), 1) if done else F.lit(kept[1]).cast("date")).alias("current_cutoff_date"),
        (stamp if done else F.lit(kept[0]).cast("timestamp_ntz")).alias("last_full_sync_at"))
    row.write.mode("overwrite").parquet(f"{target}/state/run={run}")
    return sync_state(spark, target)


def synced(spark: SparkSession, target: str) -> DataFrame:
    """The agencies after the last finished run."""
    return spark.read.parquet(f"{target}/agencies/run={sync_state(spark, target).run}")
