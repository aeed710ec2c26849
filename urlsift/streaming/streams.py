"""Incremental jobs on Structured Streaming (inventory S1-S5).

The reference polls hourly/daily; here each job is a stream with a checkpoint, so a restarted or re-run job
resumes exactly where it stopped (the checkpoint replaces the reference's cursor rows), and executor loss is
recovered by Spark's replay from the source offsets. Sinks are Parquet folders: every micro-batch *appends* rows
tagged with its epoch; readers take the latest row per key with a partial aggregation, so no table is rewritten
per batch and nothing passes through the driver.

Testdata timestamps are TIMESTAMP_NTZ; watermarks need TIMESTAMP, so event times are cast first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urlsift.functions.scalars import days_ago, key_bucket
from urlsift.operators.loads import assign_ids, repeated
from urlsift.operators.review import last_by
from urlsift.session import checkpoint_dir, written


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory (never a machine-local temp dir on a
    cluster: ``spark.checkpoint.dir`` names the shared location)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/urlsift-streams/{name}-{uuid.uuid4().hex[:12]}"


def _run(writer, available_now: bool) -> StreamingQuery:
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


# ---- S1 intake ------------------------------------------------------------------------------------------------
INTAKE_BUCKETS = 64


def stream_intake(source: DataFrame, target: str, checkpoint: str, seq: str = "seq", id_col: str | None = None,
                  buckets: int = INTAKE_BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Micro-batches of collected URLs (url, batch_id, seq, ..) are loaded as :func:`insert_urls` does, against the
    catalogue written so far. The result does not depend on how rows fall into micro-batches or on their order: a URL's
    original is its first arrival by (seq, batch_id), so an earlier one that comes late takes over, under the same id.

    ``target/urls`` (originals, a row per URL and change) and ``target/arrivals`` (copies per URL and batch) lie in folders by
    epoch and by bucket of the URL's hash (``buckets`` divides 4096). A micro-batch lists the buckets it touches, at
    most that many numbers, and reads the catalogue of those only; ids are checked in them too, as an id ends in its
    URL's bucket. A replayed epoch overwrites its own folders and reads earlier ones only."""
    spark = source.sparkSession

    def load(batch: DataFrame, epoch: int):
        where = key_bucket("url", buckets).alias("bucket")
        more = [F.min(F.struct(seq, id_col)).alias("o")] if id_col else [F.min(F.struct(seq)).alias("o")]
        offers = batch.where("url is not null").groupBy("url", "batch_id").agg(*more, F.count(F.lit(1)).alias("n")).select("url", "batch_id", "o", "n", where)
        offers = _put(offers, f"{target}/arrivals/epoch={epoch}")
        touched = [r.bucket for r in offers.select("bucket").distinct().collect()]
        firsts = offers.groupBy("url", "bucket").agg(F.min(F.struct(F.col(f"o.{seq}").alias("seq"), "batch_id", *([F.col(f"o.{id_col}").alias("id")] if id_col else []))).alias("f"))
        known = intake_urls(spark, target, touched, epoch)
        if known is None:
            met = firsts.select("url", "bucket", "f", F.lit(None).cast("long").alias("known_id"), F.lit(None).cast("long").alias("old_batch_id"))
        else:
            old = known.select("url", F.col("id").alias("known_id"), F.col("batch_id").alias("old_batch_id"), F.col("seq").alias("old_seq"))
            earlier = F.struct(F.col("f.seq"), F.col("f.batch_id")) < F.struct("old_seq", "old_batch_id")
            met = firsts.join(old, "url", "left").where(F.col("known_id").isNull() | earlier).drop("old_seq")
        if id_col:
            met = met.withColumn("id", F.coalesce("known_id", "f.id"))
        else:
            met = written(met, "intake")
            none = spark.createDataFrame([], "id long")
            made = assign_ids(met.where("known_id is null"), none if known is None else known.select("id"))
            met = met.join(made, "url", "left").withColumn("id", F.coalesce("known_id", "id"))
        changed = _put(met.select("url", F.col("id").cast("long").alias("id"), F.col("f.batch_id").alias("batch_id"), F.col("f.seq").alias("seq"),
                                  F.col("old_batch_id").cast("long").alias("old_batch_id"), "bucket"), f"{target}/urls/epoch={epoch}")
        zero = F.lit(0).cast("long")
        counts = offers.select("batch_id", "n", zero.alias("originals")).unionByName(
            changed.select("batch_id", zero.alias("n"), F.lit(1).cast("long").alias("originals"))).unionByName(
            changed.where("old_batch_id is not null").select(F.col("old_batch_id").alias("batch_id"), zero.alias("n"), F.lit(-1).cast("long").alias("originals")))
        summed = counts.groupBy("batch_id").agg(F.sum("n").alias("total_count"), F.sum("originals").alias("original_count"))
        summed.write.mode("overwrite").parquet(f"{target}/load_summary/epoch={epoch}")

    w = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


# files that an epoch's bucket is written as, so that no task writes a whole bucket
BUCKET_FILES = 8


def _put(rows: DataFrame, path: str) -> DataFrame:
    rows.repartition("bucket", F.pmod(F.hash("url"), F.lit(BUCKET_FILES))).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _exists(spark: SparkSession, pattern: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def intake_urls(spark: SparkSession, target: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """S1 result: ``url, id, batch_id, seq, outcome``, the original of every URL; only of the named buckets (whose folders
    alone are read) and of epochs before ``before`` if given. None before the first epoch."""
    if not _exists(spark, f"{target}/urls/epoch=*/bucket=*"):
        return None
    rows = spark.read.parquet(f"{target}/urls")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if before is not None:
        rows = rows.where(F.col("epoch") < before)
    first = rows.groupBy("url").agg(F.min(F.struct("seq", "batch_id", "id")).alias("f"))
    return first.select("url", "f.id", "f.batch_id", "f.seq", F.lit("pending").alias("outcome"))


def intake_duplicates(spark: SparkSession, target: str) -> DataFrame:
    """S1 result: ``url, batch_id, original_url_id``, one row per arrival that is not an original."""
    offers = spark.read.parquet(f"{target}/arrivals").groupBy("url", "batch_id").agg(F.sum("n").alias("n"))
    own = intake_urls(spark, target).select("url", F.col("id").alias("original_url_id"), F.col("batch_id").alias("first_batch"))
    left = F.col("n") - F.col("batch_id").eqNullSafe(F.col("first_batch")).cast("long")
    return repeated(offers.join(own, "url").select("url", "batch_id", "original_url_id", left.alias("n")), "n")


def intake_summary(spark: SparkSession, target: str) -> DataFrame:
    """S1 result: one row per batch, the changes of its counts summed over epochs."""
    rows = spark.read.parquet(f"{target}/load_summary")
    return rows.groupBy("batch_id").agg(F.sum("total_count").alias("total_count"), F.sum("original_count").alias("original_count")).withColumn(
        "duplicate_count", F.col("total_count") - F.col("original_count"))


# ---- S2 status ------------------------------------------------------------------------------------------------
def stream_status(updates: DataFrame, target: str, checkpoint: str, seq: str = "seq",
                  available_now: bool = True) -> StreamingQuery:
    """Keyed latest value — status updates (url_id, outcome, seq) are appended per epoch; read the current
    status with :func:`current_status`."""
    def write(batch: DataFrame, epoch: int):
        last_by(batch.select("url_id", "outcome", F.col(seq).alias("seq"), F.col(seq).alias("_by")), ["url_id"], "_by").write.mode(
            "overwrite").parquet(f"{target}/epoch={epoch}")

    return _run(updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def current_status(spark: SparkSession, target: str) -> DataFrame:
    s = spark.read.parquet(target)
    # by sequence first: an update that arrives late does not win
    return last_by(s.select("url_id", "outcome", F.struct("seq", "epoch").alias("_seq")), ["url_id"], "_seq")


# ---- S3 daily backlog -----------------------------------------------------------------------------------------
def stream_daily_counts(events: DataFrame, target: str, checkpoint: str, ts: str = "ts", key: str | None = None,
                        watermark: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """S3: per 1-day event-time window (and optional key) the number of events, with a watermark bounding the
    state. Update mode: each epoch appends the windows it changed; :func:`latest_windows` reads final counts."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    keys = [F.window("_ts", "1 day").alias("w")] + ([F.col(key)] if key else [])
    agg = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, epoch: int):
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     *([key] if key else []), "n", F.lit(epoch).cast("long").alias("epoch")) \
            .write.mode("append").parquet(target)

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def latest_windows(spark: SparkSession, target: str, key: str | None = None) -> DataFrame:
    s = spark.read.parquet(target)
    keys = ["window_start", "window_end"] + ([key] if key else [])
    return last_by(s.select(*keys, "n", F.struct("epoch").alias("_seq")), keys, "_seq")


# ---- S4 log retention -----------------------------------------------------------------------------------------
def stream_log_retention(logs: DataFrame, target: str, checkpoint: str, as_of, days: int = 7,
                         available_now: bool = True) -> StreamingQuery:
    """Keep only log rows newer than ``as_of - days`` as they arrive (M12 applied per micro-batch)."""
    kept = logs.where(F.col("created_at") >= days_ago(as_of, days))
    w = kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


# ---- S5 agency sync -------------------------------------------------------------------------------------------
def stream_agency_sync(pages: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Agency change pages arrive as files; each epoch writes the latest change per agency. Later means a later ``sync``
    (a number, where the pages have it), then page, then updated_at, so pages may come in any order. The checkpoint is the
    restartable cursor: an interrupted sync resumes at the next unread file, and a replayed epoch replaces itself."""
    sync = F.col("sync") if "sync" in pages.columns else F.lit(0)

    def write(batch: DataFrame, epoch: int):
        order = F.struct(sync.cast("long").alias("sync"), "page", "updated_at")
        last_by(batch.select("agency_id", F.col("display_name").alias("name"), F.col("state_name").alias("state"), F.col("county_name").alias("county"),
                             F.col("locality_name").alias("locality"), order.alias("at"), order.alias("_by")), ["agency_id"], "_by").write.mode(
            "overwrite").parquet(f"{target}/epoch={epoch}")

    return _run(pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def synced_agencies(spark: SparkSession, agencies: DataFrame, target: str) -> DataFrame:
    """Current agencies = base snapshot overlaid by the latest synced change per agency."""
    from urlsift.operators.review import upsert

    s = spark.read.parquet(target).drop("epoch")
    return upsert(agencies, last_by(s.withColumnRenamed("at", "_seq"), ["agency_id"], "_seq"), ["agency_id"])
