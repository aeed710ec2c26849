"""Registered streaming queries (S1, S3, S4): each runs the stream to completion with an ``availableNow``
trigger over the given table read as a file stream, then returns the sink's final state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.plans.catalog import AS_OF
from urlsift.plans.oracle import with_views
from urlsift.plans.q_intake import _SUMMARY
from urlsift.sources.fixtures import ARRIVAL_ORDER, load_model
from urlsift.streaming import streams as st


def _stream(spark, d, name):
    path = f"{d.rstrip('/')}/{name}.parquet"
    # the trailing glob makes the path a pattern: it matches a single file as well as a folder of part files
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


# rows of a stream's input file
FILE_ROWS = 250_000


def _three_loads(spark, rows, name, *by):
    """A stream of ``rows`` in three micro-batches of every third row each, by hash of ``by``. A micro-batch has as many files
    as it takes for about ``FILE_ROWS`` rows a file, so neither writing nor reading one grows with the table."""
    files, each = st.scratch_path(spark, name), max(1, -(-rows.count() // (3 * FILE_ROWS)))
    rows.repartition(3 * each, F.xxhash64(*by)).write.parquet(files)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(files)


def _daily(spark, d):
    out, ck = st.scratch_path(spark, "daily"), st.scratch_path(spark, "daily-ck")
    st.stream_daily_counts(_stream(spark, d, "events"), out, ck, key="event_type")
    return st.latest_windows(spark, out, key="event_type")


def _intake(spark, d):
    """The collections in three micro-batches of every third row each, whatever its batch and sequence."""
    li = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet")
    c = li.select(F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.org/p/"),
                           F.col("l_partkey").cast("string")).alias("url"),
                  (F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("url_id"),
                  F.col("l_orderkey").alias("batch_id"),
                  F.struct(F.col("l_orderkey").alias("batch_id"), *ARRIVAL_ORDER[1:]).alias("seq"))
    out, ck = (st.scratch_path(spark, name) for name in ("intake", "intake-ck"))
    st.stream_intake(_three_loads(spark, c, "intake-files", "seq", "url"), out, ck, id_col="url_id", buckets=16)
    return out


def _retention(spark, d):
    e = _stream(spark, d, "events")
    logs = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("batch_id"), F.col("event_type").alias("log"),
                    F.col("ts").alias("created_at"))
    out, ck = st.scratch_path(spark, "logs"), st.scratch_path(spark, "logs-ck")
    st.stream_log_retention(logs, out, ck, AS_OF)
    return spark.read.parquet(out)


QUERIES = {
    "stream_daily_event_counts": _daily,
    "stream_intake_summary": lambda spark, d: st.intake_summary(spark, _intake(spark, d)),
    "stream_intake_duplicates": lambda spark, d: st.intake_duplicates(spark, _intake(spark, d)),
    "stream_intake_urls": lambda spark, d: st.intake_urls(spark, _intake(spark, d)).select("id", "url", "batch_id", "outcome"),
    "stream_log_retention": _retention,
}

ORACLES = {
    "stream_daily_event_counts": """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
 event_type, COUNT(*) AS n FROM events GROUP BY 1, 2, 3""",
    "stream_intake_summary": with_views(_SUMMARY),
    "stream_intake_duplicates": with_views("SELECT url, batch_id, url_id AS original_url_id FROM ranked WHERE rn>1"),
    "stream_intake_urls": with_views("SELECT url_id AS id, url, batch_id, 'pending' AS outcome FROM ranked WHERE rn=1"),
    "stream_log_retention": with_views(f"SELECT * FROM logs WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
}


def _status(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("url_id"), F.col("event_type").alias("outcome"),
                                           F.col("event_id").alias("seq"))
    out, ck = st.scratch_path(spark, "status"), st.scratch_path(spark, "status-ck")
    st.stream_status(e, out, ck)
    return st.current_status(spark, out)


QUERIES["stream_status"] = _status
ORACLES["stream_status"] = "SELECT user_id AS url_id, arg_max(event_type, event_id) AS outcome FROM events GROUP BY user_id"


def _agency_sync(spark, d):
    """The change pages in three micro-batches that hold rows of every page."""
    from urlsift.plans.q_tasks import _sync_pages

    t = load_model(spark, d)
    pages = _sync_pages(t)
    out, ck = (st.scratch_path(spark, name) for name in ("sync", "sync-ck"))
    st.stream_agency_sync(_three_loads(spark, pages, "sync-files", "display_name"), out, ck)
    return st.synced_agencies(spark, t["agencies"], out)


def _register_sync():
    from urlsift.plans.q_tasks import _SYNC_PAGES, _SYNCED

    QUERIES["stream_agency_sync"] = _agency_sync
    ORACLES["stream_agency_sync"] = with_views(_SYNCED, _SYNC_PAGES)


_register_sync()
