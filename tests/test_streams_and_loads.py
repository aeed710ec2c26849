"""Agency sync stream (S5) with restart, manual batch load (A10) and stored-HTML round trip."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from urlsift.operators import loads
from urlsift.sources import intake
from urlsift.streaming import streams as st

PAGE = ("page int, agency_id long, display_name string, state_name string, county_name string, "
        "locality_name string, updated_at timestamp_ntz")


def test_agency_sync_stream_restart(spark):
    base = tempfile.mkdtemp(prefix="sync-", dir="/tmp")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    ts = dt.datetime(2024, 1, 1)
    p1 = [(1, i, f"A{i}", "S", None, None, ts) for i in range(5)]
    p2 = [(2, 1, "A1-new", "S2", None, None, ts)]
    spark.createDataFrame(p1, PAGE).write.parquet(f"{src}/p1")
    schema = spark.createDataFrame([], PAGE).schema
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)  # noqa
    st.stream_agency_sync(stream(), out, ck)
    spark.createDataFrame(p2, PAGE).write.parquet(f"{src}/p2")
    st.stream_agency_sync(stream(), out, ck)  # restart: resumes at the unread file only
    agencies = spark.createDataFrame([(0, "old", None, None, None), (9, "other", None, None, None)],
                                     "agency_id long, name string, state string, county string, locality string")
    got = {r.agency_id: r.name for r in st.synced_agencies(spark, agencies, out).collect()}
    assert got == {0: "A0", 1: "A1-new", 2: "A2", 3: "A3", 4: "A4", 9: "other"}


def test_manual_batch_load(spark):
    entries = spark.createDataFrame(
        [(f"https://m/{i % 60}", i, f"n{i}" if i % 2 else None) for i in range(100)],
        "url string, seq long, name string")
    urls = spark.createDataFrame([(1, "https://m/0")], "id long, url string")
    batch, ld, meta, dups = loads.manual_batch_load(entries, "my batch", 5, 77, urls)
    b = batch.collect()[0]
    assert (b.strategy, b.status, b.parameters) == ("manual", "ready to label", '{"name":"my batch"}')
    assert ld.new_urls.count() == 59  # 60 distinct URLs, one already catalogued
    assert dups.count() == 41  # 40 repeats inside the batch + 1 known URL
    assert meta.count() == 59


def test_store_and_read_html(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="html-", dir="/tmp"), "h")
    html = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(20)], "url_id long, html string")
    intake.store_html(html, path)
    got = intake.html_for_url(spark, path, spark.createDataFrame([(3,), (7,)], "url_id long"))
    assert sorted((r.url_id, r.html) for r in got.collect()) == [(3, "<p>3</p>"), (7, "<p>7</p>")]
