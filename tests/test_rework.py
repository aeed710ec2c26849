"""Cases that went wrong once: late status updates, replayed epochs, split tables, sync bounds, null package values."""

from pyspark.sql import functions as F

from urlsift.operators.loads import assign_ids, first_occurrence, occurrence_runs, repeated
from urlsift.operators.queues import ckan_filter
from urlsift.operators.tasks import agency_sync, sync_cursor
from urlsift.streaming import streams as st


def _pages(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("page"), F.col("id").alias("agency_id"), F.concat(F.lit("a"), "id").alias("display_name"),
        F.lit("s").alias("state_name"), F.lit(None).cast("string").alias("county_name"), F.lit(None).cast("string").alias("locality_name"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))


def test_sync_applies_every_page_and_ends_exactly_at_a_bound(spark):
    none = spark.createDataFrame([], "agency_id long, name string, state string, county string, locality string")
    assert agency_sync(none, _pages(spark, 45)).count() == 45
    assert agency_sync(none, _pages(spark, 45), 1, 30).count() == 30
    assert sync_cursor(_pages(spark, 45), 1, "2024-02-01 00:00:00", 30).first().current_page == 31
    assert sync_cursor(_pages(spark, 30), 1, "2024-02-01 00:00:00", 30).first().current_page is None
    assert sync_cursor(_pages(spark, 45), 1, "2024-02-01 00:00:00").first().current_page is None


def _split(spark, tmp_path, rows, schema, name):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_late_status_update_does_not_win(spark, tmp_path):
    s = _split(spark, tmp_path, [[(1, "validated", 10)], [(1, "pending", 3), (2, "pending", 4)], [(2, "error", 9)]],
               "url_id long, outcome string, seq long", "updates")
    st.stream_status(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.url_id: r.outcome for r in st.current_status(spark, f"{tmp_path}/out").collect()}
    assert got == {1: "validated", 2: "error"}


def _intake_state(spark, target):
    urls = sorted((r.url, r.id, r.batch_id) for r in st.intake_urls(spark, target).collect())
    dups = sorted(map(tuple, st.intake_duplicates(spark, target).collect()))
    return urls, dups, sorted(map(tuple, st.intake_summary(spark, target).where("total_count > 0").collect()))


def test_intake_over_batches_equals_one_batch_and_replays(spark, tmp_path):
    schema = "url string, url_id long, batch_id long, seq long"
    rows = [[("u1", 1, 2, 3), ("u2", 2, 1, 2), ("u2", 2, 1, 2)], [("u3", 3, 1, 5), (None, 9, 1, 9)], [("u3", 3, 2, 4), ("u1", 1, 1, 1)], [("u2", 2, 1, 7)]]
    s = _split(spark, tmp_path, rows, schema, "urls")
    st.stream_intake(s, f"{tmp_path}/many", f"{tmp_path}/ck", id_col="url_id")
    want = ([("u1", 1, 1), ("u2", 2, 1), ("u3", 3, 2)], [("u1", 2, 1), ("u2", 1, 2), ("u2", 1, 2), ("u3", 1, 3)], [(1, 5, 2, 3), (2, 2, 1, 1)])
    assert _intake_state(spark, f"{tmp_path}/many") == want  # rows that come late take over as originals
    # the same input again from scratch into the same target: epochs are overwritten, nothing doubles
    st.stream_intake(s, f"{tmp_path}/many", f"{tmp_path}/ck2", id_col="url_id")
    assert _intake_state(spark, f"{tmp_path}/many") == want


def test_intake_reads_only_the_buckets_it_touches(spark, tmp_path):
    rows = [[(f"u{k}", 1, k) for k in range(200)], [("u7", 2, 300), ("new", 2, 301)]]
    s = _split(spark, tmp_path, rows, "url string, batch_id long, seq long", "urls")
    st.stream_intake(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = st.intake_urls(spark, f"{tmp_path}/out")
    assert got.count() == got.select("id").distinct().count() == 201
    some = st.intake_urls(spark, f"{tmp_path}/out", [3, 5])
    assert "IN (3,5)" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert 0 < some.count() < 30


def test_ids_that_meet_grow_longer(spark):
    urls = spark.range(3000).select(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"))
    taken = assign_ids(urls.where("url < 'https://x/2'"), spark.createDataFrame([], "id long"), (13, 15, 18))
    ids = assign_ids(urls, taken, (13, 15, 18)).collect()
    assert len(ids) == 3000 == len({r.id for r in ids}) and min(r.id for r in ids) >= 1 << 13
    assert not {r.id for r in ids} & {r.id for r in taken.collect()}
    assert max(r.id for r in ids) >= 1 << 15  # some had to grow


def test_many_equal_rows_stay_counts(spark):
    rows = spark.range(10_000_000).select(F.lit("u").alias("url"), F.lit(1).alias("seq"))
    runs = occurrence_runs(rows, ["url"], ["seq"]).collect()
    assert [tuple(r) for r in runs] == [("u", 1, 1, 9_999_999)]
    assert first_occurrence(rows, ["url"], ["seq"]).groupBy("is_first").count().orderBy("count").collect() == [(True, 1), (False, 9_999_999)]
    odd = spark.createDataFrame([("a", 0), ("b", 4096), ("c", 4097), ("d", 1)], "k string, n long")
    assert {r.k: r["count"] for r in repeated(odd, "n").groupBy("k").count().collect()} == {"b": 4096, "c": 4097, "d": 1}


def test_package_with_null_extra_value_stays(spark):
    p = spark.createDataFrame([([("accessLevel", None)], [("r",)])], "extras array<struct<key:string,value:string>>, resources array<struct<url:string>>")
    assert ckan_filter(p).count() == 1
