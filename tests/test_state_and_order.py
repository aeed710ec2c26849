"""Stored cursors, decisions in order, numbered pages, skewed keys and bucketed reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from urlsift.operators import agency_match, ordering, sizing, sync
from urlsift.operators import review as rv
from urlsift.operators.queues import limit_by_page
from urlsift.sources import intake

AGENCY = "agency_id long, name string, state string, county string, locality string"


def _pages(spark, numbers):
    return spark.createDataFrame([(p, p % 7, f"a{p}") for p in numbers], "page int, agency_id long, display_name string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("state_name", "county_name", "locality_name")],
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))


def test_sync_goes_on_after_an_interrupted_run_and_waits_for_a_missing_page(spark, tmp_path):
    target, none, now = f"{tmp_path}/sync", spark.createDataFrame([], AGENCY), "2024-02-01 00:00:00"
    one = sync.run_agency_sync(none, _pages(spark, range(1, 10)), target, now, 4)
    assert (one.last_page, one.current_page, one.missing_page, one.last_full_sync_at) == (4, 5, None, None)
    # a run that wrote its snapshot but not its cursor did not happen
    spark.createDataFrame([(99, "half", None, None, None)], AGENCY).write.parquet(f"{target}/agencies/run=1")
    gap = sync.run_agency_sync(none, _pages(spark, [1, 2, 3, 4, 5, 7, 8, 9]), target, now)
    assert (gap.run, gap.last_page, gap.current_page, gap.missing_page) == (1, 5, 6, 6)
    waiting = sync.run_agency_sync(none, _pages(spark, [7, 8, 9]), target, now)
    assert (waiting.last_page, waiting.current_page, waiting.missing_page) == (5, 6, 6)
    full = sync.run_agency_sync(none, _pages(spark, range(1, 10)), target, now)
    assert (full.last_page, full.current_page, full.current_cutoff_date) == (9, None, dt.date(2024, 1, 31))
    assert {r.agency_id: r.name for r in sync.synced(spark, target).collect()} == {k: f"a{max(p for p in range(1, 10) if p % 7 == k)}" for k in range(7)}
    empty = sync.run_agency_sync(none, _pages(spark, []), f"{tmp_path}/none", now)
    assert empty.current_page is None and empty.last_full_sync_at is not None


@pytest.fixture
def catalogue(spark):
    urls = spark.createDataFrame([(1, "pending", None, None, None), (2, "pending", "Other", "n", "d"), (3, "pending", None, None, None)],
                                 "id long, outcome string, record_type string, name string, description string")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {"urls": urls, "agencies": table([(5, "five", None, None, None)], AGENCY), "confirmed_url_agency": table([(2, 5)], "url_id long, agency_id long"),
            "url_optional_data_source_metadata": table([(2, ["PDF"], "X", None)], "url_id long, record_formats array<string>, data_portal_type string, supplying_entity string"),
            "reviewing_user_url": table([(2, 40), (9, 41)], "url_id long, user_id long"),
            "user_relevant_suggestions": table([], "url_id long, user_id long, suggested_status string"),
            "user_record_type_suggestions": table([], "url_id long, user_id long, record_type string"),
            "user_url_agency_suggestions": table([], "url_id long, user_id long, agency_id long, is_new boolean")}


def test_two_rejections_of_a_url_give_one_row(spark, catalogue):
    d = spark.createDataFrame([(1, 7, "not relevant", 1), (1, 8, "individual record", 2), (1, 9, "spam", 3), (2, 7, "broken page/404 not found", 1)],
                              "url_id long, user_id long, reason string, seq int")
    out, rejects = rv.apply_rejections(catalogue, d)
    assert {r.id: r.outcome for r in out["urls"].collect()} == {1: "individual record", 2: "404 not found", 3: "pending"} and out["urls"].count() == 3
    assert sorted(map(tuple, out["reviewing_user_url"].collect())) == [(1, 8), (2, 7), (9, 41)]
    assert [tuple(r) for r in rejects.collect()] == [(1, "Invalid rejection reason: spam")]


def test_approvals_act_in_order(spark, catalogue):
    schema = "url_id long, user_id long, seq int, record_type string, name string, description string, agency_ids array<long>, record_formats array<string>"
    d = spark.createDataFrame([(1, 7, 1, None, "early", "e", [6], None), (1, 8, 2, "Stops", "n1", "d1", [6, 5], ["CSV"]), (1, 9, 3, None, "n2", None, [], None),
                               (2, 7, 1, None, None, None, None, None), (3, 7, 1, "Stops", "x", "y", [], None)], schema)
    out, rejects = rv.apply_approvals(catalogue, d)
    assert {r.id: tuple(r)[1:] for r in out["urls"].collect()} == {1: ("validated", "Stops", "n2", "d1"), 2: ("validated", "Other", "n", "d"), 3: ("pending", None, None, None)}
    assert sorted(map(tuple, rejects.collect())) == [(1, rv.NO_RECORD_TYPE), (3, rv.NO_AGENCY)]
    assert sorted(map(tuple, out["confirmed_url_agency"].collect())) == [(1, 5), (1, 6), (2, 5)]
    assert {r.agency_id for r in out["agencies"].collect()} == {5, 6}
    assert {r.url_id: r.record_formats for r in out["url_optional_data_source_metadata"].collect()} == {1: ["CSV"], 2: ["PDF"]}
    assert sorted(map(tuple, out["reviewing_user_url"].collect())) == [(1, 9), (2, 7), (9, 41)]


def test_annotation_with_a_new_agency_is_accepted(spark, catalogue):
    d = spark.createDataFrame([(1, 7, "relevant", "Stops", None, True, 1), (2, 7, "relevant", "Stops", None, False, 1), (3, 7, "relevant", "Stops", 8, False, 1),
                               (3, 7, "relevant", "Other", 5, False, 2), (2, 8, "not relevant", None, None, None, 1)],
                              "url_id long, user_id long, suggested_status string, record_type string, agency_id long, is_new boolean, seq int")
    out = rv.apply_all_annotations(catalogue, d)
    assert sorted(map(tuple, out["user_url_agency_suggestions"].collect())) == [(1, 7, None, True), (3, 7, 5, False)]
    assert sorted(map(tuple, out["user_record_type_suggestions"].collect())) == [(1, 7, "Stops"), (3, 7, "Other")]
    assert [(r.url_id, r.user_id) for r in out["rejects"].collect()] == [(2, 7)]


def test_pages_and_running_totals(spark):
    rows = spark.range(1037).select((F.col("id") * 37 % 1037).alias("id"), (F.col("id") % 3).alias("g")).repartition(5)
    index = ordering.page_index(rows, ["g", "id"], 100)
    want = sorted((r.g, r.id) for r in rows.collect())
    for page in (1, 2, 7, 11, 12):
        got = [(r.g, r.id) for r in ordering.read_page(rows, ["g", "id"], index, page).orderBy("g", "id").collect()]
        assert got == want[100 * (page - 1):100 * page]
    total = ordering.running_total(rows, ["id"], F.col("g"), "b")
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    run = 0
    for r in total.orderBy("id").collect():
        assert r.b == run
        run += r.g
    hits = spark.createDataFrame([(p, k % 2 == 0) for p in range(1, 9) for k in range(5)], "page int, m boolean")
    assert {r.page for r in limit_by_page(hits, 7, matched="m").collect()} == {1, 2, 3} and limit_by_page(hits.limit(0), 3).count() == 0


def test_left_join_with_hot_and_missing_keys(spark):
    left = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(4)).otherwise(F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(k, f"n{k}") for k in range(40)], "k long, name string")
    got = sizing.skew_left_join(left, right, "k", hot_rows=1000)
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.select("id", "k", "name").collect())) == sorted(map(str, want.select("id", "k", "name").collect()))
    assert sizing.skew_left_join(left, right, "k").count() == 9000


def test_stored_html_is_read_from_its_buckets_only(spark, tmp_path):
    html = spark.range(500).select(F.col("id").alias("url_id"), F.concat(F.lit("p"), "id").alias("html"))
    intake.store_html(html, f"{tmp_path}/h")
    got = intake.html_for_url(spark, f"{tmp_path}/h", spark.createDataFrame([(3,), (7,), (9999,), (3,)], "url_id long"))
    assert "bucket#" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("ReadSchema")[0]
    assert sorted((r.url_id, r.html) for r in got.collect()) == [(3, "p3"), (7, "p7")]


def test_agency_match_exact_partial_none_and_error(spark):
    agencies = spark.createDataFrame([(1, "Kent County Sheriff"), (2, "kent  county SHERIFF "), (3, "Ada Police Department"), (4, "Boise Police Department"), (5, None)],
                                     "agency_id long, name string")
    foia = spark.createDataFrame([(10, "ada police department"), (11, "Kent County Sheriff"), (12, "City of Boise Police Department"), (13, "Nobody")], "id long, name string")
    records = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (5, 77), (6, None)], "url_id long, foia_agency_id long")
    got = sorted((tuple(r) for r in agency_match.match_agencies(agency_match.foia_agency_names(records, foia), agencies).collect()), key=str)
    assert got == sorted([(1, "exact", 3), (2, "partial", 1), (2, "partial", 2), (3, "partial", 4), (4, "none", None), (5, "error", None), (6, "error", None)], key=str)
