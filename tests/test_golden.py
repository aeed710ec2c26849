"""Golden cases lifted from the reference's tests (FIXTURES.md §1.3) and edge cases of single operators."""

import datetime as dt
import json

from pyspark.sql import functions as F

from urlsift.functions import scalars as h
from urlsift.functions.html import parse_html
from urlsift.operators import loads, queues, review, sets, tasks
from urlsift.operators.metrics import backlog_by_month, pending_annotation_histogram
from urlsift.sources import intake


def test_insert_urls_first_wins(spark):
    inc = spark.createDataFrame([("/1", 1, 1), ("/2", 1, 2), ("/1", 1, 3)], "url string, batch_id long, seq long")
    ld = loads.insert_urls(inc, spark.createDataFrame([], "id long, url string"))
    s = ld.summary.collect()[0]
    assert (s.total_count, s.original_count, s.duplicate_count) == (3, 2, 1)
    assert [r.url for r in ld.duplicates.collect()] == ["/1"]
    # reloading the same URLs: every row is a duplicate of the catalogued original
    again = loads.insert_urls(inc, ld.new_urls.select("id", "url"))
    assert again.summary.collect()[0].duplicate_count == 3


def test_first_occurrence_exact_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5)], "k string, o int")
    r = loads.first_occurrence(df, ["k"], ["o"]).groupBy("k", "is_first").count().collect()
    got = {(x.k, x.is_first): x["count"] for x in r}
    assert got == {("a", True): 1, ("a", False): 2, ("b", True): 1}


def test_keyword_and_title_filters(spark):
    df = spark.createDataFrame([("https://keyword.com",), ("https://example.com",), ("https://keyword.com/page3",)],
                               "url string")
    assert [r.url for r in queues.filter_url_keyword(df, "keyword").collect()] == [
        "https://keyword.com", "https://keyword.com/page3"]
    t = spark.createDataFrame([(1, "Keyword one", 1), (1, "lemon", 2), (2, "a KEYWORD", 3)],
                              "page int, title string, id int")
    hits = queues.filter_title_search(t, "keyword")
    assert sorted(r.id for r in hits.collect()) == [1, 3]
    limited = queues.limit_by_page(hits, 1)
    assert sorted(r.id for r in limited.collect()) == [1]
    assert queues.filter_title_search(t, "").count() == 3


def test_search_intake_metadata(spark):
    p = json.dumps({"query": "q", "query_results": [{"url": "https://x", "title": "T", "snippet": "S"}]})
    out = intake.intake_search_results(spark.createDataFrame([(p,)], "payload string")).collect()
    assert out[0].url == "https://x"
    assert json.loads(out[0].collector_metadata) == {"query": "q", "title": "T", "snippet": "S"}


def test_normalize_record_formats(spark):
    df = spark.createDataFrame([(["XLSX", "CSV", "csv file", "weird", "weird", "HTML", "Other"],)],
                               "f array<string>")
    got = df.select(h.normalize_record_formats("f").alias("n")).collect()[0].n
    assert got == ["XLS", "CSV", "Other", "Other", "HTML text"]


PKG = ("name string, title string, notes string, metadata_modified string, base_url string, "
       "organization struct<title:string>, resources array<struct<format:string,url:string>>, "
       "extras array<struct<key:string,value:string>>")


def test_ckan_filter_and_parse(spark):
    rows = [
        ("a", "A", "n", "2024-03-04T00:00:00", "https://p/", ("Org",), [("HTML", "https://a")], None),
        ("b", "B", "n", "2024-03-04T00:00:00", "https://p/", ("Org",), [],
         [("landingPage", "https://land"), ("publisher", "Pub")]),
        ("c", "C", "n", "2024-03-04T00:00:00", "https://p/", ("Org",), [("CSV", "https://c")], None),
        ("d", "D", "n", "2024-03-04T00:00:00", "https://p/", ("Org",), [], [("accessLevel", "non-public")]),
        ("e", "E", "n", "2024-03-04T00:00:00", "https://p/", ("Org",), [], [("collection_metadata", "true")]),
    ]
    pk = spark.createDataFrame(rows, PKG)
    kept = queues.ckan_filter(pk)
    assert sorted(r.name for r in kept.collect()) == ["a", "b", "c"]
    parsed = {r.submitted_name: r for r in intake.ckan_packages_to_rows(kept).collect()}
    assert parsed["A"].source_url == "https://a" and parsed["A"].data_portal_type == ""
    assert parsed["B"].source_url == "https://land" and parsed["B"].record_format == ["HTML text"]
    assert parsed["B"].supplying_entity == "Pub"
    assert parsed["C"].source_url == "https://p/dataset/c" and parsed["C"].data_portal_type == "CKAN"
    assert parsed["C"].source_last_updated == "2024-03-04"


def test_parse_document_rules(spark):
    def parse_document(html, **how):
        pages = spark.createDataFrame([(1, "https://a.gov/x", html, "text/html")], "url_id long, url string, html string, content_type string")
        return parse_html(pages, **how).first().asDict()

    html = ("<html><head><title>  A \n title </title><meta name='description' content=' d  e '></head><body>"
            "<h1>One</h1><h1><a href='x'>Linked</a></h1><h2>Two <b>parts</b></h2>"
            "<div>outer <div>inner</div></div><script>var x='<div>no</div>';</script><p>unclosed<b>bold"
            "</body></html>")
    d = parse_document(html)
    assert d["title"] == "A title"
    assert d["description"] == "d e"
    assert d["h1"] == '["One"]'
    assert d["h2"] == '["Two parts"]'
    assert d["h3"] is None
    assert d["div"] == "outer inner inner "
    many = "<div>" + " ".join(["w"] * 400) + "</div><div>" + " ".join(["v"] * 200) + "</div>"
    assert parse_document(many)["div"].split() == ["w"] * 400
    assert parse_document(many, div_words=None)["div"].split() == ["w"] * 400 + ["v"] * 200
    # nested divs, headers with links, unclosed and stray tags, an absent page
    odd = parse_document("<title> a <b>c</b></title></p><div>x<div>y<script>z</script><h2>k</h2></div>w<h2><a>l</a></h2>")
    assert odd["title"] is None and odd["h2"] == '["k"]' and odd["div"] == "x y k w l y k "
    assert parse_document("<title><b> one\n two </b></title>")["title"] == "one two"
    assert parse_document(None)["div"] == "" and parse_document("")["description"] == ""


def test_match_to_suggestions(spark):
    m = "array<struct<id:long,submitted_name:string,state:string,county:string,locality:string>>"
    df = spark.createDataFrame([
        (1, "exact", [(10, "A", "S", "C", "L")]),
        (2, "partial", [(11, "B", "S", "C", "L"), (12, "C", "S", "C", None)]),
        (3, "none", []), (4, "weird", [])], f"url_id long, status string, matches {m}")
    out = {(r.url_id, r.suggestion_type, r.agency_id, r.locality, r.error is None)
           for r in tasks.match_to_suggestions(df).collect()}
    assert (1, "Confirmed", 10, None, True) in out  # locality dropped on exact match
    assert (2, "Auto Suggestion", 11, "L", True) in out and (2, "Auto Suggestion", 12, None, True) in out
    assert (3, "Unknown", None, None, True) in out
    assert (4, None, None, None, False) in out


def test_probe_404_golden(spark):
    queue = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "id long, url string")
    probes = spark.createDataFrame([(1, 200), (2, 404), (3, None)], "url_id long, status int")
    ch = tasks.probe_404_task(queue, probes, "2024-02-01 00:00:00")
    assert [r.url_id for r in ch.status_updates.collect()] == [2]
    assert ch.upserts["url_probed_for_404"].count() == 3


def test_duplicate_task_golden(spark):
    queue = spark.createDataFrame([(1, "https://a"), (2, "https://b")], "id long, url string")
    known = spark.createDataFrame([("https://a",)], "url string")
    ch = tasks.duplicate_task(queue, known, "2024-02-01 00:00:00")
    assert [(r.url_id, r.outcome) for r in ch.status_updates.collect()] == [(1, "duplicate")]
    assert ch.appends["url_checked_for_duplicate"].count() == 2


def test_expire_logs_golden(spark):
    old = dt.datetime(2024, 1, 24, 23, 0)
    t = {"logs": spark.createDataFrame([(i, 1, "x", old) for i in range(3)],
                                       "id long, batch_id long, log string, created_at timestamp_ntz")}
    assert review.expire_logs(t, "2024-02-01 00:00:00").count() == 0


def test_backlog_latest_per_month(spark):
    rows = [(1, dt.datetime(2024, 1, 3), 1), (2, dt.datetime(2024, 2, 3), 3), (3, dt.datetime(2024, 2, 20), 5),
            (4, dt.datetime(2024, 3, 1), 7), (5, dt.datetime(2024, 3, 30), 12)]
    t = {"backlog_snapshot": spark.createDataFrame(rows, "id long, created_at timestamp_ntz, count_pending_total int")}
    got = sorted((r.month_label, r.count_pending_total) for r in backlog_by_month(t).collect())
    assert got == [("February 2024", 5), ("January 2024", 1), ("March 2024", 12)]


def test_pending_histogram_zero_filled(spark):
    urls = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "error")], "id long, outcome string")
    one = spark.createDataFrame([(1,)], "url_id long")
    none = spark.createDataFrame([], "url_id long")
    t = {"urls": urls, "user_relevant_suggestions": one, "user_record_type_suggestions": one,
         "user_url_agency_suggestions": none}
    r = pending_annotation_histogram(t).collect()[0]
    assert (r.all_pending, r.annotations_0, r.annotations_1, r.annotations_2, r.annotations_3) == (2, 1, 0, 1, 0)


def test_agency_set_diff(spark):
    existing = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "url_id long, agency_id long")
    wanted = spark.createDataFrame([(1, 11), (1, 12), (3, None)], "url_id long, agency_id long")
    add, remove = sets.agency_set_diff(existing, wanted)
    assert [(r.url_id, r.agency_id) for r in add.collect()] == [(1, 12)]
    assert [(r.url_id, r.agency_id) for r in remove.collect()] == [(1, 10)]


def test_upsert_and_last_by(spark):
    cur = spark.createDataFrame([(1, 1, "relevant"), (2, 1, "relevant")], "url_id long, user_id long, suggested_status string")
    dec = spark.createDataFrame([(1, 1, 1, "not relevant"), (1, 1, 2, "individual record"), (3, 1, 1, "relevant")],
                                "url_id long, user_id long, seq long, suggested_status string")
    out = review.apply_relevance_annotations({"user_relevant_suggestions": cur}, dec)
    got = {(r.url_id, r.suggested_status) for r in out.collect()}
    assert got == {(1, "individual record"), (2, "relevant"), (3, "relevant")}


def test_scalars(spark):
    df = spark.createDataFrame([("example.com/a/b/",)], "u string")
    r = df.select(h.add_https("u").alias("a"), h.url_path("u").alias("p"), h.root_url(h.add_https("u")).alias("r"),
                  h.add_url_param(h.add_https("u"), "k", "v").alias("q"),
                  h.squeeze_ws(F.lit(" a   b\t")).alias("s")).collect()[0]
    assert r.a == "https://example.com/a/b/" and r.p == "a/b" and r.r == "https://example.com"
    assert r.q == "https://example.com/a/b/?k=v" and r.s == "a b"
