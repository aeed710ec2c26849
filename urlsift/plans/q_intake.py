"""Registered intake / dedup / set / scalar queries (A, E2, G, H) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.functions import scalars as h
from urlsift.operators import loads, sets
from urlsift.plans.oracle import with_views
from urlsift.sources import intake
from urlsift.sources.fixtures import ARRIVAL_ORDER, load_model


def _incoming(t):
    c = t["collected"]
    return c.select("url", "batch_id", "url_id", F.struct(*ARRIVAL_ORDER).alias("seq"))


def _empty_catalog(spark):
    return spark.createDataFrame([], "id long, url string")


def _load_fresh(spark, d):
    t = load_model(spark, d)
    return loads.insert_urls(_incoming(t), _empty_catalog(spark), id_col="url_id")


def _load_again(spark, d):
    t = load_model(spark, d)
    return loads.insert_urls(_incoming(t), t["urls"], id_col="url_id")


def _generated_ids(spark, d):
    """New URLs looked up again by ids that start out too short for their number: each id names its own URL."""
    new = loads.insert_urls(_incoming(load_model(spark, d)).drop("url_id"), _empty_catalog(spark), id_widths=(14, 20, 61)).new_urls
    return new.select("url", "batch_id", "id").join(new.select("id", F.col("url").alias("url_of_id")), "id").drop("id")


def _search_payloads(t):
    """Search payloads derived from the collections: one query per batch, its URLs as results."""
    c = t["collected"]
    res = F.struct("url", F.concat(F.lit("title "), F.col("l_linenumber").cast("string")).alias("title"),
                   F.col("l_returnflag").alias("snippet"))
    per_batch = c.groupBy("batch_id").agg(F.collect_list(res).alias("query_results"))
    return per_batch.select(F.to_json(F.struct(F.concat(F.lit("query "), F.col("batch_id").cast("string")).alias("query"),
                                               "query_results")).alias("payload"))


def _url_scalars(spark, d):
    p = load_model(spark, d).base("pages")
    return p.select(
        "page_id", h.add_https(F.regexp_replace("url", "^https?://", "")).alias("with_https"),
        h.url_path("url").alias("url_path"), h.root_url("url").alias("root_url"),
        h.add_url_param("url", "page", "2").alias("with_param"),
        h.squeeze_ws(F.concat(F.lit("  a \t b\n"), F.col("url"), F.lit("  "))).alias("squeezed"),
        h.iso_day(F.lit("2024-01-05T10:11:12")).alias("iso_day"))


QUERIES = {
    "insert_urls_summary": lambda spark, d: _load_fresh(spark, d).summary,
    "insert_urls_duplicates": lambda spark, d: _load_fresh(spark, d).duplicates,
    "insert_urls_new": lambda spark, d: _load_fresh(spark, d).new_urls.select("id", "url", "batch_id", "outcome"),
    "insert_urls_reload_summary": lambda spark, d: _load_again(spark, d).summary,
    "insert_urls_generated_ids": _generated_ids,
    "first_occurrence": lambda spark, d: loads.first_occurrence(
        load_model(spark, d)["collected"].select("url_id", *ARRIVAL_ORDER), ["url_id"], ARRIVAL_ORDER)
        .groupBy("batch_id", "is_first").agg(F.count(F.lit(1)).alias("n")),
    "intake_search_results": lambda spark, d: intake.intake_search_results(_search_payloads(load_model(spark, d))),
    "dedup_keep_last": lambda spark, d: sets.dedup_keep_last(
        load_model(spark, d)["collected"].select("url_id", "l_returnflag", F.col("l_linenumber").alias("seq")),
        ["url_id", "l_returnflag"]),
    "agency_set_diff_add": lambda spark, d: sets.agency_set_diff(
        load_model(spark, d)["confirmed_url_agency"], load_model(spark, d)["user_url_agency_suggestions"])[0],
    "agency_set_diff_remove": lambda spark, d: sets.agency_set_diff(
        load_model(spark, d)["confirmed_url_agency"], load_model(spark, d)["user_url_agency_suggestions"])[1],
    "union_sources": lambda spark, d: sets.union_sources(
        intake.intake_url_list(load_model(spark, d)["urls"].where("outcome = 'validated'"), "url"),
        intake.intake_search_results(_search_payloads(load_model(spark, d)))),
    "url_scalars": _url_scalars,
    "month_labels": lambda spark, d: load_model(spark, d)["batches"].select(
        "id", h.month_start("date_generated").alias("month"), h.month_label("date_generated").alias("label"),
        h.days_ago(F.col("date_generated"), 7).alias("week_before")),
}

_SUMMARY = """SELECT batch_id, COUNT(*) AS total_count, COUNT(*) FILTER (WHERE rn=1) AS original_count,
 COUNT(*) FILTER (WHERE rn>1) AS duplicate_count FROM ranked GROUP BY batch_id"""
_JSON_ROW = ("to_json(struct_pack(query:=CONCAT('query ', CAST(batch_id AS VARCHAR)), "
             "title:=CONCAT('title ', CAST(l_linenumber AS VARCHAR)), snippet:=l_returnflag))")
ORACLES = {
    "insert_urls_summary": with_views(_SUMMARY),
    "insert_urls_duplicates": with_views("SELECT url, batch_id, url_id AS original_url_id FROM ranked WHERE rn>1"),
    "insert_urls_new": with_views("SELECT url_id AS id, url, batch_id, 'pending' AS outcome FROM ranked WHERE rn=1"),
    "insert_urls_reload_summary": with_views(
        "SELECT batch_id, COUNT(*) AS total_count, CAST(0 AS BIGINT) AS original_count, COUNT(*) AS duplicate_count"
        " FROM collected GROUP BY batch_id"),
    "insert_urls_generated_ids": with_views("SELECT url, url AS url_of_id, batch_id FROM ranked WHERE rn=1"),
    "first_occurrence": with_views(
        "SELECT batch_id, rn=1 AS is_first, COUNT(*) AS n FROM ranked GROUP BY batch_id, rn=1"),
    "intake_search_results": with_views(f"SELECT url, {_JSON_ROW} AS collector_metadata FROM collected"),
    "dedup_keep_last": with_views(
        "SELECT url_id, l_returnflag, MAX(l_linenumber) AS seq FROM collected GROUP BY url_id, l_returnflag"),
    "agency_set_diff_add": with_views(
        """SELECT DISTINCT w.url_id, w.agency_id FROM user_url_agency_suggestions w WHERE w.agency_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM confirmed_url_agency e WHERE e.url_id=w.url_id AND e.agency_id=w.agency_id)"""),
    "agency_set_diff_remove": with_views(
        """SELECT e.url_id, e.agency_id FROM confirmed_url_agency e
 WHERE NOT EXISTS (SELECT 1 FROM user_url_agency_suggestions w WHERE w.url_id=e.url_id AND w.agency_id=e.agency_id)
 AND EXISTS (SELECT 1 FROM user_url_agency_suggestions w WHERE w.url_id=e.url_id AND w.agency_id IS NOT NULL)"""),
    "union_sources": with_views(
        f"""SELECT url, CAST(NULL AS VARCHAR) AS collector_metadata FROM urls WHERE outcome='validated'
UNION ALL SELECT url, {_JSON_ROW} AS collector_metadata FROM collected"""),
    "url_scalars": r"""SELECT page_id,
 CASE WHEN regexp_replace(url, '^https?://', '') LIKE 'http%' THEN regexp_replace(url, '^https?://', '')
  ELSE CONCAT('https://', regexp_replace(url, '^https?://', '')) END AS with_https,
 regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/', ''), '/$', '') AS url_path,
 regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root_url,
 CONCAT(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'page=2') AS with_param,
 CONCAT('a b ', url) AS squeezed, '2024-01-05' AS iso_day FROM pages""",
    "month_labels": with_views(
        "SELECT id, date_trunc('month', date_generated) AS month, strftime(date_trunc('month', date_generated), '%B %Y')"
        " AS label, date_generated - INTERVAL 7 DAY AS week_before FROM batches"),
}

QUERIES["batch_post_collection"] = lambda spark, d: loads.batch_post_collection(
    load_model(spark, d)["batches"], _load_fresh(spark, d).summary, "ready to label").select(
    "id", "status", "total_count", "original_count", "duplicate_count")
ORACLES["batch_post_collection"] = with_views(
    """SELECT b.id, CASE WHEN s.batch_id IS NOT NULL THEN 'ready to label' ELSE b.status END AS status,
 s.total_count, s.original_count, s.duplicate_count FROM batches b LEFT JOIN s ON s.batch_id=b.id""",
    f"s AS ({_SUMMARY})")
