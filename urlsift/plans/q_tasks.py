"""Registered enrichment-task queries (J) with answer tables derived from the given data, and their oracles.

The remote services of the reference (page fetches, probes, classifiers, the agency matcher, the submission API)
are replaced by answer tables that Spark derives from the base tables, so every task runs over the whole queue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.functions.html import html_content_wide
from urlsift.operators import agency_match, cycle, sync
from urlsift.operators import queues as qs
from urlsift.operators import tasks as tk
from urlsift.operators.review import upsert
from urlsift.plans.catalog import AS_OF
from urlsift.plans.oracle import with_views
from urlsift.plans.q_html import _P as PARSED_CTE
from urlsift.sources.fixtures import load_model
from urlsift.streaming.streams import scratch_path


def _fetched(t):
    p = t["web_pages"]
    m = F.col("url_id") % 10
    status = F.when(m == 0, 404).when(m == 1, 500).when(m == 2, F.lit(None)).otherwise(200)
    return p.select("url_id", (status == 200).alias("success"), status.cast("int").alias("status"), "html",
                    "content_type", F.when(m == 2, F.lit("timeout")).alias("exception"))


def _html_task(spark, d):
    t = load_model(spark, d)
    return tk.html_task(t["web_pages"].select(F.col("url_id").alias("id"), "url"), _fetched(t))


def _probe(spark, d):
    t = load_model(spark, d)
    q = qs.queue_404_probe(t, AS_OF)
    m = F.col("id") % 7
    probes = t["urls"].select(F.col("id").alias("url_id"),
                              F.when(m == 0, 404).when(m == 1, F.lit(None)).otherwise(200).alias("status"))
    return t, tk.probe_404_task(q, probes, AS_OF)


def _probe_stamps(spark, d):
    t, ch = _probe(spark, d)
    return upsert(t["url_probed_for_404"], ch.upserts["url_probed_for_404"], ["url_id"])


def _record_type(spark, d):
    t = load_model(spark, d)
    m = F.col("id") % 3
    labels = t["urls"].select(F.col("id").alias("url_id"),
                              F.when(m == 0, "Other").when(m == 1, "Stops").otherwise("bogus").alias("label"))
    return tk.record_type_task(qs.queue_record_type(t), labels)


def _agency(spark, d):
    t = load_model(spark, d)
    q = qs.queue_agency(t)
    names = q.select(F.col("id").alias("url_id"), (F.col("id") / 10000000).cast("long").alias("agency_id")).join(
        t["agencies"].select("agency_id", "name"), "agency_id", "left").select(
        "url_id", F.when(F.col("url_id") % 3 == 0, F.concat(F.lit("Unknown agency "), F.col("url_id").cast("string")))
        .otherwise(F.upper(F.col("name"))).alias("agency_name"))
    return tk.agency_task(q, tk.agency_name_match(names, t["agencies"]))


def _with_metadata(q):
    """The queue with collector metadata as each strategy's collector leaves it; CKAN packages with an even id lack an entity."""
    i, s = F.col("id").cast("string"), F.col("strategy")
    ckan_meta = F.struct(F.concat(F.lit("N "), i).alias("submitted_name"), F.concat(F.lit("D "), i).alias("description"),
                         F.array(F.lit("CSV"), F.lit("PDF")).alias("record_format"), F.lit("CKAN").alias("data_portal_type"),
                         F.when(F.col("id") % 2 == 1, F.lit("Entity")).alias("supplying_entity"))
    meta = (F.when(s == "auto_googler", F.to_json(F.struct(F.concat(F.lit("T "), i).alias("title"),
                                                           F.concat(F.lit("S "), i).alias("snippet"))))
            .when(s.isin(tk.FOIA), F.to_json(F.struct(F.concat(F.lit("T "), i).alias("title"))))
            .when(s == "ckan", F.to_json(ckan_meta)))
    return q.withColumn("collector_metadata", meta)


def _misc(spark, d):
    t = load_model(spark, d)
    return tk.misc_metadata_task(_with_metadata(qs.queue_misc_metadata(t)), html_content_wide(t["url_html_content"]))


def _submission(spark, d):
    t = load_model(spark, d)
    v = t["urls"].where(F.col("outcome") == "validated").select(F.col("id").alias("url_id"))
    rec = v.select("url_id", F.when(F.col("url_id") % 4 != 0, F.col("url_id") * 10).alias("data_source_id"),
                   F.when(F.col("url_id") % 4 == 0, F.lit("rejected")).alias("request_error"))
    return tk.submission_task(v, rec, AS_OF)


def _sync_pages(t):
    c = t.base("customer")
    return c.select(((F.col("c_custkey") / 100).cast("int") + 1).alias("page"), (F.col("c_custkey") % 150).alias("agency_id"),
                    F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("state_name"),
                    F.lit(None).cast("string").alias("county_name"), F.lit(None).cast("string").alias("locality_name"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
                        F.lit(0), F.lit(0), F.lit(0), F.col("c_custkey").cast("decimal(18,6)"))).alias("updated_at"))


def _sync_runs(spark, d, bounds, absent=None):
    """Runs one after the other, each bounded in pages, from one stored cursor."""
    t, target = load_model(spark, d), scratch_path(spark, "agency-sync")
    pages = _sync_pages(t).where(F.col("page") != absent) if absent else _sync_pages(t)
    for bound in bounds:
        sync.run_agency_sync(t["agencies"], pages, target, AS_OF, bound)
    return target


def _cursor(spark, d, bounds, absent=None):
    return spark.read.schema(sync.STATE).parquet(f"{_sync_runs(spark, d, bounds, absent)}/state")


def _match(spark, d):
    """Collected URLs with a FOIA agency id (some not known), whose names equal, resemble or miss catalogue agencies."""
    t = load_model(spark, d)
    a = t["agencies"].select(F.col("agency_id").alias("id"), F.when(F.col("agency_id") % 4 == 0, F.concat(F.lit("office "), F.col("name")))
                             .when(F.col("agency_id") % 4 == 1, F.upper(F.col("name"))).when(F.col("agency_id") % 4 == 2, F.lit("Harbour office"))
                             .otherwise(F.col("name")).alias("name"))
    records = t["urls"].select(F.col("id").alias("url_id"), F.when(F.col("id") % 7 != 0, (F.col("id") / 10000000).cast("long")).alias("foia_agency_id"))
    return agency_match.match_agencies(agency_match.foia_agency_names(records, a), t["agencies"])


def _keyword_hits(x: str) -> str:
    return " + ".join(f"((length({x}) - length(replace({x}, '{w}', ''))) // {len(w)})"
                      for w in ("record", "report", "police", "data", "example"))


QUERIES = {
    "html_task_updates": lambda spark, d: _html_task(spark, d).status_updates,
    "html_task_errors": lambda spark, d: _html_task(spark, d).errors,
    "html_task_content_rows": lambda spark, d: _html_task(spark, d).appends["url_html_content"],
    "duplicate_task": lambda spark, d: tk.duplicate_task(
        qs.queue_duplicate_check(load_model(spark, d)),
        load_model(spark, d)["duplicates"].select(F.col("original_url_id").alias("url_id")), AS_OF).status_updates,
    "probe_404_task_updates": lambda spark, d: _probe(spark, d)[1].status_updates,
    "probe_404_task_stamps": lambda spark, d: _probe_stamps(spark, d),
    "record_type_task_suggestions": lambda spark, d: _record_type(spark, d).appends["auto_record_type_suggestions"],
    "record_type_task_errors": lambda spark, d: _record_type(spark, d).errors,
    "relevance_task": lambda spark, d: tk.relevance_task(qs.queue_auto_relevance(load_model(spark, d))).appends[
        "auto_relevant_suggestions"],
    "agency_task_confirmed": lambda spark, d: _agency(spark, d).appends["confirmed_url_agency"],
    "agency_task_auto": lambda spark, d: _agency(spark, d).appends["automated_url_agency_suggestions"],
    "agency_task_errors": lambda spark, d: _agency(spark, d).errors,
    "agency_task_agencies": lambda spark, d: _agency(spark, d).upserts["agencies"].distinct(),
    "misc_metadata_task_names": lambda spark, d: _misc(spark, d).upserts["urls"],
    "misc_metadata_task_errors": lambda spark, d: _misc(spark, d).errors,
    "misc_metadata_task_rows": lambda spark, d: _misc(spark, d).appends["url_optional_data_source_metadata"],
    "submission_task_updates": lambda spark, d: _submission(spark, d).status_updates,
    "submission_task_errors": lambda spark, d: _submission(spark, d).errors,
    "agency_sync": lambda spark, d: tk.agency_sync(load_model(spark, d)["agencies"], _sync_pages(load_model(spark, d))),
    "agency_sync_cursor": lambda spark, d: _cursor(spark, d, [5, 5]),
    "agency_sync_gap": lambda spark, d: _cursor(spark, d, [2, None], absent=4),
    "agency_sync_resumed": lambda spark, d: sync.synced(spark, _sync_runs(spark, d, [5, 3, None])),
    "agency_match": _match,
    "link_task_urls": lambda spark, d: tk.link_task_urls(99999, qs.queue_html(load_model(spark, d))),
}

_QUEUE_404 = f"""q AS (SELECT u.id FROM urls u LEFT JOIN url_probed_for_404 p ON p.url_id=u.id WHERE u.outcome='pending'
 AND (p.url_id IS NULL OR p.last_probed_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY))"""
_QUEUE_RT = """q AS (SELECT u.id FROM urls u WHERE u.outcome='pending'
 AND NOT EXISTS (SELECT 1 FROM auto_record_type_suggestions x WHERE x.url_id=u.id)
 AND EXISTS (SELECT 1 FROM url_html_content h WHERE h.url_id=u.id))"""
_QUEUE_AG = """q AS (SELECT u.id, b.strategy FROM urls u LEFT JOIN link_batch_urls l ON l.url_id=u.id LEFT JOIN batches b ON b.id=l.batch_id
 WHERE u.outcome='pending' AND NOT EXISTS (SELECT 1 FROM automated_url_agency_suggestions x WHERE x.url_id=u.id)
 AND NOT EXISTS (SELECT 1 FROM confirmed_url_agency x WHERE x.url_id=u.id)),
 r AS (SELECT id AS url_id, strategy, CASE WHEN strategy IN ('muckrock_simple_search','muckrock_county_search','muckrock_all_search','ckan') THEN 'match'
  WHEN strategy IN ('auto_googler','common_crawler') THEN 'unknown' ELSE 'error' END AS route FROM q),
 nm AS (SELECT r.url_id, a.agency_id FROM r LEFT JOIN agencies a ON r.url_id % 3 <> 0 AND a.agency_id = r.url_id // 10000000
  WHERE r.route='match')"""
_QUEUE_MISC = """q AS (SELECT u.id, b.strategy FROM urls u JOIN link_batch_urls l ON l.url_id=u.id JOIN batches b ON b.id=l.batch_id
 WHERE u.outcome='pending' AND NOT EXISTS (SELECT 1 FROM url_optional_data_source_metadata x WHERE x.url_id=u.id)),
 hw AS (SELECT url_id, MAX(CASE WHEN content_type='Title' THEN content END) AS title,
  MAX(CASE WHEN content_type='Description' THEN content END) AS description FROM url_html_content GROUP BY url_id)"""
_FOIA = "('muckrock_simple_search','muckrock_county_search','muckrock_all_search')"

_SYNCED = """SELECT a.* FROM agencies a WHERE a.agency_id NOT IN (SELECT agency_id FROM pg)
 UNION ALL SELECT agency_id, arg_max(display_name, k) AS name, arg_max(state_name, k) AS state,
  CAST(NULL AS VARCHAR) AS county, CAST(NULL AS VARCHAR) AS locality FROM pg GROUP BY agency_id"""
_SYNC_PAGES = """pg AS (SELECT CAST(c_custkey // 100 AS INT) + 1 AS page, c_custkey % 150 AS agency_id, c_name AS display_name,
 c_mktsegment AS state_name, c_custkey AS k FROM customer)"""

ORACLES = {
    "html_task_updates": """SELECT page_id AS url_id, CASE WHEN page_id % 10 = 0 THEN '404 not found' ELSE 'error' END AS outcome
 FROM pages WHERE page_id % 10 IN (0, 1, 2)""",
    "html_task_errors": """SELECT page_id AS url_id, CASE WHEN page_id % 10 = 1 THEN 'HTTP status 500' ELSE 'timeout' END AS error
 FROM pages WHERE page_id % 10 IN (1, 2)""",
    "html_task_content_rows": f"""WITH {PARSED_CTE} SELECT * FROM (
 SELECT url_id, 'Title' AS content_type, title AS content FROM p UNION ALL
 SELECT url_id, 'H1', h1 FROM p UNION ALL SELECT url_id, 'Div', div FROM p) r
 WHERE trim(content) <> '' AND url_id % 10 >= 3""",
    "duplicate_task": with_views(
        """SELECT u.id AS url_id, 'duplicate' AS outcome FROM urls u WHERE u.outcome='pending'
 AND NOT EXISTS (SELECT 1 FROM url_checked_for_duplicate x WHERE x.url_id=u.id)
 AND EXISTS (SELECT 1 FROM duplicates d WHERE d.original_url_id=u.id)"""),
    "probe_404_task_updates": with_views(
        "SELECT id AS url_id, '404 not found' AS outcome FROM q WHERE id % 7 = 0", _QUEUE_404),
    "probe_404_task_stamps": with_views(
        f"""SELECT url_id, last_probed_at FROM url_probed_for_404 p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.id=p.url_id)
 UNION ALL SELECT id AS url_id, TIMESTAMP '{AS_OF}' AS last_probed_at FROM q""", _QUEUE_404),
    "record_type_task_suggestions": with_views(
        "SELECT id AS url_id, CASE WHEN id % 3 = 0 THEN 'Other' ELSE 'Stops' END AS record_type FROM q WHERE id % 3 <> 2",
        _QUEUE_RT),
    "record_type_task_errors": with_views(
        "SELECT id AS url_id, 'invalid value: bogus' AS error FROM q WHERE id % 3 = 2", _QUEUE_RT),
    "relevance_task": with_views(
        f"""SELECT url_id, hits > 0 AS relevant, round(hits / (hits + 1.0), 6) AS confidence, 'keyword-rule' AS model_name
 FROM (SELECT u.id AS url_id, {_keyword_hits('lower(h.html)')} AS hits FROM urls u JOIN url_compressed_html h ON h.url_id=u.id
 WHERE u.outcome='pending' AND NOT EXISTS (SELECT 1 FROM auto_relevant_suggestions x WHERE x.url_id=u.id)) s"""),
    "agency_task_confirmed": with_views("SELECT url_id, agency_id FROM nm WHERE agency_id IS NOT NULL", _QUEUE_AG),
    "agency_task_auto": with_views(
        """SELECT url_id, CAST(NULL AS BIGINT) AS agency_id, TRUE AS is_unknown FROM nm WHERE agency_id IS NULL
 UNION ALL SELECT url_id, CAST(NULL AS BIGINT), TRUE FROM r WHERE route='unknown'""", _QUEUE_AG),
    "agency_task_errors": with_views(
        "SELECT url_id, CONCAT('No agency subtask for collector ', COALESCE(strategy, 'none')) AS error FROM r WHERE route='error'",
        _QUEUE_AG),
    "agency_task_agencies": with_views(
        """SELECT DISTINCT a.agency_id, a.name, a.state, a.county, CAST(NULL AS VARCHAR) AS locality
 FROM nm JOIN agencies a ON a.agency_id=nm.agency_id""", _QUEUE_AG),
    "misc_metadata_task_names": with_views(
        f"""SELECT q.id AS url_id,
 COALESCE(CASE WHEN strategy IN {_FOIA} OR strategy='auto_googler' THEN CONCAT('T ', CAST(q.id AS VARCHAR))
  WHEN strategy='ckan' THEN CONCAT('N ', CAST(q.id AS VARCHAR)) END, hw.title) AS name,
 COALESCE(CASE WHEN strategy IN {_FOIA} THEN CONCAT('T ', CAST(q.id AS VARCHAR))
  WHEN strategy='auto_googler' THEN CONCAT('S ', CAST(q.id AS VARCHAR)) WHEN strategy='ckan' THEN CONCAT('D ', CAST(q.id AS VARCHAR)) END,
  hw.description) AS description FROM q LEFT JOIN hw ON hw.url_id=q.id""", _QUEUE_MISC),
    "misc_metadata_task_errors": with_views(
        "SELECT id AS url_id, '''supplying_entity''' AS error FROM q WHERE strategy='ckan' AND id % 2 = 0", _QUEUE_MISC),
    "misc_metadata_task_rows": with_views(
        """SELECT id AS url_id, CASE WHEN strategy='ckan' THEN ['CSV', 'PDF'] END AS record_formats,
 CASE WHEN strategy='ckan' THEN 'CKAN' END AS data_portal_type,
 CASE WHEN strategy='ckan' AND id % 2 = 1 THEN 'Entity' END AS supplying_entity FROM q""", _QUEUE_MISC),
    "submission_task_updates": with_views(
        "SELECT id AS url_id, 'submitted' AS outcome FROM urls WHERE outcome='validated' AND id % 4 <> 0"),
    "submission_task_errors": with_views(
        "SELECT id AS url_id, 'rejected' AS error FROM urls WHERE outcome='validated' AND id % 4 = 0"),
    "agency_sync": with_views(_SYNCED, _SYNC_PAGES),
    "agency_sync_cursor": f"""WITH m AS (SELECT MAX(c_custkey // 100 + 1) AS n FROM customer), r AS (SELECT 0 AS run UNION ALL SELECT 1),
 s AS (SELECT run, n, CASE WHEN run = 1 AND n <= 5 THEN n ELSE LEAST(n, 5 * (run + 1)) END AS last FROM r, m)
SELECT run, CAST(last AS INT) AS last_page, CAST(CASE WHEN last < n THEN last + 1 END AS INT) AS current_page, CAST(NULL AS INT) AS missing_page,
 CASE WHEN last >= n THEN DATE '{AS_OF[:10]}' - 1 END AS current_cutoff_date, CASE WHEN last >= n THEN TIMESTAMP '{AS_OF}' END AS last_full_sync_at FROM s""",
    "agency_sync_gap": f"""WITH m AS (SELECT MAX(c_custkey // 100 + 1) AS n FROM customer WHERE c_custkey // 100 + 1 <> 4), r AS (SELECT 0 AS run UNION ALL SELECT 1),
 s AS (SELECT run, n, LEAST(n, run + 2) AS last FROM r, m)
SELECT run, CAST(last AS INT) AS last_page, CAST(CASE WHEN last < n THEN last + 1 END AS INT) AS current_page,
 CAST(CASE WHEN last = 3 AND last < n THEN 4 END AS INT) AS missing_page,
 CASE WHEN last >= n THEN DATE '{AS_OF[:10]}' - 1 END AS current_cutoff_date, CASE WHEN last >= n THEN TIMESTAMP '{AS_OF}' END AS last_full_sync_at FROM s""",
    "agency_sync_resumed": with_views(_SYNCED, _SYNC_PAGES),
    "agency_match": with_views(
        """SELECT u.id AS url_id, CASE WHEN a.agency_id IS NULL THEN 'error' WHEN a.agency_id % 4 = 0 THEN 'partial' WHEN a.agency_id % 4 = 2 THEN 'none' ELSE 'exact' END AS status,
 CASE WHEN a.agency_id % 4 <> 2 THEN a.agency_id END AS agency_id
 FROM urls u LEFT JOIN agencies a ON u.id % 7 <> 0 AND a.agency_id = u.id // 10000000"""),
    "link_task_urls": with_views(
        """SELECT 99999 AS task_id, u.id AS url_id FROM urls u WHERE u.outcome='pending'
 AND NOT EXISTS (SELECT 1 FROM url_html_content x WHERE x.url_id=u.id)
 AND NOT EXISTS (SELECT 1 FROM link_task_urls lt JOIN tasks tk ON tk.id=lt.task_id
  WHERE lt.url_id=u.id AND tk.task_type='HTML' AND tk.task_status='ready to label')"""),
}


_CYCLE_TABLES = ("urls", "url_error_info", "link_task_urls", "url_checked_for_duplicate", "url_probed_for_404", "url_data_sources", "url_html_content",
                 "url_compressed_html", "auto_record_type_suggestions", "automated_url_agency_suggestions", "confirmed_url_agency", "agencies",
                 "url_optional_data_source_metadata", "auto_relevant_suggestions", "tasks", "task_errors", "batches", "link_batch_urls")


def _cycle_answers(t):
    """What the remote services say, as functions of a task's queue."""
    i, text = F.col("id"), lambda c: c.cast("string")

    def fetched(q):
        m = i % 10
        status = F.when(m == 0, 404).when(m == 1, 500).when(m == 2, F.lit(None)).otherwise(200)
        html = F.concat(F.lit("<html><head><title>T "), text(i), F.when(i % 2 == 0, F.lit(" report")).otherwise(F.lit("")), F.lit('</title><meta name="description" content="D '),
                        text(i), F.lit('"></head><body></body></html>'))
        return q.select(i.alias("url_id"), F.coalesce(status == 200, F.lit(False)).alias("success"), status.cast("int").alias("status"), html.alias("html"),
                        F.lit("text/html").alias("content_type"), F.when(m == 2, F.lit("timeout")).alias("exception"))

    def names(q):
        own = q.select(i.alias("url_id"), (i / 10000000).cast("long").alias("agency_id")).join(t["agencies"].select("agency_id", "name"), "agency_id", "left")
        known = F.when(F.col("url_id") % 3 == 0, F.concat(F.lit("Unknown agency "), text(F.col("url_id")))).otherwise(F.upper("name"))
        return tk.agency_name_match(own.select("url_id", known.alias("agency_name")), t["agencies"])

    return {
        "HTML": fetched,
        "Duplicate Detection": lambda q: t["duplicates"].where(F.col("original_url_id") % 2 == 0).select(F.col("original_url_id").alias("url_id")),
        "404 Probe": lambda q: q.select(i.alias("url_id"), F.when(i % 7 == 0, 404).when(i % 7 != 1, 200).alias("status")),
        "Record Type": lambda q: q.select(i.alias("url_id"), F.when(i % 3 == 0, "Other").when(i % 3 == 1, "Stops").otherwise("bogus").alias("label")),
        "Agency Identification": names,
        "Misc Metadata": _with_metadata,
        "Submit Approved URLs": lambda q: q.select(i.alias("url_id"), F.when(i % 4 != 0, i * 10).alias("data_source_id"), F.when(i % 4 == 0, F.lit("rejected")).alias("request_error")),
    }


def _cycle(spark, d):
    """Every table the eight tasks change, after the cycle, as (table, key, value)."""
    t = load_model(spark, d)
    with t.in_buckets() as (stored, buckets):
        state = {n: stored[n] for n in _CYCLE_TABLES}
        state["urls"] = stored["urls"].select("*", *[F.lit(None).cast("string").alias(c) for c in ("name", "description")])
        out = cycle.run_cycle(spark, state, cycle.standard_tasks(_cycle_answers(t), AS_OF), scratch_path(spark, "cycle"), 900001, AS_OF, buckets)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shown = {
        "urls": ("id", F.concat_ws("|", s("outcome"), s("name"), s("description"))), "url_error_info": ("url_id", F.concat_ws("|", s("task_id"), s("error"))),
        "link_task_urls": ("url_id", s("task_id")), "url_checked_for_duplicate": ("url_id", day("created_at")), "url_probed_for_404": ("url_id", day("last_probed_at")),
        "url_data_sources": ("url_id", s("data_source_id")), "url_html_content": ("url_id", F.concat_ws("|", s("content_type"), s("content"))),
        "url_compressed_html": ("url_id", s("html")), "auto_record_type_suggestions": ("url_id", s("record_type")),
        "automated_url_agency_suggestions": ("url_id", F.concat_ws("|", s("agency_id"), s("is_unknown"))), "confirmed_url_agency": ("url_id", s("agency_id")),
        "agencies": ("agency_id", F.concat_ws("|", s("name"), s("state"), s("county"))),
        "url_optional_data_source_metadata": ("url_id", F.concat_ws("|", F.coalesce(F.concat_ws(",", "record_formats"), F.lit("")), s("data_portal_type"), s("supplying_entity"))),
        "auto_relevant_suggestions": ("url_id", F.concat_ws("|", s("relevant"), s("model_name"))), "tasks": ("id", F.concat_ws("|", s("task_type"), s("task_status"))),
        "task_errors": ("task_id", s("error")),
    }
    rows = [out[n].select(F.lit(n).alias("table"), F.col(k).cast("long").alias("key"), v.alias("value")) for n, (k, v) in shown.items()]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


QUERIES["run_cycle"] = _cycle


def _after(k: int, cases: str) -> str:
    """The URLs after task k: the outcome of the queue's URLs by ``cases`` (null keeps it)."""
    return f"s{k} AS (SELECT u.id, u.url, u.strategy, u.has_batch, CASE WHEN q.id IS NULL THEN u.outcome ELSE COALESCE({cases}, u.outcome) END AS outcome FROM s{k - 1} u LEFT JOIN q{k} q ON q.id=u.id)"


_NX = "NOT EXISTS (SELECT 1 FROM {} x WHERE x.url_id=u.id)"
_OLD_HTML = "EXISTS (SELECT 1 FROM {} x WHERE x.url_id=u.id) OR EXISTS (SELECT 1 FROM q1 x WHERE x.id=u.id AND x.id % 10 > 2)"
_MATCHED = "strategy IN ('muckrock_simple_search','muckrock_county_search','muckrock_all_search','ckan')"
_ID = "CAST(id AS VARCHAR)"
_NAME = f"CASE WHEN strategy IN {_FOIA} OR strategy='auto_googler' THEN CONCAT('T ', {_ID}) WHEN strategy='ckan' THEN CONCAT('N ', {_ID}) END"
_DESC = f"CASE WHEN strategy IN {_FOIA} THEN CONCAT('T ', {_ID}) WHEN strategy='auto_googler' THEN CONCAT('S ', {_ID}) WHEN strategy='ckan' THEN CONCAT('D ', {_ID}) END"
_HTML_OF = f"""CONCAT('<html><head><title>T ', {_ID}, CASE WHEN id % 2 = 0 THEN ' report' ELSE '' END, '</title><meta name="description" content="D ', {_ID}, '"></head><body></body></html>')"""
_CYCLE = ",\n".join([
    """s0 AS (SELECT u.id, u.url, b.strategy, l.url_id IS NOT NULL AS has_batch, u.outcome FROM urls u LEFT JOIN link_batch_urls l ON l.url_id=u.id LEFT JOIN batches b ON b.id=l.batch_id)""",
    f"""q1 AS (SELECT u.id FROM s0 u WHERE u.outcome='pending' AND {_NX.format('url_html_content')} AND NOT EXISTS (SELECT 1 FROM link_task_urls lt JOIN tasks tk ON tk.id=lt.task_id
 WHERE lt.url_id=u.id AND tk.task_type='HTML' AND tk.task_status='ready to label'))""",
    _after(1, "CASE q.id % 10 WHEN 0 THEN '404 not found' WHEN 1 THEN 'error' WHEN 2 THEN 'error' END"),
    f"q2 AS (SELECT u.id FROM s1 u WHERE u.outcome='pending' AND {_NX.format('url_checked_for_duplicate')})",
    _after(2, "CASE WHEN q.id % 2 = 0 AND EXISTS (SELECT 1 FROM duplicates d WHERE d.original_url_id=q.id) THEN 'duplicate' END"),
    f"""q3 AS (SELECT u.id FROM s2 u LEFT JOIN url_probed_for_404 p ON p.url_id=u.id WHERE u.outcome='pending'
 AND (p.url_id IS NULL OR p.last_probed_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY))""",
    _after(3, "CASE WHEN q.id % 7 = 0 THEN '404 not found' END"),
    f"q4 AS (SELECT u.id FROM s3 u WHERE u.outcome='pending' AND {_NX.format('auto_record_type_suggestions')} AND ({_OLD_HTML.format('url_html_content')}))",
    _after(4, "CASE WHEN q.id % 3 = 2 THEN 'error' END"),
    f"q5 AS (SELECT u.* FROM s4 u WHERE u.outcome='pending' AND {_NX.format('automated_url_agency_suggestions')} AND {_NX.format('confirmed_url_agency')})",
    _after(5, f"CASE WHEN q.{_MATCHED} OR q.strategy IN ('auto_googler','common_crawler') THEN NULL ELSE 'error' END"),
    f"q6 AS (SELECT u.* FROM s5 u WHERE u.outcome='pending' AND u.has_batch AND {_NX.format('url_optional_data_source_metadata')})",
    _after(6, "CASE WHEN q.strategy='ckan' AND q.id % 2 = 0 THEN 'error' END"),
    "q7 AS (SELECT u.id FROM s6 u WHERE u.outcome='validated')",
    _after(7, "CASE WHEN q.id % 4 = 0 THEN 'error' ELSE 'submitted' END"),
    f"q8 AS (SELECT u.id FROM s7 u WHERE u.outcome='pending' AND {_NX.format('auto_relevant_suggestions')} AND ({_OLD_HTML.format('url_compressed_html')}))",
    """content AS (SELECT url_id, content_type, content FROM url_html_content UNION ALL SELECT id, 'Title', CONCAT('T ', CAST(id AS VARCHAR), CASE WHEN id % 2 = 0 THEN ' report' ELSE '' END)
 FROM q1 WHERE id % 10 > 2 UNION ALL SELECT id, 'Description', CONCAT('D ', CAST(id AS VARCHAR)) FROM q1 WHERE id % 10 > 2)""",
    f"stored_html AS (SELECT url_id, html FROM url_compressed_html UNION ALL SELECT id, {_HTML_OF} FROM q1 WHERE id % 10 > 2)",
    f"""named AS (SELECT id, COALESCE({_NAME}, w.title) AS name, COALESCE({_DESC}, w.description) AS description FROM q6 LEFT JOIN (SELECT url_id,
 MAX(CASE WHEN content_type='Title' THEN content END) AS title, MAX(CASE WHEN content_type='Description' THEN content END) AS description FROM content GROUP BY url_id) w ON w.url_id=q6.id)""",
    f"""matched AS (SELECT q5.id, a.agency_id FROM q5 LEFT JOIN agencies a ON q5.id % 3 <> 0 AND a.agency_id = q5.id // 10000000 AND q5.{_MATCHED}
 WHERE {_MATCHED} OR strategy IN ('auto_googler','common_crawler'))""",
    """errors AS (SELECT id, 900001 AS task_id, CASE id % 10 WHEN 1 THEN 'HTTP status 500' ELSE 'timeout' END AS error FROM q1 WHERE id % 10 IN (1, 2)
 UNION ALL SELECT id, 900004, 'invalid value: bogus' FROM q4 WHERE id % 3 = 2
 UNION ALL SELECT id, 900005, CONCAT('No agency subtask for collector ', COALESCE(strategy, 'none')) FROM q5 WHERE NOT EXISTS (SELECT 1 FROM matched WHERE matched.id=q5.id)
 UNION ALL SELECT id, 900006, '''supplying_entity''' FROM q6 WHERE strategy='ckan' AND id % 2 = 0 UNION ALL SELECT id, 900007, 'rejected' FROM q7 WHERE id % 4 = 0)""",
    """linked AS (SELECT id, 900001 AS task_id FROM q1 UNION ALL SELECT id, 900002 FROM q2 UNION ALL SELECT id, 900003 FROM q3 UNION ALL SELECT id, 900004 FROM q4
 UNION ALL SELECT id, 900005 FROM q5 UNION ALL SELECT id, 900006 FROM q6 UNION ALL SELECT id, 900007 FROM q7 UNION ALL SELECT id, 900008 FROM q8)""",
    """made AS (SELECT * FROM (VALUES (900001, 'HTML'), (900002, 'Duplicate Detection'), (900003, '404 Probe'), (900004, 'Record Type'), (900005, 'Agency Identification'),
 (900006, 'Misc Metadata'), (900007, 'Submit Approved URLs'), (900008, 'Relevancy')) x(id, task_type) WHERE id IN (SELECT task_id FROM linked))""",
])
_NOW = f"'{AS_OF[:10]}'"
ORACLES["run_cycle"] = with_views(
    f"""SELECT 'urls' AS "table", s7.id AS key, CONCAT(outcome, '|', COALESCE(n.name, '-'), '|', COALESCE(n.description, '-')) AS value FROM s7 LEFT JOIN named n ON n.id=s7.id
UNION ALL SELECT 'url_error_info', url_id, CONCAT(task_id, '|', error) FROM url_error_info UNION ALL SELECT 'url_error_info', id, CONCAT(task_id, '|', error) FROM errors
UNION ALL SELECT 'link_task_urls', url_id, CAST(task_id AS VARCHAR) FROM link_task_urls UNION ALL SELECT 'link_task_urls', id, CAST(task_id AS VARCHAR) FROM linked
UNION ALL SELECT 'url_checked_for_duplicate', url_id, strftime(created_at, '%Y-%m-%d') FROM url_checked_for_duplicate UNION ALL SELECT 'url_checked_for_duplicate', id, {_NOW} FROM q2
UNION ALL SELECT 'url_probed_for_404', url_id, strftime(last_probed_at, '%Y-%m-%d') FROM url_probed_for_404 p WHERE NOT EXISTS (SELECT 1 FROM q3 WHERE q3.id=p.url_id)
UNION ALL SELECT 'url_probed_for_404', id, {_NOW} FROM q3
UNION ALL SELECT 'url_data_sources', url_id, CAST(data_source_id AS VARCHAR) FROM url_data_sources UNION ALL SELECT 'url_data_sources', id, CAST(id * 10 AS VARCHAR) FROM q7 WHERE id % 4 <> 0
UNION ALL SELECT 'url_html_content', url_id, CONCAT(content_type, '|', content) FROM content
UNION ALL SELECT 'url_compressed_html', url_id, html FROM stored_html
UNION ALL SELECT 'auto_record_type_suggestions', url_id, record_type FROM auto_record_type_suggestions
UNION ALL SELECT 'auto_record_type_suggestions', id, CASE WHEN id % 3 = 0 THEN 'Other' ELSE 'Stops' END FROM q4 WHERE id % 3 <> 2
UNION ALL SELECT 'automated_url_agency_suggestions', url_id, CONCAT(COALESCE(CAST(agency_id AS VARCHAR), '-'), '|', CAST(is_unknown AS VARCHAR)) FROM automated_url_agency_suggestions
UNION ALL SELECT 'automated_url_agency_suggestions', id, '-|true' FROM matched WHERE agency_id IS NULL
UNION ALL SELECT 'confirmed_url_agency', url_id, CAST(agency_id AS VARCHAR) FROM confirmed_url_agency
UNION ALL SELECT 'confirmed_url_agency', id, CAST(agency_id AS VARCHAR) FROM matched WHERE agency_id IS NOT NULL
UNION ALL SELECT 'agencies', agency_id, CONCAT(name, '|', state, '|', county) FROM agencies
UNION ALL SELECT 'url_optional_data_source_metadata', url_id, CONCAT(array_to_string(record_formats, ','), '|', COALESCE(data_portal_type, '-'), '|', COALESCE(supplying_entity, '-')) FROM url_optional_data_source_metadata
UNION ALL SELECT 'url_optional_data_source_metadata', id, CASE WHEN strategy='ckan' THEN CONCAT('CSV,PDF|CKAN|', CASE WHEN id % 2 = 1 THEN 'Entity' ELSE '-' END) ELSE '|-|-' END FROM q6
UNION ALL SELECT 'auto_relevant_suggestions', url_id, CONCAT(CAST(relevant AS VARCHAR), '|', model_name) FROM auto_relevant_suggestions
UNION ALL SELECT 'auto_relevant_suggestions', q8.id, CONCAT(CAST({_keyword_hits('lower(h.html)')} > 0 AS VARCHAR), '|keyword-rule') FROM q8 JOIN stored_html h ON h.url_id=q8.id
UNION ALL SELECT 'tasks', id, CONCAT(task_type, '|', task_status) FROM tasks UNION ALL SELECT 'tasks', id, CONCAT(task_type, '|ready to label') FROM made
UNION ALL SELECT 'task_errors', id, CONCAT('failed: ', task_type) FROM tasks WHERE task_status='error'""", _CYCLE)
