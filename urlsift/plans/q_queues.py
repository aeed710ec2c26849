"""Registered filter / queue / listing queries (B, C, F) and their DuckDB oracles.

Queues are registered whole (``k=None``): the ranked top-1 "next URL" is the first row of the same set, which the
unit tests check separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.operators import ordering
from urlsift.operators import queues as q
from urlsift.plans.catalog import AS_OF
from urlsift.plans.oracle import with_views
from urlsift.sources.fixtures import load_model


def _q(fn, *args, **kw):
    return lambda spark, d: fn(load_model(spark, d), *args, **kw)


def _nx(table, col="u.id"):
    return f"NOT EXISTS (SELECT 1 FROM {table} x WHERE x.url_id={col})"


def _ex(table, col="u.id"):
    return f"EXISTS (SELECT 1 FROM {table} x WHERE x.url_id={col})"


QUERIES = {
    "urls_with_error_rows": _q(q.urls_with_error_rows),
    "lookup_urls": lambda spark, d: q.lookup_urls(
        load_model(spark, d),
        load_model(spark, d)["collected"].select(
            F.concat(F.lit("https://s"), F.col("l_partkey").cast("string"), F.lit(".example.org/p/"),
                     F.col("l_suppkey").cast("string")).alias("url")).distinct()),
    "validated_urls": _q(q.validated_urls),
    "filter_url_keyword": lambda spark, d: q.filter_url_keyword(load_model(spark, d)["urls"], "s1.example"),
    "filter_title_search": lambda spark, d: q.filter_title_search(
        load_model(spark, d)["url_html_content"].where(F.col("content_type") == "Title").withColumnRenamed(
            "content", "title"), "ORG/P/1"),
    "tasks_filtered": _q(q.tasks_filtered, "HTML", "ready to label"),
    "queue_html": _q(q.queue_html),
    "queue_without_model": _q(q.queue_without_model, "auto_relevant_suggestions"),
    "queue_auto_relevance": _q(q.queue_auto_relevance),
    "queue_agency": _q(q.queue_agency),
    "queue_misc_metadata": _q(q.queue_misc_metadata),
    "queue_duplicate_check": _q(q.queue_duplicate_check),
    "queue_404_probe": _q(q.queue_404_probe, AS_OF),
    "urls_by_batch": _q(q.urls_by_batch),
    "duplicates_by_batch": _q(q.duplicates_by_batch),
    "urls_with_errors": _q(q.urls_with_errors),
    "agency_suggestions": _q(q.agency_suggestions),
    "urls_confirmed": _q(q.urls_confirmed),
    "tasks_with_counts": _q(q.tasks_with_counts),
    "task_detail": _q(q.task_detail),
    "urls_listing": _q(q.urls_listing),
    "urls_listing_errors_only": _q(q.urls_listing, errors_only=True),
    "submission_records": _q(q.submission_records),
    "batch_logs": _q(q.batch_logs),
    "html_rows_for_url": _q(q.html_rows_for_url),
    "next_for_relevance": _q(q.next_for_relevance, k=None),
    "next_for_record_type": _q(q.next_for_record_type, k=None),
    "next_for_agency": _q(q.next_for_agency, k=None),
    "next_for_all": _q(q.next_for_all, k=None),
    "review_queue": _q(q.review_queue),
}

_HTML_TASK = """NOT EXISTS (SELECT 1 FROM link_task_urls lt JOIN tasks tk ON tk.id=lt.task_id
 WHERE lt.url_id=u.id AND tk.task_type='HTML' AND tk.task_status='ready to label')"""
_URL_BATCH = "LEFT JOIN (SELECT l.url_id, l.batch_id, b.strategy FROM link_batch_urls l JOIN batches b ON b.id=l.batch_id) ub ON ub.url_id=u.id"

ORACLES = {
    "urls_with_error_rows": with_views(f"SELECT * FROM urls u WHERE {_ex('url_error_info')}"),
    "lookup_urls": with_views(
        """SELECT w.url, i.id IS NOT NULL AS found, i.id AS url_id FROM (SELECT DISTINCT CONCAT('https://s',
 CAST(l_partkey AS VARCHAR), '.example.org/p/', CAST(l_suppkey AS VARCHAR)) AS url FROM collected) w
 LEFT JOIN urls i ON i.url=w.url"""),
    "validated_urls": with_views("SELECT * FROM urls WHERE outcome='validated'"),
    "filter_url_keyword": with_views("SELECT * FROM urls WHERE contains(url, 's1.example')"),
    "filter_title_search": with_views(
        "SELECT url_id, content_type, content AS title FROM url_html_content WHERE content_type='Title'"
        " AND contains(lower(content), 'org/p/1')"),
    "tasks_filtered": with_views("SELECT * FROM tasks WHERE task_type='HTML' AND task_status='ready to label'"),
    "queue_html": with_views(
        f"SELECT u.id, u.url FROM urls u WHERE u.outcome='pending' AND {_nx('url_html_content')} AND {_HTML_TASK}"),
    "queue_without_model": with_views(
        f"SELECT u.id, u.url FROM urls u WHERE u.outcome='pending' AND {_nx('auto_relevant_suggestions')}"),
    "queue_auto_relevance": with_views(
        f"""SELECT u.id, u.url, h.html FROM urls u JOIN url_compressed_html h ON h.url_id=u.id
 WHERE u.outcome='pending' AND {_nx('auto_relevant_suggestions')}"""),
    "queue_agency": with_views(
        f"""SELECT u.id, u.url, CAST(NULL AS VARCHAR) AS collector_metadata, ub.batch_id, ub.strategy FROM urls u {_URL_BATCH}
 WHERE u.outcome='pending' AND {_nx('automated_url_agency_suggestions')} AND {_nx('confirmed_url_agency')}"""),
    "queue_misc_metadata": with_views(
        f"""SELECT u.id, u.url, CAST(NULL AS VARCHAR) AS collector_metadata, ub.batch_id, ub.strategy FROM urls u {_URL_BATCH}
 WHERE u.outcome='pending' AND ub.url_id IS NOT NULL AND {_nx('url_optional_data_source_metadata')}"""),
    "queue_duplicate_check": with_views(
        f"SELECT u.id, u.url FROM urls u WHERE u.outcome='pending' AND {_nx('url_checked_for_duplicate')}"),
    "queue_404_probe": with_views(
        f"""SELECT u.id, u.url FROM urls u LEFT JOIN url_probed_for_404 p ON p.url_id=u.id WHERE u.outcome='pending'
 AND (p.url_id IS NULL OR p.last_probed_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"""),
    "urls_by_batch": with_views(
        "SELECT l.batch_id, u.id, u.url, u.outcome, u.created_at FROM link_batch_urls l JOIN urls u ON u.id=l.url_id"),
    "duplicates_by_batch": with_views(
        """SELECT d.batch_id AS duplicate_batch_id, d.original_url_id, u.url AS source_url, l.batch_id AS original_batch_id,
 db.strategy AS duplicate_batch_strategy, ob.strategy AS original_batch_strategy
FROM duplicates d JOIN urls u ON u.id=d.original_url_id JOIN link_batch_urls l ON l.url_id=d.original_url_id
 JOIN batches db ON db.id=d.batch_id JOIN batches ob ON ob.id=l.batch_id"""),
    "urls_with_errors": with_views(
        "SELECT u.id AS url_id, u.url, e.task_id, e.error FROM urls u JOIN url_error_info e ON e.url_id=u.id"
        " WHERE u.outcome='error'"),
    "agency_suggestions": with_views(
        """SELECT s.url_id, s.agency_id, CASE WHEN s.is_unknown THEN 'Unknown' ELSE 'Auto Suggestion' END AS suggestion_type,
 a.name AS agency_name, a.state, a.county, a.locality
FROM automated_url_agency_suggestions s LEFT JOIN agencies a ON a.agency_id=s.agency_id"""),
    "urls_confirmed": with_views(f"SELECT * FROM urls u WHERE {_ex('confirmed_url_agency')}"),
    "tasks_with_counts": with_views(
        """SELECT t.id AS task_id, t.task_type, t.task_status, t.updated_at, COALESCE(c.n,0) AS url_count,
 COALESCE(e.n,0) AS url_error_count FROM tasks t
 LEFT JOIN (SELECT task_id, COUNT(task_id) AS n FROM link_task_urls GROUP BY task_id) c ON c.task_id=t.id
 LEFT JOIN (SELECT task_id, COUNT(task_id) AS n FROM url_error_info GROUP BY task_id) e ON e.task_id=t.id"""),
    "task_detail": with_views(
        """SELECT t.id AS task_id, t.task_type, t.task_status, t.updated_at, lt.url_id, u.url, u.outcome, e.error
FROM tasks t LEFT JOIN (link_task_urls lt JOIN urls u ON u.id=lt.url_id) ON lt.task_id=t.id
 LEFT JOIN url_error_info e ON e.task_id=t.id AND e.url_id=lt.url_id"""),
    "urls_listing": with_views(
        """SELECT u.id, u.url, u.outcome, u.created_at, l.batch_id,
 COALESCE((SELECT list_sort(list(e.error)) FROM url_error_info e WHERE e.url_id=u.id), []) AS errors
FROM urls u LEFT JOIN link_batch_urls l ON l.url_id=u.id"""),
    "urls_listing_errors_only": with_views(
        f"""SELECT u.id, u.url, u.outcome, u.created_at, l.batch_id,
 COALESCE((SELECT list_sort(list(e.error)) FROM url_error_info e WHERE e.url_id=u.id), []) AS errors
FROM urls u LEFT JOIN link_batch_urls l ON l.url_id=u.id WHERE {_ex('url_error_info')}"""),
    "submission_records": with_views(
        """SELECT u.id AS url_id, u.url, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS description,
 CAST(NULL AS VARCHAR) AS record_type,
 COALESCE((SELECT list_sort(list(c.agency_id)) FROM confirmed_url_agency c WHERE c.url_id=u.id), []) AS agency_ids,
 m.record_formats, m.data_portal_type, m.supplying_entity
FROM urls u LEFT JOIN url_optional_data_source_metadata m ON m.url_id=u.id WHERE u.outcome='validated'"""),
    "batch_logs": with_views("SELECT batch_id, id, log, created_at FROM logs"),
    "html_rows_for_url": with_views("SELECT * FROM url_html_content"),
    "next_for_relevance": with_views(
        f"""SELECT u.id, u.url, a.relevant AS auto_relevant, a.confidence AS auto_confidence, a.model_name AS auto_model_name
FROM urls u LEFT JOIN auto_relevant_suggestions a ON a.url_id=u.id
WHERE u.outcome='pending' AND {_nx('user_relevant_suggestions')}"""),
    "next_for_record_type": with_views(
        f"""SELECT u.id, u.url, a.record_type AS auto_record_type
FROM urls u LEFT JOIN auto_record_type_suggestions a ON a.url_id=u.id
WHERE u.outcome='pending' AND {_nx('user_record_type_suggestions')}
 AND NOT EXISTS (SELECT 1 FROM user_relevant_suggestions r WHERE r.url_id=u.id AND r.suggested_status<>'relevant')"""),
    "next_for_agency": with_views(
        f"""SELECT u.id, u.url FROM urls u WHERE u.outcome='pending' AND {_nx('user_url_agency_suggestions')}
 AND {_ex('automated_url_agency_suggestions')} AND {_nx('confirmed_url_agency')}
 AND NOT EXISTS (SELECT 1 FROM user_relevant_suggestions r WHERE r.url_id=u.id AND r.suggested_status<>'relevant')"""),
    "next_for_all": with_views(
        f"""SELECT u.id, u.url FROM urls u WHERE u.outcome='pending' AND {_nx('user_url_agency_suggestions')}
 AND {_nx('user_record_type_suggestions')} AND {_nx('user_relevant_suggestions')}"""),
    "review_queue": with_views(
        f"""SELECT u.id, u.url, 3 AS total_distinct_annotation_count FROM urls u WHERE u.outcome='pending'
 AND {_ex('user_url_agency_suggestions')} AND {_ex('user_record_type_suggestions')} AND {_ex('user_relevant_suggestions')}"""),
}

QUERIES["queue_record_type"] = lambda spark, d: q.queue_record_type(load_model(spark, d)).select(
    "id", "url", F.size("html").alias("html_fields"))
ORACLES["queue_record_type"] = with_views(
    f"""SELECT u.id, u.url, (SELECT COUNT(*) FROM url_html_content h WHERE h.url_id=u.id) AS html_fields FROM urls u
 WHERE u.outcome='pending' AND {_nx('auto_record_type_suggestions')} AND {_ex('url_html_content')}""")
QUERIES["filter_jurisdictions"] = lambda spark, d: q.filter_jurisdictions(
    load_model(spark, d)["agencies"].select(F.col("county").alias("name"), F.col("agency_id").alias("id"),
                                            F.col("agency_id").alias("seq")),
    load_model(spark, d).base("nation").where("n_regionkey IN (0, 1)").select("n_name"))[0]
ORACLES["filter_jurisdictions"] = with_views(
    """SELECT county AS name, MAX(agency_id) AS id FROM agencies
 WHERE county IN (SELECT n_name FROM nation WHERE n_regionkey IN (0, 1)) GROUP BY county""")


def _pages(spark, d):
    """Pages 1, 2 and the last one of the URLs by outcome and id, read by their index."""
    u, order = load_model(spark, d)["urls"].select("outcome", "id", "url"), ["outcome", "id"]
    index = ordering.page_index(u, order)
    last = index.agg(F.max("page")).first()[0] or 0
    pages = [ordering.read_page(u, order, index, p).withColumn("page", F.lit(p).cast("long")) for p in sorted({1, 2, last})]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def _limited_pages(spark, d):
    """Search hits in pages of 1000 ids; whole pages are kept until 5000 titles match."""
    hits = load_model(spark, d)["urls"].select("id", "url", F.floor(F.col("id") / 1000000).alias("page"), F.col("url").contains("7").alias("matched"))
    return q.limit_by_page(hits, 5000, matched="matched").select("id", "page")


QUERIES["urls_pages"] = _pages
QUERIES["limit_by_page"] = _limited_pages
QUERIES["next_for_relevance_page"] = lambda spark, d: q.with_page_context(load_model(spark, d), q.next_for_relevance(load_model(spark, d), k=100)).select(
    "id", "url", "auto_relevant", "auto_model_name", "title", "description")
QUERIES["next_for_record_type_page"] = lambda spark, d: q.with_page_context(load_model(spark, d), q.next_for_record_type(load_model(spark, d), k=100)).select(
    "id", "url", "auto_record_type", "title", "description")
QUERIES["next_for_all_page"] = lambda spark, d: q.with_page_context(load_model(spark, d), q.next_for_all(load_model(spark, d), k=100)).select(
    "id", "url", "title", "description")
QUERIES["next_for_agency_user"] = lambda spark, d: q.with_page_context(
    load_model(spark, d), q.next_for_agency(load_model(spark, d), user_id=7, k=100), suggestions=True).select(
    "id", "url", "title", "description", "unknown", F.array_sort(F.transform("suggestions", lambda x: x["agency_id"])).alias("agency_ids"))

_WIDE = """hw AS (SELECT url_id, MAX(CASE WHEN content_type='Title' THEN content END) AS title,
 MAX(CASE WHEN content_type='Description' THEN content END) AS description FROM url_html_content GROUP BY url_id)"""
_TOP = "FROM urls u LEFT JOIN hw ON hw.url_id=u.id"
ORACLES["urls_pages"] = with_views(
    """SELECT outcome, id, url, page FROM (SELECT outcome, id, url, CAST((ROW_NUMBER() OVER (ORDER BY outcome, id) - 1) // 100 + 1 AS BIGINT) AS page,
 COUNT(*) OVER () AS n FROM urls) x WHERE page IN (1, 2, (n + 99) // 100)""")
ORACLES["limit_by_page"] = with_views(
    """SELECT id, page FROM (SELECT id, id // 1000000 AS page FROM urls) h WHERE page IN (SELECT page FROM (SELECT page,
 SUM(m) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
 SELECT id // 1000000 AS page, COUNT(*) FILTER (WHERE url LIKE '%7%') AS m FROM urls GROUP BY 1) a) b WHERE COALESCE(before, 0) < 5000)""")
ORACLES["next_for_relevance_page"] = with_views(
    f"""SELECT u.id, u.url, a.relevant AS auto_relevant, a.model_name AS auto_model_name, title, description {_TOP}
 LEFT JOIN auto_relevant_suggestions a ON a.url_id=u.id WHERE u.outcome='pending' AND {_nx('user_relevant_suggestions')} ORDER BY u.id LIMIT 100""", _WIDE)
ORACLES["next_for_record_type_page"] = with_views(
    f"""SELECT u.id, u.url, a.record_type AS auto_record_type, title, description {_TOP}
 LEFT JOIN auto_record_type_suggestions a ON a.url_id=u.id WHERE u.outcome='pending' AND {_nx('user_record_type_suggestions')}
 AND NOT EXISTS (SELECT 1 FROM user_relevant_suggestions r WHERE r.url_id=u.id AND r.suggested_status <> 'relevant') ORDER BY u.id LIMIT 100""", _WIDE)
ORACLES["next_for_all_page"] = with_views(
    f"""SELECT u.id, u.url, title, description {_TOP} WHERE u.outcome='pending' AND {_nx('user_relevant_suggestions')}
 AND {_nx('user_record_type_suggestions')} AND {_nx('user_url_agency_suggestions')} ORDER BY u.id LIMIT 100""", _WIDE)
ORACLES["next_for_agency_user"] = with_views(
    f"""SELECT u.id, u.url, title, description, s.n = 1 AND s.x = 1 AS unknown,
 CASE WHEN s.n = 1 AND s.x = 1 THEN [CAST(NULL AS BIGINT)] ELSE list_sort(s.l) END AS agency_ids {_TOP}
 JOIN (SELECT url_id, COUNT(*) AS n, MAX(CAST(is_unknown AS INT)) AS x, list(agency_id) AS l FROM automated_url_agency_suggestions GROUP BY url_id) s ON s.url_id=u.id
 WHERE u.outcome='pending' AND {_nx('user_url_agency_suggestions')} AND {_nx('confirmed_url_agency')}
 AND NOT EXISTS (SELECT 1 FROM user_relevant_suggestions r WHERE r.url_id=u.id AND r.user_id=7 AND r.suggested_status <> 'relevant') ORDER BY u.id LIMIT 100""", _WIDE)
