"""Registered metric queries (D, E, C18) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.operators import metrics as m
from urlsift.plans.catalog import AS_OF
from urlsift.plans.oracle import with_views
from urlsift.sources.fixtures import load_model


def _q(fn, *args, **kw):
    return lambda spark, d: fn(load_model(spark, d), *args, **kw)


def _exists(table: str, alias: str, url_expr: str = "u.id") -> str:
    return f"CASE WHEN EXISTS (SELECT 1 FROM {table} x WHERE x.url_id={url_expr}) THEN 1 ELSE 0 END AS {alias}"


ALL6 = ",\n ".join(_exists(t, n) for n, t in m.ANNOTATION_MODELS)
USER3 = ",\n ".join(_exists(t, n) for n, t in m.USER_MODELS)
PENDING_FLAGS = f"pf AS (SELECT u.id AS url_id, u.created_at,\n {USER3}\n FROM urls u WHERE u.outcome='pending')"
BATCH_FLAGS = (f"bf AS (SELECT l.batch_id, u.id AS url_id, u.outcome,\n {USER3}\n"
               " FROM link_batch_urls l JOIN urls u ON u.id=l.url_id)")
N3 = "(has_user_relevant+has_user_record_type+has_user_agency)"

QUERIES = {
    "annotation_exists": _q(m.annotation_exists),
    "pending_annotation_sums": _q(m.pending_annotation_sums),
    "pending_annotation_histogram": _q(m.pending_annotation_histogram),
    "pending_metrics": _q(m.pending_metrics),
    "batch_url_counts": _q(m.batch_url_counts),
    "batch_url_counts_has_pending": _q(m.batch_url_counts, has_pending=True),
    "batch_url_counts_no_pending_manual": _q(m.batch_url_counts, strategy="manual", has_pending=False),
    "batch_summaries": _q(m.batch_summaries),
    "urls_aggregated": _q(m.urls_aggregated),
    "oldest_pending": _q(m.oldest_pending),
    "batches_aggregated": _q(m.batches_aggregated),
    "batches_breakdown": _q(m.batches_breakdown),
    "urls_submitted_by_month": _q(m.urls_submitted_by_month),
    "urls_pending_by_month": _q(m.urls_pending_by_month),
    "urls_pending_by_month_fanout": _q(m.urls_pending_by_month, fanout=True),
    "annotation_batch_info": _q(m.annotation_batch_info),
    "final_review_batch_info": _q(m.final_review_batch_info),
    "review_remaining": _q(m.review_remaining),
    "backlog_snapshot": _q(m.backlog_snapshot, AS_OF),
    "backlog_by_month": _q(m.backlog_by_month),
    "url_annotation_flags": _q(m.url_annotation_flags),
    "task_url_counts": lambda spark, d: m.count_by_key(load_model(spark, d)["link_task_urls"], "task_id", "url_count"),
    "error_info_distinct": lambda spark, d: load_model(spark, d)["url_error_info"].agg(
        m.count_distinct("url_id").alias("distinct_urls"), m.sum_distinct("task_id").cast("long").alias("task_id_sum")),
}

ORACLES = {
    "annotation_exists": with_views(f"SELECT u.id AS url_id,\n {ALL6}\nFROM urls u WHERE u.outcome='pending'"),
    "pending_annotation_sums": with_views(
        "SELECT CAST(SUM(has_user_relevant) AS BIGINT) AS relevant, CAST(SUM(has_user_record_type) AS BIGINT)"
        " AS record_type, CAST(SUM(has_user_agency) AS BIGINT) AS agency FROM pf", PENDING_FLAGS),
    "pending_annotation_histogram": with_views(
        "SELECT COUNT(*) AS all_pending, "
        + ", ".join(f"COUNT(*) FILTER (WHERE {N3}={k}) AS annotations_{k}" for k in range(4)) + " FROM pf",
        PENDING_FLAGS),
    "pending_metrics": with_views(
        "SELECT COUNT(*) AS all_pending, CAST(COALESCE(SUM(has_user_relevant),0) AS BIGINT) AS relevant,"
        " CAST(COALESCE(SUM(has_user_record_type),0) AS BIGINT) AS record_type,"
        " CAST(COALESCE(SUM(has_user_agency),0) AS BIGINT) AS agency, "
        + ", ".join(f"COUNT(*) FILTER (WHERE {N3}={k}) AS annotations_{k}" for k in range(4)) + " FROM pf",
        PENDING_FLAGS),
}

_BATCH_COUNTS = """SELECT b.id AS batch_id, COUNT(u.id) AS total,
 COUNT(CASE WHEN u.outcome='pending' THEN 1 END) AS pending, COUNT(CASE WHEN u.outcome='submitted' THEN 1 END) AS submitted,
 COUNT(CASE WHEN u.outcome='not relevant' THEN 1 END) AS not_relevant, COUNT(CASE WHEN u.outcome='error' THEN 1 END) AS error,
 COUNT(CASE WHEN u.outcome='duplicate' THEN 1 END) AS duplicate
 FROM batches b LEFT JOIN link_batch_urls l ON l.batch_id=b.id LEFT JOIN urls u ON u.id=l.url_id"""
_HAS_PENDING = ("EXISTS (SELECT 1 FROM link_batch_urls l2 JOIN urls u2 ON u2.id=l2.url_id"
                " WHERE l2.batch_id=b.id AND u2.outcome='pending')")
ORACLES["batch_url_counts"] = with_views(_BATCH_COUNTS + " GROUP BY b.id")
ORACLES["batch_url_counts_has_pending"] = with_views(_BATCH_COUNTS + f" WHERE {_HAS_PENDING} GROUP BY b.id")
ORACLES["batch_url_counts_no_pending_manual"] = with_views(
    _BATCH_COUNTS + f" WHERE b.strategy='manual' AND NOT {_HAS_PENDING} GROUP BY b.id")
ORACLES["batch_summaries"] = with_views(
    "SELECT b.id AS batch_id, b.strategy, b.status, b.user_id, b.compute_time, b.date_generated,"
    " c.total, c.pending, c.submitted, c.not_relevant, c.error, c.duplicate FROM batches b JOIN bc c ON c.batch_id=b.id",
    f"bc AS ({_BATCH_COUNTS} GROUP BY b.id)")
ORACLES["urls_aggregated"] = with_views(
    """SELECT COUNT(DISTINCT id) AS count_urls_total,
 COUNT(DISTINCT CASE WHEN outcome='pending' THEN id END) AS count_urls_pending,
 COUNT(DISTINCT CASE WHEN outcome='submitted' THEN id END) AS count_urls_submitted,
 COUNT(DISTINCT CASE WHEN outcome='validated' THEN id END) AS count_urls_validated,
 COUNT(DISTINCT CASE WHEN outcome='not relevant' THEN id END) AS count_urls_rejected,
 COUNT(DISTINCT CASE WHEN outcome='error' THEN id END) AS count_urls_errors,
 (SELECT id FROM urls WHERE outcome='pending' ORDER BY created_at, id LIMIT 1) AS oldest_pending_url_id,
 (SELECT created_at FROM urls WHERE outcome='pending' ORDER BY created_at, id LIMIT 1) AS oldest_pending_url_created_at
FROM urls""")
ORACLES["oldest_pending"] = with_views(
    "SELECT id AS url_id, created_at FROM urls WHERE outcome='pending' ORDER BY created_at, id LIMIT 1")
ORACLES["batches_aggregated"] = with_views(
    """SELECT bc.strategy, bc.done AS count_successful_batches, bc.failed AS count_failed_batches,
 COALESCE(uc.p,0)+COALESCE(uc.s,0)+COALESCE(uc.r,0)+COALESCE(uc.e,0)+COALESCE(uc.v,0) AS count_urls,
 COALESCE(uc.p,0) AS count_urls_pending, COALESCE(uc.v,0) AS count_urls_validated,
 COALESCE(uc.s,0) AS count_urls_submitted, COALESCE(uc.r,0) AS count_urls_rejected, COALESCE(uc.e,0) AS count_urls_errors,
 (SELECT COUNT(DISTINCT id) FROM batches) AS total_batches
FROM bc LEFT JOIN uc ON uc.strategy=bc.strategy""",
    """bc AS (SELECT strategy, COUNT(DISTINCT CASE WHEN status='ready to label' THEN id END) AS done,
 COUNT(DISTINCT CASE WHEN status='error' THEN id END) AS failed FROM batches GROUP BY strategy),
uc AS (SELECT b.strategy, COUNT(DISTINCT CASE WHEN u.outcome='pending' THEN u.id END) AS p,
 COUNT(DISTINCT CASE WHEN u.outcome='error' THEN u.id END) AS e, COUNT(DISTINCT CASE WHEN u.outcome='validated' THEN u.id END) AS v,
 COUNT(DISTINCT CASE WHEN u.outcome='submitted' THEN u.id END) AS s, COUNT(DISTINCT CASE WHEN u.outcome='not relevant' THEN u.id END) AS r
 FROM urls u JOIN link_batch_urls l ON l.url_id=u.id LEFT JOIN batches b ON b.id=l.batch_id GROUP BY b.strategy)""")
ORACLES["batches_breakdown"] = with_views(
    """SELECT b.id AS batch_id, b.strategy, b.status, b.date_generated AS created_at,
 COALESCE(c.t,0) AS count_url_total, COALESCE(c.p,0) AS count_url_pending, COALESCE(c.s,0) AS count_url_submitted,
 COALESCE(c.r,0) AS count_url_rejected, COALESCE(c.e,0) AS count_url_error, COALESCE(c.v,0) AS count_url_validated
FROM batches b LEFT JOIN c ON c.batch_id=b.id""",
    """c AS (SELECT l.batch_id, COUNT(DISTINCT u.id) AS t, COUNT(DISTINCT CASE WHEN u.outcome='pending' THEN u.id END) AS p,
 COUNT(DISTINCT CASE WHEN u.outcome='submitted' THEN u.id END) AS s, COUNT(DISTINCT CASE WHEN u.outcome='not relevant' THEN u.id END) AS r,
 COUNT(DISTINCT CASE WHEN u.outcome='error' THEN u.id END) AS e, COUNT(DISTINCT CASE WHEN u.outcome='validated' THEN u.id END) AS v
 FROM link_batch_urls l JOIN urls u ON l.url_id=u.id GROUP BY l.batch_id)""")
ORACLES["urls_submitted_by_month"] = with_views(
    "SELECT date_trunc('month', created_at) AS month, strftime(date_trunc('month', created_at), '%B %Y') AS month_label,"
    " COUNT(*) AS count_submitted FROM url_data_sources GROUP BY 1, 2")
ORACLES["urls_pending_by_month"] = with_views(
    """SELECT date_trunc('month', created_at) AS month, strftime(date_trunc('month', created_at), '%B %Y') AS month_label,
 COUNT(*) AS count_pending_total, COUNT(*) FILTER (WHERE has_user_relevant=1) AS count_pending_relevant_user,
 COUNT(*) FILTER (WHERE has_user_record_type=1) AS count_pending_record_type_user,
 COUNT(*) FILTER (WHERE has_user_agency=1) AS count_pending_agency_user FROM pf GROUP BY 1, 2""", PENDING_FLAGS)
ORACLES["urls_pending_by_month_fanout"] = with_views(
    """SELECT date_trunc('month', u.created_at) AS month, strftime(date_trunc('month', u.created_at), '%B %Y') AS month_label,
 COUNT(*) AS count_pending_total, COUNT(r.url_id) AS count_pending_relevant_user,
 COUNT(t.url_id) AS count_pending_record_type_user, COUNT(a.url_id) AS count_pending_agency_user
FROM urls u LEFT JOIN user_record_type_suggestions t ON t.url_id=u.id
 LEFT JOIN user_relevant_suggestions r ON r.url_id=u.id LEFT JOIN user_url_agency_suggestions a ON a.url_id=u.id
WHERE u.outcome='pending' GROUP BY 1, 2""")
ORACLES["annotation_batch_info"] = with_views(
    f"""SELECT batch_id, COUNT(*) FILTER (WHERE {N3}=3) AS count_annotated, COUNT(*) FILTER (WHERE {N3}=0) AS count_not_annotated,
 COUNT(*) FILTER (WHERE {N3}=3) + COUNT(*) FILTER (WHERE {N3}=0) AS total_urls
FROM bf WHERE outcome='pending' GROUP BY batch_id""", BATCH_FLAGS)
ORACLES["final_review_batch_info"] = with_views(
    f"""SELECT batch_id,
 COUNT(*) FILTER (WHERE outcome IN ('validated','not relevant','submitted','individual record')) AS count_reviewed,
 COUNT(*) FILTER (WHERE outcome='pending' AND {N3}=3) AS count_ready_for_review FROM bf GROUP BY batch_id""",
    BATCH_FLAGS)
ORACLES["review_remaining"] = with_views(f"SELECT COUNT(*) FILTER (WHERE {N3}=3) AS remaining FROM pf", PENDING_FLAGS)
ORACLES["backlog_snapshot"] = with_views(
    f"SELECT TIMESTAMP '{AS_OF}' AS created_at, COUNT(*) AS count_pending_total FROM urls WHERE outcome='pending'")
ORACLES["backlog_by_month"] = with_views(
    """SELECT month, strftime(month, '%B %Y') AS month_label, created_at, count_pending_total FROM (
 SELECT date_trunc('month', created_at) AS month, created_at, count_pending_total,
  ROW_NUMBER() OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at DESC, id DESC) AS rn
 FROM backlog_snapshot) s WHERE rn=1""")
_FLAG8 = [("has_auto_record_type_suggestion", "auto_record_type_suggestions"),
          ("has_auto_relevant_suggestion", "auto_relevant_suggestions"),
          ("has_auto_agency_suggestion", "automated_url_agency_suggestions"),
          ("has_user_record_type_suggestion", "user_record_type_suggestions"),
          ("has_user_relevant_suggestion", "user_relevant_suggestions"),
          ("has_user_agency_suggestion", "user_url_agency_suggestions"),
          ("has_confirmed_agency", "confirmed_url_agency")]
ORACLES["url_annotation_flags"] = with_views(
    "SELECT u.id AS url_id, "
    + ", ".join(f"EXISTS (SELECT 1 FROM {t} x WHERE x.url_id=u.id) AS {n}" for n, t in _FLAG8)
    + ", EXISTS (SELECT 1 FROM reviewing_user_url x WHERE x.url_id=u.id) AS was_reviewed FROM urls u")
ORACLES["task_url_counts"] = with_views("SELECT task_id, COUNT(*) AS url_count FROM link_task_urls GROUP BY task_id")
ORACLES["error_info_distinct"] = with_views(
    "SELECT COUNT(DISTINCT url_id) AS distinct_urls, CAST(SUM(DISTINCT task_id) AS BIGINT) AS task_id_sum FROM url_error_info")
