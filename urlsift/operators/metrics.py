"""Metrics and roll-ups (inventory D1-D16, E1).

Every operator takes the model tables ``t`` (anything indexable by table name: :class:`Tables` or a dict of
DataFrames) and returns a DataFrame. Patterns used throughout, chosen for 100 TB inputs:

- *Flags by one aggregation.* "Does URL x have a row in table T_k" for k = 1..6 is computed by unioning the url_id
  column of every T_k (tagged with its flag) and the base URL set, then one ``groupBy(url_id).max(flags)``. That is
  one shuffle with partial aggregation instead of six joins, and a URL annotated by many users never fans out.
- *Pre-aggregate, then join.* Per-status URL counts are first reduced to one row per batch; only those rows meet
  the batch table, and per-strategy totals are summed from them (no URL-level join with batches).
- *Conditional counts on unique keys* use ``count(when)`` rather than ``countDistinct`` (no Expand node); the
  keys involved (``urls.id``, ``link_batch_urls.url_id``, ``batches.id``) are unique by model constraint.
- *Latest-per-group* uses ``max(struct(..))`` (partial aggregation) instead of a ``row_number`` window, so one
  very large group never lands in one sorting task.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.functions.scalars import count_when, month_label, month_start

# (flag column, model table) — the six annotation models; the first three are automatic, the last three human.
ANNOTATION_MODELS = [
    ("has_auto_record_type", "auto_record_type_suggestions"),
    ("has_auto_relevant", "auto_relevant_suggestions"),
    ("has_auto_agency", "automated_url_agency_suggestions"),
    ("has_user_relevant", "user_relevant_suggestions"),
    ("has_user_record_type", "user_record_type_suggestions"),
    ("has_user_agency", "user_url_agency_suggestions"),
]
USER_MODELS = ANNOTATION_MODELS[3:]
REVIEWED_STATUSES = ["validated", "not relevant", "submitted", "individual record"]


def _pending(t) -> DataFrame:
    return t["urls"].where(F.col("outcome") == "pending")


def url_flags(t, base: DataFrame, models: Sequence[tuple[str, str]] = ANNOTATION_MODELS,
              carry: Sequence[str] = ()) -> DataFrame:
    """url_id (+ ``carry`` columns of ``base``) and one 0/1 int flag per model: does the URL have a row there.

    ``base`` must have one row per ``url_id``. One shuffle: union of tagged url_id columns + max per url."""
    names = [n for n, _ in models]
    zero_flags = [F.lit(0).alias(n) for n in names]
    parts = [base.select("url_id", *carry, F.lit(1).alias("_base"), *zero_flags)]
    for name, table in models:
        parts.append(t[table].select(
            "url_id", *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in carry], F.lit(0).alias("_base"),
            *[F.lit(1 if n == name else 0).alias(n) for n in names]))
    unioned = reduce(DataFrame.unionByName, parts)
    agg = unioned.groupBy("url_id").agg(F.max("_base").alias("_base"), *[F.max(c).alias(c) for c in carry],
                                        *[F.max(n).alias(n) for n in names])
    return agg.where(F.col("_base") == 1).drop("_base")


def annotation_exists(t) -> DataFrame:
    """Per pending URL, six 0/1 flags (auto/user × record type/relevance/agency)."""
    return url_flags(t, _pending(t).select(F.col("id").alias("url_id")))


def _user_total(df: DataFrame) -> Column:
    return sum((F.col(n) for n, _ in USER_MODELS), F.lit(0))


def pending_annotation_sums(t) -> DataFrame:
    """One row — pending URLs having a user relevance / record type / agency annotation."""
    f = url_flags(t, _pending(t).select(F.col("id").alias("url_id")), USER_MODELS)
    return f.agg(F.sum("has_user_relevant").cast("long").alias("relevant"),
                 F.sum("has_user_record_type").cast("long").alias("record_type"),
                 F.sum("has_user_agency").cast("long").alias("agency"))


def pending_annotation_histogram(t) -> DataFrame:
    """One row — pending total and how many pending URLs have 0, 1, 2, 3 user annotations (zero-filled)."""
    f = url_flags(t, _pending(t).select(F.col("id").alias("url_id")), USER_MODELS)
    n = _user_total(f)
    return f.agg(F.count(F.lit(1)).alias("all_pending"),
                 *[count_when(n == k).alias(f"annotations_{k}") for k in range(4)])


def pending_metrics(t) -> DataFrame:
    """D9 + D10 as the reference's pending-metrics record: all, relevant, record_type, agency, annotations_0..3."""
    f = url_flags(t, _pending(t).select(F.col("id").alias("url_id")), USER_MODELS)
    n = _user_total(f)
    return f.agg(F.count(F.lit(1)).alias("all_pending"),
                 F.coalesce(F.sum("has_user_relevant"), F.lit(0)).cast("long").alias("relevant"),
                 F.coalesce(F.sum("has_user_record_type"), F.lit(0)).cast("long").alias("record_type"),
                 F.coalesce(F.sum("has_user_agency"), F.lit(0)).cast("long").alias("agency"),
                 *[count_when(n == k).alias(f"annotations_{k}") for k in range(4)])


# ---- per-batch URL counts ---------------------------------------------------------------------------------------
BATCH_COUNT_STATUSES = [("pending", "pending"), ("submitted", "submitted"), ("not_relevant", "not relevant"),
                        ("error", "error"), ("duplicate", "duplicate"), ("validated", "validated")]


def _url_counts_per_batch(t, statuses=BATCH_COUNT_STATUSES) -> DataFrame:
    """batch_id, total, one count per status — one row per batch that has URLs (partial aggregation)."""
    lu = t["link_batch_urls"].join(t["urls"].select(F.col("id").alias("url_id"), "outcome"), "url_id")
    return lu.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"),
                                      *[count_when(F.col("outcome") == s).alias(n) for n, s in statuses])


def batches_filtered(t, strategy: str | None = None, status: str | None = None, batch_id: int | None = None,
                     has_pending: bool | None = None) -> DataFrame:
    """Batches under optional conjunctive filters; ``has_pending`` is an EXISTS / NOT EXISTS on pending URLs."""
    b = t["batches"]
    if strategy is not None:
        b = b.where(F.col("strategy") == strategy)
    if status is not None:
        b = b.where(F.col("status") == status)
    if batch_id is not None:
        b = b.where(F.col("id") == batch_id)
    if has_pending is not None:
        pend = t["link_batch_urls"].join(_pending(t).select(F.col("id").alias("url_id")), "url_id", "left_semi")
        pend = pend.select(F.col("batch_id").alias("id"))
        b = b.join(pend, "id", "left_semi" if has_pending else "left_anti")
    return b


def batch_url_counts(t, strategy=None, status=None, batch_id=None, has_pending=None) -> DataFrame:
    """Per batch (outer from batches): total, pending, submitted, not_relevant, error, duplicate; 0 if none."""
    b = batches_filtered(t, strategy, status, batch_id, has_pending).select(F.col("id").alias("batch_id"))
    counts = _url_counts_per_batch(t, BATCH_COUNT_STATUSES[:5])
    cols = ["total", "pending", "submitted", "not_relevant", "error", "duplicate"]
    return b.join(counts, "batch_id", "left").select(
        "batch_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cols])


def batch_summaries(t, page: int | None = None, **filters) -> DataFrame:
    """D1 joined back to batch attributes; ``page`` (1-based, 100 rows by batch id) is optional."""
    counts = batch_url_counts(t, **filters)
    if page is not None:
        counts = counts.orderBy("batch_id").offset((page - 1) * 100).limit(100)
    b = t["batches"].select(F.col("id").alias("batch_id"), "strategy", "status", "user_id", "compute_time",
                            "date_generated")
    return b.join(counts, "batch_id")


def urls_aggregated(t) -> DataFrame:
    """D3: one row — URL totals by status plus the oldest pending URL (ties on created_at → smallest id)."""
    u = t["urls"]
    oldest = F.min(F.when(F.col("outcome") == "pending", F.struct("created_at", "id")))
    return u.agg(
        F.count(F.lit(1)).alias("count_urls_total"),
        count_when(F.col("outcome") == "pending").alias("count_urls_pending"),
        count_when(F.col("outcome") == "submitted").alias("count_urls_submitted"),
        count_when(F.col("outcome") == "validated").alias("count_urls_validated"),
        count_when(F.col("outcome") == "not relevant").alias("count_urls_rejected"),
        count_when(F.col("outcome") == "error").alias("count_urls_errors"),
        oldest.alias("_o"),
    ).select("*", F.col("_o.id").alias("oldest_pending_url_id"),
             F.col("_o.created_at").alias("oldest_pending_url_created_at")).drop("_o")


def oldest_pending(t) -> DataFrame:
    """arg-min created_at over pending URLs (one row; none if no pending URL)."""
    p = _pending(t)
    return p.agg(F.min(F.struct("created_at", "id")).alias("_o")).where(F.col("_o").isNotNull()).select(
        F.col("_o.id").alias("url_id"), F.col("_o.created_at").alias("created_at"))


def batches_aggregated(t) -> DataFrame:
    """Per strategy — done / failed batches, URL counts for five statuses and ``count_urls`` (their sum, K10),
    plus the total number of batches (repeated on every row)."""
    b = t["batches"]
    per_strategy = b.groupBy("strategy").agg(
        count_when(F.col("status") == "ready to label").alias("count_successful_batches"),
        count_when(F.col("status") == "error").alias("count_failed_batches"),
        F.count(F.lit(1)).alias("_n"))
    per_batch = _url_counts_per_batch(t)
    by_strategy = (per_batch.join(b.select(F.col("id").alias("batch_id"), "strategy"), "batch_id")
                   .groupBy("strategy").agg(*[F.sum(c).alias(c) for c in
                                              ["pending", "error", "validated", "submitted", "not_relevant"]]))
    j = per_strategy.join(by_strategy, "strategy", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = j.select(
        "strategy", "count_successful_batches", "count_failed_batches",
        (z("pending") + z("submitted") + z("not_relevant") + z("error") + z("validated")).alias("count_urls"),
        z("pending").alias("count_urls_pending"), z("validated").alias("count_urls_validated"),
        z("submitted").alias("count_urls_submitted"), z("not_relevant").alias("count_urls_rejected"),
        z("error").alias("count_urls_errors"),
        F.sum("_n").over(_whole()).cast("long").alias("total_batches"))
    return out


def _whole():
    from pyspark.sql import Window
    # a window over the per-strategy rows only (at most 8 rows): a global total without a second scan
    return Window.partitionBy(F.lit(0))


def batches_breakdown(t, page: int | None = None) -> DataFrame:
    """Per batch — strategy, status, created_at, total and five status counts (0 default); ordered by
    created_at (then id), optional page of 100 (K11: offset *and* limit)."""
    counts = _url_counts_per_batch(t)
    b = t["batches"].select(F.col("id").alias("batch_id"), "strategy", "status",
                            F.col("date_generated").alias("created_at"))
    j = b.join(counts, "batch_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = j.select("batch_id", "strategy", "status", "created_at", z("total").alias("count_url_total"),
                   z("pending").alias("count_url_pending"), z("submitted").alias("count_url_submitted"),
                   z("not_relevant").alias("count_url_rejected"), z("error").alias("count_url_error"),
                   z("validated").alias("count_url_validated"))
    if page is not None:
        out = out.orderBy("created_at", "batch_id").offset((page - 1) * 100).limit(100)
    return out


def urls_submitted_by_month(t) -> DataFrame:
    """Submissions per calendar month with a ``%B %Y`` label."""
    s = t["url_data_sources"]
    return s.groupBy(month_start("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("count_submitted")).select("month", month_label("month").alias("month_label"),
                                                          "count_submitted")


def urls_pending_by_month(t, fanout: bool = False) -> DataFrame:
    """Per created-month of pending URLs — total and counts with a user relevance / record type / agency
    annotation. ``fanout=True`` counts the rows that joining all three annotation tables would give (K4), as products
    of a URL's numbers of annotations, without making those rows; default counts URLs."""
    p = _pending(t).select(F.col("id").alias("url_id"), "created_at")
    if fanout:
        return _fanout_by_month(t, p)
    f = url_flags(t, p, USER_MODELS, carry=["created_at"])
    return f.groupBy(month_start("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("count_pending_total"),
        count_when(F.col("has_user_relevant") == 1).alias("count_pending_relevant_user"),
        count_when(F.col("has_user_record_type") == 1).alias("count_pending_record_type_user"),
        count_when(F.col("has_user_agency") == 1).alias("count_pending_agency_user"),
    ).select("month", month_label("month").alias("month_label"), "count_pending_total",
             "count_pending_relevant_user", "count_pending_record_type_user", "count_pending_agency_user")


def _fanout_by_month(t, pending: DataFrame) -> DataFrame:
    names = [n for n, _ in USER_MODELS]
    none = [F.lit(0).cast("long").alias(n) for n in names]
    rows = pending.select("url_id", "created_at", F.lit(1).cast("long").alias("_own"), *none)
    for flag, table in USER_MODELS:
        one = [F.lit(int(n == flag)).cast("long").alias(n) for n in names]
        rows = rows.unionByName(t[table].select("url_id", F.lit(None).cast(pending.schema["created_at"].dataType).alias("created_at"),
                                                F.lit(0).cast("long").alias("_own"), *one))
    per_url = rows.groupBy("url_id").agg(F.max("created_at").alias("created_at"), F.sum("_own").alias("_own"), *[F.sum(n).alias(n) for n in names]).where("_own > 0")
    # a left join keeps a URL without annotations of a kind once
    product = F.col("_own")
    for n in names:
        product = product * F.greatest(F.col(n), F.lit(1))
    counted = lambda n: F.sum(F.when(F.col(n) > 0, product).otherwise(0))
    return per_url.groupBy(month_start("created_at").alias("month")).agg(
        F.sum(product).alias("count_pending_total"), counted("has_user_relevant").alias("count_pending_relevant_user"),
        counted("has_user_record_type").alias("count_pending_record_type_user"), counted("has_user_agency").alias("count_pending_agency_user"),
    ).select("month", month_label("month").alias("month_label"), "count_pending_total",
             "count_pending_relevant_user", "count_pending_record_type_user", "count_pending_agency_user")


def _pending_in_batches(t, batch_id=None) -> DataFrame:
    lb = t["link_batch_urls"]
    if batch_id is not None:
        lb = lb.where(F.col("batch_id") == batch_id)
    return lb.join(_pending(t).select(F.col("id").alias("url_id")), "url_id")


def annotation_batch_info(t, models: Sequence[tuple[str, str]] = USER_MODELS, batch_id=None) -> DataFrame:
    """Per batch — pending URLs with every given annotation / with none of them, and their sum (K7: partly
    annotated URLs are in neither count)."""
    base = _pending_in_batches(t, batch_id)
    f = url_flags(t, base, models, carry=["batch_id"])
    n = sum((F.col(c) for c, _ in models), F.lit(0))
    k = len(models)
    agg = f.groupBy("batch_id").agg(count_when(n == k).alias("count_annotated"),
                                    count_when(n == 0).alias("count_not_annotated"))
    return agg.withColumn("total_urls", F.col("count_annotated") + F.col("count_not_annotated"))


def _review_flags(t, batch_id=None) -> DataFrame:
    lb = t["link_batch_urls"]
    if batch_id is not None:
        lb = lb.where(F.col("batch_id") == batch_id)
    base = lb.join(t["urls"].select(F.col("id").alias("url_id"), "outcome"), "url_id")
    return url_flags(t, base, USER_MODELS, carry=["batch_id", "outcome"])


def final_review_batch_info(t, batch_id=None) -> DataFrame:
    """Per batch with URLs — reviewed URLs (validated, not relevant, submitted, individual record) and
    URLs ready for review (pending with all three user annotations), 0 by default."""
    f = _review_flags(t, batch_id)
    ready = (F.col("outcome") == "pending") & (_user_total(f) == 3)
    return f.groupBy("batch_id").agg(count_when(F.col("outcome").isin(REVIEWED_STATUSES)).alias("count_reviewed"),
                                     count_when(ready).alias("count_ready_for_review"))


def review_remaining(t, batch_id=None) -> DataFrame:
    """One row — number of URLs in the review queue (pending with all three user annotations)."""
    if batch_id is None:
        f = url_flags(t, _pending(t).select(F.col("id").alias("url_id")), USER_MODELS)
    else:
        f = url_flags(t, _pending_in_batches(t, batch_id), USER_MODELS)
    return f.agg(count_when(_user_total(f) == 3).alias("remaining"))


def backlog_snapshot(t, as_of) -> DataFrame:
    """The snapshot row to append — pending URL count at ``as_of``."""
    p = _pending(t)
    return p.agg(F.count(F.lit(1)).alias("count_pending_total")).select(
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"), "count_pending_total")


def count_by_key(df: DataFrame, key: str | Sequence[str], name: str = "count") -> DataFrame:
    """Rows per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_distinct(c: Column | str) -> Column:
    """D15b."""
    return F.countDistinct(c)


def sum_distinct(c: Column | str) -> Column:
    """D15c."""
    return F.sum_distinct(F.col(c) if isinstance(c, str) else c)


def backlog_by_month(t) -> DataFrame:
    """The latest backlog snapshot of each month (ties on created_at → larger id), with its label."""
    s = t["backlog_snapshot"]
    latest = s.groupBy(month_start("created_at").alias("month")).agg(
        F.max(F.struct("created_at", "id", "count_pending_total")).alias("_l"))
    return latest.select("month", month_label("month").alias("month_label"),
                         F.col("_l.created_at").alias("created_at"),
                         F.col("_l.count_pending_total").alias("count_pending_total"))


def url_annotation_flags(t) -> DataFrame:
    """Per URL (every status), eight boolean "has X" flags: the six models, confirmed agency, reviewer.
    Distinct per URL (K5)."""
    models = [
        ("has_auto_record_type_suggestion", "auto_record_type_suggestions"),
        ("has_auto_relevant_suggestion", "auto_relevant_suggestions"),
        ("has_auto_agency_suggestion", "automated_url_agency_suggestions"),
        ("has_user_record_type_suggestion", "user_record_type_suggestions"),
        ("has_user_relevant_suggestion", "user_relevant_suggestions"),
        ("has_user_agency_suggestion", "user_url_agency_suggestions"),
        ("has_confirmed_agency", "confirmed_url_agency"),
        ("was_reviewed", "reviewing_user_url"),
    ]
    f = url_flags(t, t["urls"].select(F.col("id").alias("url_id")), models)
    return f.select("url_id", *[(F.col(n) == 1).alias(n) for n, _ in models])
