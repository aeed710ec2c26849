"""Filters, work queues and listings (inventory B, C, F).

Every "queue" is a set expression over URL ids: semi joins for EXISTS, anti joins for NOT EXISTS (never
``NOT IN``, whose NULL semantics differ). Queues return the whole ranked set (``k=None``) or its top ``k``;
``orderBy(..).limit(k)`` plans as TakeOrderedAndProject (per-partition top-k, then a k-row merge), so a top-1
"next URL" never sorts the queue globally. The reference's slices of 100 rows are unnecessary here: a queue is
processed in one pass, partitioned by Spark.

Anti/semi joins against model tables shuffle both sides on url_id at scale; when a side is known to be small
(an explicit list of wanted URLs, a towns list), the caller may wrap it in ``broadcast`` after checking its size
with :func:`urlsift.operators.sizing.broadcast_if_small`.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.functions.scalars import PAGE_SIZE, days_ago
from urlsift.operators.ordering import running_total
from urlsift.operators.sizing import broadcast_if_small, skew_left_join


def _pending_urls(t) -> DataFrame:
    return t["urls"].where(F.col("outcome") == "pending")


def _ids(df: DataFrame, col: str = "url_id") -> DataFrame:
    return df.select(F.col(col).alias("id"))


def _rank(df: DataFrame, order: Sequence[Column | str], k: int | None) -> DataFrame:
    if k is None:
        return df
    return df.orderBy(*order).limit(k)


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


# ---- B: projections, filters, predicates --------------------------------------------------------------------
def filter_url_keyword(df: DataFrame, keyword: str, col: str = "url") -> DataFrame:
    """B1: case-sensitive substring match on the URL."""
    return df.where(F.col(col).contains(keyword))


def filter_title_search(df: DataFrame, term: str, col: str = "title") -> DataFrame:
    """B2: case-insensitive substring match on the title; an empty term keeps every row."""
    if not term:
        return df
    return df.where(F.lower(F.col(col)).contains(term.lower()))


def limit_by_page(df: DataFrame, max_results: int, page: str = "page", matched: str | None = None) -> DataFrame:
    """B3 (soft limit): keep whole pages, in page order, until the running number of matches reaches
    ``max_results``; the page on which it is reached is kept entirely. ``matched`` (bool column) marks the rows
    that count; default all rows.

    Matches are first reduced to one row per page (partial aggregation); the running number comes from a prefix
    sum over ranges of pages, and the page set is joined back."""
    m = F.coalesce(F.col(matched).cast("int"), F.lit(0)) if matched else F.lit(1)
    per_page = df.groupBy(page).agg(F.sum(m).alias("_m"))
    keep = running_total(per_page, [page], F.col("_m"), "_before").where(F.col("_before") < max_results).select(page)
    return df.join(keep, page, "left_semi")


def filter_jurisdictions(df: DataFrame, towns: DataFrame, name: str = "name", id_col: str = "id",
                         seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Keep (name -> id) for names in ``towns``; when a name repeats the last id (by ``seq``) wins.
    Returns (mapping, counts[distinct_names, total_hits])."""
    t = broadcast_if_small(towns.select(F.col(towns.columns[0]).alias(name)).distinct())
    hits = df.join(t, name, "left_semi")
    mapping = hits.groupBy(name).agg(F.max_by(id_col, seq).alias(id_col))
    counts = hits.agg(F.countDistinct(name).alias("distinct_names"), F.count(F.lit(1)).alias("total_hits"))
    return mapping, counts


def ckan_filter(packages: DataFrame) -> DataFrame:
    """Drop collection parents without resources, non-public packages, and resource-less packages without a
    ``landingPage`` extra; packages without ``extras`` are kept."""
    ex, res = F.col("extras"), F.col("resources")
    no_res = F.coalesce(F.size(res), F.lit(0)) <= 0
    parent_empty = F.exists(ex, lambda e: e["key"].eqNullSafe("collection_metadata") & e["value"].eqNullSafe("true")) & no_res
    non_public = F.exists(ex, lambda e: e["key"].eqNullSafe("accessLevel") & e["value"].eqNullSafe("non-public"))
    no_landing = no_res & ~F.exists(ex, lambda e: e["key"].eqNullSafe("landingPage"))
    drop = parent_empty | non_public | no_landing
    return packages.where(ex.isNull() | ~drop)


def tasks_filtered(t, task_type: str | None = None, status: str | None = None) -> DataFrame:
    """Tasks with an optional type / status filter."""
    tk = t["tasks"]
    if task_type is not None:
        tk = tk.where(F.col("task_type") == task_type)
    if status is not None:
        tk = tk.where(F.col("task_status") == status)
    return tk


def urls_with_error_rows(t) -> DataFrame:
    """URLs having at least one error row."""
    return t["urls"].join(_ids(t["url_error_info"]), "id", "left_semi")


def lookup_urls(t, wanted: DataFrame) -> DataFrame:
    """Batch point lookup — (url, found, url_id) for every wanted URL."""
    u = t["urls"].select("url", F.col("id").alias("url_id"))
    return wanted.select("url").join(u, "url", "left").select("url", F.col("url_id").isNotNull().alias("found"),
                                                              "url_id")


def validated_urls(t, k: int | None = None) -> DataFrame:
    """Validated URLs, optionally the first ``k`` by id."""
    return _rank(t["urls"].where(F.col("outcome") == "validated"), ["id"], k)


def has_work(queue: DataFrame) -> bool:
    """Does the queue have any row (a ``LIMIT 1`` probe, not a count)."""
    return not queue.isEmpty()


def annotation_payload_valid(df: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when valid): non-relevant annotations must carry neither record type nor
    agency; relevant ones need both. A new agency (``is_new``, where the column is there) has no id yet and counts as one."""
    rel = F.coalesce(F.col("suggested_status") == "relevant", F.lit(False))
    new = F.coalesce(F.col("is_new"), F.lit(False)) if "is_new" in df.columns else F.lit(False)
    rt, ag = F.col("record_type"), F.when(new, F.lit("new")).otherwise(F.col("agency").cast("string"))
    reason = (F.when(~rel & rt.isNotNull(), "record_type must be None if suggested_status is not relevant")
              .when(~rel & ag.isNotNull(), "agency must be None if suggested_status is not relevant")
              .when(rel & rt.isNull(), "record_type must be provided if suggested_status is relevant")
              .when(rel & ag.isNull(), "agency must be provided if suggested_status is relevant"))
    return df.withColumn("reason", reason)


def agency_payload_valid(df: DataFrame) -> DataFrame:
    """Adds ``reason``: a new-agency suggestion carries no agency id; otherwise the id is required."""
    new, aid = F.coalesce(F.col("is_new"), F.lit(False)), F.col("agency_id")
    reason = (F.when(new & aid.isNotNull(), "agency_id must be None when is_new is True")
              .when(~new & aid.isNull(), "agency_id must be provided when is_new is False"))
    return df.withColumn("reason", reason)


# ---- C: joins / queues ---------------------------------------------------------------------------------------
def user_suggestion_exists(urls: DataFrame, model: DataFrame, key: str = "id") -> DataFrame:
    """URLs having a row in ``model`` (EXISTS)."""
    return urls.join(model.select(F.col("url_id").alias(key)), key, "left_semi")


def user_suggestion_not_exists(urls: DataFrame, model: DataFrame, key: str = "id") -> DataFrame:
    """URLs without a row in ``model`` (NOT EXISTS)."""
    return urls.join(model.select(F.col("url_id").alias(key)), key, "left_anti")


def queue_html(t, k: int | None = None) -> DataFrame:
    """Pending URLs with no HTML content rows and not linked to an HTML task that is ready to label."""
    html_tasks = t["tasks"].where((F.col("task_type") == "HTML") & (F.col("task_status") == "ready to label"))
    in_html_task = t["link_task_urls"].join(html_tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    q = user_suggestion_not_exists(_pending_urls(t), t["url_html_content"])
    q = q.join(_ids(in_html_task), "id", "left_anti")
    return _rank(q.select("id", "url"), ["id"], k)


def queue_without_model(t, model: str, k: int | None = None) -> DataFrame:
    """Pending URLs with no row in the given suggestion table."""
    return _rank(user_suggestion_not_exists(_pending_urls(t), t[model]).select("id", "url"), ["id"], k)


def html_content_map(rows: DataFrame) -> DataFrame:
    """(url_id, content_type, content) rows -> url_id, map content_type -> content (bounded: ≤ 9 keys)."""
    return rows.groupBy("url_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "content")))).alias("html"))


def queue_auto_relevance(t, k: int | None = None) -> DataFrame:
    """Pending URLs that have stored raw HTML and no automatic relevance suggestion, with that HTML."""
    q = user_suggestion_not_exists(_pending_urls(t), t["auto_relevant_suggestions"])
    raw = t["url_compressed_html"].select(F.col("url_id").alias("id"), "html")
    return _rank(q.select("id", "url").join(raw, "id"), ["id"], k)


def queue_record_type(t, k: int | None = None) -> DataFrame:
    """C4: pending URLs with HTML content (K12) and no automatic record-type suggestion, HTML rows as a map."""
    q = user_suggestion_not_exists(_pending_urls(t), t["auto_record_type_suggestions"]).select("id", "url")
    html = html_content_map(t["url_html_content"]).withColumnRenamed("url_id", "id")
    return _rank(q.join(html, "id"), ["id"], k)


def _url_batch(t, q: DataFrame) -> DataFrame:
    """The batches of a queue's URLs; only their links meet the batches."""
    return t["link_batch_urls"].join(q.select(F.col("id").alias("url_id")), "url_id", "left_semi").join(
        t["batches"].select(F.col("id").alias("batch_id"), "strategy"), "batch_id").select(
        F.col("url_id").alias("id"), "batch_id", "strategy")


def queue_agency(t, k: int | None = None) -> DataFrame:
    """Pending URLs with neither an automatic agency suggestion nor a confirmed agency; carries the
    collector metadata and the batch strategy (the routing key of the agency task)."""
    u = _pending_urls(t)
    q = user_suggestion_not_exists(u, t["automated_url_agency_suggestions"])
    q = user_suggestion_not_exists(q, t["confirmed_url_agency"])
    q = q.select("id", "url", _opt(q, "collector_metadata")).join(_url_batch(t, q), "id", "left")
    return _rank(q, ["id"], k)


def queue_misc_metadata(t, k: int | None = None) -> DataFrame:
    """Pending URLs without name, description and optional-metadata row, that belong to a batch."""
    u = _pending_urls(t)
    u = u.where(_opt(u, "name").isNull() & _opt(u, "description").isNull())
    q = user_suggestion_not_exists(u, t["url_optional_data_source_metadata"])
    q = q.select("id", "url", _opt(q, "collector_metadata")).join(_url_batch(t, q), "id")
    return _rank(q, ["id"], k)


def queue_duplicate_check(t, k: int | None = None) -> DataFrame:
    """Pending URLs not yet checked for duplicates."""
    q = user_suggestion_not_exists(_pending_urls(t), t["url_checked_for_duplicate"])
    return _rank(q.select("id", "url"), ["id"], k)


def queue_404_probe(t, as_of, days: int = 30, k: int | None = None) -> DataFrame:
    """Pending URLs never probed for 404, or last probed before ``as_of - days``."""
    probed = t["url_probed_for_404"].select(F.col("url_id").alias("id"), "last_probed_at")
    q = _pending_urls(t).join(probed, "id", "left")
    q = q.where(F.col("last_probed_at").isNull() | (F.col("last_probed_at") < days_ago(as_of, days)))
    return _rank(q.select("id", "url"), ["id"], k)


def paginate(df: DataFrame, order: Sequence[Column | str], page: int | None, size: int = PAGE_SIZE) -> DataFrame:
    """page ``n`` ≥ 1 of ``size`` rows in ``order`` (``None`` → every row, unsorted)."""
    if page is None:
        return df
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def with_page_context(t, queue: DataFrame, suggestions: bool = False) -> DataFrame:
    """The rows of a ranked queue (id, ..) with what an annotator sees: the page's HTML content by type and, with
    ``suggestions``, the automatic agency suggestions (M9). Only the queue's rows of those tables are aggregated."""
    from urlsift.functions.html import html_content_wide
    from urlsift.operators.review import agency_auto_info

    ids = queue.select(F.col("id").alias("url_id"))
    wide = html_content_wide(t["url_html_content"].join(ids, "url_id", "left_semi")).withColumnRenamed("url_id", "id")
    out = queue.join(wide, "id", "left")
    if suggestions:
        own = {"automated_url_agency_suggestions": t["automated_url_agency_suggestions"].join(ids, "url_id", "left_semi"), "agencies": t["agencies"]}
        out = out.join(agency_auto_info(own).withColumnRenamed("url_id", "id"), "id", "left")
    return out


def urls_by_batch(t, batch_id: int | None = None, page: int | None = None) -> DataFrame:
    """URLs of a batch (or of every batch) with their batch id; optional page by URL id."""
    lb = t["link_batch_urls"]
    if batch_id is not None:
        lb = lb.where(F.col("batch_id") == batch_id)
    u = t["urls"]
    out = lb.join(u.withColumnRenamed("id", "url_id"), "url_id").select(
        "batch_id", F.col("url_id").alias("id"), "url", "outcome", "created_at")
    return paginate(out, ["id"], page)


def duplicates_by_batch(t, batch_id: int | None = None, page: int | None = None) -> DataFrame:
    """Duplicate rows with the original URL, the original's batch and the duplicate's batch
    (``batches`` joined twice under two roles)."""
    d = t["duplicates"]
    if batch_id is not None:
        d = d.where(F.col("batch_id") == batch_id)
    orig = t["urls"].select(F.col("id").alias("original_url_id"), F.col("url").alias("source_url"))
    orig_batch = t["link_batch_urls"].select(F.col("url_id").alias("original_url_id"),
                                             F.col("batch_id").alias("original_batch_id"))
    b = t["batches"]
    dup_b = b.select(F.col("id").alias("batch_id"), F.col("strategy").alias("duplicate_batch_strategy"))
    org_b = b.select(F.col("id").alias("original_batch_id"), F.col("strategy").alias("original_batch_strategy"))
    out = (d.join(orig, "original_url_id").join(orig_batch, "original_url_id").join(dup_b, "batch_id")
           .join(org_b, "original_batch_id")
           .select(F.col("batch_id").alias("duplicate_batch_id"), "original_url_id", "source_url",
                   "original_batch_id", "duplicate_batch_strategy", "original_batch_strategy"))
    return paginate(out, ["original_url_id", "duplicate_batch_id"], page)


def urls_with_errors(t) -> DataFrame:
    """C11: URLs in error state joined to their error rows."""
    u = t["urls"].where(F.col("outcome") == "error").select(F.col("id").alias("url_id"), "url")
    return u.join(t["url_error_info"], "url_id").select("url_id", "url", "task_id", "error")


def agency_suggestions(t, url_id: int | None = None) -> DataFrame:
    """Automatic agency suggestions left-joined to the agency; type Unknown when ``is_unknown``."""
    s = t["automated_url_agency_suggestions"]
    if url_id is not None:
        s = s.where(F.col("url_id") == url_id)
    a = t["agencies"].select("agency_id", F.col("name").alias("agency_name"), "state", "county", "locality")
    return skew_left_join(s, a, "agency_id").select(
        "url_id", "agency_id",
        F.when(F.col("is_unknown"), F.lit("Unknown")).otherwise(F.lit("Auto Suggestion")).alias("suggestion_type"),
        "agency_name", "state", "county", "locality")


def urls_confirmed(t) -> DataFrame:
    """URLs having any confirmed agency."""
    return user_suggestion_exists(t["urls"], t["confirmed_url_agency"])


def tasks_with_counts(t, task_type=None, status=None, page: int | None = None) -> DataFrame:
    """C14: tasks with their URL count and error count (pre-aggregated per task, null -> 0); K1: paginated
    when a page is given."""
    urls_per = t["link_task_urls"].groupBy("task_id").agg(F.count(F.lit(1)).alias("url_count"))
    errs_per = t["url_error_info"].groupBy("task_id").agg(F.count(F.lit(1)).alias("url_error_count"))
    tk = tasks_filtered(t, task_type, status).withColumnRenamed("id", "task_id")
    out = tk.join(urls_per, "task_id", "left").join(errs_per, "task_id", "left").select(
        "task_id", "task_type", "task_status", "updated_at",
        F.coalesce("url_count", F.lit(0)).alias("url_count"),
        F.coalesce("url_error_count", F.lit(0)).alias("url_error_count"))
    return paginate(out, ["task_id"], page)


def task_detail(t, task_id: int | None = None) -> DataFrame:
    """Task attributes with each linked URL and that URL's error for the task (long form: one row per
    (task, URL) — the nested view is a ``groupBy(task)`` of this, left to the reader so no task's URL list is
    ever collected into one row)."""
    tk = t["tasks"].withColumnRenamed("id", "task_id")
    links = t["link_task_urls"]
    if task_id is not None:
        tk, links = tk.where(F.col("task_id") == task_id), links.where(F.col("task_id") == task_id)
    u = t["urls"].select(F.col("id").alias("url_id"), "url", "outcome")
    err = t["url_error_info"].select("task_id", "url_id", "error")
    linked = links.join(u, "url_id").join(err, ["task_id", "url_id"], "left")  # a task without URLs keeps one row
    return (tk.join(linked, "task_id", "left")
            .select("task_id", "task_type", "task_status", "updated_at", "url_id", "url", "outcome", "error"))


def urls_listing(t, page: int | None = None, errors_only: bool = False) -> DataFrame:
    """URLs with their batch id and their error messages (sorted array; one row per URL)."""
    u = urls_with_error_rows(t) if errors_only else t["urls"]
    errs = t["url_error_info"].groupBy("url_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    lb = t["link_batch_urls"].withColumnRenamed("url_id", "id")
    out = (u.select("id", "url", "outcome", "created_at").join(lb, "id", "left")
           .join(errs.withColumnRenamed("url_id", "id"), "id", "left")
           .withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))))
    return paginate(out, ["id"], page)


def submission_records(t) -> DataFrame:
    """C17: validated URLs with their confirmed agency ids (sorted), optional metadata and reviewer."""
    v = t["urls"].where(F.col("outcome") == "validated")
    ag = t["confirmed_url_agency"].groupBy("url_id").agg(F.array_sort(F.collect_list("agency_id")).alias("agency_ids"))
    out = v.select(F.col("id").alias("url_id"), "url", _opt(v, "name"), _opt(v, "description"),
                   _opt(v, "record_type")).join(ag, "url_id", "left")
    try:
        meta = t["url_optional_data_source_metadata"]
        out = out.join(meta.select("url_id", "record_formats", "data_portal_type", "supplying_entity"), "url_id", "left")
    except (KeyError, AttributeError):
        pass
    return out.withColumn("agency_ids", F.coalesce("agency_ids", F.array().cast("array<long>")))


def batch_logs(t, batch_id: int | None = None) -> DataFrame:
    """C20: logs of a batch (or all), ordered by time when read."""
    lg = t["logs"]
    if batch_id is not None:
        lg = lg.where(F.col("batch_id") == batch_id)
    return lg.select("batch_id", "id", "log", "created_at")


def html_rows_for_url(t, url_id: int | None = None) -> DataFrame:
    """HTML content rows of one URL (or all)."""
    h = t["url_html_content"]
    return h if url_id is None else h.where(F.col("url_id") == url_id)


# ---- F: ranked "next" queues ---------------------------------------------------------------------------------
def _in_batch(t, q: DataFrame, batch_id) -> DataFrame:
    if batch_id is None:
        return q
    lb = t["link_batch_urls"].where(F.col("batch_id") == batch_id).select(F.col("url_id").alias("id"))
    return q.join(lb, "id", "left_semi")


def _marked_not_relevant(t, user_id=None) -> DataFrame:
    s = t["user_relevant_suggestions"].where(F.col("suggested_status") != "relevant")
    if user_id is not None:
        s = s.where(F.col("user_id") == user_id)
    return s


def next_for_relevance(t, batch_id=None, k: int | None = 1) -> DataFrame:
    """pending URLs without a user relevance annotation, with the automatic suggestion (if any), by id."""
    q = user_suggestion_not_exists(_in_batch(t, _pending_urls(t), batch_id), t["user_relevant_suggestions"])
    auto = t["auto_relevant_suggestions"].select(F.col("url_id").alias("id"), F.col("relevant").alias("auto_relevant"),
                                                 F.col("confidence").alias("auto_confidence"),
                                                 F.col("model_name").alias("auto_model_name"))
    return _rank(q.select("id", "url").join(auto, "id", "left"), ["id"], k)


def next_for_record_type(t, batch_id=None, k: int | None = 1) -> DataFrame:
    """as F2 for record type, also excluding URLs any user marked as not relevant."""
    q = user_suggestion_not_exists(_in_batch(t, _pending_urls(t), batch_id), t["user_record_type_suggestions"])
    q = user_suggestion_not_exists(q, _marked_not_relevant(t))
    auto = t["auto_record_type_suggestions"].select(F.col("url_id").alias("id"),
                                                    F.col("record_type").alias("auto_record_type"))
    return _rank(q.select("id", "url").join(auto, "id", "left"), ["id"], k)


def next_for_agency(t, user_id=None, batch_id=None, k: int | None = 1) -> DataFrame:
    """pending, no user agency annotation, has an automatic suggestion, no confirmed agency, and not marked
    not-relevant by this user (any user when ``user_id`` is None)."""
    q = _in_batch(t, _pending_urls(t), batch_id)
    q = user_suggestion_not_exists(q, t["user_url_agency_suggestions"])
    q = user_suggestion_exists(q, t["automated_url_agency_suggestions"])
    q = user_suggestion_not_exists(q, t["confirmed_url_agency"])
    q = user_suggestion_not_exists(q, _marked_not_relevant(t, user_id))
    return _rank(q.select("id", "url"), ["id"], k)


def next_for_all(t, batch_id=None, k: int | None = 1) -> DataFrame:
    """pending URLs with none of the three user annotations, smallest id first."""
    q = _in_batch(t, _pending_urls(t), batch_id)
    for m in ("user_url_agency_suggestions", "user_record_type_suggestions", "user_relevant_suggestions"):
        q = user_suggestion_not_exists(q, t[m])
    return _rank(q.select("id", "url"), ["id"], k)


def review_queue(t, batch_id=None, k: int | None = None) -> DataFrame:
    """pending URLs having all three user annotations, ranked by annotation count desc then id (K8: the
    count is always 3, so the order is by id)."""
    from urlsift.operators.metrics import USER_MODELS, url_flags

    base = _in_batch(t, _pending_urls(t), batch_id).select(F.col("id").alias("url_id"), "url")
    f = url_flags(t, base, USER_MODELS, carry=["url"])
    n = sum((F.col(c) for c, _ in USER_MODELS), F.lit(0))
    q = f.where(n == 3).select(F.col("url_id").alias("id"), "url", n.alias("total_distinct_annotation_count"))
    return _rank(q, [F.col("total_distinct_annotation_count").desc(), "id"], k)
