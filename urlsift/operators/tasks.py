"""Enrichment tasks (inventory J1-J15, U2-U4).

The reference runs each task as a per-row loop with one remote call per URL, on slices of 100. Here a task is a
set operation: ``task(queue, answers, ..) -> Changes`` where the remote answers are a table joined on url_id,
and routing/splitting/status transitions are column expressions. One pass handles the whole queue; Spark
partitions it. Nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsift.functions.html import html_content_rows, parse_html
from urlsift.functions.scalars import RECORD_TYPES, as_enum, metadata_field
from urlsift.operators.sets import http_outcome

FOIA = ["muckrock_simple_search", "muckrock_county_search", "muckrock_all_search"]


@dataclass
class Changes:
    """What a task run changes: status updates (url_id, outcome), rows to append or upsert per table, errors
    (url_id, error)."""

    status_updates: DataFrame | None = None
    appends: dict[str, DataFrame] = field(default_factory=dict)
    upserts: dict[str, DataFrame] = field(default_factory=dict)
    errors: DataFrame | None = None


def _err(df: DataFrame, msg: Column) -> DataFrame:
    return df.select("url_id", msg.alias("error"))


# ---- J1 HTML ----------------------------------------------------------------------------------------------------
def html_task(queue: DataFrame, fetched: DataFrame) -> Changes:
    """Fetch answers (url_id, success, status, html, content_type, exception) for queued URLs (id, url):
    success -> parsed content rows + raw html; 404 -> status '404 not found'; anything else -> error row and
    status 'error'."""
    j = queue.select(F.col("id").alias("url_id"), "url").join(fetched, "url_id")
    tagged = j.withColumn("_o", http_outcome())
    ok = tagged.where(F.col("_o") == "ok")
    rows = html_content_rows(parse_html(ok.select("url_id", "url", "html", "content_type")))
    nf = tagged.where(F.col("_o") == "404").select("url_id", F.lit("404 not found").alias("outcome"))
    bad = tagged.where(F.col("_o") == "error")
    errors = _err(bad, F.coalesce(F.col("exception"), F.concat(F.lit("HTTP status "),
                                                               F.coalesce(F.col("status").cast("string"), F.lit("none")))))
    updates = nf.unionByName(errors.select("url_id", F.lit("error").alias("outcome")))
    return Changes(status_updates=updates,
                   appends={"url_html_content": rows, "url_compressed_html": ok.select("url_id", "html")},
                   errors=errors)


# ---- J2 duplicates / J3 404 probes --------------------------------------------------------------------------------
def duplicate_task(queue: DataFrame, known_urls: DataFrame, as_of) -> Changes:
    """Queued URLs that the remote catalogue knows become 'duplicate'; every checked URL gets a
    checked-for-duplicate row. ``known_urls``: (url) or (url_id)."""
    q = queue.select(F.col("id").alias("url_id"), "url")
    key = "url" if "url" in known_urls.columns else "url_id"
    dup = q.join(known_urls.select(key).distinct(), key, "left_semi")
    checked = q.select("url_id", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
    return Changes(status_updates=dup.select("url_id", F.lit("duplicate").alias("outcome")),
                   appends={"url_checked_for_duplicate": checked})


def probe_404_task(queue: DataFrame, probes: DataFrame, as_of) -> Changes:
    """Probe answers (url_id, status); 404 -> '404 not found', null status ignored; every queued URL is
    stamped as probed at ``as_of`` (an upsert on url_id)."""
    q = queue.select(F.col("id").alias("url_id"))
    j = q.join(probes.select("url_id", "status"), "url_id", "left")
    nf = j.where(F.col("status") == 404).select("url_id", F.lit("404 not found").alias("outcome"))
    stamp = q.select("url_id", F.lit(as_of).cast("timestamp_ntz").alias("last_probed_at"))
    return Changes(status_updates=nf, upserts={"url_probed_for_404": stamp})


# ---- J4 / J5 classifiers (U3) -----------------------------------------------------------------------------------
def record_type_task(queue: DataFrame, labels: DataFrame) -> Changes:
    """A label inside the closed record-type set becomes an automatic suggestion; anything else is an
    error row. ``labels``: (url_id, label)."""
    j = queue.select(F.col("id").alias("url_id")).join(labels, "url_id")
    e = j.withColumn("_e", as_enum(F.col("label"), RECORD_TYPES))
    ok = e.where(F.col("_e.error").isNull()).select("url_id", F.col("_e.value").alias("record_type"))
    bad = _err(e.where(F.col("_e.error").isNotNull()), F.col("_e.error"))
    return Changes(appends={"auto_record_type_suggestions": ok}, errors=bad,
                   status_updates=bad.select("url_id", F.lit("error").alias("outcome")))


def scorer_udf(scorer: Callable[[pd.Series], pd.DataFrame]):
    """Wrap ``scorer(html: pd.Series) -> DataFrame[relevant, confidence, error]`` as an Arrow-batched UDF."""
    schema = T.StructType([T.StructField("relevant", T.BooleanType()), T.StructField("confidence", T.DoubleType()),
                           T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(html: pd.Series) -> pd.DataFrame:
        return scorer(html)

    return run


def keyword_scorer(html: pd.Series) -> pd.DataFrame:
    """Deterministic stand-in for the hosted relevance model (tests and local runs): relevant when the page
    mentions a records keyword; confidence grows with the number of mentions; empty HTML is an error."""
    words = ("record", "report", "police", "data", "example")
    text = html.fillna("").str.lower()
    hits = sum(text.str.count(w) for w in words)
    return pd.DataFrame({"relevant": hits > 0, "confidence": (hits / (hits + 1.0)).round(6),
                         "error": text.map(lambda s: "empty html" if not s else None)})


def relevance_task(queue: DataFrame, scorer=keyword_scorer, model_name: str = "keyword-rule") -> Changes:
    """Score the queued pages' HTML (queue from C3: id, html) -> (url_id, relevant, confidence, model_name);
    failures -> error rows."""
    s = queue.select(F.col("id").alias("url_id"), scorer_udf(scorer)(F.col("html")).alias("_s"))
    ok = s.where(F.col("_s.error").isNull()).select("url_id", F.col("_s.relevant").alias("relevant"),
                                                   F.col("_s.confidence").alias("confidence"),
                                                   F.lit(model_name).alias("model_name"))
    bad = _err(s.where(F.col("_s.error").isNotNull()), F.col("_s.error"))
    return Changes(appends={"auto_relevant_suggestions": ok}, errors=bad)


# ---- J6-J9 agency identification ----------------------------------------------------------------------------------
def route_agency(queue: DataFrame) -> DataFrame:
    """J6 (U2): routing per collector strategy — FOIA strategies and CKAN look agencies up by name, search and
    crawl strategies are Unknown, everything else (example, manual, no batch) has no subtask → error."""
    s = F.col("strategy")
    route = (F.when(s.isin(FOIA) | (s == "ckan"), F.lit("match")).when(s.isin("auto_googler", "common_crawler"),
                                                                       F.lit("unknown")).otherwise(F.lit("error")))
    return queue.withColumn("route", route)


def agency_name_match(names: DataFrame, agencies: DataFrame) -> DataFrame:
    """J8 (the remote matcher, made local and exact): names (url_id, agency_name) -> (url_id, status, matches[]).
    Names are compared case- and whitespace-insensitively; one candidate -> exact, several -> partial, none ->
    none. (Agency names per normalized key are bounded by the agency dimension.)"""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a = agencies.select(norm(F.col("name")).alias("_k"), F.struct(
        F.col("agency_id").alias("id"), F.col("name").alias("submitted_name"), "state", "county",
        "locality").alias("m"))
    cand = a.groupBy("_k").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    j = names.withColumn("_k", norm(F.col("agency_name"))).join(cand, "_k", "left").drop("_k")
    n = F.coalesce(F.size("matches"), F.lit(0))
    n = F.when(F.col("matches").isNull(), F.lit(0)).otherwise(n)
    status = F.when(n == 1, "exact").when(n > 1, "partial").otherwise("none")
    return j.select("url_id", status.alias("status"),
                    F.coalesce("matches", F.array().cast(cand.schema["matches"].dataType)).alias("matches"))


def match_to_suggestions(matches: DataFrame) -> DataFrame:
    """Exact -> one Confirmed row (first match, no locality, K15); partial -> one Auto row per match;
    none -> one Unknown row; other statuses -> error rows (suggestion_type null, error set)."""
    st = F.col("status")
    first = F.get(F.col("matches"), 0)
    exact = matches.where(st == "exact").select(
        "url_id", F.lit("Confirmed").alias("suggestion_type"), first["id"].cast("long").alias("agency_id"),
        first["submitted_name"].alias("agency_name"), first["state"].alias("state"), first["county"].alias("county"),
        F.lit(None).cast("string").alias("locality"), F.lit(None).cast("string").alias("error"))
    part = matches.where(st == "partial").select("url_id", F.explode("matches").alias("m")).select(
        "url_id", F.lit("Auto Suggestion").alias("suggestion_type"), F.col("m.id").cast("long").alias("agency_id"),
        F.col("m.submitted_name").alias("agency_name"), F.col("m.state").alias("state"),
        F.col("m.county").alias("county"), F.col("m.locality").alias("locality"),
        F.lit(None).cast("string").alias("error"))
    none = matches.where(st == "none").select(
        "url_id", F.lit("Unknown").alias("suggestion_type"), F.lit(None).cast("long").alias("agency_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("agency_name", "state", "county", "locality", "error")])
    other = matches.where(~st.isin("exact", "partial", "none") | st.isNull()).select(
        "url_id", F.lit(None).cast("string").alias("suggestion_type"), F.lit(None).cast("long").alias("agency_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("agency_name", "state", "county", "locality")],
        F.concat(F.lit("Unknown Match Agency Response Status: "), F.coalesce(st, F.lit("null"))).alias("error"))
    return exact.unionByName(part).unionByName(none).unionByName(other)


def agency_task(queue: DataFrame, matches: DataFrame) -> Changes:
    """Route (J6); 'match' URLs take the matcher's answer (J7), 'unknown' URLs get an Unknown suggestion,
    'error' URLs an error row. Non-unknown suggestions upsert their agency; Confirmed -> confirmed links; the
    rest -> automatic suggestions with ``is_unknown``."""
    r = route_agency(queue.select(F.col("id").alias("url_id"), "strategy"))
    to_match = r.where(F.col("route") == "match").join(matches, "url_id")
    sugg = match_to_suggestions(to_match.select("url_id", "status", "matches"))
    unknown = match_to_suggestions(r.where(F.col("route") == "unknown").select(
        "url_id", F.lit("none").alias("status"), F.array().cast(matches.schema["matches"].dataType).alias("matches")))
    allsug = sugg.unionByName(unknown)
    routed_err = _err(r.where(F.col("route") == "error"),
                      F.concat(F.lit("No agency subtask for collector "), F.coalesce("strategy", F.lit("none"))))
    errors = routed_err.unionByName(_err(allsug.where(F.col("error").isNotNull()), F.col("error")))
    good = allsug.where(F.col("error").isNull())
    agencies = good.where(F.col("agency_id").isNotNull()).select(
        "agency_id", F.col("agency_name").alias("name"), "state", "county", "locality")
    confirmed = good.where(F.col("suggestion_type") == "Confirmed").select("url_id", "agency_id")
    auto = good.where(F.col("suggestion_type") != "Confirmed").select(
        "url_id", "agency_id", (F.col("suggestion_type") == "Unknown").alias("is_unknown"))
    return Changes(upserts={"agencies": agencies},
                   appends={"confirmed_url_agency": confirmed, "automated_url_agency_suggestions": auto},
                   errors=errors)


# ---- J10 misc metadata ------------------------------------------------------------------------------------------
def misc_metadata_task(queue: DataFrame, html_wide: DataFrame | None = None) -> Changes:
    """Per strategy, name/description (and for CKAN record formats, portal type, supplying entity) come
    from the collector metadata; null name/description fall back to the HTML title/description; a missing key
    is an error row; the metadata row is written for every URL (K16)."""
    q = queue.select(F.col("id").alias("url_id"), "strategy", "collector_metadata")
    if html_wide is not None:
        q = q.join(html_wide.select("url_id", F.col("title").alias("_ht"), F.col("description").alias("_hd")),
                   "url_id", "left")
    else:
        q = q.withColumn("_ht", F.lit(None).cast("string")).withColumn("_hd", F.lit(None).cast("string"))
    s, m = F.col("strategy"), F.col("collector_metadata")
    key_name = F.when(s.isin(FOIA) | (s == "auto_googler"), F.lit("title")).when(s == "ckan", F.lit("submitted_name"))
    key_desc = (F.when(s.isin(FOIA), F.lit("title")).when(s == "auto_googler", F.lit("snippet"))
                .when(s == "ckan", F.lit("description")))
    has = lambda k: F.array_contains(F.coalesce(F.json_object_keys(m), F.array().cast("array<string>")), k)  # noqa
    get = lambda k: F.get_json_object(m, f"$.{k}")
    missing = (F.when(key_name.isNotNull() & ~has(key_name), key_name)
               .when(key_desc.isNotNull() & ~has(key_desc), key_desc))
    ckan = s == "ckan"
    missing = missing.when(ckan & ~has(F.lit("record_format")), F.lit("record_format")) \
        .when(ckan & ~has(F.lit("data_portal_type")), F.lit("data_portal_type")) \
        .when(ckan & ~has(F.lit("supplying_entity")), F.lit("supplying_entity"))
    name = F.when(s.isin(FOIA) | (s == "auto_googler"), get("title")).when(ckan, get("submitted_name"))
    desc = (F.when(s.isin(FOIA), get("title")).when(s == "auto_googler", get("snippet"))
            .when(ckan, get("description")))
    out = q.select(
        "url_id",
        F.coalesce(name, F.col("_ht")).alias("name"),
        F.coalesce(desc, F.col("_hd")).alias("description"),
        F.when(ckan, F.from_json(get("record_format"), "array<string>")).alias("record_formats"),
        F.when(ckan, get("data_portal_type")).alias("data_portal_type"),
        F.when(ckan, get("supplying_entity")).alias("supplying_entity"),
        missing.alias("_missing"))
    errors = _err(out.where(F.col("_missing").isNotNull()), F.concat(F.lit("'"), F.col("_missing"), F.lit("'")))
    return Changes(upserts={"urls": out.select("url_id", "name", "description")},
                   appends={"url_optional_data_source_metadata": out.select(
                       "url_id", "record_formats", "data_portal_type", "supplying_entity")},
                   errors=errors)


# ---- J11 submission ---------------------------------------------------------------------------------------------
def submission_task(queue: DataFrame, receipts: DataFrame, as_of) -> Changes:
    """Receipts (url_id, data_source_id, request_error): a data source id -> 'submitted' +
    url_data_sources row; a request error -> error row."""
    j = queue.select(F.col("url_id") if "url_id" in queue.columns else F.col("id").alias("url_id")).join(
        receipts, "url_id")
    ok = j.where(F.col("data_source_id").isNotNull() & F.col("request_error").isNull())
    bad = _err(j.where(F.col("request_error").isNotNull()), F.col("request_error"))
    return Changes(status_updates=ok.select("url_id", F.lit("submitted").alias("outcome")),
                   appends={"url_data_sources": ok.select("url_id", "data_source_id",
                                                          F.lit(as_of).cast("timestamp_ntz").alias("created_at"))},
                   errors=bad)


# ---- J12 agency sync ------------------------------------------------------------------------------------------------
def agency_sync(agencies: DataFrame, pages: DataFrame, cursor_page: int | None = None,
                max_pages: int | None = None) -> DataFrame:
    """Apply pages of agency changes (page, agency_id, display_name, state_name, county_name,
    locality_name, updated_at) from ``cursor_page`` on, all of them unless the caller bounds a run to ``max_pages`` pages
    (:func:`sync_cursor` then names the page to go on with), last writer (highest page,
    then updated_at) wins per agency; returns the new agencies snapshot (see M1)."""
    from urlsift.operators.review import upsert

    start = cursor_page or 1
    p = pages.where(F.col("page") >= start)
    if max_pages is not None:
        p = p.where(F.col("page") < start + max_pages)
    latest = p.groupBy("agency_id").agg(F.max(F.struct("page", "updated_at", "display_name", "state_name",
                                                         "county_name", "locality_name")).alias("_l"))
    changes = latest.select("agency_id", F.col("_l.display_name").alias("name"), F.col("_l.state_name").alias("state"),
                            F.col("_l.county_name").alias("county"), F.col("_l.locality_name").alias("locality"))
    return upsert(agencies, changes, ["agency_id"])


def sync_cursor(pages: DataFrame, cursor_page: int | None, as_of, max_pages: int | None = None) -> DataFrame:
    """J12 cursor row after a run: next page to read, or — when an empty page was reached — full-sync stamp with
    cutoff = as_of − 1 day and page = null."""
    start = cursor_page or 1
    seen = pages.where(F.col("page") >= start).agg(F.max("page").alias("last"))
    # done when no page lies beyond the bound, so exactly ``max_pages`` pages end as a full sync
    done = F.lit(True) if max_pages is None else F.col("last").isNull() | (F.col("last") < start + max_pages)
    following = F.lit(None if max_pages is None else start + max_pages).cast("int")
    return seen.select(
        F.when(done, F.lit(as_of).cast("timestamp_ntz")).alias("last_full_sync_at"),
        F.when(done, F.to_date(F.lit(as_of)) - F.lit(1)).alias("current_cutoff_date"),
        F.when(done, F.lit(None).cast("int")).otherwise(following).alias("current_page"))


# ---- J13 / J14 audit and errors -------------------------------------------------------------------------------------
def link_task_urls(task_id: int, queue: DataFrame) -> DataFrame:
    """Audit rows (task_id, url_id) for every processed URL."""
    key = "url_id" if "url_id" in queue.columns else "id"
    return queue.select(F.lit(task_id).cast("long").alias("task_id"), F.col(key).alias("url_id")).distinct()


def record_errors(errors: DataFrame, task_id: int, as_of) -> tuple[DataFrame, DataFrame]:
    """(error rows to append, status updates to 'error')."""
    rows = errors.select("url_id", F.lit(task_id).cast("long").alias("task_id"), "error",
                         F.lit(as_of).cast("timestamp_ntz").alias("updated_at"))
    return rows, errors.select("url_id", F.lit("error").alias("outcome")).distinct()


# ---- U4 tasks (J15, the cycle, is in urlsift.operators.cycle) -----------------------------------------------------
@dataclass
class Task:
    """U4: a task = its queue (prerequisite: non-empty) + how to turn the queue into changes."""

    name: str
    queue: Callable[[dict], DataFrame]
    apply: Callable[[DataFrame, dict], Changes]
