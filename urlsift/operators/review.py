"""Annotation, review and merge semantics (inventory M1-M12).

Parquet tables reject MERGE/UPDATE, so state is an immutable snapshot: every operator returns the *new*
DataFrame(s) of the tables it changes; :mod:`urlsift.operators.cycle` writes them to versioned paths. Merges are an anti join on the key plus a union — one shuffle of the key
columns, no full outer join — and "last decision wins" is a partial ``max_by``/``max(struct)`` aggregation.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.functions.scalars import PLACEHOLDER_AGENCY_NAME

TABLE_KEYS = {
    "urls": ["id"], "agencies": ["agency_id"], "url_probed_for_404": ["url_id"],
    "user_relevant_suggestions": ["url_id", "user_id"], "user_record_type_suggestions": ["url_id", "user_id"],
    "user_url_agency_suggestions": ["url_id", "user_id"],
    "auto_relevant_suggestions": ["url_id"], "auto_record_type_suggestions": ["url_id"],
    "url_optional_data_source_metadata": ["url_id"], "reviewing_user_url": ["url_id"],
    "confirmed_url_agency": ["url_id", "agency_id"],
}


def _align(df: DataFrame, like: DataFrame) -> DataFrame:
    cols = []
    for f in like.schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif df.schema[f.name].dataType.simpleString() == f.dataType.simpleString():
            cols.append(F.col(f.name))  # same type up to nullability: union widens it
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def last_by(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keep the row with the highest ``seq`` per key (partial aggregation; no window sort of a hot key)."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], as_of=None) -> DataFrame:
    """M1: insert new keys, overwrite every non-key column of existing keys; ``updated_at`` is stamped with
    ``as_of`` on changed rows when the table has that column (Q6). ``changes`` must be unique per key."""
    ch = changes
    if as_of is not None and "updated_at" in current.columns:
        ch = ch.withColumn("updated_at", F.lit(as_of).cast(current.schema["updated_at"].dataType))
    kept = current.join(ch.select(*keys), list(keys), "left_anti")
    return kept.unionByName(_align(ch, current))


def overlay(current: DataFrame, changes: DataFrame, key_current: str, key_changes: str, as_of=None) -> DataFrame:
    """H15 over tables: for the columns present in ``changes``, a non-null new value replaces the old one."""
    cols = [c for c in changes.columns if c != key_changes and c in current.columns]
    ch = changes.select(F.col(key_changes).alias(key_current), *[F.col(c).alias(f"_new_{c}") for c in cols],
                        F.lit(True).alias("_hit"))
    j = current.join(ch, key_current, "left")
    out = j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                     for c in current.columns], "_hit")
    if as_of is not None and "updated_at" in current.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(as_of).cast(current.schema["updated_at"].dataType))
                             .otherwise(F.col("updated_at")))
    return out.drop("_hit")


def folded(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Two sets of changes as one, for one :func:`overlay` instead of two: per key and column the later non-null value, else the earlier."""
    new = later.where(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"_new_{c}") for c in later.columns if c != key])
    value = {c: F.col(c) for c in earlier.columns if c != key}
    value |= {c: F.coalesce(F.col(f"_new_{c}"), value[c]) if c in value else F.col(f"_new_{c}") for c in later.columns if c != key}
    return earlier.where(F.col(key).isNotNull()).join(new, key, "full").select(key, *[v.alias(c) for c, v in value.items()])


def set_status(urls: DataFrame, updates: DataFrame, as_of=None) -> DataFrame:
    """M2: bulk status transition by url id; when several updates name one URL, the later table position is
    not meaningful, so ``updates`` must be unique per url_id (callers pass one task's result)."""
    return overlay(urls, updates.select("url_id", "outcome"), "id", "url_id", as_of)


# ---- decisions -----------------------------------------------------------------------------------------------------
def last_values(decisions: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per key: of every field the last non-null value by ``seq``, as if the decisions overlaid one another in
    order. A partial aggregation: a key with many decisions is reduced where they lie. Ties in ``seq``: the greatest value."""
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("_s"), F.col(c).alias("_v"))))["_v"].alias(c) for c in fields]
    return decisions.groupBy(*keys).agg(*last)


def _in_order(decisions: DataFrame, seq: str = "seq") -> DataFrame:
    return decisions if seq in decisions.columns else decisions.withColumn(seq, F.lit(0))


def _reviewed(t, decisions: DataFrame, as_of) -> DataFrame:
    """The reviewers table with the last reviewer of every decided URL (one row per URL)."""
    last = last_values(decisions, ["url_id"], ["user_id"])
    return upsert(t["reviewing_user_url"], last, ["url_id"], as_of)


# ---- M3-M6 annotations --------------------------------------------------------------------------------------------
def apply_relevance_annotations(t, decisions: DataFrame) -> DataFrame:
    """M3: per (url, user) the latest decision (by ``seq``) updates the existing status or is inserted."""
    d = last_by(decisions.select("url_id", "user_id", "seq", "suggested_status"), ["url_id", "user_id"], "seq")
    return upsert(t["user_relevant_suggestions"], d, ["url_id", "user_id"])


def apply_record_type_annotations(t, decisions: DataFrame) -> DataFrame:
    """M4: as M3 for record types."""
    d = last_by(decisions.select("url_id", "user_id", "seq", "record_type"), ["url_id", "user_id"], "seq")
    return upsert(t["user_record_type_suggestions"], d, ["url_id", "user_id"])


def apply_agency_annotations(t, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: user agency suggestions (url_id, user_id, agency_id, is_new, seq): the latest of a user for a URL replaces
    the user's earlier one. A new agency has no id; an id that is not known yet creates a placeholder agency.
    Returns (suggestions', agencies')."""
    d = _in_order(decisions).select("url_id", "user_id", "seq", F.coalesce("is_new", F.lit(False)).alias("is_new"), "agency_id")
    d = last_by(d.withColumn("agency_id", F.when(~F.col("is_new"), F.col("agency_id"))), ["url_id", "user_id"], "seq")
    sugg = upsert(t["user_url_agency_suggestions"], d, ["url_id", "user_id"])
    return sugg, _with_placeholders(t["agencies"], d)


def _with_placeholders(agencies: DataFrame, named: DataFrame) -> DataFrame:
    new = named.where(F.col("agency_id").isNotNull()).select("agency_id").distinct().join(agencies.select("agency_id"), "agency_id", "left_anti")
    return agencies.unionByName(_align(new.withColumn("name", F.lit(PLACEHOLDER_AGENCY_NAME)), agencies))


def apply_all_annotations(t, decisions: DataFrame) -> dict:
    """M6: relevance always; record type and agency (also a new one) only when the decision says relevant. Invalid
    payloads (B12) are returned under ``rejects``."""
    from urlsift.operators.queues import annotation_payload_valid

    checked = annotation_payload_valid(_in_order(decisions).withColumnRenamed("agency_id", "agency"))
    ok = checked.where(F.col("reason").isNull()).withColumnRenamed("agency", "agency_id")
    if "is_new" not in ok.columns:
        ok = ok.withColumn("is_new", F.lit(False))
    rel = ok.where(F.col("suggested_status") == "relevant")
    out = {"user_relevant_suggestions": apply_relevance_annotations(t, ok),
           "user_record_type_suggestions": apply_record_type_annotations(t, rel)}
    out["user_url_agency_suggestions"], out["agencies"] = apply_agency_annotations(t, rel)
    out["rejects"] = checked.where(F.col("reason").isNotNull())
    return out


# ---- M7 / M8 review decisions ---------------------------------------------------------------------------------------
# The messages of decisions that lack a required field.
NO_RECORD_TYPE = "Must specify record_type if it does not already exist"
NO_AGENCY = "Must specify agency_id if URL does not already have a confirmed agency"
NO_NAME = "Must specify name if it does not already exist"
NO_DESCRIPTION = "Must specify description if it does not already exist"

APPROVAL_FIELDS = {"record_type": "string", "name": "string", "description": "string", "agency_ids": "array<long>",
                   "record_formats": "array<string>", "data_portal_type": "string", "supplying_entity": "string"}


def apply_approvals(t, decisions: DataFrame, as_of=None) -> tuple[dict, DataFrame]:
    """M7: approve URLs. decisions: url_id, user_id, seq and any of ``APPROVAL_FIELDS``; several decisions for a URL act in
    the order of ``seq``, each laying its non-null fields over what is there.

    Record type, name and description are required when the URL has none, and an agency when it has no confirmed one.
    A decision without them is rejected and changes nothing; the first one that has them makes up for all later ones.
    Valid decisions set status 'validated', overlay the fields, replace confirmed agencies by the last agencies named (G5),
    add placeholder agencies, insert or overlay the optional metadata and record the last reviewer. ``urls`` must have the columns
    record_type, name and description. Returns (changed tables, rejects[url_id, reason])."""
    from urlsift.operators.sets import agency_set_diff

    u, dec = t["urls"], _in_order(decisions)
    for c, kind in APPROVAL_FIELDS.items():
        if c not in dec.columns:
            dec = dec.withColumn(c, F.lit(None).cast(kind))
    dec = dec.withColumn("agency_ids", F.when(F.size("agency_ids") > 0, F.col("agency_ids")))
    asked = dec.select("url_id").distinct()
    own = u.withColumnRenamed("id", "url_id").join(asked, "url_id", "left_semi").select(
        "url_id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("record_type", "name", "description")])
    agencies = t["confirmed_url_agency"].select("url_id").distinct().withColumn("has_agency_ids", F.lit(True))
    j = dec.join(own, "url_id", "left").join(agencies, "url_id", "left")
    lacks = lambda c: F.col(c).isNull() & ~F.coalesce(F.col(f"has_{c}"), F.lit(False))
    j = j.withColumn("reason", F.when(lacks("record_type"), NO_RECORD_TYPE).when(lacks("agency_ids"), NO_AGENCY)
                     .when(lacks("name"), NO_NAME).when(lacks("description"), NO_DESCRIPTION))
    first_valid = j.where("reason is null").groupBy("url_id").agg(F.min("seq").alias("_from"))
    j = j.join(first_valid, "url_id", "left")
    stands = F.coalesce(F.col("seq") >= F.col("_from"), F.lit(False))
    rejects = j.where(~stands).select("url_id", "reason")
    valid = j.where(stands)
    ok = last_values(valid, ["url_id"], list(APPROVAL_FIELDS))

    urls2 = overlay(u, ok.select("url_id", F.lit("validated").alias("outcome"), "record_type", "name", "description"), "id", "url_id", as_of)
    add, remove = agency_set_diff(t["confirmed_url_agency"], ok.select("url_id", F.explode("agency_ids").alias("agency_id")))
    confirmed2 = t["confirmed_url_agency"].join(remove, ["url_id", "agency_id"], "left_anti").unionByName(_align(add, t["confirmed_url_agency"]))
    meta_new = ok.select("url_id", "record_formats", "data_portal_type", "supplying_entity")
    meta = t["url_optional_data_source_metadata"]
    meta2 = overlay(meta, meta_new, "url_id", "url_id").unionByName(_align(meta_new.join(meta.select("url_id"), "url_id", "left_anti"), meta))
    out = {"urls": urls2, "confirmed_url_agency": confirmed2, "agencies": _with_placeholders(t["agencies"], add),
           "url_optional_data_source_metadata": meta2, "reviewing_user_url": _reviewed(t, valid, as_of)}
    return out, rejects


REJECTION_STATUS = {"individual record": "individual record", "broken page/404 not found": "404 not found",
                    "not relevant": "not relevant"}


def apply_rejections(t, decisions: DataFrame, as_of=None) -> tuple[dict, DataFrame]:
    """M8: decisions (url_id, user_id, reason, seq): the reason maps to the new status (individual record, 404 not found, not
    relevant) and the reviewer is recorded; of several valid decisions for a URL the last by ``seq`` holds. Unknown reasons go to ``rejects``."""
    m = F.create_map(*[F.lit(x) for kv in REJECTION_STATUS.items() for x in kv])
    d = _in_order(decisions).withColumn("outcome", F.element_at(m, F.col("reason")))
    ok = d.where(F.col("outcome").isNotNull())
    rejects = d.where(F.col("outcome").isNull()).select("url_id", F.concat(
        F.lit("Invalid rejection reason: "), F.coalesce("reason", F.lit("null"))).alias("reason"))
    out = {"urls": set_status(t["urls"], last_values(ok, ["url_id"], ["outcome"]), as_of), "reviewing_user_url": _reviewed(t, ok, as_of)}
    return out, rejects


# ---- M9-M11 review record -----------------------------------------------------------------------------------------
def agency_auto_info(t) -> DataFrame:
    """M9: per URL with automatic agency suggestions — ``unknown`` and the suggestion list: a single unknown
    suggestion -> unknown + [Unknown]; otherwise Auto suggestions with agency fields (sorted by agency id).
    URLs without suggestions are absent (the reader's default is unknown=true, [])."""
    from urlsift.operators.sizing import skew_left_join

    s = skew_left_join(t["automated_url_agency_suggestions"],
                       t["agencies"].select("agency_id", F.col("name").alias("agency_name"), "state", "county", "locality"), "agency_id")
    per = s.groupBy("url_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("is_unknown").cast("int")).alias("_u"),
        F.array_sort(F.collect_list(F.struct("agency_id", "agency_name", "state", "county", "locality"))).alias("_l"))
    single_unknown = (F.col("_n") == 1) & (F.col("_u") == 1)
    auto = F.transform("_l", lambda x: F.struct(F.lit("Auto Suggestion").alias("suggestion_type"),
                                                x["agency_id"].alias("agency_id"), x["agency_name"].alias("agency_name"),
                                                x["state"].alias("state"), x["county"].alias("county"),
                                                x["locality"].alias("locality")))
    unknown_list = F.array(F.struct(F.lit("Unknown").alias("suggestion_type"), F.lit(None).cast("long").alias("agency_id"),
                                    *[F.lit(None).cast("string").alias(c) for c in
                                      ("agency_name", "state", "county", "locality")]))
    return per.select("url_id", single_unknown.alias("unknown"),
                      F.when(single_unknown, unknown_list).otherwise(auto).alias("suggestions"))


def agency_user_info(t) -> DataFrame:
    """Per URL, the user agency suggestion as (suggestion_type New Agency / User Suggestion + agency
    fields); with several annotators the smallest user id's suggestion is shown."""
    s = t["user_url_agency_suggestions"]
    first = s.groupBy("url_id").agg(F.min(F.struct("user_id", "agency_id", "is_new")).alias("_f")).select(
        "url_id", F.col("_f.agency_id").alias("agency_id"), F.col("_f.is_new").alias("is_new"))
    a = t["agencies"].select("agency_id", F.col("name").alias("agency_name"), "state", "county", "locality")
    j = first.join(a, "agency_id", "left")
    new = F.coalesce("is_new", F.lit(False))
    return j.select("url_id", F.when(new, "New Agency").otherwise("User Suggestion").alias("suggestion_type"),
                    *[F.when(~new, F.col(c)).alias(c) for c in ("agency_id", "agency_name", "state", "county",
                                                                 "locality")])


def review_record(t, batch_id=None, k: int | None = None) -> DataFrame:
    """The nested review record of every URL in the review queue (F6): html (wide), automatic and user
    relevance / record type / agency, confirmed agencies, optional metadata, batch info. Each side is
    pre-aggregated to one row per URL before the joins, so nothing fans out."""
    from urlsift.functions.html import html_content_wide
    from urlsift.operators.queues import review_queue

    q = review_queue(t, batch_id, k).select(F.col("id").alias("url_id"), "url")
    html = html_content_wide(t["url_html_content"])
    rel_user = t["user_relevant_suggestions"].groupBy("url_id").agg(
        F.count_if(F.col("suggested_status") == "relevant").alias("relevant_votes"),
        F.count_if(F.col("suggested_status") != "relevant").alias("not_relevant_votes"))
    rt_user = t["user_record_type_suggestions"].groupBy("url_id", "record_type").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("url_id").agg(F.max(F.struct("n", "record_type")).alias("_m")) \
        .select("url_id", F.col("_m.record_type").alias("user_record_type"))
    auto_rel = t["auto_relevant_suggestions"].select("url_id", F.col("relevant").alias("auto_relevant"))
    auto_rt = t["auto_record_type_suggestions"].select("url_id", F.col("record_type").alias("auto_record_type"))
    conf = t["confirmed_url_agency"].groupBy("url_id").agg(
        F.array_sort(F.collect_list("agency_id")).alias("confirmed_agency_ids"))
    auto_ag = agency_auto_info(t).select("url_id", F.struct("unknown", "suggestions").alias("agency_auto"))
    user_ag = agency_user_info(t).select("url_id", F.struct("suggestion_type", "agency_id", "agency_name",
                                                            "state", "county", "locality").alias("agency_user"))
    meta = t["url_optional_data_source_metadata"]
    lb = t["link_batch_urls"].select("url_id", "batch_id")
    out = q
    for side in (lb, html, rel_user, rt_user, auto_rel, auto_rt, conf, auto_ag, user_ag, meta):
        out = out.join(side, "url_id", "left")
    return out


def expire_logs(t, as_of, days: int = 7) -> DataFrame:
    """The logs that remain after deleting those older than ``days`` before ``as_of``."""
    from urlsift.functions.scalars import days_ago

    return t["logs"].where(F.col("created_at") >= days_ago(as_of, days))
