"""Registered annotation / review / merge / quality queries (M, Q) and their DuckDB oracles.

Decisions (annotations, approvals, rejections) are derived from the given tables, so each merge runs over the
whole catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsift.operators import quality as qc
from urlsift.operators import review as rv
from urlsift.plans.catalog import AS_OF
from urlsift.plans.oracle import with_views
from urlsift.sources.fixtures import load_model


def _relevance_decisions(t):
    c = t["collected"].where(F.col("l_quantity").cast("int") % 7 == 0)
    o = t.base("orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("user_id"))
    st = F.when(F.col("l_quantity").cast("int") % 2 == 0, "relevant").otherwise("not relevant")
    return c.join(o, "batch_id").select("url_id", "user_id", F.struct("batch_id", "l_linenumber").alias("seq"),
                                        st.alias("suggested_status"))


def _rejections(t):
    """Two rounds: every ninth pending URL, then every 18th again with the next reason."""
    u = t["urls"].where((F.col("outcome") == "pending") & (F.col("id") % 9 == 0))
    rounds = []
    for seq, part in ((1, u), (2, u.where(F.col("id") % 18 == 0))):
        m = (F.col("id") + F.lit(seq - 1)) % 4
        reason = (F.when(m == 0, "not relevant").when(m == 1, "broken page/404 not found")
                  .when(m == 2, "individual record").otherwise("spam"))
        rounds.append(part.select(F.col("id").alias("url_id"), F.lit(seq).cast("long").alias("user_id"), F.lit(seq).alias("seq"), reason.alias("reason")))
    return rounds[0].unionByName(rounds[1])


def _approvals(t):
    """Two rounds: every eleventh pending URL, then every 33rd again with other fields."""
    u = t["urls"].where((F.col("outcome") == "pending") & (F.col("id") % 11 == 0))
    i = F.col("id")
    first = u.select(i.alias("url_id"), F.lit(7).cast("long").alias("user_id"), F.lit(1).alias("seq"),
                     F.when(i % 2 == 0, F.lit("Stops")).alias("record_type"),
                     F.when(i % 3 != 0, F.array((i / 10000000).cast("long"))).alias("agency_ids"),
                     F.when(i % 5 != 0, F.concat(F.lit("Name "), i.cast("string"))).alias("name"),
                     F.concat(F.lit("Desc "), i.cast("string")).alias("description"),
                     F.when(i % 7 == 0, F.array(F.lit("PDF"))).alias("record_formats"))
    second = u.where(i % 33 == 0).select(
        i.alias("url_id"), F.lit(8).cast("long").alias("user_id"), F.lit(2).alias("seq"),
        F.when(i % 2 == 1, F.lit("Other")).alias("record_type"),
        F.when(i % 5 != 1, F.array((i / 10000000).cast("long"), F.lit(9000000) + i % 10)).alias("agency_ids"),
        F.when(i % 4 == 0, F.lit("Second name")).alias("name"), F.lit(None).cast("string").alias("description"),
        F.array(F.lit("CSV")).alias("record_formats"))
    return first.unionByName(second)


def _reviewed_model(t):
    """The catalogue with the columns that reviews fill: URLs that are not pending have them, and some pending ones."""
    u = t["urls"]
    known = (F.col("outcome") != "pending") | (F.col("id") % 13 == 0)
    urls = u.select("*", F.when(known, F.lit("Other")).alias("record_type"), F.when(known, F.concat(F.lit("Known "), F.col("id").cast("string"))).alias("name"),
                    F.when(known, F.lit("known")).alias("description"))
    return {"urls": urls} | {n: t[n] for n in ("agencies", "confirmed_url_agency", "url_optional_data_source_metadata", "reviewing_user_url")}


def _approved(spark, d):
    t = load_model(spark, d)
    return rv.apply_approvals(_reviewed_model(t), _approvals(t))


def _rejected(spark, d):
    t = load_model(spark, d)
    return rv.apply_rejections(t, _rejections(t))


def _annotated(spark, d):
    """Whole annotations (M6) of two users' rounds: valid ones, ones with new agencies and unknown ids, and invalid payloads."""
    t = load_model(spark, d)
    c = t["collected"].where(F.col("l_quantity").cast("int") % 7 == 0)
    i = F.col("url_id")
    rows = c.groupBy("url_id", "l_linenumber").agg(F.max("batch_id").alias("seq")).select(
        "url_id", (F.col("l_linenumber") % 2).cast("long").alias("user_id"), F.struct("seq", "l_linenumber").alias("seq"),
        F.when(F.col("l_linenumber") == 3, "not relevant").otherwise("relevant").alias("suggested_status"),
        F.when(i % 5 != 0, F.lit("Stops")).alias("record_type"), (i % 3 == 0).alias("is_new"),
        F.when(i % 3 == 1, (i / 10000000).cast("long")).when((i % 3 == 2) & (i % 2 == 0), F.lit(8000000) + i % 10).alias("agency_id"))
    state = {n: t[n] for n in ("user_relevant_suggestions", "user_record_type_suggestions", "user_url_agency_suggestions", "agencies")}
    return rv.apply_all_annotations(state, rows)


def _auto_info_flat(spark, d):
    a = rv.agency_auto_info(load_model(spark, d))
    return a.select("url_id", "unknown",
                    F.array_sort(F.transform("suggestions", lambda x: x["suggestion_type"])).alias("suggestion_types"),
                    F.array_sort(F.transform("suggestions", lambda x: x["agency_id"])).alias("agency_ids"))


QUERIES = {
    "apply_relevance_annotations": lambda spark, d: rv.apply_relevance_annotations(
        load_model(spark, d), _relevance_decisions(load_model(spark, d))),
    "apply_rejections_urls": lambda spark, d: _rejected(spark, d)[0]["urls"].select("id", "outcome"),
    "apply_rejections_reviewers": lambda spark, d: _rejected(spark, d)[0]["reviewing_user_url"],
    "apply_rejections_rejects": lambda spark, d: _rejected(spark, d)[1],
    "apply_approvals_rejects": lambda spark, d: _approved(spark, d)[1],
    "apply_approvals_confirmed": lambda spark, d: _approved(spark, d)[0]["confirmed_url_agency"],
    "apply_approvals_status": lambda spark, d: _approved(spark, d)[0]["urls"].groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
    "apply_approvals_urls": lambda spark, d: _approved(spark, d)[0]["urls"].select("id", "outcome", "record_type", "name", "description"),
    "apply_approvals_agencies": lambda spark, d: _approved(spark, d)[0]["agencies"],
    "apply_approvals_metadata": lambda spark, d: _approved(spark, d)[0]["url_optional_data_source_metadata"],
    "apply_approvals_reviewers": lambda spark, d: _approved(spark, d)[0]["reviewing_user_url"],
    "apply_all_annotations_relevance": lambda spark, d: _annotated(spark, d)["user_relevant_suggestions"],
    "apply_all_annotations_record_types": lambda spark, d: _annotated(spark, d)["user_record_type_suggestions"],
    "apply_all_annotations_agency": lambda spark, d: _annotated(spark, d)["user_url_agency_suggestions"],
    "apply_all_annotations_agencies": lambda spark, d: _annotated(spark, d)["agencies"],
    "apply_all_annotations_rejects": lambda spark, d: _annotated(spark, d)["rejects"].select("url_id", "user_id", "reason"),
    "agency_auto_info": _auto_info_flat,
    "agency_user_info": lambda spark, d: rv.agency_user_info(load_model(spark, d)),
    "review_record": lambda spark, d: rv.review_record(load_model(spark, d)),
    "expire_logs": lambda spark, d: rv.expire_logs(load_model(spark, d), AS_OF),
    "check_model": lambda spark, d: qc.check_model(load_model(spark, d)),
    "check_fk_duplicates": lambda spark, d: qc.check_fk(
        load_model(spark, d)["duplicates"], "duplicates", "batch_id", load_model(spark, d)["batches"], "id"),
    "check_enum_tasks": lambda spark, d: qc.check_enum(
        load_model(spark, d)["tasks"], "tasks", "task_type", ["HTML", "Relevancy", "Record Type"]),
    "check_unique_user_agency": lambda spark, d: qc.check_unique(
        load_model(spark, d)["user_url_agency_suggestions"], "user_url_agency_suggestions", ["url_id"]),
}

_APPROVALS = """ap AS (SELECT id AS url_id, 1 AS seq, 7 AS user_id, CASE WHEN id % 2 = 0 THEN 'Stops' END AS record_type,
 CASE WHEN id % 3 <> 0 THEN [id // 10000000] END AS agency_ids, CASE WHEN id % 5 <> 0 THEN CONCAT('Name ', CAST(id AS VARCHAR)) END AS name,
 CONCAT('Desc ', CAST(id AS VARCHAR)) AS description, CASE WHEN id % 7 = 0 THEN ['PDF'] END AS record_formats,
 id % 13 = 0 AS known FROM urls WHERE outcome='pending' AND id % 11 = 0
 UNION ALL SELECT id, 2, 8, CASE WHEN id % 2 = 1 THEN 'Other' END, CASE WHEN id % 5 <> 1 THEN [id // 10000000, 9000000 + id % 10] END,
 CASE WHEN id % 4 = 0 THEN 'Second name' END, NULL, ['CSV'], id % 13 = 0 FROM urls WHERE outcome='pending' AND id % 33 = 0),
 aq AS (SELECT *, CASE WHEN record_type IS NULL AND NOT known THEN 'Must specify record_type if it does not already exist'
  WHEN agency_ids IS NULL AND NOT EXISTS (SELECT 1 FROM confirmed_url_agency c WHERE c.url_id=ap.url_id)
   THEN 'Must specify agency_id if URL does not already have a confirmed agency'
  WHEN name IS NULL AND NOT known THEN 'Must specify name if it does not already exist'
  WHEN description IS NULL AND NOT known THEN 'Must specify description if it does not already exist' END AS reason FROM ap),
 ar AS (SELECT aq.*, COALESCE(aq.seq >= (SELECT MIN(v.seq) FROM aq v WHERE v.url_id=aq.url_id AND v.reason IS NULL), FALSE) AS stands FROM aq),
 av AS (SELECT url_id, arg_max(record_type, seq) FILTER (WHERE record_type IS NOT NULL) AS record_type,
  arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name, arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS description,
  arg_max(agency_ids, seq) FILTER (WHERE agency_ids IS NOT NULL) AS agency_ids,
  arg_max(record_formats, seq) FILTER (WHERE record_formats IS NOT NULL) AS record_formats, arg_max(user_id, seq) AS user_id
  FROM ar WHERE stands GROUP BY url_id)"""
_NEW_CONFIRMED = """SELECT c.url_id, c.agency_id FROM confirmed_url_agency c
 WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.agency_ids IS NOT NULL AND av.url_id=c.url_id)
UNION ALL SELECT url_id, unnest(agency_ids) AS agency_id FROM av WHERE agency_ids IS NOT NULL"""
_REJECTIONS = """rj AS (SELECT *, CASE m WHEN 0 THEN 'not relevant' WHEN 1 THEN '404 not found' WHEN 2 THEN 'individual record' END AS outcome_new FROM (
 SELECT id AS url_id, 1 AS seq, id % 4 AS m FROM urls WHERE outcome='pending' AND id % 9 = 0
 UNION ALL SELECT id, 2, (id + 1) % 4 FROM urls WHERE outcome='pending' AND id % 18 = 0) x),
 rl AS (SELECT url_id, arg_max(outcome_new, seq) AS outcome, MAX(seq) AS user_id FROM rj WHERE outcome_new IS NOT NULL GROUP BY url_id)"""
_ANNOTATIONS = """an AS (SELECT url_id, CAST(l_linenumber % 2 AS BIGINT) AS user_id, MAX(batch_id) * 10 + l_linenumber AS seq,
 CASE WHEN l_linenumber = 3 THEN 'not relevant' ELSE 'relevant' END AS suggested_status, CASE WHEN url_id % 5 <> 0 THEN 'Stops' END AS record_type,
 url_id % 3 = 0 AS is_new, CASE WHEN url_id % 3 = 1 THEN url_id // 10000000 WHEN url_id % 6 = 2 THEN 8000000 + url_id % 10 END AS agency_id
 FROM collected WHERE CAST(l_quantity AS INT) % 7 = 0 GROUP BY url_id, l_linenumber),
 ac AS (SELECT *, CASE WHEN suggested_status <> 'relevant' AND record_type IS NOT NULL THEN 'record_type must be None if suggested_status is not relevant'
  WHEN suggested_status <> 'relevant' AND (is_new OR agency_id IS NOT NULL) THEN 'agency must be None if suggested_status is not relevant'
  WHEN suggested_status = 'relevant' AND record_type IS NULL THEN 'record_type must be provided if suggested_status is relevant'
  WHEN suggested_status = 'relevant' AND NOT is_new AND agency_id IS NULL THEN 'agency must be provided if suggested_status is relevant' END AS reason FROM an),
 ok AS (SELECT url_id, user_id, arg_max(suggested_status, seq) AS suggested_status FROM ac WHERE reason IS NULL GROUP BY 1, 2),
 rel AS (SELECT url_id, user_id, ANY_VALUE(is_new) AS is_new, ANY_VALUE(agency_id) AS agency_id FROM ac
  WHERE reason IS NULL AND suggested_status='relevant' GROUP BY 1, 2)"""

ORACLES = {
    "apply_relevance_annotations": with_views(
        """SELECT url_id, user_id, suggested_status FROM user_relevant_suggestions s
 WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.url_id=s.url_id AND d.user_id=s.user_id)
UNION ALL SELECT url_id, user_id, suggested_status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url_id, user_id
 ORDER BY batch_id DESC, l_linenumber DESC, suggested_status DESC) AS rk FROM dec) x WHERE rk=1""",
        """dec AS (SELECT c.url_id, o.o_custkey AS user_id, c.batch_id, c.l_linenumber,
 CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'relevant' ELSE 'not relevant' END AS suggested_status
 FROM collected c JOIN orders o ON o.o_orderkey=c.batch_id WHERE CAST(l_quantity AS INT) % 7 = 0)"""),
    "apply_rejections_urls": with_views("SELECT u.id, COALESCE(rl.outcome, u.outcome) AS outcome FROM urls u LEFT JOIN rl ON rl.url_id=u.id", _REJECTIONS),
    "apply_rejections_reviewers": with_views(
        """SELECT * FROM reviewing_user_url r WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.url_id=r.url_id)
UNION ALL SELECT url_id, user_id, NULL AS created_at FROM rl""", _REJECTIONS),
    "apply_rejections_rejects": with_views("SELECT url_id, 'Invalid rejection reason: spam' AS reason FROM rj WHERE m = 3", _REJECTIONS),
    "apply_approvals_rejects": with_views("SELECT url_id, reason FROM ar WHERE NOT stands", _APPROVALS),
    "apply_approvals_confirmed": with_views(_NEW_CONFIRMED, _APPROVALS),
    "apply_approvals_status": with_views(
        """SELECT CASE WHEN av.url_id IS NOT NULL THEN 'validated' ELSE u.outcome END AS outcome, COUNT(*) AS n
 FROM urls u LEFT JOIN av ON av.url_id=u.id GROUP BY 1""", _APPROVALS),
    "apply_approvals_urls": with_views(
        """SELECT u.id, CASE WHEN av.url_id IS NOT NULL THEN 'validated' ELSE u.outcome END AS outcome,
 COALESCE(av.record_type, CASE WHEN u.outcome <> 'pending' OR u.id % 13 = 0 THEN 'Other' END) AS record_type,
 COALESCE(av.name, CASE WHEN u.outcome <> 'pending' OR u.id % 13 = 0 THEN CONCAT('Known ', CAST(u.id AS VARCHAR)) END) AS name,
 COALESCE(av.description, CASE WHEN u.outcome <> 'pending' OR u.id % 13 = 0 THEN 'known' END) AS description
 FROM urls u LEFT JOIN av ON av.url_id=u.id""", _APPROVALS),
    "apply_approvals_agencies": with_views(
        """SELECT * FROM agencies UNION ALL SELECT DISTINCT agency_id, 'PLACEHOLDER_AGENCY_NAME', NULL, NULL, NULL
 FROM (SELECT unnest(agency_ids) AS agency_id FROM av WHERE agency_ids IS NOT NULL) x WHERE agency_id NOT IN (SELECT agency_id FROM agencies)""", _APPROVALS),
    "apply_approvals_metadata": with_views(
        """SELECT m.url_id, COALESCE(av.record_formats, m.record_formats) AS record_formats, m.data_portal_type, m.supplying_entity
 FROM url_optional_data_source_metadata m LEFT JOIN av ON av.url_id=m.url_id
UNION ALL SELECT url_id, record_formats, NULL, NULL FROM av WHERE NOT EXISTS (SELECT 1 FROM url_optional_data_source_metadata m WHERE m.url_id=av.url_id)""", _APPROVALS),
    "apply_approvals_reviewers": with_views(
        """SELECT * FROM reviewing_user_url r WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.url_id=r.url_id)
UNION ALL SELECT url_id, user_id, NULL AS created_at FROM av""", _APPROVALS),
    "apply_all_annotations_relevance": with_views(
        """SELECT * FROM user_relevant_suggestions s WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.url_id=s.url_id AND ok.user_id=s.user_id)
UNION ALL SELECT url_id, user_id, suggested_status FROM ok""", _ANNOTATIONS),
    "apply_all_annotations_record_types": with_views(
        """SELECT * FROM user_record_type_suggestions s WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.url_id=s.url_id AND rel.user_id=s.user_id)
UNION ALL SELECT url_id, user_id, 'Stops' AS record_type FROM rel""", _ANNOTATIONS),
    "apply_all_annotations_agency": with_views(
        """SELECT * FROM user_url_agency_suggestions s WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.url_id=s.url_id AND rel.user_id=s.user_id)
UNION ALL SELECT url_id, user_id, CASE WHEN NOT is_new THEN agency_id END AS agency_id, is_new FROM rel""", _ANNOTATIONS),
    "apply_all_annotations_agencies": with_views(
        """SELECT * FROM agencies UNION ALL SELECT DISTINCT agency_id, 'PLACEHOLDER_AGENCY_NAME', NULL, NULL, NULL FROM rel
 WHERE agency_id IS NOT NULL AND agency_id NOT IN (SELECT agency_id FROM agencies)""", _ANNOTATIONS),
    "apply_all_annotations_rejects": with_views("SELECT url_id, user_id, reason FROM ac WHERE reason IS NOT NULL", _ANNOTATIONS),
    "agency_auto_info": with_views(
        """SELECT url_id, n=1 AND u=1 AS unknown,
 CASE WHEN n=1 AND u=1 THEN ['Unknown'] ELSE list_sort(tl) END AS suggestion_types,
 CASE WHEN n=1 AND u=1 THEN [CAST(NULL AS BIGINT)] ELSE list_sort(il) END AS agency_ids
FROM (SELECT url_id, COUNT(*) AS n, MAX(CAST(is_unknown AS INT)) AS u, list('Auto Suggestion') AS tl, list(agency_id) AS il
 FROM automated_url_agency_suggestions GROUP BY url_id) s"""),
    "agency_user_info": with_views(
        """SELECT f.url_id, CASE WHEN COALESCE(f.is_new, FALSE) THEN 'New Agency' ELSE 'User Suggestion' END AS suggestion_type,
 CASE WHEN NOT COALESCE(f.is_new, FALSE) THEN f.agency_id END AS agency_id,
 CASE WHEN NOT COALESCE(f.is_new, FALSE) THEN a.name END AS agency_name,
 CASE WHEN NOT COALESCE(f.is_new, FALSE) THEN a.state END AS state,
 CASE WHEN NOT COALESCE(f.is_new, FALSE) THEN a.county END AS county,
 CASE WHEN NOT COALESCE(f.is_new, FALSE) THEN a.locality END AS locality
FROM (SELECT url_id, arg_min(agency_id, user_id) AS agency_id, arg_min(is_new, user_id) AS is_new
 FROM user_url_agency_suggestions GROUP BY url_id) f LEFT JOIN agencies a ON a.agency_id=f.agency_id"""),
    "expire_logs": with_views(f"SELECT * FROM logs WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
    "check_fk_duplicates": with_views(
        """SELECT 'fk' AS rule, 'duplicates' AS "table", CAST(batch_id AS VARCHAR) AS key, 'batch_id without parent' AS detail
 FROM duplicates d WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE b.id=d.batch_id)"""),
    "check_enum_tasks": with_views(
        """SELECT 'enum' AS rule, 'tasks' AS "table", CAST(id AS VARCHAR) AS key, CONCAT('task_type=', task_type) AS detail
 FROM tasks WHERE task_type NOT IN ('HTML', 'Relevancy', 'Record Type')"""),
    "check_unique_user_agency": with_views(
        """SELECT 'unique' AS rule, 'user_url_agency_suggestions' AS "table", to_json(struct_pack(url_id:=url_id)) AS key,
 CONCAT('rows=', CAST(COUNT(*) AS VARCHAR)) AS detail FROM user_url_agency_suggestions GROUP BY url_id HAVING COUNT(*) > 1"""),
}
