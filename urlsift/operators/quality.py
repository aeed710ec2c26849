"""Data-quality rules — the database constraints of the reference as checks (inventory Q1-Q6).

Each check returns violation rows ``(rule, table, key, detail)``; an empty result means the rule holds. All are
single aggregations or anti joins over whole tables.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsift.functions.scalars import BATCH_STATUSES, COLLECTOR_STRATEGIES, SUGGESTED_STATUSES, URL_STATUSES
from urlsift.operators.loads import dealt

VIOLATION = "rule string, table string, key string, detail string"


def _v(df: DataFrame, rule: str, table: str, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key"),
                     detail.cast("string").alias("detail"))


def check_enum(df: DataFrame, table: str, column: str, allowed: Iterable[str], key: str = "id") -> DataFrame:
    """Q1: values outside the closed set (nulls are not violations here; see the column's nullability)."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))
    return _v(bad, "enum", table, F.col(key), F.concat(F.lit(f"{column}="), F.col(column)))


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Q2: key combinations that occur more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _v(dup, "unique", table, F.to_json(F.struct(*keys)), F.concat(F.lit("rows="), F.col("_n").cast("string")))


def check_fk(child: DataFrame, table: str, fk: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Q3: child rows whose foreign key has no parent (null keys are allowed)."""
    orphans = child.where(F.col(fk).isNotNull()).join(
        parent.select(F.col(parent_key).alias(fk)).distinct(), fk, "left_anti")
    return _v(orphans, "fk", table, F.col(fk), F.lit(f"{fk} without parent"))


def cascade_delete(child: DataFrame, fk: str, surviving_parents: DataFrame, parent_key: str) -> DataFrame:
    """Q3 (delete cascade): keep the child rows whose parent survives."""
    return child.join(surviving_parents.select(F.col(parent_key).alias(fk)), fk, "left_semi")


def check_unknown_agency(t) -> DataFrame:
    """Q4: an unknown automatic suggestion and a new-agency user suggestion carry no agency id."""
    a = t["automated_url_agency_suggestions"].where(F.col("is_unknown") & F.col("agency_id").isNotNull())
    u = t["user_url_agency_suggestions"].where(F.col("is_new") & F.col("agency_id").isNotNull())
    return _v(a, "unknown_agency", "automated_url_agency_suggestions", F.col("url_id"), F.lit("is_unknown with agency_id")) \
        .unionByName(_v(u, "unknown_agency", "user_url_agency_suggestions", F.col("url_id"), F.lit("is_new with agency_id")))


def check_validated_name(t) -> DataFrame:
    """Q5: validated URLs must have a name."""
    u = t["urls"]
    name = F.col("name") if "name" in u.columns else F.lit(None).cast("string")
    return _v(u.where((F.col("outcome") == "validated") & name.isNull()), "validated_name", "urls", F.col("id"),
              F.lit("validated without name"))


def touch_updated_at(df: DataFrame, changed, as_of) -> DataFrame:
    """Q6: stamp ``updated_at`` on the rows where ``changed`` holds."""
    return df.withColumn("updated_at", F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")))


def check_model(t) -> DataFrame:
    """All rules over the model tables at once."""
    checks = [
        check_enum(t["urls"], "urls", "outcome", URL_STATUSES),
        check_enum(t["batches"], "batches", "strategy", COLLECTOR_STRATEGIES),
        check_enum(t["batches"], "batches", "status", BATCH_STATUSES),
        check_enum(t["user_relevant_suggestions"], "user_relevant_suggestions", "suggested_status",
                   SUGGESTED_STATUSES, key="url_id"),
        check_unique(t["urls"], "urls", ["url"]),
        check_unique(t["link_batch_urls"], "link_batch_urls", ["url_id"]),
        check_unique(t["user_relevant_suggestions"], "user_relevant_suggestions", ["url_id", "user_id"]),
        check_unique(t["url_html_content"], "url_html_content", ["url_id", "content_type"]),
        # batches are a view of a given table, in files of any size
        check_fk(t["link_batch_urls"], "link_batch_urls", "batch_id", dealt(t["batches"].select("id")), "id"),
        check_fk(t["link_batch_urls"], "link_batch_urls", "url_id", t["urls"], "id"),
        check_fk(t["confirmed_url_agency"], "confirmed_url_agency", "agency_id", t["agencies"], "agency_id"),
        check_fk(t["user_url_agency_suggestions"], "user_url_agency_suggestions", "agency_id", t["agencies"], "agency_id"),
        check_fk(t["duplicates"], "duplicates", "original_url_id", t["urls"], "id"),
        check_unknown_agency(t),
        check_validated_name(t),
    ]
    return reduce(DataFrame.unionByName, checks)
