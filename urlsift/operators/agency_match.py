"""Agency names to agencies (J8): looked up by id, then equal names, then shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.session import written

PARTIAL_PERCENT = 60


def foia_agency_names(records: DataFrame, foia_agencies: DataFrame) -> DataFrame:
    """J8, first step: ``url_id, agency_name, error`` for records (url_id, foia_agency_id) by the FOIA service's agencies
    (id, name). An id that is not there, or a record without one, is an error row."""
    known = foia_agencies.groupBy(F.col("id").alias("foia_agency_id")).agg(F.min("name").alias("agency_name"))
    j = records.select("url_id", "foia_agency_id").join(known, "foia_agency_id", "left")
    missing = F.concat(F.lit("FOIA agency not found: "), F.coalesce(F.col("foia_agency_id").cast("string"), F.lit("none")))
    return j.select("url_id", "agency_name", F.when(F.col("agency_name").isNull(), missing).alias("error"))


def _normal(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def _words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def partial_matches(names: DataFrame, agencies: DataFrame, percent: int = PARTIAL_PERCENT) -> DataFrame:
    """``url_id, agency_id`` where the distinct words of name and agency have a Jaccard similarity of ``percent`` or more.

    Words are ordered by how many agencies have them, rarest first; two sets that similar share a word among the first
    n - ceil(percent * n / 100) + 1 of each, so only those words are joined, and no word of every other agency
    name makes candidates. Different URLs with one name are matched once."""
    a = agencies.where("name is not null").select("agency_id", _words(F.col("name")).alias("words"))
    held = a.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = names.where("agency_name is not null").select("agency_name").distinct().withColumn("words", _words(F.col("agency_name")))

    def rare(df: DataFrame, key: str) -> DataFrame:
        ranked = df.select(key, "words", F.explode("words").alias("w")).join(held, "w", "left").groupBy(key).agg(
            F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))  # one name's words
        size = F.size("words")
        return ranked.select(key, "words", F.explode(F.slice(F.transform("o", lambda x: x["w"]), F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)).alias("w"))

    pairs = rare(n, "agency_name").join(rare(a, "agency_id").withColumnRenamed("words", "other"), "w").where(
        (100 * F.size("other") >= percent * F.size("words")) & (100 * F.size("words") >= percent * F.size("other")))
    shared = F.size(F.array_intersect("words", "other"))
    alike = pairs.where(100 * shared >= percent * (F.size("words") + F.size("other") - shared)).select("agency_name", "agency_id").distinct()
    return names.select("url_id", "agency_name").join(alike, "agency_name").select("url_id", "agency_id")


def match_agencies(names: DataFrame, agencies: DataFrame, percent: int = PARTIAL_PERCENT) -> DataFrame:
    """``url_id, status, agency_id`` (long form, a row per candidate): one agency of the same name (case and white
    space aside) is 'exact', several are 'partial', else agencies alike in words are 'partial', else 'none'; a name row with
    an ``error`` is 'error'."""
    names = names if "error" in names.columns else names.withColumn("error", F.lit(None).cast("string"))
    ok = names.where("error is null")
    keyed = agencies.select(_normal(F.col("name")).alias("k"), "agency_id")
    equal = written(ok.withColumn("k", _normal(F.col("agency_name"))).join(keyed, "k").select("url_id", "agency_id"), "equal-names")
    several = equal.groupBy("url_id").agg(F.count(F.lit(1)).alias("n"))
    found = equal.join(several, "url_id").select("url_id", F.when(F.col("n") == 1, "exact").otherwise("partial").alias("status"), "agency_id")
    rest = ok.join(several, "url_id", "left_anti")
    alike = written(partial_matches(rest, agencies, percent).select("url_id", F.lit("partial").alias("status"), "agency_id"), "alike-names")
    none = rest.join(alike.select("url_id").distinct(), "url_id", "left_anti").select("url_id", F.lit("none").alias("status"), F.lit(None).cast("long").alias("agency_id"))
    bad = names.where("error is not null").select("url_id", F.lit("error").alias("status"), F.lit(None).cast("long").alias("agency_id"))
    return found.unionByName(alike).unionByName(none).unionByName(bad)
