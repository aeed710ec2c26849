"""Collector payloads -> (url, collector_metadata) rows (inventory A2-A8), raw-HTML storage.

Each preprocessor is a ``DataFrame -> DataFrame`` function registered by collector strategy (U1), built from
``from_json``/``explode``/``to_json`` so the flattening runs JVM-side inside whole-stage codegen. Payloads are
read with an explicit schema (no inference pass over the input)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsift.functions.scalars import ckan_parse

SEARCH_PAYLOAD = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("query_results", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType())]))),
])
OUTPUT_COLUMNS = ["url", "collector_metadata"]


def intake_search_results(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """A2: search payload rows (JSON string or struct with ``query`` and ``query_results[]``) -> one row per
    result, metadata = {query, title, snippet}."""
    p = F.from_json(F.col(col), SEARCH_PAYLOAD) if isinstance(payloads.schema[col].dataType, T.StringType) else F.col(col)
    q = payloads.select(p.alias("_p")).select(F.col("_p.query").alias("query"),
                                              F.explode("_p.query_results").alias("_r"))
    return q.select(F.col("_r.url").alias("url"),
                    F.to_json(F.struct("query", F.col("_r.title").alias("title"),
                                       F.col("_r.snippet").alias("snippet")), _KEEP_NULLS).alias("collector_metadata"))


# a field without a value stays in the metadata as null
_KEEP_NULLS = {"ignoreNullFields": "false"}


def intake_ckan(packages: DataFrame) -> DataFrame:
    """A3: parsed catalogue packages (see :func:`ckan_parse`) -> source_url as url, other fields as metadata;
    the last-updated timestamp becomes ``yyyy-MM-dd``."""
    cols = [c for c in packages.columns if c != "source_url"]
    meta = F.struct(*[(F.date_format(F.col(c), "yyyy-MM-dd") if isinstance(packages.schema[c].dataType,
                                                                          (T.TimestampType, T.TimestampNTZType))
                       else F.col(c)).alias(c) for c in cols])
    return packages.select(F.col("source_url").alias("url"), F.to_json(meta, _KEEP_NULLS).alias("collector_metadata"))


def intake_foia(records: DataFrame, url_col: str = "url") -> DataFrame:
    """A4: FOIA records -> (url, whole record as metadata)."""
    return records.select(F.col(url_col).alias("url"),
                          F.to_json(F.struct(*[F.col(c) for c in records.columns]), _KEEP_NULLS).alias("collector_metadata"))


def intake_url_list(df: DataFrame, col: str = "urls") -> DataFrame:
    """A5: a bare URL list (array column or one URL per row) -> rows with null metadata."""
    dt = df.schema[col].dataType
    u = F.explode(F.col(col)) if isinstance(dt, T.ArrayType) else F.col(col)
    return df.select(u.alias("url")).select("url", F.lit(None).cast("string").alias("collector_metadata"))


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON crawl-index records -> url column (schema given, no inference)."""
    return spark.read.schema("url string").json(path).select("url")


def foia_records(pages: DataFrame, results_col: str = "results") -> DataFrame:
    """FOIA listing pages with ``results[]`` -> (absolute_url, record)."""
    r = pages.select(F.explode(F.col(results_col)).alias("record"))
    return r.select(F.col("record.absolute_url").alias("absolute_url"), "record")


def search_items(responses: DataFrame, items_col: str = "items") -> DataFrame:
    """Search API items -> (url = link, title, snippet defaulting to '')."""
    i = responses.select(F.explode(F.col(items_col)).alias("i"))
    return i.select(F.col("i.link").alias("url"), F.col("i.title").alias("title"),
                    F.coalesce(F.col("i.snippet"), F.lit("")).alias("snippet"))


def ckan_packages_to_rows(packages: DataFrame) -> DataFrame:
    """H13 applied to a package table: one parsed row per package."""
    return packages.select(ckan_parse(F.struct(*[F.col(c) for c in packages.columns])).alias("p")).select("p.*")


# Per-strategy preprocessor registry
PREPROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "auto_googler": intake_search_results,
    "ckan": lambda df: intake_ckan(ckan_packages_to_rows(df).drop("error")),
    "muckrock_simple_search": intake_foia,
    "muckrock_county_search": intake_foia,
    "muckrock_all_search": intake_foia,
    "common_crawler": intake_url_list,
    "example": intake_url_list,
}


def preprocess(strategy: str, payload: DataFrame) -> DataFrame:
    return PREPROCESSORS[strategy](payload)


# ---- A11: raw HTML storage -------------------------------------------------------------------------------------
def store_html(html: DataFrame, path: str, mode: str = "append") -> None:
    """Persist raw HTML (url_id, html) as zstd Parquet, hash-partitioned into files by url_id bucket so that a
    lookup reads one bucket directory."""
    (html.select("url_id", "html", (F.abs(F.xxhash64("url_id")) % 64).alias("bucket"))
     .repartition("bucket").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path))


def html_for_url(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Read stored HTML back for the wanted url ids: their buckets are listed (64 numbers at most) and no other bucket's
    folder is read."""
    wanted = ids.select("url_id").distinct()
    buckets = [r.bucket for r in wanted.select((F.abs(F.xxhash64("url_id")) % 64).cast("int").alias("bucket")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets)).join(wanted, "url_id", "left_semi").drop("bucket")
