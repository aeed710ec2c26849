"""The catalogue model (A1) built from the driver's TPC-H-shaped parquet tables.

Every model table is a lazily built DataFrame over the base parquet files, so each query only scans the
columns and files it touches (Catalyst prunes columns and pushes filters into the parquet scan). The mapping
from base tables to model tables is the fixture definition in FIXTURES.md §3; the same definitions, as SQL
text, feed the DuckDB oracle in :mod:`urlsift.plans.oracle`.

Scale notes
- ``urls``/``link_batch_urls`` come from :func:`first_rows` (a partial aggregation keyed by url, over rows dealt by
  content) rather than a ``row_number`` window, so a URL collected a billion times is reduced in many tasks first.
- Tables that are row-by-row views of others (:func:`view_property`) are not stored, only what is aggregated or joined.
- The ``user_*`` suggestion tables join ``collected`` to ``orders`` on the batch key; both sides are large at
  scale, so this is a shuffle join on ``batch_id`` (AQE may switch it to broadcast when the filtered side is
  small at run time). ``part`` joins use the part key; ``agencies`` is supplier ⋈ nation ⋈ region, where nation
  and region are fixed 25/5-row dimensions (broadcast-safe by construction).
"""

from __future__ import annotations

import hashlib
import os
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsift.operators.buckets import bucket_count, bucketed, forget, write_bucketed
from urlsift.operators.loads import dealt, first_rows, without_firsts
from urlsift.session import RELEASE, checkpoint_dir, settings

# (application id, data dir, table) -> path of the written table, filled after a successful write
_WRITTEN: dict[tuple[str, str, str], str] = {}
# stored tables that are dealt by a key when they are made lie in buckets of it; path -> number of buckets
BUCKET_KEYS = {"_firsts": "url_id"}
_BUCKETS: dict[str, int] = {}


def cached_property(fn):
    """A model table: built once per :class:`Tables`; with ``materialize`` it is written once per application
    to the shared checkpoint folder as zstd Parquet and read back, as a stored catalogue table would be, so the
    derivation (aggregations over the collections) runs once instead of once per query, and lineage is cut."""
    name = fn.__name__

    def getter(self):
        cache = self.__dict__.setdefault("_cache", {})
        if name not in cache:
            df = fn(self)
            if self.materialize:
                df = self._stored(name, df)
            cache[name] = df
        return cache[name]

    getter.__doc__ = fn.__doc__
    return property(getter)


def view_property(fn):
    """A model table that is a row-by-row view (columns and conditions) of a given or stored table: built once per
    :class:`Tables` and never written, as a copy would only be written and read again."""
    name = fn.__name__

    def getter(self):
        cache = self.__dict__.setdefault("_cache", {})
        if name not in cache:
            cache[name] = fn(self)
        return cache[name]

    getter.__doc__ = fn.__doc__
    return property(getter)

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

# order that decides which collection of a URL is the original
ARRIVAL_ORDER = ["batch_id", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity"]


def _url_id(suppkey, partkey):
    return suppkey * 10000000 + partkey


def _url(suppkey, partkey):
    return F.concat(F.lit("https://s"), suppkey.cast("string"), F.lit(".example.org/p/"), partkey.cast("string"))


def _strategy(key):
    names = ["example", "auto_googler", "common_crawler", "muckrock_simple_search", "muckrock_county_search",
             "muckrock_all_search", "ckan", "manual"]
    m = key % 8
    expr = F.when(m == 0, F.lit(names[0]))
    for i, n in enumerate(names[1:-1], start=1):
        expr = expr.when(m == i, F.lit(n))
    return expr.otherwise(F.lit(names[-1]))


def _outcome(partkey, suppkey):
    m = (partkey + F.lit(3) * suppkey) % 10
    return (F.when(m == 4, "submitted").when(m == 5, "validated").when(m == 6, "not relevant")
            .when(m == 7, "error").when(m == 8, "404 not found").when(m == 9, "individual record")
            .otherwise("pending"))


class Tables:
    """Model tables of one data directory; attribute access builds (and memoises) the DataFrame plan."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        if materialize is None:
            materialize = os.environ.get("URLSIFT_MATERIALIZE", "1") == "1"
        self.materialize = materialize

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        path = _WRITTEN.get(key)
        if path is None:
            tag = hashlib.sha1(f"{key[0]}|{self.sf_dir}".encode()).hexdigest()[:16]
            path = f"{checkpoint_dir(self.spark).rstrip('/')}/urlsift-model/{tag}/{name}"
            with settings(self.spark, RELEASE):
                if name in BUCKET_KEYS:
                    _BUCKETS[path] = bucket_count(self.spark)
                    write_bucketed(df, path, BUCKET_KEYS[name], _BUCKETS[path])
                else:
                    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(path)

    @contextmanager
    def in_buckets(self) -> Iterator[tuple[Tables, int | None]]:
        """The same tables, those that are views of the first collections read by the buckets of their URL, and the number of
        buckets (none where nothing is stored). For the length of the block the catalogue has a table of them."""
        firsts = self._firsts
        path = _WRITTEN.get((self.spark.sparkContext.applicationId, self.sf_dir, "_firsts")) if self.materialize else None
        if path is None:
            yield self, None
            return
        table, rows = bucketed(self.spark, path, firsts, BUCKET_KEYS["_firsts"], _BUCKETS[path])
        try:
            other = Tables(self.spark, self.sf_dir, self.materialize)
            other.__dict__["_cache"] = {"_firsts": rows}
            yield other, _BUCKETS[path]
        finally:
            forget(self.spark, table)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    # ---- dimensions -------------------------------------------------------------------------------------------
    @cached_property
    def agencies(self) -> DataFrame:
        s, n, r = self.base("supplier"), self.base("nation"), self.base("region")
        geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))  # 25 rows, fixed
        return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
            s.s_suppkey.alias("agency_id"), s.s_name.alias("name"), F.col("r_name").alias("state"),
            F.col("n_name").alias("county"), F.lit(None).cast("string").alias("locality"))

    @view_property
    def batches(self) -> DataFrame:
        o = self.base("orders")
        status = (F.when(o.o_orderstatus == "F", "ready to label").when(o.o_orderstatus == "O", "in-process")
                  .otherwise("error"))
        return o.select(o.o_orderkey.alias("id"), _strategy(o.o_orderkey).alias("strategy"), status.alias("status"),
                        o.o_custkey.alias("user_id"), o.o_orderdate.alias("date_generated"),
                        o.o_totalprice.alias("compute_time"))

    # ---- URL intake --------------------------------------------------------------------------------------------
    @view_property
    def collected(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(
            _url_id(li.l_suppkey, li.l_partkey).alias("url_id"),
            _url(li.l_suppkey, li.l_partkey).alias("url"), li.l_orderkey.alias("batch_id"), "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

    @cached_property
    def _firsts(self) -> DataFrame:
        # without the URL itself: it is made again from the two keys where it is read
        c = self.collected.select("l_partkey", "l_suppkey", *ARRIVAL_ORDER)
        return first_rows(c, ["url_id"], ARRIVAL_ORDER, carry=["l_partkey", "l_suppkey"], count="collections",
                          made={"url_id": _url_id(F.col("l_suppkey"), F.col("l_partkey"))})

    @view_property
    def urls(self) -> DataFrame:
        f = self._firsts
        return f.select(F.col("url_id").alias("id"), _url(F.col("l_suppkey"), F.col("l_partkey")).alias("url"), F.col("l_shipdate").alias("created_at"),
                        _outcome(F.col("l_partkey"), F.col("l_suppkey")).alias("outcome"))

    @view_property
    def link_batch_urls(self) -> DataFrame:
        return self._firsts.select("batch_id", "url_id")

    @cached_property
    def duplicates(self) -> DataFrame:
        later = without_firsts(self.collected.select("batch_id", "url_id"), ["url_id"], self._firsts.select("batch_id", "url_id", "collections"), "collections")
        return later.select("batch_id", F.col("url_id").alias("original_url_id"))

    # ---- annotations -------------------------------------------------------------------------------------------
    def _collected_by_user(self, cols, cond) -> DataFrame:
        c = self.collected.where(cond).select("url_id", "batch_id", *cols)
        o = self.base("orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("user_id"))
        return c.join(o, "batch_id")

    @cached_property
    def user_relevant_suggestions(self) -> DataFrame:
        q = F.col("l_quantity").cast("int")
        j = self._collected_by_user(["l_quantity"], q % 2 == 0)
        st = F.when(q % 8 == 2, "not relevant").when(q % 8 == 6, "individual record").otherwise("relevant")
        return j.groupBy("url_id", "user_id").agg(F.min(st).alias("suggested_status"))

    @cached_property
    def user_record_type_suggestions(self) -> DataFrame:
        j = self._collected_by_user(["l_partkey"], F.col("l_quantity").cast("int") % 3 == 0)
        p = self.base("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        return j.join(p, "l_partkey").groupBy("url_id", "user_id").agg(F.min("p_type").alias("record_type"))

    @cached_property
    def user_url_agency_suggestions(self) -> DataFrame:
        j = self._collected_by_user(["l_linenumber", "l_suppkey"], F.col("l_quantity").cast("int") % 5 == 0)
        return j.groupBy("url_id", "user_id").agg(
            F.min(F.when(F.col("l_linenumber") != 7, F.col("l_suppkey"))).alias("agency_id"),
            (F.min("l_linenumber") == 7).alias("is_new"))

    @cached_property
    def auto_relevant_suggestions(self) -> DataFrame:
        c = self.collected.where(F.col("l_tax") >= 0.04)
        return c.groupBy("url_id").agg(
            (F.max("l_discount") < 0.05).alias("relevant"), (1 - F.min("l_discount")).alias("confidence"),
            F.lit("fixture").alias("model_name"))

    @cached_property
    def auto_record_type_suggestions(self) -> DataFrame:
        c = self.collected.where(F.col("l_linenumber") <= 2).select("url_id", "l_partkey")
        p = self.base("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        return c.join(p, "l_partkey").groupBy("url_id").agg(F.min("p_type").alias("record_type"))

    @cached_property
    def automated_url_agency_suggestions(self) -> DataFrame:
        c = self.collected.where(F.col("l_linestatus") == "O")
        return dealt(c.select("url_id", F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("agency_id"),
                              (F.col("l_returnflag") == "N").alias("is_unknown"))).distinct()

    @cached_property
    def confirmed_url_agency(self) -> DataFrame:
        c = self.collected.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
        return dealt(c.select("url_id", F.col("l_suppkey").alias("agency_id"))).distinct()

    # ---- tasks, errors, audit ----------------------------------------------------------------------------------
    @view_property
    def tasks(self) -> DataFrame:
        e = self.base("events")
        t = (F.when(e.event_type == "click", "HTML").when(e.event_type == "view", "Relevancy")
             .when(e.event_type == "purchase", "Record Type").when(e.event_type == "signup", "Agency Identification")
             .otherwise("Duplicate Detection"))
        m = e.event_id % 4
        s = F.when(m == 0, "error").when(m == 1, "in-process").when(m == 2, "aborted").otherwise("ready to label")
        return e.select(e.event_id.alias("id"), t.alias("task_type"), s.alias("task_status"),
                        e.ts.alias("updated_at"))

    @view_property
    def task_errors(self) -> DataFrame:
        """One error row per failed task."""
        return self.tasks.where(F.col("task_status") == "error").select(
            F.col("id").alias("task_id"), F.concat(F.lit("failed: "), F.col("task_type")).alias("error"), "updated_at")

    @cached_property
    def link_task_urls(self) -> DataFrame:
        return self.collected.select((F.col("batch_id") % 1000).alias("task_id"), "url_id").distinct()

    @cached_property
    def url_error_info(self) -> DataFrame:
        u = self.urls.where(F.col("outcome") == "error").select(F.col("id").alias("url_id"))
        c = self.collected.where(F.col("l_linenumber") == 1).select("url_id", "batch_id", "l_linenumber")
        return u.join(c, "url_id").select(
            "url_id", (F.col("batch_id") % 1000).alias("task_id"),
            F.concat(F.lit("error "), F.col("l_linenumber").cast("string")).alias("error")).distinct()

    @view_property
    def url_data_sources(self) -> DataFrame:
        return self.urls.where(F.col("outcome") == "submitted").select(
            F.col("id").alias("url_id"), F.col("id").alias("data_source_id"), "created_at")

    @view_property
    def backlog_snapshot(self) -> DataFrame:
        o = self.base("orders")
        return o.select(o.o_orderkey.alias("id"), o.o_orderdate.alias("created_at"),
                        F.floor(o.o_totalprice).cast("int").alias("count_pending_total"))

    @view_property
    def logs(self) -> DataFrame:
        e = self.base("events")
        return e.select(e.event_id.alias("id"), e.user_id.alias("batch_id"), e.event_type.alias("log"),
                        e.ts.alias("created_at"))

    @view_property
    def url_checked_for_duplicate(self) -> DataFrame:
        return self.urls.where(F.col("id") % 3 == 0).select(F.col("id").alias("url_id"), "created_at")

    @view_property
    def url_probed_for_404(self) -> DataFrame:
        return self.urls.where(F.col("id") % 4 == 0).select(F.col("id").alias("url_id"),
                                                            F.col("created_at").alias("last_probed_at"))

    @cached_property
    def reviewing_user_url(self) -> DataFrame:
        """One reviewer per reviewed URL: the user of the URL's batch, for URLs whose outcome a review gives."""
        u = self.urls.where(F.col("outcome").isin("validated", "submitted", "not relevant")).select(F.col("id").alias("url_id"), "created_at")
        o = self.base("orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("user_id"))
        return u.join(self.link_batch_urls, "url_id").join(o, "batch_id").select("url_id", "user_id", "created_at")

    # ---- HTML and metadata derived from collections (not in FIXTURES.md; documented in README) ---------------
    @cached_property
    def url_html_content(self) -> DataFrame:
        # distinct by what the texts are made of: a URL by its two keys, which both count as null where one is
        c = self.collected.where(F.col("l_linenumber").isin(3, 4)).select(
            "l_linenumber", F.when(F.col("l_partkey").isNotNull(), F.col("l_suppkey")).alias("l_suppkey"),
            F.when(F.col("l_suppkey").isNotNull(), F.col("l_partkey")).alias("l_partkey"))
        url_id, url = _url_id(F.col("l_suppkey"), F.col("l_partkey")), _url(F.col("l_suppkey"), F.col("l_partkey"))
        kind = F.when(F.col("l_linenumber") == 3, "Title").otherwise("Description")
        text = F.concat(F.when(F.col("l_linenumber") == 3, F.lit("Title ")).otherwise(F.lit("About ")), url)
        return dealt(c).distinct().select(url_id.alias("url_id"), kind.alias("content_type"), text.alias("content"))

    @cached_property
    def url_compressed_html(self) -> DataFrame:
        c = self.collected.where(F.col("l_linenumber") == 3)
        html = F.concat(F.lit("<html><head><title>"), F.col("url"), F.lit("</title></head><body><div>"),
                        F.col("url"), F.lit("</div></body></html>"))
        return c.select("url_id", html.alias("html")).distinct()

    @view_property
    def url_optional_data_source_metadata(self) -> DataFrame:
        u = self.urls.where(F.col("id") % 5 == 0)
        return u.select(F.col("id").alias("url_id"), F.array(F.lit("HTML text")).alias("record_formats"),
                        F.when(F.col("id") % 2 == 0, F.lit("CKAN")).alias("data_portal_type"),
                        F.lit(None).cast("string").alias("supplying_entity"))

    # ---- HTML --------------------------------------------------------------------------------------------------
    @view_property
    def web_pages(self) -> DataFrame:
        """Raw pages as fetch answers: (url_id, url, html, content_type)."""
        p = self.base("pages")
        return p.select(F.col("page_id").alias("url_id"), "url", "html", F.lit("text/html").alias("content_type"))


def load_model(spark: SparkSession, sf_dir: str, materialize: bool | None = None) -> Tables:
    """A1: the typed model tables of a data directory (``materialize``: store derived tables once, default on;
    ``URLSIFT_MATERIALIZE=0`` keeps every table a lazy plan over the base files)."""
    return Tables(spark, sf_dir, materialize)
