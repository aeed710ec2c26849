"""Loading batches of collected URLs: first-occurrence dedup (E2), insert (A9), manual batches (A10),
batch post-collection update (A12) and the load summary (D16).

Skew note: one URL (or one batch) may carry a third of all incoming rows. Equal rows travel as one row with a count,
"which row is the original" is a partial (map-side combined) ``min(struct(order..))``, and rows are made from counts
again only where a result lists them, a bounded number at a time. The input is read once; what
several results are made from is a stored table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.functions.scalars import surrogate_key
from urlsift.session import written


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), count: str | None = None,
               made: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the row that sorts first by ``order`` (ties broken by ``carry``); columns keys+order+carry, and the
    number of the key's rows as ``count`` where that is named. ``made``: keys that the other columns give, by expressions; they
    are made where rows have been dealt, instead of being dealt with them.

    A minimum of structs is found by sorting, so rows are dealt by their content first: what a task sorts is a shuffle
    partition, however large the files or row groups are, and a hot key's rows are reduced in many of them."""
    fields = [*order, *[c for c in carry if c not in order]]
    best = F.min(F.struct(*[F.col(c) for c in fields])).alias("_first")
    made = made or {}
    own = [*dict.fromkeys([*[k for k in keys if k not in made], *fields])]
    dealt = df.select(*own).repartition(*([c for c in own if c in keys or c in order] if not made else own))
    dealt = dealt.select(*own, *[v.alias(k) for k, v in made.items()])
    rows = [F.count(F.lit(1)).alias(count)] if count else []
    return dealt.groupBy(*keys).agg(best, *rows).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in fields], *[count] * bool(count))


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Every row ``n`` times, without ``n``. Rows are made in three steps of at most 4096, so no row holds an array of
    its copies."""
    step = 1 << 12
    cols = [c for c in df.columns if c != n]
    out = df.where(F.col(n) > 0).withColumn("_high", F.expr(f"explode(sequence(0L, ({n} - 1) div {step * step}))"))
    out = out.withColumn("_rows", F.least(F.lit(step * step), F.col(n) - F.col("_high") * step * step))
    out = out.withColumn("_mid", F.expr(f"explode(sequence(0L, (_rows - 1) div {step}))"))
    out = out.withColumn("_rows", F.least(F.lit(step), F.col("_rows") - F.col("_mid") * step))
    return out.withColumn("_low", F.expr("explode(sequence(1L, _rows))")).select(*cols)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, dealt by their content and by the task that read them, for an aggregation to follow.

    What that task's map of distinct rows holds is then a shuffle partition, however large the files or row groups are;
    copies of one row go to as many tasks as there were to read them."""
    return df.withColumn("_task", F.spark_partition_id()).repartition(*df.columns, "_task").drop("_task")


def occurrence_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """E2 as counts: every distinct row once with ``n_first`` (1 if it holds its key's first row, else 0) and
    ``n_repeat`` (its other copies). The input is aggregated once, in parts that do not grow with its files, and stored;
    of the distinct rows only those that share their key with others are joined."""
    cols = df.columns
    rest = [*order, *[c for c in cols if c not in keys and c not in order]]
    runs = written(dealt(df).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")), "occurrences")
    best = runs.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"), F.count(F.lit(1)).alias("_runs"), F.sum("_n").alias("_rows"))
    field = {c: F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in cols}
    alone = best.where("_runs = 1").select(*field.values(), F.lit(1).cast("long").alias("n_first"), (F.col("_rows") - 1).alias("n_repeat"))
    # both parts ask for the same columns, so that the aggregation is shuffled once
    among = best.where("_runs > 1 and _rows > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    first = F.struct(*rest).eqNullSafe(F.col("_first")).cast("long")
    return alone.unionByName(runs.join(among, same).select(*cols, first.alias("n_first"), (F.col("_n") - first).alias("n_repeat")))


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every input row plus ``is_first``; exactly one row per key is the first by ``order``.

    The multiset of rows is that of ``row_number() over (partition by keys order by order) == 1``. Null keys are a key."""
    runs = occurrence_runs(df, keys, order)
    firsts = runs.where("n_first = 1").select(*df.columns, F.lit(True).alias("is_first"))
    return firsts.unionByName(repeated(runs.drop("n_first"), "n_repeat").withColumn("is_first", F.lit(False)))


def without_firsts(df: DataFrame, keys: Sequence[str], firsts: DataFrame, count: str) -> DataFrame:
    """The rows of E2 that are not first, in the columns a result needs: ``df`` less one copy of every row of ``firsts``, which
    has the same columns and the number of its key's rows (``first_rows``).

    Rows are counts until they are listed. What decides who is first is not moved again, and rows that are alone under their
    key meet the keys that have several and go no further."""
    cols, one = df.columns, F.lit(1).cast("long")
    several = firsts.where(F.col(count) > 1).select(*cols)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = df.join(several.select(*[F.col(k).alias(f"_{k}") for k in keys]), same, "left_semi")
    counts = dealt(rows).withColumn("_n", one).unionByName(several.withColumn("_n", -one))
    return repeated(counts.groupBy(*cols).agg(F.sum("_n").alias("_n")), "_n")


# widths of generated ids: the first is used unless an id is taken, then the next; the last is tried with new seeds
ID_WIDTHS = (52, 57, 61)


def assign_ids(new: DataFrame, taken: DataFrame, widths: Sequence[int] = ID_WIDTHS) -> DataFrame:
    """``url, id`` for distinct new URLs, no id given twice nor one of ``taken`` (column ``id``).

    An id is a hash of its URL. Of new URLs with one id the smallest keeps it, unless the catalogue has it; the others
    get a longer id from another seed, until none is left. Ids so depend on the catalogue and the set of new URLs only."""
    todo, done, level = new.select("url"), [], 0
    while True:
        width = widths[min(level, len(widths) - 1)]
        tried = written(todo.select("url", surrogate_key("url", width, level).alias("id")), "ids-tried")
        used = taken.select("id")
        for d in done:
            used = used.unionByName(d.select("id"))
        free = tried.groupBy("id").agg(F.min("url").alias("url")).join(used, "id", "left_anti").select("url", "id")
        done.append(written(free, "ids"))
        todo = tried.join(done[-1].select("url"), "url", "left_anti").select("url")
        level += 1
        if todo.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


@dataclass
class Load:
    """Result of loading one or more batches of URLs."""

    new_urls: DataFrame  # id, url, batch_id, + payload, outcome 'pending'
    links: DataFrame  # batch_id, url_id
    duplicate_runs: DataFrame  # batch_id, original_url_id, url, n: the duplicates, equal rows counted
    summary: DataFrame  # batch_id, total_count, original_count, duplicate_count

    @property
    def duplicates(self) -> DataFrame:
        """batch_id, original_url_id, url: one row per duplicate arrival."""
        return repeated(self.duplicate_runs, "n")


# places to which the arrivals of one URL in one batch are dealt before they are reduced
SPREAD = 64


def insert_urls(incoming: DataFrame, urls: DataFrame, seq: str = "seq", id_col: str | None = None,
                id_widths: Sequence[int] = ID_WIDTHS) -> Load:
    """First arrival of each URL becomes an original; every later arrival (same or other batch) and every
    arrival of an already-catalogued URL becomes a ``duplicates`` row pointing at the original's id.

    ``incoming`` needs ``url, batch_id`` and an arrival order column ``seq``; other columns ride along into ``new_urls``.
    New ids are ``id_col`` when given, else :func:`assign_ids`. Rows without a URL are left out.

    Plan: arrivals are dealt to tasks (a URL's of one batch to up to ``SPREAD``), so that what a task sorts does not grow with
    the files it reads, reduced to one row per URL and batch (stored), those to one per URL, which alone meets the catalogue;
    all results are read from these two tables."""
    rest = [c for c in incoming.columns if c not in ("url", "batch_id", seq)]
    dealt = incoming.where("url is not null").repartition("url", "batch_id", F.pmod(F.hash(seq), F.lit(SPREAD)))
    offers = written(dealt.groupBy("url", "batch_id").agg(
        F.min(F.struct(seq, *rest)).alias("first"), F.count(F.lit(1)).alias("n")), "offers")
    # by arrival, batch, then what rides along; the arrival travels once
    per_url = offers.groupBy("url").agg(F.min(F.struct(
        F.col(f"first.{seq}").alias("_0"), F.col("batch_id").alias("_1"), *[F.col(f"first.{c}").alias(f"r_{c}") for c in rest])).alias("o"))
    known = urls.select("url", F.col("id").alias("known_id"))
    first = F.struct(F.col("o._0").alias(seq), *[F.col(f"o.r_{c}").alias(c) for c in rest])
    met = per_url.select("url", F.col("o._1").alias("first_batch"), first.alias("first")).join(known, "url", "left")
    if id_col:
        originals = written(met.withColumn("id", F.coalesce("known_id", F.col(f"first.{id_col}"))), "originals")
    else:
        met = written(met, "originals")
        made = assign_ids(met.where("known_id is null"), urls, id_widths)
        originals = met.join(made, "url", "left").withColumn("id", F.coalesce("known_id", "id"))
    new_urls = originals.where("known_id is null").select(
        "url", F.col("first_batch").alias("batch_id"), *[F.col(f"first.{c}").alias(c) for c in (seq, *rest) if c != "id"],
        "id", F.lit("pending").alias("outcome"))
    is_original = (F.col("known_id").isNull() & F.col("batch_id").eqNullSafe(F.col("first_batch"))).cast("long")
    arrivals = offers.select("url", "batch_id", "n").join(originals.select("url", "first_batch", "known_id", "id"), "url").select(
        "url", "batch_id", F.col("id").alias("original_url_id"), "n", is_original.alias("original"))
    runs = arrivals.select("batch_id", "original_url_id", "url", (F.col("n") - F.col("original")).alias("n")).where("n > 0")
    summary = arrivals.groupBy("batch_id").agg(F.sum("n").alias("total_count"), F.sum("original").alias("original_count")).withColumn(
        "duplicate_count", F.col("total_count") - F.col("original_count"))
    return Load(new_urls, new_urls.select("batch_id", F.col("id").alias("url_id")), runs, summary)


def load_summary(incoming: DataFrame, links: DataFrame) -> DataFrame:
    """Per batch — total rows offered, originals created, duplicates (= total − originals)."""
    total = incoming.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_count"))
    orig = links.groupBy("batch_id").agg(F.count(F.lit(1)).alias("original_count"))
    return (
        total.join(orig, "batch_id", "left")
        .select(
            "batch_id",
            "total_count",
            F.coalesce("original_count", F.lit(0)).cast("long").alias("original_count"),
        )
        .withColumn("duplicate_count", F.col("total_count") - F.col("original_count"))
    )


MANUAL_ENTRY_OPTIONAL = ("name", "description", "collector_metadata", "record_type", "record_formats",
                         "data_portal_type", "supplying_entity")


def manual_batch_load(entries: DataFrame, name: str, user_id: int, batch_id: int, urls: DataFrame,
                      seq: str = "seq") -> tuple[DataFrame, Load, DataFrame, DataFrame]:
    """A10: one manual batch (status ready to label, parameters {"name": ..}); entries whose URL already exists
    (or repeats inside the batch) are reported as duplicate URLs instead of being inserted.

    Returns (batch_row, load, optional_metadata_rows, duplicate_urls)."""
    spark = entries.sparkSession
    batch = spark.range(1).select(
        F.lit(batch_id).cast("long").alias("id"),
        F.lit("manual").alias("strategy"),
        F.lit("ready to label").alias("status"),
        F.to_json(F.struct(F.lit(name).alias("name"))).alias("parameters"),
        F.lit(user_id).cast("long").alias("user_id"),
    )
    with_batch = entries.withColumn("batch_id", F.lit(batch_id).cast("long"))
    load = insert_urls(with_batch, urls, seq=seq)
    present = [c for c in ("record_formats", "data_portal_type", "supplying_entity") if c in entries.columns]
    metadata = load.new_urls.select(F.col("id").alias("url_id"), *present)
    dup_urls = load.duplicates.select("url")
    return batch, load, metadata, dup_urls


def batch_post_collection(batches: DataFrame, summary: DataFrame, status: Column | str,
                          compute_time: Column | float | None = None) -> DataFrame:
    """Stamp the batches of a finished collection with status, compute_time and load counts (K17: the
    counts are carried as columns of the result; batches not in ``summary`` are unchanged)."""
    s = summary.select("batch_id", "total_count", "original_count", "duplicate_count",
                       F.lit(True).alias("_hit"))
    joined = batches.join(s, batches["id"] == s["batch_id"], "left").drop("batch_id")
    status_col = status if isinstance(status, Column) else F.lit(status)
    ct = compute_time if isinstance(compute_time, Column) else F.lit(compute_time)
    out = joined.withColumn("status", F.when(F.col("_hit"), status_col).otherwise(F.col("status")))
    if compute_time is not None:
        out = out.withColumn("compute_time", F.when(F.col("_hit"), ct.cast("double")).otherwise(F.col("compute_time")))
    return out.drop("_hit")
