"""What the cycle and its input write and move: new rows only, joins by URL without the URLs, nothing left behind."""

import glob
import os
import random
from collections import Counter

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from urlsift.operators import cycle, loads
from urlsift.operators import queues as qs
from urlsift.operators.tasks import Changes, Task
from urlsift.session import checkpoint_dir
from urlsift.sources import fixtures

NOW = "2024-02-01 00:00:00"


def _tables(spark, urls):
    return {"urls": spark.createDataFrame(urls, "id long, outcome string, name string"),
            "tasks": spark.createDataFrame([], "id long, task_type string, task_status string, updated_at timestamp_ntz"),
            "task_errors": spark.createDataFrame([], "task_id long, error string, updated_at timestamp_ntz"),
            "link_task_urls": spark.createDataFrame([(1, k) for k in range(500)], "task_id long, url_id long"),
            "url_error_info": spark.createDataFrame([(k, 1, "old") for k in range(300)], "url_id long, task_id long, error string")}


def _task(name, change):
    return Task(name, lambda s: s["urls"].where("outcome = 'pending'"), lambda q, s: change(q.select(F.col("id").alias("url_id"))))


def test_cycle_writes_what_changes(spark, tmp_path):
    """Appended rows are written alone, a table without changes is not; named, failed and retried URLs end as they did."""
    urls = [(k, "pending", None) for k in range(40)] + [(None, "pending", "none"), (7, "pending", "twice")]
    tasks = [_task("names", lambda q: Changes(upserts={"urls": q.where("url_id % 4 = 0").distinct().select("url_id", F.concat(F.lit("n"), "url_id").alias("name"))},
                                              status_updates=q.where("url_id % 4 = 1").select("url_id", F.lit("duplicate").alias("outcome")))),
             _task("nothing", lambda q: Changes(status_updates=q.where("url_id < 0").select("url_id", F.lit("x").alias("outcome")))),
             _task("errors", lambda q: Changes(status_updates=q.where("url_id % 4 < 3").select("url_id", F.lit("seen").alias("outcome")),
                                               errors=q.where("url_id = 2 or url_id = 7").select("url_id", F.lit("bad").alias("error"))))]
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/urlsift-tables/*"))
    out = cycle.run_cycle(spark, _tables(spark, urls), tasks, f"{tmp_path}/c", 70, NOW)
    want = Counter()
    for k, outcome, name in urls:
        if k is not None:
            name = f"n{k}" if k % 4 == 0 else name
            outcome = "error" if k in (2, 7) else "duplicate" if k % 4 == 1 else "seen" if k % 4 < 3 else outcome
        want[(k, outcome, name)] += 1
    assert Counter(map(tuple, out["urls"].collect())) == want
    links = {(1, k) for k in range(500)} | {(70, k) for k in [*range(40), None]} | {(71, k) for k in [*range(40), None] if k is None or k % 4 != 1}
    assert {tuple(r) for r in out["link_task_urls"].collect()} >= links and out["link_task_urls"].count() == 500 + 41 + 31 + 31
    assert sorted(map(tuple, out["url_error_info"].where("error = 'bad'").collect())) == [(2, 72, "bad"), (7, 72, "bad")] and out["url_error_info"].count() == 302
    rows = lambda *at: sum(ds.dataset(f).count_rows() for f in glob.glob(os.path.join(tmp_path, "c", *at, "*.parquet")))
    assert [rows(f"v{k:02d}", "link_task_urls") for k in range(3)] == [41, 31, 31] and rows("v*", "url_error_info") == 2
    assert not os.path.exists(f"{tmp_path}/c/v01/urls") and rows("v00", "urls") == 20 and rows("v02", "urls") == 31
    again = cycle.run_cycle(spark, _tables(spark, urls), tasks, f"{tmp_path}/c", 70, NOW)
    assert Counter(map(tuple, again["urls"].collect())) == want and again["link_task_urls"].count() == out["link_task_urls"].count()
    # nothing that a task stores for itself outlives it
    assert set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/urlsift-tables/*")) == before
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("urlsift_")]


def test_urls_named_twice_stay_two_rows(spark, tmp_path):
    """A URL that a task's queue holds twice is overlaid twice; later changes keep its rows and do not multiply them."""
    twice = lambda q: q.where("url_id < 4").crossJoin(spark.range(2).select((F.col("id") * 0).alias("copy")))
    tasks = [_task("names", lambda q: Changes(upserts={"urls": twice(q).select("url_id", F.concat(F.lit("n"), "url_id").alias("name"))},
                                              errors=q.where("url_id = 1").select("url_id", F.lit("bad").alias("error")))),
             _task("seen", lambda q: Changes(status_updates=q.where("url_id % 2 = 0").select("url_id", F.lit("seen").alias("outcome"))))]
    out = cycle.run_cycle(spark, _tables(spark, [(k, "pending", None) for k in range(8)]), tasks, f"{tmp_path}/c", 70, NOW)
    want = Counter({(k, "error" if k == 1 else "seen" if k % 2 == 0 else "pending", f"n{k}" if k < 4 else None): 2 if k < 4 else 1 for k in range(8)})
    assert Counter(map(tuple, out["urls"].collect())) == want


def test_joins_by_url_do_not_move_the_urls(spark, tmp_path, monkeypatch):
    """A queue and the merge of a task's updates read the URLs where they lie: of two sides one is shuffled at most."""
    tables = _tables(spark, [(k, "pending", None) for k in range(200)])
    task = Task("seen", lambda s: qs.user_suggestion_not_exists(s["urls"].where("outcome = 'pending'"), s["url_error_info"]),
                lambda q, s: Changes(status_updates=q.join(q.select("id", F.lit("seen").alias("outcome_")), "id").select(F.col("id").alias("url_id"), F.col("outcome_").alias("outcome"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    try:
        write = cycle.write_bucketed
        monkeypatch.setattr(cycle, "write_bucketed", lambda df, path, key, n: (seen.append((path, df._jdf.queryExecution().executedPlan().toString())), write(df, path, key, n)) and None)
        out = cycle.run_cycle(spark, {**tables, "url_error_info": tables["url_error_info"].where("url_id < 50")}, [task], f"{tmp_path}/c", 70, NOW)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.outcome for r in out["urls"].where("id >= 50").collect()} == {"seen"} and out["urls"].where("outcome = 'pending'").count() == 50
    queue = next(plan for path, plan in seen if path.endswith("/queue"))
    assert "SortMergeJoin" in queue and queue.count("Exchange hashpartitioning") == 1
    whole = out["urls"].inputFiles()
    assert whole and all("/c/end01/urls/" in f for f in whole)


def _lineitem(spark, folder, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").selectExpr(
        "*", "0.1d as l_discount", "0.05d as l_tax", "'A' as l_returnflag", "'F' as l_linestatus", "timestamp_ntz '2024-01-01 00:00:00' as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def test_duplicates_are_the_rows_behind_the_first(spark, tmp_path):
    """Copies of a row, of a URL in one batch, null URLs and null batches; no wide copy of the collections is stored."""
    dice = random.Random(11)
    rows = [(dice.choice([None, 1, 2, 3, 4]), dice.choice([None, 1, 2]), dice.choice([1, 2, 3]), dice.randrange(3), float(dice.randrange(2)), 1.0) for _ in range(300)]
    rows += [(9, 50 + k, 1, 1, 1.0, 1.0) for k in range(100)] + [(5, 99, 1, 1, 1.0, 1.0)] * 200
    _lineitem(spark, tmp_path, rows)
    t = fixtures.load_model(spark, str(tmp_path), materialize=True)
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/urlsift-tables/occurrences-*"))
    got = Counter(map(tuple, t["duplicates"].select("batch_id", "original_url_id").collect()))
    assert set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/urlsift-tables/occurrences-*")) == before
    e2 = loads.first_occurrence(t["collected"].select("url_id", *fixtures.ARRIVAL_ORDER), ["url_id"], fixtures.ARRIVAL_ORDER)
    assert got == Counter(map(tuple, e2.where("not is_first").select("batch_id", "url_id").collect())) and sum(got.values()) > 400
