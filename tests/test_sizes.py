"""What a task sorts, reads and writes does not grow with the table: plans and files of the shared steps."""

import glob
import random
import uuid
from collections import Counter

import pyarrow.parquet as pq

from urlsift.operators import loads
from urlsift.operators.loads import first_rows
from urlsift.plans import q_streams
from urlsift.session import checkpoint_dir
from urlsift.sources import fixtures


def _lineitem(spark, folder):
    spark.createDataFrame([(k, k % 7, k % 3, 1 + k % 2, 1.0, 2.0, 0.1, 0.05, "A", "F") for k in range(60)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string").selectExpr(
        "*", "timestamp_ntz '2024-01-01 00:00:00' as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def test_views_are_not_written(spark, tmp_path):
    """`urls` is made from the stored first collections; neither it nor the collections are stored again."""
    _lineitem(spark, tmp_path)
    t = fixtures.load_model(spark, str(tmp_path), materialize=True)
    urls = {(r.id, r.url) for r in t["urls"].collect()}
    assert urls == {((k % 3) * 10000000 + k % 7, f"https://s{k % 3}.example.org/p/{k % 7}") for k in range(60)}
    names = {name for _, folder, name in fixtures._WRITTEN if folder == str(tmp_path)}
    assert names == {"_firsts"}
    assert "url" not in spark.read.parquet(next(p for k, p in fixtures._WRITTEN.items() if k[1] == str(tmp_path))).columns


def test_first_rows_sort_shuffle_partitions_only(spark):
    dice = random.Random(5)
    rows = [(dice.choice([None, 1, 2, 3]), dice.randrange(40), dice.randrange(9), k) for k in range(500)] + [(4, 1, 1, 0)] * 300
    df = spark.createDataFrame(rows, "k long, a long, b long, c long")
    out = first_rows(df, ["k"], ["a", "b"], ["c"])
    want = {}
    for k, a, b, c in rows:
        want[k] = min(want.get(k, (a, b, c)), (a, b, c))
    assert {r.k: (r.a, r.b, r.c) for r in out.collect()} == want and out.count() == len(want)
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()  # from the result down to the scan
    dealt = [i for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x]
    assert dealt and dealt[0] > max(i for i, x in enumerate(lines) if "Aggregate" in x)


def test_stream_files_stay_small(spark, monkeypatch):
    """Three micro-batches whatever the table's size; each in as many files as its rows need."""
    monkeypatch.setattr(q_streams, "FILE_ROWS", 100)
    name = f"sizes-{uuid.uuid4().hex}"
    rows = spark.range(3000).withColumnRenamed("id", "a")
    source = q_streams._three_loads(spark, rows, name, "a")
    files = glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/urlsift-streams/{name}-*/*.parquet")
    counts = [pq.ParquetFile(f).metadata.num_rows for f in files]
    assert sum(counts) == 3000 and len(counts) == 30 and max(counts) < 200
    seen = []
    query = source.writeStream.foreachBatch(lambda batch, epoch: seen.append(batch.count())).trigger(availableNow=True).option(
        "checkpointLocation", q_streams.st.scratch_path(spark, "sizes-ck")).start()
    query.awaitTermination()
    assert len(seen) == 3 and sum(seen) == 3000


def test_arrivals_are_dealt_before_they_are_sorted(spark, monkeypatch):
    """Arrivals of one URL in one batch go to several tasks, and the load is that of a plain recount."""
    plans, write = {}, loads.written
    monkeypatch.setattr(loads, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().sparkPlan().toString()}) or write(df, tag))
    dice = random.Random(3)
    rows = [(f"u{dice.randrange(20)}", dice.randrange(4), k, 100 + k) for k in range(200)] + [("hot", 1, 500 + k, 900) for k in range(300)] + [(None, 1, 0, 0)]
    dice.shuffle(rows)
    out = loads.insert_urls(spark.createDataFrame(rows, "url string, batch_id long, seq long, extra long"), spark.createDataFrame([(7, "u3")], "id long, url string"))
    want = {}
    for url, batch, seq, extra in rows:
        if url and url != "u3":
            want[url] = min(want.get(url, (seq, batch, extra)), (seq, batch, extra))
    assert {r.url: (r.seq, r.batch_id, r.extra) for r in out.new_urls.collect()} == want
    assert sum(r.total_count for r in out.summary.collect()) == 500 and out.duplicates.count() == 500 - len(want)
    lines = plans["offers"].splitlines()
    assert max(i for i, x in enumerate(lines) if "Aggregate" in x) < next(i for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x)


def test_distinct_rows_are_counted_in_dealt_parts(spark, tmp_path, monkeypatch):
    """What is counted or made distinct over a scan is dealt first, and only rows that share their key are joined."""
    plans, write = {}, loads.written
    monkeypatch.setattr(loads, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().sparkPlan().toString()}) or write(df, tag))
    dice = random.Random(11)
    rows = [(dice.choice([None, *range(90)]), dice.choice([None, 1, 2, 3]), dice.randrange(2)) for _ in range(200)] + [(7, 1, 0)] * 300 + [(500, 9, 9)] * 5
    runs = loads.occurrence_runs(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], ["a"])

    def rank(r):
        return [(v is not None, v or 0) for v in r[1:]]

    count, want = Counter(rows), {}
    for r in count:
        want[r[0]] = min(want.get(r[0], r), r, key=rank)
    got = Counter(((r.k, r.a, r.b), r.n_first, r.n_repeat) for r in runs.collect())
    assert got == Counter((r, int(want[r[0]] == r), n - int(want[r[0]] == r)) for r, n in count.items())
    _lineitem(spark, tmp_path)
    t = fixtures.load_model(spark, str(tmp_path), materialize=False)
    views = {x: t[x]._jdf.queryExecution().sparkPlan().toString() for x in ("url_html_content", "confirmed_url_agency", "automated_url_agency_suggestions")}
    for plan in [plans["occurrences"], *views.values()]:
        lines = plan.splitlines()
        assert max(i for i, x in enumerate(lines) if "Aggregate" in x) < next(i for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x)


def test_texts_of_urls_with_null_keys(spark, tmp_path):
    """Collections without a part or supplier have no URL and are one row for each kind."""
    rows = [(1, 3), (1, 3), (None, 3), (None, 3), (2, 4)]
    spark.createDataFrame([(k, part, supp, line, 1.0, 2.0, 0.1, 0.05, "A", "F") for k, (part, line) in enumerate(rows) for supp in (5, None)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string").selectExpr(
        "*", "timestamp_ntz '2024-01-01 00:00:00' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Counter(map(tuple, fixtures.load_model(spark, str(tmp_path), materialize=False)["url_html_content"].collect()))
    assert got == Counter([(50000001, "Title", "Title https://s5.example.org/p/1"), (50000002, "Description", "About https://s5.example.org/p/2"),
                           (None, "Title", None), (None, "Description", None)])
