"""Periodic runs against a brute-force search, long texts and awkward rows."""

import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from urlsift.llm.periodic_runs import collapsed, cycled, periodic_runs, periodic_stretches, strongest


def brute(words):
    """Every maximal stretch of every period, kept where the period is the smallest of the stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - start >= max(24, 3 * q):
                found.setdefault((start, k + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 120), st.integers(1, 3)), max_size=5), st.integers(0, 2**31))
def test_runs_against_brute_force(parts, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(2):
        words = []
        for period, length, letters in parts:
            unit = [rng.choice("abc"[:letters]) for _ in range(period)]
            words += (unit * (length // period + 1))[:length]
        texts.append(words)
    assert list(periodic_stretches(texts)) == [brute(w) for w in texts]


def test_fixed_shapes():
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    thue = [("x", "y")[bin(k).count("1") % 2] for k in range(512)]
    nested = ((["a"] * 30 + ["b"]) * 5 + ["c"]) * 4
    texts = [fib[1], thue, nested, ["w"] * 23, ["w"] * 24, [], ["w"] * 100 + ["v"] * 100, [str(k % 100) for k in range(299)], [str(k % 100) for k in range(300)]]
    got = list(periodic_stretches(texts))
    assert got == [brute(w) for w in texts]
    assert not got[3] and got[4] == [(0, 24, 1)] and not got[7] and got[8] == [(0, 300, 100)]


def test_long_texts_stay_near_linear():
    def seconds(words):
        t = time.process_time()
        runs = next(periodic_stretches([words]))
        return time.process_time() - t, runs

    rng = random.Random(1)
    for make in (lambda n: ["w"] * n, lambda n: [str(k % 7) for k in range(n)], lambda n: [str(rng.randrange(2)) for _ in range(n)],
                 lambda n: ([str(k) for k in range(n // 10)] * 10)[:n]):
        few, many = seconds(make(50_000)), seconds(make(400_000))
        assert many[0] < 30 * max(few[0], 0.05)


def test_strongest_and_collapsed():
    assert strongest([(0, 25, 8), (5, 50, 16), (9, 26, 8)]) == (9, 26, 8) and strongest([]) is None
    assert strongest([(3, 24, 2), (7, 48, 4)]) == (3, 24, 2)
    words = ["a", *"bc" * 12, "d"]
    assert collapsed(words, [(1, 24, 2)]) == "a b c d"


def test_query_rows(spark):
    unit = "buy this now "
    rows = [(1, "x " + unit * 10 + "end"), (2, None), (3, ""), (None, "a " * 30), (1, "one two"), (8, "t1 t2\x0bt3 \x1c t4"), (9, "word " * 20000)]
    docs = spark.createDataFrame([(i, t, "t", 0) for i, t in rows], "doc_id long, text string, start string, n_runs int").repartition(2)
    got = sorted(map(tuple, periodic_runs(docs, spans=True).drop("runs_sha256").collect()), key=str)
    none = (0, None, None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda i, top, runs, rest: (i, *top, sha(rest), runs, rest)
    assert got == sorted([row(1, (1, 1, 30, 3, 10000), [(1, 30, 3)], "x buy this now end"), row(2, none, [], ""), row(3, none, [], ""),
                          row(None, (1, 0, 30, 1, 30000), [(0, 30, 1)], "a"), row(1, none, [], "one two"), row(8, none, [], "t1 t2 t3 \x1c t4"),
                          row(9, (1, 0, 20000, 1, 20000000), [(0, 20000, 1)], "word")], key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_over_whole_table_against_brute_force(spark):
    from urlsift.llm.queries import op12_periodic_runs

    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_periodic_runs(spark, path).collect()
    assert len(got) == len(texts)
    checked = changed = 0
    for r in got:
        words = (texts[r.doc_id] or "").split()
        after = cycled(r.doc_id, words)
        changed += after != words
        if len(after) > 1500:
            continue
        runs, checked = brute(after), checked + 1
        top = strongest(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(after) if k not in drop).encode()).hexdigest()
    assert checked > 150 and changed > 5
