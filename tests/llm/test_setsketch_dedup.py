"""SetSketch near duplicates against brute force, the estimate, and awkward rows."""

import random
import re

import numpy as np
import pytest

from urlsift.llm import setsketch_dedup as ss


def _set(text, words=3):
    own = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[k:k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else ({tuple(own)} if own else set())


def brute(rows, percent=85):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    held = {}
    for k, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        for o in {o for g in s for o in held[g] if o < k}:
            shared = len(s & sets[o])
            if 100 * shared >= percent * (len(s) + len(sets[o]) - shared):
                up[root(k)] = root(o)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[root(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def families(seed, groups, copies, length, most):
    """Groups of near copies that differ from an original in a few to many words, the original left out."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            own = base[:]
            for _ in range(rng.randrange(most + 1)):
                own[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(own[:length - rng.randrange(3)]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("groups", "copies", "length", "most"), [(6, 60, 90, 6), (1, 400, 150, 9), (40, 4, 40, 2)])
def test_components_against_brute_force(spark, monkeypatch, groups, copies, length, most):
    monkeypatch.setattr(ss, "BLOCK", 37)  # several blocks a group
    rows = list(enumerate(families(groups, groups, copies, length, most)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ss.setsketch_duplicates(docs).collect()), key=str) == brute(rows)


def test_awkward_rows(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(5, base), (3, base + " end"), (None, base), (9, None), (10, ""), (11, " \t\n"), (12, "one"), (2, "One"), (13, "two words"), (3, base.replace(" ", "\n")),
            (14, "word " * 4000), (15, "word word word"), (None, "lonely text here"), (16, " ".join(f"u{k}" for k in range(70_000))),
            (17, " ".join(f"u{k}" for k in range(69_000))), (18, "a\x1cb c\x85d e")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n int").repartition(3)
    got = ss.setsketch_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert ss.setsketch_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 60_000, np.uint64)
    parts = ss.sketches([pool[:10_000], pool[10_000:]])
    whole = ss.sketches([pool])
    assert (whole[0] == parts.max(axis=0)).all()  # merged by maximum
    n, tried = 0, 400
    for wanted in (0.86, 0.5):
        size, reach = 300, []
        for _ in range(tried):
            own = rng.integers(0, 2**64, 2 * size, np.uint64)
            shared = round(2 * size * wanted / (1 + wanted))
            a, b = ss.sketches([own[:size], own[size - shared:2 * size - shared]])
            reach.append(ss.may_reach(np.array([size]), np.array([size]), a[None], b[None], 85)[0])
            n += (a == b).mean()
        assert all(reach) if wanted > 0.85 else not any(reach)
    assert abs(n / tried - 1.36) < 0.08  # equal registers are about as likely as the sets are similar


def test_block_overlaps():
    rng = np.random.default_rng(2)
    sets = [[np.unique(rng.integers(0, 9000, rng.integers(0, 3000)).astype(np.uint64)) for _ in range(9)] for _ in range(2)]
    packed = [(np.cumsum([0] + [len(s) for s in side]), np.concatenate(side)) for side in sets]
    assert (ss.block_overlaps(*packed) == [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]).all()


def test_query_over_whole_table_against_brute_force(spark):
    from urlsift.llm.queries import op13_setsketch_dedup

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_setsketch_dedup(spark, path).collect()), key=str) == brute(rows)
