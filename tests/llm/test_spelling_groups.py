"""Spelling variants against brute force over all pairs, list refinement and awkward rows."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from urlsift.llm.spelling_groups import letter_dropped, near_in_list, near_words, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(counts, ratio=5):
    near = {w: [] for w in counts}
    masks = {}
    for w in counts:  # words that agree when one code point is deleted from either or both
        for form in {w} | {w[:k] + "\0" + w[k + 1:] for k in range(len(w))} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            masks.setdefault(form, set()).add(w)
    for group in masks.values():
        for w in group:
            near[w] += [v for v in group if one_edit(w, v)]
    out = {}
    for w, vs in near.items():
        vs = sorted(set(vs), key=lambda v: (-counts[v], v))
        form = vs[0] if vs and counts[vs[0]] >= ratio * counts[w] else None
        out[w] = (form, len(vs), counts[form] if form else None)
    rows = {}
    for w, (form, k, n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, counts[w], k, n)
    return rows


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=5), max_size=40), st.integers(0, 5))
def test_scan_of_one_list_against_all_pairs(words, upper):
    import os.path

    words = sorted(words)
    got = set(near_in_list(words, 4, upper))
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])
            and min(len(words[i]), len(words[j])) == 4 and len(os.path.commonprefix([words[i], words[j]])) < upper}
    assert got == want


def test_lists_dealt_out_give_every_pair_once(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = {"".join(p) for p in itertools.product("ab", repeat=7)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 14))) for _ in range(600)}
    counts = {w: 5 + zlib.crc32(w.encode()) % 900 for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = {w: r for w, r in brute(counts).items() if r[3]}
    for limit in (2, 20, 10**6):
        got = {r.word: (r.n_near, -r.best.less_n) for r in near_words(vocabulary, 6, limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[w][0] == want[w][3] and (want[w][4] is None or got[w][1] == want[w][4]) for w in got), limit


def _counts(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = letter_dropped(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in run))
            if len(word) >= 6:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 5}


def test_variants_of_awkward_rows(spark):
    chain = "letter " * 700 + "lettre " * 9 + "letters " * 100 + "lettters " * 12 + "LETTERß " * 5 + "Élan-vital Éclair éclairs " * 30
    rows = [(1, chain), (2, None), (3, ""), (None, "between betwen " * 6), (1, chain), (4, "aaaaaa" * 2000), (5, "Straße straßen ÉCLAIR " * 7), (6, "short")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(2)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs, change=letter_dropped).collect()}
    want = brute(_counts(rows))
    assert got == want
    assert got["lettters"][1] == "letter" and got["lettters"][0] == "letters"
    assert spelling_variants(docs.limit(0)).count() == 0


def test_query_over_whole_table_against_brute_force(spark):
    from urlsift.llm.queries import op11_spelling_variants

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op11_spelling_variants(spark, path).collect()}
    want = brute(_counts(rows))
    assert got == want and sum(r[0] is not None for r in want.values()) > 10
