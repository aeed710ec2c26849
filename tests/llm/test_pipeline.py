"""The pipeline's rows against a brute-force version: every stage again in plain Python on what the one before kept.
The labels that the personal-data classifier learns come from the operator; its base spans and the cuts are plain."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_pii_spans import _parsed, plain_base, plain_redact
from test_quality_references import EN, FR, plain_references, plain_verdict

import corpus_pipeline
from urlsift.llm import pii_weak
from urlsift.llm.common import SPACE_CHARS, table, words_of
from urlsift.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long"


def _prose(rng, common, n):
    return " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("etaoinshrdlu", k=rng.randrange(4, 9))) for _ in range(n)) + "."


def _rows():
    rng = random.Random(12)
    texts = [(_prose(rng, EN, rng.randrange(60, 400)), "en") for _ in range(90)] + [(_prose(rng, FR, rng.randrange(60, 400)), "fr") for _ in range(60)]
    texts += [(_prose(rng, EN, 9000), "en"), (None, "en"), ("", None), ("few words", "fr"), ("again and again " * 40, "en")]
    texts += [(" ".join("".join(rng.choices("#*$%&|<>^~@=+", k=6)) for _ in range(120)), x) for x in ("en", "xq", None)]
    for k in range(0, 60, 3):
        words = texts[k][0].split()
        texts += [(texts[k][0], "en"), ("  ".join(words) + "\n", "en")]  # equal but for white space
        for cut in (1, 2, len(words) // 8):  # near copies, near copies of those, and texts that are just too far
            words = words[:-cut] + [f"other{k}" for _ in range(cut)]
            texts.append((" ".join(words), "en"))
    marks = ["mail a.b@c.example.org", "from 10.0.0.3", "card 4539 1488 0343 6467", "call +1 (212) 555-0100", "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"",
             "my ssn 123-45-6789", "<|endoftext|>"]
    texts += [(_prose(rng, EN, 150) + " " + " ".join(rng.choices(marks, k=rng.randrange(1, 5))) + " " + _prose(rng, EN, 40), "en") for _ in range(60)]
    rng.shuffle(texts)
    return [(3 * k + 1, t, lang, "s", 1, "row", 5) for k, (t, lang) in enumerate(texts)]


def plain_distinct(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate({ord(c): None for c in SPACE_CHARS})].append(r)
    return sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())


def plain_far_apart(rows, words=5, percent=80):
    sets = {}
    for r in rows:
        own = words_of((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r[0]] = {tuple(own[k:k + words]) for k in range(max(len(own) - words + 1, 1))} if own else set()
    low = {k: k for k in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def _write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_rows_equal_a_brute_force_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = _rows()
    folder = _write(spark, tmp_path, rows)
    references = plain_references([r[:3] for r in rows])
    assert sorted(references) == ["en", "fr"]
    good = [r for r in rows if plain_verdict(r[1], (r[2] or "und"), references)]
    distinct = plain_distinct(good)
    apart = plain_far_apart(distinct)
    assert len(rows) > len(good) > len(distinct) > len(apart) > 150
    docs = table(spark, folder, "documents")
    wanted = [good, distinct, apart]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], wanted, strict=True):
        docs = stage(spark, docs, folder)
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want) and docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    survivors = spark.createDataFrame(apart, SCHEMA)
    spans = {r.doc_id: _parsed(r.spans) for r in pii_weak.find_personal_data(survivors).collect()}
    assert all(set(plain_base(r[1])) <= set(spans[r[0]]) for r in apart) and sum(bool(s) for s in spans.values()) >= 50
    clean = {r[0]: plain_redact(r[1], [(s, e, k) for k, s, e in spans[r[0]]]) for r in apart}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in clean.items()}

    pieces, used = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        used[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for k, own in pieces.items():
        at = 0
        for start, length, crc, tokens in sorted(own):
            assert start == at and tokens == len(ids[k]) and crc == zlib.crc32(ids[k][start:start + length].tobytes())
            at += length
        assert at == len(ids[k])
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= 1.05 * sum(map(len, ids.values())) / 2048 + 2


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None), (None, "two words", "en", "s", 1, "row", 1)]])
def test_empty_and_rejected_tables(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, _write(spark, tmp_path, rows)).count() == 0
