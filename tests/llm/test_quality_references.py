"""Language references: support, a text's own share, and the whole verdict against a plain recount."""

import random
from collections import Counter

import numpy as np
import pytest

from urlsift.llm import quality_divergence as q

EN = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()
FR = "le la les de des du un une et que qui dans pour pas sur plus par avec ce il est au se ne sont comme mais on ou leur".split()


def _prose(rng, common, n=220):
    return " ".join(rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("etaoinshrdlu", k=rng.randrange(4, 9))) for _ in range(n)) + "."


def _junk(rng, n=120):
    return " ".join("".join(rng.choices("#*$%&|<>^~@=+", k=6)) for _ in range(n))


def _rows():
    rng = random.Random(5)
    rows = [(_prose(rng, EN), "en") for _ in range(70)] + [(_prose(rng, FR), "fr ") for _ in range(60)]
    rows += [(_prose(rng, FR), "FR"), (_prose(rng, EN), None), (_junk(rng), "en"), (_junk(rng), "xq"), (_junk(rng), None), (None, "en"), ("", "de")]
    rows += [(_prose(rng, ["zu", "mit", "der", "die"]), "de")] * 200  # many copies are one text: no reference
    return [(k, t, lang) for k, (t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def plain_references(rows):
    texts, words, classes = {}, {}, {}
    for _, text, lang in rows:
        lang = (lang or "und").strip().lower()
        own = q.words_of(text or "")
        if q.fails_base(len(own), q.repeated_words(own)) or lang == "und":
            continue
        texts.setdefault(lang, set()).add(text)
        words.setdefault(lang, Counter()).update(q.words_of(text.lower()))
        classes[lang] = classes.get(lang, 0) + q.class_counts(text)
    good = [x for x in texts if len(texts[x]) >= q.MIN_TEXTS and sum(words[x].values()) >= q.MIN_REFERENCE_WORDS]
    return {x: (classes[x].astype(float), words[x]) for x in sorted(good)}


def plain_verdict(text, lang, references):
    own = q.words_of(text or "")
    if q.fails_base(len(own), q.repeated_words(own)):
        return False
    low, best = Counter(q.words_of(text.lower())), None
    for name, (classes, words) in references.items():
        top = sorted(words, key=lambda w: (-words[w], w))[:q.COMMON_WORDS]
        mine = np.array([low[w] for w in top] + [len(own) - sum(low[w] for w in top)], float)
        ref = np.array([words[w] for w in top] + [sum(words.values()) - sum(words[w] for w in top)], float)
        if name == lang:
            classes, ref = classes - q.class_counts(text), ref - mine
        c = q.divergence(q.class_counts(text).astype(float), classes) if len(text) >= q.GUARD_CHARS else 0.0
        w = q.divergence(mine, ref) if len(own) >= q.GUARD_WORDS and lang in ("und", *references) else 0.0
        at = (c / q.MAX_CLASS_DIVERGENCE + w / q.MAX_WORD_DIVERGENCE, c, w)
        best = min(best or at, at)
    return best is None or best[1] <= q.MAX_CLASS_DIVERGENCE and best[2] <= q.MAX_WORD_DIVERGENCE


def test_verdicts_equal_a_plain_recount(docs, rows):
    references = plain_references(rows)
    assert sorted(references) == ["en", "fr"]
    found = q.language_references(docs)
    assert {r.lang for r in found.select("lang").distinct().collect()} == {"en", "fr"}
    got = {r.doc_id: r for r in q.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for k, text, lang in rows:
        assert got[k].kept == plain_verdict(text, (lang or "und").strip().lower(), references), (k, lang)
        assert got[k].word_chars == sum(map(len, q.words_of(text or ""))) and got[k].n_symbols == sum((text or "").count(c) for c in q.SYMBOLS)
    kept = {k for k in got if got[k].kept}
    assert {k for k, t, lang in rows if lang in ("en", "fr ", "FR") and t and t[0].isalpha()} <= kept
    assert not kept & {k for k, t, _ in rows if t and not t[0].isalpha()}  # junk, whatever its mark
    assert {r.doc_id for r in q.keep_passing(docs).select("doc_id").collect()} == kept


def test_stray_codes_make_no_reference(spark, docs, rows):
    rng = random.Random(9)
    stray = spark.createDataFrame([(1000 + k, _junk(rng), "xq") for k in range(10)] + [(2000 + k, _junk(rng), None) for k in range(60)],
                                  "doc_id long, text string, lang string")
    got = q.quality_rules(docs.unionByName(stray)).where("kept").select("doc_id").collect()
    assert not any(r.doc_id >= 1000 for r in got)
    assert q.quality_rules(stray).where("not kept and not base_failed").count() == 0  # nothing to be held against


def test_distinct_texts_are_counted_over_flushed_sets(spark):
    rng = random.Random(2)
    texts = [_prose(rng, EN, 40) for _ in range(30)]
    docs = spark.createDataFrame([(t, "en") for t in texts * 3] + [(t, "fr") for t in texts[:29] * 3], "text string, lang string").repartition(7)
    langs = {r.lang for r in q.language_references(docs, min_texts=30, min_words=1).select("lang").distinct().collect()}
    assert langs == {"en"}
