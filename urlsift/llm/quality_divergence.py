"""Quality rules: base rules, then distribution divergence against language references.

References are learned from the corpus itself, over every document that passes the base rules: per language, the
histogram of character classes and the ``COMMON_WORDS`` most frequent words with their shares. Only a language with at
least ``MIN_TEXTS`` distinct passing texts and ``MIN_REFERENCE_WORDS`` words makes a reference, and rows without a
language mark never do, so no stray code vouches for the few rows that bear it. A document is held against the
reference of its language less its own share in it and, since language marks may be wrong, against all others; the
nearest counts. A language without a reference is judged by character classes alone, since its words are in none.
Both histograms are compared by Jensen-Shannon divergence (base 2, 0 to 1) behind minimum-length guards, since short
texts diverge by chance.

Scale. Pass one counts words per task in a bounded table (flushed when full), sums them with a shuffle on (language,
word) that no single word can make hot, because every task sends each word about once, and keeps the top words of
each language by a ranked window with early limiting. Distinct texts are counted up to ``MIN_TEXTS`` from the smallest
hashes of each task. Only that reference is broadcast: at most ``COMMON_WORDS`` words
for each language code, and codes are two or three letters (others count as one), which bounds it whatever the input.
Pass two scores documents where they lie. Repeated windows are found by doubling (1, 2, 4, 8 words) on positions that
still repeat, exactly and in memory linear in the document.

Defined results. Null or empty text: no words, base_failed. Null language: compared with all references. Where no language
has enough passing texts there is no reference, and no document fails by divergence. Rows are judged one by one, so repeated
rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsift.llm.common import narrow_batches, stored, text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = 64
GUARD_CHARS = 400  # shorter texts are not judged by character classes
GUARD_WORDS = 50  # nor by common words
MAX_CLASS_DIVERGENCE = 0.1  # clean labelled texts stay below 0.07, symbol-ridden ones begin near 0.11
MAX_WORD_DIVERGENCE = 0.26  # clean labelled texts stay below 0.19, tables and lists begin near 0.3
MIN_TEXTS = 50  # distinct passing texts that a language needs to make a reference
MIN_REFERENCE_WORDS = 5_000
TABLE_WORDS = 150_000  # entries of a task's counting table before it is flushed

CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "wide", "other")


def _class_table() -> bytes:
    out = bytearray([7] * 256)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:!?'\"()-")):
        for c in chars:
            out[ord(c)] = k
    for b in range(0x21, 0x7F):
        if out[b] == 7:
            out[b] = 5
    out[0xC0:0x100] = bytes([6]) * 64  # first bytes of characters beyond ASCII
    out[0x80:0xC0] = bytes([8]) * 64  # their further bytes: not counted
    return bytes(out)


_CLASS_OF = _class_table()


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_CLASS_OF), np.uint8)
    return np.bincount(codes, minlength=9)[:8]


def _repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes and a mark where a code occurs twice or more."""
    _, dense, n = np.unique(codes, return_inverse=True, return_counts=True)
    return dense, n[dense] > 1


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[str, int] = {}
    codes = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    marks = np.bincount(codes)[codes] > 1
    run = np.concatenate([[0], np.cumsum(marks)])
    at = np.flatnonzero(run[window:] - run[:-window] == window)  # windows made of words that all repeat
    if len(at) < 2:
        return 0
    live = np.zeros(n, bool)  # positions inside such windows
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    live = np.cumsum(edge)[:n] > 0
    size, code = 1, codes
    while size < window:
        at = np.flatnonzero(live[: n - 2 * size + 1] & live[size: n - size + 1])
        dense, again = _repeats(code[at] * (int(code.max()) + 1) + code[at + size])
        code, live = np.zeros(n, np.int64), np.zeros(n, bool)
        code[at], live[at] = dense, again
        size *= 2
        if not again.any():
            return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(live)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_counts(text: str) -> dict[str, int]:
    words = words_of(text)
    lines = [x for x in text.split("\n") if x and not x.isspace() or words_of(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words)}


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence (base 2) of two histograms; 0 if either is empty."""
    a, b = float(p.sum()), float(q.sum())
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2

    def kl(x):
        own = x > 0
        return float((x[own] * np.log2(x[own] / m[own])).sum())

    return min(1.0, max(0.0, (kl(p) + kl(q)) / 2))


def _language(col):
    code = F.lower(F.trim(col))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.lit("und"))


def _lang_column(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(_language(F.col(f"`{lang_col}`")), F.lit("und")) if lang_col in docs.columns else F.lit("und")


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_texts: int = MIN_TEXTS,
                        min_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """``lang, kind ('class', 'word' or 'total'), key, n`` over all documents that pass the base rules, for the languages
    with at least ``min_texts`` distinct such texts and ``min_words`` words."""
    narrow_batches(docs.sparkSession)
    source = docs.select(_lang_column(docs, lang_col).alias("lang"), text_of(text_col).alias("text")).where("lang != 'und'")

    def count(batches):
        import xxhash

        counts, classes, totals, texts = {}, {}, Counter(), {}

        def smallest(hashes):
            return set(heapq.nsmallest(min_texts, hashes))

        def rows(table, kind):
            out = [(lang, kind, k, n) for lang, c in table.items() for k, n in c.items()]
            table.clear()
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                              names=["lang", "kind", "key", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                if fails_base(len(words), repeated_words(words)):
                    continue
                lang = langs[k]
                own = texts.setdefault(lang, set())
                own.add(xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))
                if len(own) > 2 * min_texts + 1000:
                    texts[lang] = smallest(own)
                counts.setdefault(lang, Counter()).update(words_of(text.lower()))
                totals[lang] += len(words)
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, counts.values())) > TABLE_WORDS:
                yield rows(counts, "word")
        yield rows(counts, "word")
        yield rows({lang: {"": n} for lang, n in totals.items()}, "total")
        yield rows({lang: dict.fromkeys(smallest(own), 1) for lang, own in texts.items()}, "text")
        yield rows({lang: dict(zip(CLASSES, map(int, c), strict=True)) for lang, c in classes.items()}, "class")

    raw = source.mapInArrow(count, "lang string, kind string, key string, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    raw = stored(raw, "reference-counts")
    enough = (raw.where("kind in ('text', 'total')").groupBy("lang")
              .agg(F.count_if(F.col("kind") == "text").alias("texts"), F.sum(F.when(F.col("kind") == "total", F.col("n"))).alias("words"))
              .where((F.col("texts") >= min_texts) & (F.col("words") >= min_words)).select("lang"))
    raw = raw.where("kind != 'text'").join(F.broadcast(enough), "lang", "left_semi")  # codes of two or three letters
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = raw.where("kind = 'word'").withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).drop("rank")  # limited before the shuffle
    return stored(raw.where("kind != 'word'").unionByName(top), "references")


def _collect_references(references: DataFrame) -> list[tuple[str, np.ndarray, dict[str, int], np.ndarray]]:
    """(language, class histogram, word to bin, word histogram with all other words last). Bounded: see above."""
    classes, words, totals = {}, {}, {}
    for r in references.collect():
        if r.kind == "total":
            totals[r.lang] = r.n
        elif r.kind == "class":
            classes.setdefault(r.lang, {})[r.key] = r.n
        else:
            words.setdefault(r.lang, []).append((-r.n, r.key))
    out = []
    for lang in sorted(classes):
        top = sorted(words.get(lang, []))
        seen = sum(-n for n, _ in top)
        out.append((lang, np.array([classes[lang].get(c, 0) for c in CLASSES], float), {w: k for k, (_, w) in enumerate(top)},
                    np.array([-n for n, _ in top] + [max(0, totals.get(lang, 0) - seen)], float)))
    return out


def nearest(text: str, words: list[str], references, lang: str | None = None) -> tuple[float, float]:
    """Divergences of classes and of common words from the reference that is nearest by their sum. The text's own counts
    are taken out of the reference of its language, ``lang``."""
    best = (math.inf, 0.0, 0.0)
    unknown = lang not in (None, "und") and all(name != lang for name, *_ in references)
    classes = class_counts(text).astype(float)
    judge_classes = len(text) >= GUARD_CHARS
    counts = Counter(words) if len(words) >= GUARD_WORDS and not unknown else None
    for name, ref_classes, bins, ref_words in references:
        c = 0.0
        if judge_classes:
            c = divergence(classes, np.maximum(ref_classes - classes, 0) if name == lang else ref_classes)
        w = 0.0
        if counts is not None:
            own = np.zeros(len(ref_words))
            for word, k in bins.items():
                own[k] = counts.get(word, 0)
            own[-1] = len(words) - own.sum()
            w = divergence(own, np.maximum(ref_words - own, 0) if name == lang else ref_words)
        best = min(best, (c / MAX_CLASS_DIVERGENCE + w / MAX_WORD_DIVERGENCE, c, w))
    return best[1:]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  references: DataFrame | None = None) -> DataFrame:
    """Base counts, ``base_failed``, the two divergences and ``kept`` for every row of ``docs``."""
    found = references if references is not None else language_references(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(_collect_references(found))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), _lang_column(docs, lang_col).alias("lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches):
        for batch in batches:
            out = {n: [] for n in (*counts, "base_failed", "class_divergence", "word_divergence", "kept")}
            for text, lang in zip(batch.column(1), batch.column(2), strict=True):
                row = judged(text.as_py(), shared.value, lang.as_py())
                for n, column in out.items():
                    column.append(row[n])
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True))],
                                             names=["id", *out])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(judge, f"id {kind}, " + ", ".join(f"{n} long" for n in counts)
                             + ", base_failed boolean, class_divergence double, word_divergence double, kept boolean").withColumnRenamed("id", id_col)


def judged(text: str, references, lang: str | None = None) -> dict:
    row = base_counts(text)
    failed = fails_base(row["n_words"], row["n_repeat_words"])
    c, w = (0.0, 0.0) if failed or not references else nearest(text, words_of(text.lower()), references, lang)
    return row | {"base_failed": failed, "class_divergence": c, "word_divergence": w,
                  "kept": not failed and c <= MAX_CLASS_DIVERGENCE and w <= MAX_WORD_DIVERGENCE}


def keep_passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; texts stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(_collect_references(language_references(docs, text_col, lang_col)))

    @F.pandas_udf("boolean")
    def passes(text, lang):
        import pandas as pd

        return pd.Series([judged(t, shared.value, x)["kept"] for t, x in zip(text, lang, strict=True)], dtype=bool)

    return docs.where(passes(text_of(text_col), _lang_column(docs, lang_col)))
