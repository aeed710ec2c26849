"""Spelling variants: words of a vocabulary one edit apart, each led to its much more frequent near word.

Method. Words are scanned as sorted lists. The edit matrix of a word and the list is filled row by row for the list
word's code points, in a band of three cells (one edit); the next list word keeps the rows of the prefix it shares with
the word before (adjacent longest common prefixes), and once no cell of a row is within one edit, all words with that
prefix are skipped (links to the next smaller common prefix).

Distribution. Two words one edit apart are equal before the edit and behind it, so with m the length of the shorter one
they share their first or their last m / 2 code points. Each word goes into the lists of its own length and of the
length below, once by its first and once by its last half. A list that has grown past ``LIST_WORDS`` is dealt out again by
the same argument on what is left in the middle; in the end all but one code point are shared, so no list can hold more
than A + A * A words of an alphabet of A. A pair is taken in one list only: first halves decide by the length of the common prefix.
A list gives one row per word that has near words (their number and the best of them), never the pairs.

Counting. Distinct words are counted within a task before they are shuffled, so a frequent word costs a row per task.
Roots come from pointer doubling over stored tables: a word's form is at least ``ratio`` times as frequent, so a
chain has at most log(n) steps and few rounds are needed.

Defined results. A null text has no words, a null id is the empty id. Rows with one id are separate rows. A vocabulary
without words gives an empty result. Ties in n: the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, stored

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
LIST_WORDS = 100  # a list with more words is dealt out by a further part of the word
HELD_WORDS = 200_000  # distinct words a task holds before it hands on their counts
NO_END = 1 << 30


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                change: Callable[[object, str], str] | None = None) -> DataFrame:
    """``word, n``: runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lowered, of at least ``min_length`` code points and
    ``min_count`` occurrences over all texts. ``change`` maps (id, run) to the word counted; it may shorten the run."""
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")  # a shorter run can only lose code points

    def count(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(run.findall(text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if change is None:
                    total.update(own)
                else:
                    for word, n in own.items():
                        word = change(key, word)
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) > HELD_WORDS:
                    yield _counts(total)
                    total.clear()
        if total:
            yield _counts(total)

    def _counts(total):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counted = id_text(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def near_in_list(words: list[str], shorter: int, upper: int = NO_END):
    """Index pairs of a sorted list of distinct words (``shorter`` or one more code points long) that are one edit
    apart, one of them ``shorter`` long, with a common prefix below ``upper``."""
    n = len(words)
    shared, jump = [0] * (n + 1), [n] * (n + 1)  # common prefix with the word before; next index with a smaller one
    for k in range(1, n):
        a, b = words[k - 1], words[k]
        most = min(len(a), len(b))
        d = 0
        while d < most and a[d] == b[d]:
            d += 1
        shared[k] = d
    shared[n] = -1
    open_at: list[int] = []
    for k in range(1, n + 1):
        while open_at and shared[open_at[-1]] > shared[k]:
            jump[open_at.pop()] = k
        open_at.append(k)
    for i in range(n - 1):
        size = len(words[i])
        q = words[i] + "\0\0\0"
        depth = common = shared[i + 1]
        rows: list = [(1, 0, 1)] * (depth + 1) + [None] * (shorter + 2 - depth)
        if depth == 0:
            rows[0] = (2, 0, 1)
        j = i + 1
        while j < n:
            if shared[j] < depth:
                depth = shared[j]
            if shared[j] < common:
                common = shared[j]
            w = words[j]
            a, b, c = rows[depth]
            dead = -1
            for d in range(depth, len(w)):
                x = w[d]
                # the cells one left of, on and one right of the diagonal
                below = b + 1
                if x != q[d - 1]:
                    a += 1
                if below < a:
                    a = below
                if x != q[d]:
                    b += 1
                if a < b - 1:
                    b = a + 1
                if c < b - 1:
                    b = c + 1
                if x != q[d + 1]:
                    c += 1
                if b < c - 1:
                    c = b + 1
                rows[d + 1] = (a, b, c)
                if a > 1 and b > 1 and c > 1:
                    dead = d
                    break
            if dead >= 0:
                depth, j = dead, j + 1
                while shared[j] > dead:  # all words that share the dead prefix
                    j = jump[j]
                continue
            depth = len(w)
            if size + depth <= 2 * shorter + 1 and common < upper and (a, b, c)[size - depth + 1] == 1:
                yield i, j
            j += 1


def _lists(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """``word, n, m, at, upper, cut, key``: every word in its first lists. ``at`` leading and ``cut`` trailing code points are shared."""
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.when(size > min_length, F.array(size, size - 1)).otherwise(F.array(size))).alias("m"))
    rows = rows.withColumns({"at": F.lit(0), "upper": F.lit(NO_END), "cut": F.lit(0), "key": F.col("m").cast("string")})
    return _dealt(rows)


def _dealt(rows: DataFrame) -> DataFrame:
    """Every row twice: by the first and by the last half of what its list does not share yet."""
    half = F.expr("(m - at - cut) div 2").cast("int")
    by_first = F.struct((F.col("at") + half).alias("at"), F.col("upper"), F.col("cut"),
                        F.concat("key", F.lit("f"), F.expr("substring(word, at + 1, (m - at - cut) div 2)")).alias("key"))
    by_last = F.struct(F.col("at"), (F.col("at") + half).alias("upper"), (F.col("cut") + half).alias("cut"),
                       F.concat("key", F.lit("l"), F.expr("substring(word, length(word) - cut - (m - at - cut) div 2 + 1, (m - at - cut) div 2)")).alias("key"))
    return rows.select("word", "n", "m", F.explode(F.array(by_first, by_last)).alias("s")).select("word", "n", "m", "s.*")


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, list_words: int = LIST_WORDS) -> DataFrame:
    """``word, n_near, best`` (struct of -n and word, the most frequent near word) for the words with a near word."""
    parts, rows = [], stored(_lists(vocabulary, min_length), "spelling-lists")
    while True:
        long = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min(F.expr("m - at - cut")).alias("left"))
                      .where((F.col("k") > list_words) & (F.col("left") > 1)).select("key"), "spelling-long")
        if long.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(long, "key", "left_anti"))
        rows = stored(_dealt(rows.join(long, "key", "left_semi").select(*rows.columns)), "spelling-lists")
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)

    def scan(batches):
        key, words, counts, m, upper = None, [], [], 0, 0
        out: list[tuple] = []
        for batch in batches:
            for k, w, n, length, bound in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "upper")), strict=True):
                if k != key:
                    out += _best(words, counts, m, upper)
                    key, words, counts, m, upper = k, [], [], length, bound
                    if len(out) > 20_000:
                        yield _found(out)
                        out = []
                words.append(w)
                counts.append(n)
        yield _found(out + _best(words, counts, m, upper))

    def _best(words, counts, m, upper):
        if len(words) < 2:
            return []
        near: dict[int, tuple] = {}
        for i, j in near_in_list(words, m, upper):
            for a, b in ((i, j), (j, i)):
                k, n, w = near.get(a, (0, 0, ""))
                better = (-counts[b], words[b]) < (n, w) if k else True
                near[a] = (k + 1, -counts[b], words[b]) if better else (k + 1, n, w)
        return [(words[a], *v) for a, v in near.items()]

    def _found(out):
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                          names=["word", "n_near", "less_n", "near"])

    found = lists.select("key", "word", "n", "m", "upper").repartition("key").sortWithinPartitions("key", "word").mapInArrow(
        scan, "word string, n_near long, less_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less_n", "near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word of every chain of forms, by doubling."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary. ``form`` is the near word with the
    largest n where that is at least ``ratio`` times the word's n, else null; ``root`` the end of the chain of forms."""
    vocabulary = stored(word_counts(docs, id_col, text_col, min_length, min_count, change), "spelling-vocabulary")
    led = F.col("form_n") >= ratio * F.col("n")
    words = stored(vocabulary.join(near_words(vocabulary, min_length), "word", "left")
                   .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less_n")).alias("form_n"))
                   .select("word", "n", "n_near", F.when(led, F.col("near")).alias("form"), F.when(led, F.col("form_n")).alias("form_n")), "spelling-words")
    roots = _roots(words.where("form is not null"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_dropped(doc_id: object, run: str) -> str:
    """The query's input rule: with h = crc32 of ``<doc_id>:<run>``, a run whose h is divided by 199 loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % 199:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]
