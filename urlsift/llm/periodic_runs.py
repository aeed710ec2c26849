"""Periodic runs of words in a text, by online dyadic square catching.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), at least ``MIN_LENGTH``
words and ``MIN_REPEATS`` periods long, that no neighbouring word extends.

Method. The words of a text are appended one after the other. Whenever a block of 2^k words, aligned to 2^k, is complete,
it becomes the level's catcher and stays open while the next 2^k words are appended: so at every moment a level has one
catcher, and it watches the periods from 2^k to 2^(k+1) - 1. A word's suffix comparison at a level holds the window of 2^k
words around it against the open catcher. A hit at distance p is a possible square; comparing word by word to both
sides gives the whole stretch of period p, into which the squares at all its words merge. Any two periods of a run hold an
aligned block of 2^k words, and its copy one period on lies in the run too, so every run with three periods is caught.
Short periods need no smaller blocks: a run of 24 words with a period up to 8 is 16 words longer than its period, so the
blocks of 8 words watch the periods from 1 on.

The comparisons of one level do not depend on one another, so those of all words of a few texts are one array operation
(``_hits``); words are numbers given to distinct words, windows are compared by hashes doubled from level to
level and every hit is confirmed on the numbers. Hits inside a found run of a smaller period are multiples of it
and go first; a stretch that is already known as a run has a smaller period and is not reported again. So a text costs
O(n log n) array steps, also when it repeats one word throughout.

Scale. One pass, no shuffle; a task holds one text (or about ``CHUNK_WORDS`` words of short ones) at a time.

Defined results. A null text has no words. Rows are independent: null or repeated ids are carried along. Texts without
runs have null digest columns but the two hashes. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urlsift.llm.common import id_text, words_of

MIN_LENGTH = 24
MIN_REPEATS = 3
BASE = 8  # words of the smallest blocks
CHUNK_WORDS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of 2 * ``size`` words from those of ``size`` words."""
    return _mix(h[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + h[size:]) if len(h) > size else h[:0]


def _hits(windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, period) of every window that equals the catcher open at it: the block before its own."""
    at = np.arange(size, len(windows))
    block = (at // size - 1) * size
    found = np.flatnonzero(windows[block] == windows[at])
    return block[found], at[found] - block[found]


def _same(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from ``a`` and ``b`` on are equal, ``most`` at most (step -1 is done on reversed arrays)."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        differ = words[a + done:a + done + step] != words[b + done:b + done + step]
        first = int(differ.argmax()) if differ.any() else step
        done += first
        if first < step:
            break
        step *= 2
    return done


class SquareCatcher:
    """Runs of an array of word numbers; a negative number equals no other word (it ends a text)."""

    def __init__(self, words: np.ndarray):
        self.words, self.back, self.n = words, words[::-1], len(words)
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    def run(self) -> dict[tuple[int, int], int]:
        h, size = _mix(self.words.astype(np.uint64) + np.uint64(1)), 1
        while size < BASE:
            h, size = _doubled(h, size), size * 2
        self._short_periods(h)
        while len(h) > size:
            self._merge(*_hits(h, size), size)
            h, size = _doubled(h, size), size * 2
        return self.runs

    def _short_periods(self, h: np.ndarray) -> None:
        """Periods below ``BASE``: the blocks of ``BASE`` words are held against the windows that overlap them."""
        for period in range(1, BASE):
            block = np.arange(0, max(0, len(h) - period), BASE)
            block = block[h[block] == h[block + period]]
            self._merge(block, np.full(len(block), period), BASE)

    def _merge(self, block: np.ndarray, period: np.ndarray, size: int) -> None:
        """Hits to runs: hits within a run of a smaller period are dropped, the others extended to both sides."""
        if self.runs and len(block):
            known = np.array(sorted(self.runs), np.int64)
            reach = np.maximum.accumulate(known[:, 1])
            left = np.searchsorted(known[:, 0], block, side="right") - 1
            new = (left < 0) | (reach[left] < block + period + size)
            block, period = block[new], period[new]
        order = np.lexsort((block, period))
        last, end = 0, 0
        for b, p in zip(block[order].tolist(), period[order].tolist(), strict=True):
            if p == last and b + p < end:
                continue  # a square of the stretch just found
            right = b + p + _same(self.words, b, b + p, self.n - b - p)
            if right < b + p + size:
                continue  # equal hashes of different windows
            start = b - _same(self.back, self.n - b, self.n - b - p, b)
            last, end = p, right
            if right - start >= max(MIN_LENGTH, MIN_REPEATS * p):
                self.runs.setdefault((start, right), p)


def periodic_stretches(texts: list[list[str]]) -> Iterator[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (a list of words), by start, then period."""
    number = defaultdict(count().__next__)
    solid = [k for k, words in enumerate(texts) if len(words) >= MIN_LENGTH]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if solid:
        sizes = [len(texts[k]) + 1 for k in solid]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(begin[-1], np.int64)
        for at, (k, a) in enumerate(zip(solid, begin.tolist(), strict=False)):
            ids[a:a + len(texts[k])] = np.fromiter(map(number.__getitem__, texts[k]), np.int64, len(texts[k]))
            ids[a + len(texts[k])] = -1 - at
        for (start, end), period in SquareCatcher(ids).run().items():
            k = int(np.searchsorted(begin, start, side="right")) - 1
            out[solid[k]].append((start - int(begin[k]), end - start, period))
    for runs in out:
        yield sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one space: of every run the first period stays."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return " ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  change: Callable[[object, list[str]], list[str]] | None = None, spans: bool = False) -> DataFrame:
    """Per row ``<id_col>, n_runs, start, length, period, exponent_milli`` (of the strongest run), ``runs_sha256,
    collapsed_sha256``; with ``spans`` also ``runs`` (array of start, length, period) and ``collapsed`` (the text without
    repeats). ``change`` maps (id, words) to the words that are searched."""
    source = id_text(docs, id_col, text_col)

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            k = 0
            while k < len(texts):
                held, size, first = [], 0, k
                while k < len(texts) and size < CHUNK_WORDS:
                    words = words_of(texts[k].as_py())
                    words = words if change is None else change(ids[k].as_py(), words)
                    held.append(words)
                    size += len(words)
                    k += 1
                yield _table(ids.slice(first, len(held)), held)

    def _table(ids, texts):
        cols = defaultdict(list)
        for words, runs in zip(texts, periodic_stretches(texts), strict=True):
            top = strongest(runs)
            cols["n_runs"].append(len(runs))
            for name, value in zip(("start", "length", "period"), top or (None,) * 3, strict=True):
                cols[name].append(value)
            cols["exponent_milli"].append(1000 * top[1] // top[2] if top else None)
            rest = collapsed(words, runs)
            cols["runs_sha256"].append(_hex("".join(f"{s},{n},{p}\n" for s, n, p in runs)))
            cols["collapsed_sha256"].append(_hex(rest))
            if spans:
                cols["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                cols["collapsed"].append(rest)
        kinds = {name: pa.int64() for name in ("n_runs", "start", "length", "period", "exponent_milli")} | {
            "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}
        return pa.RecordBatch.from_arrays([ids, *(pa.array(v, kinds.get(c, pa.string())) for c, v in cols.items())], names=[id_col, *cols])

    kind = source.schema["id"].dataType.simpleString()
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if spans else ""
    return source.mapInArrow(rows, f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
                                   f"runs_sha256 string, collapsed_sha256 string{more}")


def cycled(doc_id: object, words: list[str]) -> list[str]:
    """The query's input rule: with h = crc32 of the decimal id, one text in ten repeats its words from a on with
    period p. A row without an id stays as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]
