"""Packing of token sequences: shortest pack first over the length histogram.

Documents are tokenised once and cut into full sequences plus one rest piece; the checksum of every piece is taken
on the way, so token ids never move. From then on only (length, rank) matters: the histogram of piece lengths has at
most ``max_tokens`` entries and is the only thing the driver sees. Packing places lengths longest first, each on the
shortest pack it fits, and keeps counts of packing patterns rather than packs. Patterns are then joined back to pieces
by rank among the pieces of one length.

Scale. A rank is a piece's place within its own input task plus the number of pieces of that length in earlier tasks;
no window runs over all pieces of a length, however common the length is. The pattern table has a few entries per
length (a bound set by ``max_tokens``, not by the data) and is broadcast.

Defined results. Null or empty text is one piece that holds only the end id. Repeated and null ids are packed like
any other row; equal rows give equal pieces in different places. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, stored
from urlsift.llm.tokenizing import ByteLevelEncoder, encoder

MAX_TOKENS = 2048
END_ID = 1


def pack_histogram(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns ``(count, [(length, times), ...])`` with every length placed as often as it occurs.

    Lengths go longest first. Each is put on the shortest pack that still has room; as many packs of that pattern as
    there are pieces left change at once, so the work depends on the number of patterns, not of pieces."""
    open_by_total: dict[int, list[tuple[int, tuple]]] = {}
    closed: list[tuple[int, tuple]] = []

    def put(total: int, count: int, pattern: tuple) -> None:
        if total == max_tokens:
            closed.append((count, pattern))
        else:
            open_by_total.setdefault(total, []).append((count, pattern))

    def plus(pattern: tuple, length: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + 1))
        return (*pattern, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            total = min(open_by_total, default=max_tokens)
            if total + length > max_tokens:  # the shortest pack has no room, so no pack has
                fit = max_tokens // length
                if fit > 1 and left >= fit:
                    put(fit * length, left // fit, ((length, fit),))
                    left %= fit
                else:
                    put(length, 1 if fit > 1 else left, ((length, 1),))
                    left -= 1 if fit > 1 else left
                continue
            count, pattern = open_by_total[total].pop()
            if not open_by_total[total]:
                del open_by_total[total]
            used = min(count, left)
            if count > used:
                put(total, count - used, pattern)
            put(total + length, used, plus(pattern, length))
            left -= used
    return [(c, list(p)) for c, p in closed] + [(c, list(p)) for packs in open_by_total.values() for c, p in packs]


def pattern_slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The patterns as intervals of ranks. Pieces of one length with ranks ``first .. first + count * times - 1`` lie
    in ``count`` sequences from ``sequence`` on, ``times`` in each, side by side from ``offset`` on."""
    rows, placed, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = placed.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            placed[length] = first + count * times
            offset += length * times
        sequence += count
    rows.sort()
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return {k: np.array(v, np.int64) for k, v in zip(("length", "first", "times", "sequence", "offset"), columns, strict=True)}


def tokenized_pieces(docs: DataFrame, vocab_path: str, pattern: str, id_col: str, text_col: str, max_tokens: int,
                     end_id: int) -> DataFrame:
    """Every document cut into pieces: ``id, start, length, ids_crc32, doc_tokens, task, local_rank``. ``local_rank``
    counts pieces of one length within the input task."""
    source = id_text(docs, id_col, text_col)
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        from pyspark import TaskContext

        enc, task, seen = encoder(ByteLevelEncoder, vocab_path, pattern), TaskContext.get().partitionId(), {}
        for batch in batches:
            at, start, length, crc, doc_tokens, rank = ([] for _ in range(6))
            for k, text in enumerate(batch.column(1)):
                ids = memoryview(enc.ids(text.as_py()) + end)
                total = len(ids) // 4
                for first in range(0, total, max_tokens):
                    size = min(max_tokens, total - first)
                    at.append(k)
                    start.append(first)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * first:4 * (first + size)]))
                    doc_tokens.append(total)
                    rank.append(seen.get(size, 0))
                    seen[size] = rank[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, doc_tokens)),
                 pa.array([task] * len(at), pa.int64()), pa.array(rank, pa.int64())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "local_rank"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, local_rank long")


def pack_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece."""
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, vocab_path, pattern, id_col, text_col, max_tokens, end_id), "pieces")
    per_task = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= max_tokens rows
    slots = spark.sparkContext.broadcast(pattern_slots(pack_histogram(histogram, max_tokens)))
    before = per_task.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        s = slots.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = s["length"] << 44 | s["first"]  # sorted, as slots are; ranks stay below 2^44
        k = np.searchsorted(key, length << 44 | rank, side="right") - 1
        within = rank - s["first"][k]
        return pd.DataFrame({"sequence_id": s["sequence"][k] + within // s["times"][k],
                             "offset": s["offset"][k] + within % s["times"][k] * length})

    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("local_rank") + F.coalesce("before", F.lit(0)))
    return ranked.withColumn("at", place("length", "rank")).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
