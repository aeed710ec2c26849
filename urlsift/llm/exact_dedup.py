"""Exact dedup by two-pass Bloom filtering.

Texts are equal when identical after deleting white space. Pass one records every text hash in a Bloom filter
with two planes of bits: "hit" and "hit again". Only a row whose probes all fall on bits that were hit again can
have an equal elsewhere, so pass two sends just those rows through a shuffle; all others pass straight through.

Scale. The filter is built from per-task bit blocks, which a second step folds block by block in a stream, so no
task holds more than a few blocks. Its size follows the row count (``BITS_PER_ROW``) up to ``MAX_FILTER_BITS``:
what is broadcast is never above 32 MB. Beyond that bound the filter fills up and lets more rows through to the
shuffle; the result stays exact because equal hashes are always grouped by the full SHA-256. Groups are reduced
with partial aggregation before the shuffle, and a kept row is found by joining on (hash, id), a key that one
large group of copies cannot make hot.

Defined results. Null text is the empty text. Of equal texts, the one with the most code points stays, then the
smallest id, null ids last. Rows that share id and text are one document: each gets the same decision, and
:func:`drop_exact_duplicates` keeps one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import SPACE_CHARS, partitions_for, stored, text_of

PROBES = 4
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28  # 32 MB broadcast at most
BLOCK_BITS = 1 << 18
_BLOCK_BYTES = BLOCK_BITS // 8


def text_hash(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(text, SPACE_CHARS, ""), 256))


def _positions(hashes: list[bytes], bits: int) -> np.ndarray:
    """The ``PROBES`` bit positions of each hash: its 64-bit words modulo the filter size."""
    return np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, PROBES) % np.uint64(bits)


def filter_bits(rows: int) -> int:
    return min(MAX_FILTER_BITS, partitions_for(rows * BITS_PER_ROW, BLOCK_BITS, 1) * BLOCK_BITS)


def repeated_plane(digest: DataFrame, rows: int) -> np.ndarray:
    """The "hit again" plane over ``digest.h``: a byte array of ``filter_bits(rows)`` bits."""
    bits = filter_bits(rows)

    def local_blocks(batches):
        hit, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            at, n = np.unique(_positions(batch.column(0).to_pylist(), bits), return_counts=True)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
            old = (hit[byte] & bit) != 0
            np.bitwise_or.at(again, byte[old | (n > 1)], bit[old | (n > 1)])
            np.bitwise_or.at(hit, byte, bit)
        for k in range(bits // BLOCK_BITS if seen else 0):
            part = slice(k * _BLOCK_BYTES, (k + 1) * _BLOCK_BYTES)
            if hit[part].any():
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([k], pa.int64()), "hit": pa.array([zlib.compress(hit[part].tobytes(), 1)]),
                    "again": pa.array([zlib.compress(again[part].tobytes(), 1)])})

    def fold(batches):
        block, hit, again = None, None, None
        for batch in batches:
            for k, h, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (h, a))
                if k != block:
                    if block is not None:
                        yield _block(block, again)
                    block, hit, again = k, h.copy(), a.copy()
                else:
                    again |= a | (hit & h)
                    hit |= h
        if block is not None:
            yield _block(block, again)

    def _block(k, again):
        return pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()),
                                           "again": pa.array([zlib.compress(again.tobytes(), 1)])})

    local = digest.select("h").mapInArrow(local_blocks, "block long, hit binary, again binary")
    parts = min(bits // BLOCK_BITS, 512)
    folded = (local.repartition(parts, "block").sortWithinPartitions("block")
              .mapInArrow(fold, "block long, again binary"))
    plane = np.zeros(bits // 8, np.uint8)
    for row in folded.toLocalIterator():  # at most MAX_FILTER_BITS / 8 bytes in all
        plane[row.block * _BLOCK_BYTES:(row.block + 1) * _BLOCK_BYTES] = np.frombuffer(zlib.decompress(row.again), np.uint8)
    return plane


def maybe_repeated(spark, plane: np.ndarray):
    """Scalar function over the hash column: whether every probe falls on a bit that was hit again."""
    shared, bits = spark.sparkContext.broadcast(plane), len(plane) * 8

    @F.pandas_udf("boolean")
    def probe(h):
        import pandas as pd

        if not len(h):
            return pd.Series([], dtype=bool)
        at = _positions(list(h), bits)
        byte = shared.value[(at >> np.uint64(3)).astype(np.int64)]
        return pd.Series(((byte >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))

    return probe


def _digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_of(text_col)).alias("h"),
                              F.char_length(text_of(text_col)).cast("long").alias("n")), "digest")


def _winners(candidates: DataFrame) -> DataFrame:
    """One row per repeated hash: the id that stays and the size of the group (partial aggregation first)."""
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = candidates.groupBy("h").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return stored(groups.select("h", F.col("best.id").alias("keep_id"), "group_size"), "winners")


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, keep_id, group_size, kept, text_sha256`` for every row of ``docs``, dropped ones included."""
    spark = docs.sparkSession
    digest = _digest(docs, id_col, text_col)
    probe = maybe_repeated(spark, repeated_plane(digest, digest.count()))
    flagged = stored(digest.withColumn("maybe", probe("h")), "flagged")
    winners = _winners(flagged.where("maybe"))
    alone = flagged.where("not maybe").select("id", "h", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = flagged.where("maybe").join(winners, "h").select("id", "h", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("h")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Rows outside the candidate set do not move."""
    spark, columns = docs.sparkSession, docs.columns
    digest = _digest(docs, id_col, text_col)
    probe = maybe_repeated(spark, repeated_plane(digest, digest.count()))
    winners = _winners(digest.where(probe("h")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
                         text_hash(text_of(text_col)).alias("h")).withColumn("maybe", probe("h"))
    stays = (marked.where("maybe").alias("d").join(
        winners.alias("w"), (F.col("d.h") == F.col("w.h")) & F.col(f"d.row.`{id_col}`").eqNullSafe(F.col("w.keep_id")), "left_semi")
        .dropDuplicates(["h"]))
    return marked.where("not maybe").select("row.*").unionByName(stays.select("row.*"))
