"""Token-id files in Simple-8b word-aligned code.

A 64-bit word holds a selector in its top four bits and, below, as many ids as its width allows: 60 ids of one bit up
to one id of 60 bits. Selector 15 is the escape: the word after it is one raw 64-bit value. A segment is a
self-contained byte image: header, per-document table (id counts and word offsets) and the words. Because every
block's word offset is stored, any document can be decoded alone and all words of a segment are unpacked at once,
selector by selector, with array operations.

Files. Executors have no shared local disk, so segments are written through Spark as rows of Parquet files in
the given folder, one row per segment; the segment bytes are the format above, stored uncompressed. Documents are
ordered by id through a range partitioning, and a segment closes at ``SEGMENT_IDS`` ids, so memory is bounded by one
segment and one document. Each document's start (ids of all documents before it) is a running sum within a file
plus the totals of the files before it: no task sees more than one file's rows.

Defined results. Null or empty text gives only the end id. Null document ids come first. Rows with equal ids lie side
by side, ordered by their text, each with its own start. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, stored
from urlsift.llm.tokenizing import WordEndEncoder, encoder

SEGMENT_IDS = 1 << 18
MAGIC = b"S8B1"
# selector: (ids in a word, bits of each)
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_COUNT = np.array([n for n, _ in PACKINGS] + [0, 1], np.int64)


def _widest(bits: np.ndarray) -> np.ndarray:
    """For every position, how many ids the best word beginning there holds (0: it needs an escape)."""
    n, window = len(bits), {1: bits}
    best = np.where(bits <= 60, 1, 0).astype(np.uint8)

    def widen(a: int, b: int) -> np.ndarray:  # maximum over a + b ids, from those over a and over b
        x, y = window[a], window[b]
        out = np.full(n, 255, np.uint8)
        if n > a:
            out[:n - a] = np.maximum(x[:n - a], y[a:])
        return out

    for size, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 3, 2), (6, 3, 3), (7, 4, 3), (8, 4, 4), (10, 5, 5), (12, 6, 6),
                       (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30)):
        window[size] = widen(a, b)
        width = next(w for c, w in PACKINGS if c == size)
        fits = window[size] <= width
        if not fits.any():
            if size >= 8:
                break
            continue
        best[fits] = size
    return best


_SELECTOR_OF = np.full(61, ESCAPE, np.uint8)
for _k, (_n, _w) in enumerate(PACKINGS):
    _SELECTOR_OF[_n] = _k


def pack_words(values: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, list[int]]:
    """Words of the documents that lie one behind another in ``values``; no word spans two documents. Returns the
    words and each document's number of words."""
    values = values.astype(np.uint64)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    # a mark of 255 bits behind each document keeps windows from running into the next
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    big = values >= (1 << 52)
    if big.any():
        width[big] = [int(v).bit_length() for v in values[big]]
    width[values == 0] = 1
    marked = np.insert(width, ends, 255)
    widest = _widest(marked)
    best = widest.tolist()
    starts, doc_words, at = [], [], 0
    for size in sizes:
        stop, first, escapes = at + size, len(starts), 0
        while at < stop:
            starts.append(at)
            hop = best[at]
            if not hop:
                escapes += 1
                hop = 1
            at += hop
        at += 1
        doc_words.append(len(starts) - first + escapes)
    start = np.array(starts, np.int64)
    chosen = _SELECTOR_OF[widest[start]] if len(start) else np.zeros(0, np.uint8)
    source = np.zeros(len(marked), np.uint64)
    own = np.ones(len(marked), bool)
    own[ends + np.arange(len(ends))] = False
    source[own] = values
    slot = np.arange(len(start)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(start) + int((chosen == ESCAPE).sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS):
        own = np.flatnonzero(chosen == k)
        if len(own):
            word = np.full(len(own), np.uint64(k) << np.uint64(60), np.uint64)
            for j in range(count):
                word |= source[start[own] + j] << np.uint64(j * bits)
            words[slot[own]] = word
    own = np.flatnonzero(chosen == ESCAPE)
    words[slot[own]] = np.uint64(ESCAPE) << np.uint64(60)
    words[slot[own] + 1] = source[start[own]]
    return words, doc_words


def unpack_words(words: np.ndarray) -> np.ndarray:
    """All values of a run of words, by one gather per selector."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escapes = np.flatnonzero(selector == ESCAPE)
    if len(escapes):  # the word behind an escape is raw; of several marks in a row, every second one may be raw
        raw = np.zeros(len(words), bool)
        last = -2
        for k in escapes.tolist():
            if k - 1 != last:
                raw[k + 1] = True
                last = k
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    sel = selector[heads]
    out_at = np.cumsum(_COUNT[sel]) - _COUNT[sel]
    out = np.zeros(int(_COUNT[sel].sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS):
        own = np.flatnonzero(sel == k)
        if len(own):
            word, mask = words[heads[own]], np.uint64((1 << bits) - 1)
            for j in range(count):
                out[out_at[own] + j] = word >> np.uint64(j * bits) & mask
    own = np.flatnonzero(sel == ESCAPE)
    out[out_at[own]] = words[heads[own] + 1]
    return out


def write_segment(sizes: list[int], word_counts: list[int], words: bytes) -> bytes:
    """Segment image: magic, number of documents, their id counts (u32), their word offsets (u32), the words."""
    offsets = np.cumsum([0, *word_counts])[:-1]
    return b"".join([MAGIC, struct.pack("<I", len(sizes)), np.asarray(sizes, "<u4").tobytes(),
                     np.asarray(offsets, "<u4").tobytes(), words])


def read_segment(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id counts, word offsets, words) of a segment."""
    if image[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    (n,) = struct.unpack_from("<I", image, 4)
    sizes = np.frombuffer(image, "<u4", n, 8)
    offsets = np.frombuffer(image, "<u4", n, 8 + 4 * n)
    return sizes, offsets, np.frombuffer(image, "<u8", -1, 8 + 8 * n)


def segment_document(image: bytes, k: int) -> np.ndarray:
    """The ids of one document of a segment, by its offset alone."""
    _, offsets, words = read_segment(image)
    return unpack_words(words[offsets[k]:offsets[k + 1] if k + 1 < len(offsets) else None])


def write_token_files(docs: DataFrame, vocab_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write segments in ascending id order; returns the files as a table with one row per
    segment: ``shard, segment, ids array, n_ids, image binary``. A document longer than a segment has its own."""
    source = id_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def segments(batches):
        from pyspark import TaskContext

        enc, shard, number, own = encoder(WordEndEncoder, vocab_path), TaskContext.get().partitionId(), 0, []
        end = np.array([end_id], "<u4").tobytes()

        def close():
            sizes = [len(v) for _, v in own]
            words, counts = pack_words(np.concatenate([v for _, v in own]), sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([[i for i, _ in own]], pa.list_(id_type)),
                 pa.array([sum(sizes)], pa.int64()), pa.array([write_segment(sizes, counts, words.tobytes())], pa.binary())], names=["shard", "segment", "ids", "n_ids", "image"])

        held = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(enc.ids(text.as_py()) + end, np.uint32)
                if own and held + len(values) > segment_ids:
                    yield close()
                    number, held, own = number + 1, 0, []
                own.append((doc, values))
                held += len(values)
        if own:
            yield close()

    # the texts are put in order, not their ids: range bounds are sampled before the encoding, which runs once
    spark = docs.sparkSession
    ordered = source.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = ordered.mapInArrow(segments, f"shard long, segment long, ids array<{kind}>, n_ids long, image binary")
    if path is None:
        return stored(files, "token-files")
    files.write.option("compression", "none").parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, decoded from the segments: ``<id_col>, start, n_tokens, ids_crc32`` (and ``token_ids``)."""
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for shard, segment, ids, image in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "ids", "image")), strict=True):
                sizes, _, words = read_segment(image)
                values = unpack_words(words).astype("<u4")
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(values.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                n = len(ids)
                columns = [pa.array(ids, batch.schema.field("ids").type.value_type), pa.array([shard] * n, pa.int64()),
                           pa.array([segment] * n, pa.int64()), pa.array(ends - sizes, pa.int64()),
                           pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["id", "shard", "segment", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([values[e - s:e].astype(np.int64) for s, e in zip(sizes, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    totals = files.select("shard", "segment", F.col("n_ids").alias("n"))
    per_shard = totals.groupBy("shard").agg(F.sum("n").alias("n"))  # a row per file: the only window over everything
    before_shard = per_shard.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    before = totals.join(before_shard, "shard").select("shard", "segment", (F.col("shard_start") + F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    columns = f"id {kind}, shard long, segment long, within long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    read = files.select("shard", "segment", "ids", "image").mapInArrow(run, columns)
    return read.join(before, ["shard", "segment"]).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
        *(["token_ids"] if with_ids else []))
