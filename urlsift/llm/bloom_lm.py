"""Language-model scores from a log-frequency Bloom filter.

N-gram counts are quantised on a log scale: an n-gram with count c is stored once for each level 1 .. 1 + floor(log_b
c). A count is read back by probing level after level until one is absent; the level gives the count. Unigrams and
bigrams share the filter, and the probability of a word after another interpolates both:
``P(w|v) = (c(v,w) + mu * P(w)) / (c(v) + mu)`` with ``P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``.

Scale. Counting: every task reduces its bigrams to sorted 48-bit keys per shard before they are shuffled as arrays, so
a frequent bigram costs one key per task, and the number of shards follows the input. Each shard then builds its own
segment of the filter alone, with ``BITS_PER_ENTRY`` bits for each entry whatever their number. A filter of at most
``max_bits`` (8 MB) is broadcast. A larger one stays where it is: texts are taken in runs, each run sends its distinct
n-grams to their segments, once, as packed sorted differences, and gets their levels back. What waits for them is the run's
words, stored as numbers in order of first use; its bigrams are made from those where they are asked for. Both ways probe the same
segments, so scores do not depend on it. Shuffle files are released as soon as what they served is written.
Every training bigram is stored, those seen once at level 1.
The exact base score needs every word's count. Words at or above a count threshold, chosen from the histogram of counts
so that at most ``TOP_WORDS`` are at or above it, are broadcast; the rest of each text's words, rare by construction, meet their
counts in a join that has no hot key, and sums go back to the text by its row number.

Defined results. Null text: only the end token. Null id counts as the empty string for the split, repeated ids are
scored row by row. Without any training document counts are 0 and V is 0; scores are then finite. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urlsift.llm.common import id_text, lower_words, partitions_for, stored

END = b"\n"  # the end token; no word holds a line feed
TOP_WORDS = 200_000
LOG_BASE = 1.5  # counts 1, 2, 3, 4-5, 6-7, ... share a level
BITS_PER_ENTRY = 10
PROBES = 3
MAX_FILTER_BITS = 1 << 26  # broadcast up to here (8 MB): every Python worker holds a copy of its own
TASK_KEYS = 2_000_000  # bigram keys a task gathers before it sends them
TASK_WORDS = 300_000
SHARD_KEYS = 2_000_000
RUN_TOKENS = 1_000_000  # tokens scored together ...
RUN_WORDS = 300_000  # ... and distinct words
MU = 200.0
KEY_BITS = 48

_MEMO_WORDS = 500_000
_WORD_HASH: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_WORD_HASH) > _MEMO_WORDS:
        _WORD_HASH.clear()
    known, out = _WORD_HASH, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bigram_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(3) + mix(hashes[1:])) >> np.uint64(64 - KEY_BITS)


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - KEY_BITS)


def levels_of(counts: np.ndarray, base: float | None = None) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base or LOG_BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float | None = None) -> np.ndarray:
    """The middle (geometric) of a level's counts; level 1 is exactly one for small bases, level 0 is none."""
    base = base or LOG_BASE
    low, high = np.ceil(base ** (levels - 1.0) - 1e-9), np.maximum(np.ceil(base ** levels.astype(float) - 1e-9) - 1, 1)
    return np.where(levels > 0, np.sqrt(low * np.maximum(high, low)), 0.0)


class LogBloom:
    """Membership of (key, level), in segments by the key's shard."""

    def __init__(self, segments: list[np.ndarray], shards: int):
        self.shards = shards
        self.bits = np.array([len(s) * 8 for s in segments], np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.uint64)[:-1]
        self.data = np.concatenate(segments) if segments else np.zeros(8, np.uint8)

    @staticmethod
    def build(keys: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
        plane = np.zeros(bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for p in range(PROBES):
                plane[(LogBloom.probe(own, level, p) % np.uint64(bits)).astype(np.int64)] = True
        return np.packbits(plane, bitorder="little")

    @staticmethod
    def probe(keys: np.ndarray, level: int, p: int) -> np.ndarray:
        return mix(keys * np.uint64(2 * PROBES + 1) + np.uint64(level * 64 + p))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """For each key the highest level up to which all are present."""
        out = np.zeros(len(keys), np.int64)
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        bits, start = self.bits[shard], self.start[shard]
        alive, level = np.arange(len(keys)), 0
        while len(alive):
            level += 1
            for p in range(PROBES):
                at = start[alive] + self.probe(keys[alive], level, p) % bits[alive]
                alive = alive[(self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            out[alive] = level
            if level >= 100:
                break
        return out


def _training(docs: DataFrame, id_col: str, text_col: str, fold: int, folds: int) -> DataFrame:
    source = id_text(docs, id_col, text_col)
    return source.withColumn("held_out", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == fold)


tokens = lower_words


def word_counts(source: DataFrame) -> DataFrame:
    """``word, n`` over the training rows, the end token included."""

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
            held[END] += batch.num_rows
            if len(held) > TASK_WORDS:
                yield rows()
        yield rows()

    return stored(source.where("not held_out").select("text").mapInArrow(count, "word binary, n long")
                  .where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by shard and value, the bounds of each shard in it)"""
    shard = keys % np.uint64(shards)
    order = np.lexsort((keys, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def packed(values: np.ndarray) -> bytes:
    """32-bit values byte by byte, all low bytes first, compressed: high bytes hold little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def coded_keys(keys: np.ndarray, shards: int) -> bytes:
    """Sorted keys of one shard as differences of four bytes; behind them the few that are wider, and how many these are."""
    steps = np.diff(keys // np.uint64(shards), prepend=np.uint64(0))
    wide = np.flatnonzero(steps >> np.uint64(32))
    return packed(np.concatenate([steps.astype("<u4"), wide.astype("<u4"), (steps[wide] >> np.uint64(32)).astype("<u4"), np.array([len(wide)], "<u4")]))


def keys_of(data: bytes, shard: int, shards: int) -> np.ndarray:
    raw = unpacked(data)
    wide = int(raw[-1])
    n = len(raw) - 1 - 2 * wide
    steps = raw[:n].astype(np.uint64)
    steps[raw[n:n + wide]] += raw[n + wide:n + 2 * wide].astype(np.uint64) << np.uint64(32)
    return np.cumsum(steps, dtype=np.uint64) * np.uint64(shards) + np.uint64(shard)


class _Numbers(dict):
    """Words numbered in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def run_ngrams(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of a run's distinct words, then of its distinct bigrams; at which of them each word and each bigram is)"""
    pairs, at = np.unique(bigram_keys(hashes[words]), return_inverse=True)
    return np.concatenate([unigram_keys(hashes), pairs]), words, at + len(hashes)


def filter_segments(source: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """``shard, data, bits``: segments of the filter over all training bigrams and all unigrams."""

    def blobs(keys: np.ndarray, n: np.ndarray):
        """Sorted 48-bit keys, per shard, as differences; counts beyond one apart."""
        order, cuts = _by_shard(keys, shards)
        n, keys = n[order], keys[order]
        out = [(s, coded_keys(keys[a:b], shards), (many := np.flatnonzero(n[a:b] > 1)).astype("<u4").tobytes(), n[a:b][many].astype("<i8").tobytes())
               for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                          names=["shard", "keys", "many", "n"])

    def gather(batches):
        held, size = [], 0

        def flush():
            return blobs(*np.unique(np.concatenate(held), return_counts=True))

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                if words:
                    held.append(bigram_keys(word_hashes([END, *words, END])))
                    size += len(words) + 1
                if size > TASK_KEYS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def unigrams(batches):
        for batch in batches:
            if batch.num_rows:
                yield blobs(unigram_keys(word_hashes(batch.column(0).to_pylist())), np.array(batch.column(1).to_pylist(), np.int64))


    def segment(batches):
        shard, held = None, []

        def close():
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, back = np.unique(keys, return_inverse=True)
            levels = levels_of(np.bincount(back, weights=n).astype(np.int64))
            bits = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([LogBloom.build(keys, levels, bits).tobytes()], pa.binary()),
                                               pa.array([bits], pa.int64())], names=["shard", "data", "bits"])

        for batch in batches:
            for s, keys, many, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and held:
                    yield close()
                    held = []
                shard = s
                keys = keys_of(keys, s, shards)
                own = np.ones(len(keys), np.int64)
                own[np.frombuffer(many, "<u4")] = np.frombuffer(n, "<i8")
                held.append((keys, own))
        if held:
            yield close()

    kind = "shard int, keys binary, many binary, n binary"
    sent = source.where("not held_out").select("text").mapInArrow(gather, kind).unionByName(counts.select("word", "n").mapInArrow(unigrams, kind))
    return stored(sent.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard").mapInArrow(segment, "shard int, data binary, bits long"), "filter")


def whole_filter(built: DataFrame, shards: int, max_bits: int) -> LogBloom | None:
    """The filter in one piece, or nothing if it has more than ``max_bits``."""
    if (built.agg(F.sum("bits")).first()[0] or 0) > max_bits:
        return None
    segments = [np.zeros(8, np.uint8)] * shards
    for r in built.select("shard", "data").toLocalIterator():  # max_bits / 8 bytes at most
        segments[r.shard] = np.frombuffer(r.data, np.uint8)
    return LogBloom(segments, shards)


def levels_at_segments(built: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """``run, shard, levels`` (packed) for ``asked``: ``run, shard, keys``. Every segment meets the keys of its shard
    behind it in one sorted partition; one segment is held at a time."""

    def answer(batches):
        at, bloom = None, None
        for batch in batches:
            out = [[], [], []]
            for shard, run, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, bloom = shard, None
                if run is None:
                    bloom = LogBloom([np.frombuffer(data, np.uint8)], 1)
                    continue
                keys = keys_of(data, shard, shards)
                levels = bloom.levels(keys) if bloom is not None else np.zeros(len(keys), np.int64)
                for column, value in zip(out, (run, shard, packed(levels)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["run", "shard", "levels"])

    both = built.select("shard", F.lit(None).cast("long").alias("run"), "data").unionByName(asked.select("shard", "run", F.col("keys").alias("data")))
    return (both.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", F.asc_nulls_first("run"))
            .mapInArrow(answer, "run long, shard int, levels binary"))


def asked_keys(runs: DataFrame, shards: int) -> DataFrame:
    """``run, shard, keys``: the distinct n-grams of each run (``run, words, hashes``) for each segment."""

    def ask(batches):
        for batch in batches:
            for run, words, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = run_ngrams(np.frombuffer(hashes, "<u8"), unpacked(words).astype(np.int64))[0]
                order, cuts = _by_shard(keys, shards)
                keys = keys[order]
                out = [(run, s, coded_keys(keys[a:b], shards)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                                 names=["run", "shard", "keys"])

    return runs.select("run", "words", "hashes").mapInArrow(ask, "run long, shard int, keys binary")


def run_scores(runs: DataFrame, levels: DataFrame, probabilities, shards: int, parts: int) -> DataFrame:
    """``row, score``: each run (``run, words, hashes, lengths``) meets the levels of its distinct n-grams, which come by shard."""

    def close(run, words, hashes, lengths, held):
        keys, uni_at, pair_at = run_ngrams(np.frombuffer(hashes, "<u8"), unpacked(words).astype(np.int64))
        level = np.empty(len(keys), np.int64)
        level[_by_shard(keys, shards)[0]] = np.concatenate([unpacked(h) for h in held])
        scores = probabilities(level[uni_at], level[pair_at], np.frombuffer(lengths, "<i8"))
        return pa.RecordBatch.from_arrays([pa.array(run + np.arange(len(scores)), pa.int64()), pa.array(scores, pa.float64())], names=["row", "score"])

    def score(batches):
        now, held = None, []
        for batch in batches:
            for run, _, words, hashes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words is None:
                    held.append(data)
                    continue
                if now is not None:
                    yield close(*now, held)
                now, held = (run, words, hashes, data), []
        if now is not None:
            yield close(*now, held)

    none = F.lit(None).cast("binary")
    both = runs.select("run", F.lit(-1).alias("shard"), "words", "hashes", F.col("lengths").alias("data")).unionByName(
        levels.select("run", "shard", none.alias("words"), none.alias("hashes"), F.col("levels").alias("data")))
    return both.repartition(parts, "run").sortWithinPartitions("run", "shard").mapInArrow(score, "row long, score double")


def _top_words(counts: DataFrame, limit: int = TOP_WORDS) -> dict[bytes, int]:
    """The most frequent words: all with a count at or above the least threshold that admits at most ``limit``."""
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(limit).collect()
    threshold, taken = None, 0
    for r in histogram:
        if taken + r.words > limit:
            break
        threshold, taken = r.n, taken + r.words
    if threshold is None:
        return {}
    return {bytes(r.word): r.n for r in counts.where(F.col("n") >= threshold).toLocalIterator()}


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5,
              max_bits: int = MAX_FILTER_BITS, mu: float = MU) -> DataFrame:
    """``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``; trained on rows outside the fold."""
    spark = docs.sparkSession
    source = _training(docs, id_col, text_col, fold, folds)
    counts = word_counts(source)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, vocabulary = int(total.n), int(total.v)
    shards = partitions_for(n_train, SHARD_KEYS, 16)
    built = filter_segments(source, counts, shards)
    whole = whole_filter(built, shards, max_bits)
    apart = whole is None
    model = spark.sparkContext.broadcast((whole, _top_words(counts)))
    space = max(n_train + 0.5 * (vocabulary + 1), 1.0)
    log_space = math.log10(space)
    kind = source.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(source.schema["id"].dataType)

    def score(batches):
        from pyspark import TaskContext

        bloom, top = model.value
        row = TaskContext.get().partitionId() << 33
        numbers, texts, ids, held = _Numbers(), [], [], []
        size = 0
        for batch in batches:
            for key, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = tokens(text.as_py())
                texts.append(np.fromiter(map(numbers.__getitem__, (END, *words, END)), np.int64, len(words) + 2))
                ids.append(key)
                held.append(out)
                size += len(words) + 2
                if size > RUN_TOKENS or len(numbers) > RUN_WORDS:
                    yield close(row, numbers, texts, ids, held, bloom, top)
                    row += len(ids)
                    numbers, texts, ids, held = _Numbers(), [], [], []
                    size = 0
        if ids:
            yield close(row, numbers, texts, ids, held, bloom, top)

    def close(row: int, numbers: dict, texts: list, ids: list, held: list, bloom: LogBloom | None, top: dict) -> pa.RecordBatch:
        """The rows of a run: sums over the frequent words, the rare ones, and scores, or, beside its first row, what it asks the segments for."""
        vocab = list(numbers)
        counts = np.array([top.get(w, 0) for w in vocab], np.int64)
        logs = np.where(counts > 0, np.log10(counts + 0.5), 0.0)
        known, base, rare, rare_n = [], [], [], []
        for own in texts:
            own = own[1:]  # a text's own tokens: words and the end
            found = counts[own] > 0
            words, n = np.unique(own[~found], return_counts=True)
            known.append(int(found.sum()))
            base.append(float(logs[own].sum()))
            rare.append([vocab[w] for w in words])
            rare_n.append(n)
        hashes, words, lengths = word_hashes(vocab), np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
        if bloom is not None:  # each distinct n-gram of the run is probed once
            keys, uni_at, pair_at = run_ngrams(hashes, words)
            level = bloom.levels(keys)
            scores, request = probabilities(level[uni_at], level[pair_at], lengths), [None] * 3
        else:
            scores, request = [None] * len(ids), [packed(words), hashes.astype("<u8").tobytes(), lengths.astype("<i8").tobytes()]
        rest = [None] * (len(ids) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            (ids, held, lengths - 1, known, base, rare, rare_n, scores, *([r, *rest] for r in request), row + np.arange(len(ids))), (
                id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.float64(), pa.binary(), pa.binary(),
                pa.binary(), pa.int64()), strict=True)],
            names=["id", "held_out", "n_tokens", "known", "base", "rare", "rare_n", "score", "words", "hashes", "lengths", "row"])

    def probabilities(uni: np.ndarray, pair: np.ndarray, lengths: np.ndarray) -> list[float]:
        """Log10 probabilities of several texts from the levels of their words and of their pairs of words."""
        uni, pair = count_of(uni), count_of(pair)
        before = np.maximum(uni[:-1], pair)
        p = np.log10(np.minimum((pair + mu * (uni[1:] + 0.5) / space) / (before + mu), 1.0))
        stops = np.cumsum(lengths)
        p[stops[:-1] - 1] = 0.0  # from one text's end to the next one's start
        return np.add.reduceat(p, np.concatenate([[0], stops[:-1]])).tolist()

    scored = stored(source.select("id", "text", "held_out").mapInArrow(
        score, f"id {kind}, held_out boolean, n_tokens long, known long, base double, rare array<binary>, rare_n array<long>, score double, "
               "words binary, hashes binary, lengths binary, row long"), "scored")
    if apart:
        runs = scored.where("words is not null").withColumnRenamed("row", "run")
        levels = levels_at_segments(built, asked_keys(runs, shards), shards)
        scores = stored(run_scores(runs, levels, probabilities, shards, partitions_for(n_train, SHARD_KEYS, 16)), "scores")
    else:
        scores = scored.select("row", "score")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    none = F.lit(None).cast("double").alias("score")
    met = rare.join(counts, "word").select("row", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("n") + F.lit(0.5))).alias("base"), none)
    sums = (met.unionByName(scored.select("row", "known", "base", none)).unionByName(scores.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score"))
            .groupBy("row").agg(F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.max("score").alias("score")))
    return scored.select("row", "id", "held_out", "n_tokens").join(sums, "row").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("n_tokens") - F.col("n_known")) * F.lit(math.log10(0.5)) - F.col("n_tokens") * F.lit(log_space)).alias("base_score"),
        "score")
