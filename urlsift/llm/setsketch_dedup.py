"""Near-duplicate documents by SetSketch registers: bands of registers, joint likelihood, verification on full sets.

Sketch. Of every register's exponential hash values only the smallest counts, and of that only its step on a scale with
ratio ``BASE`` between steps (8 bits). Registers of parts of a set merge by maximum (long texts are sketched in runs), and
equal registers are as likely as two sets are similar.

Candidates. A document's set is hashed whole; equal sets are one class. ``BANDS`` bands of ``ROWS`` registers make the
buckets; a pair at the threshold of 0.85 misses all of them with a probability of about 1e-9. A bucket is not paired out: its
members meet the bucket's centre, the one that shares most buckets with others (in a group of copies, a copy near the
original). A pair goes on when the joint likelihood of its registers and set sizes does not rule the threshold out by more
than ``DEVIATIONS`` standard deviations; then full sets decide.

What a centre misses. Members of a centre's buckets that lie in another component than the centre are strays. Only
they are held against the other members, in blocks: every member is written as its difference from the centre, and
since |x & y| = |c| - |c - x| - |c - y| + (shared differences), one product of incidence matrices gives the exact overlaps of two
blocks. A block gives at most one link from a stray to a component. So rows grow with the members and with the pairs of
blocks that hold strays, a group of copies is never paired out, and every pair that shares a bucket is decided exactly.

Scale and skew. Equal sets are grouped with partial aggregation; bucket sizes and centres are partial aggregations too;
blocks are cut from a global sort, so no group lies in one task. Nothing but emptiness tests reaches the driver, and a filter of
bounded size for reading the full sets of candidates. All intermediates are stored tables.

Defined results. Fewer words than a shingle: the whole sequence is the one shingle. No words or null text: empty set, linked
with nothing. Rows that share an id are separate documents of that id; a null id is a component's id only if it has no
other, and its row is then kept. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, stored
from urlsift.llm.jaccard_groupjoin import components, shingle_sets, whole_sets

WORDS = 3
PERCENT = 85
ROWS = 6  # registers of a band: with 8 bits each and the band's number a bucket key is one long
BANDS = 42
REGISTERS = ROWS * BANDS
BASE = 1.1
RATE = 20.0
DEVIATIONS = 6.0
RUN = 1 << 15  # shingles sketched at once
BLOCK = 256  # members of a block
BLOCK_TOKENS = 1 << 18
_COLUMNS = 4096

_RANDOM = np.random.Generator(np.random.PCG64(20111)).integers(0, 2**64, (2, REGISTERS), np.uint64, endpoint=False)
_SEED, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of smallest 64-bit hashes: exponential variates of rate ``RATE`` on a scale of powers of ``BASE``."""
    uniform = (minima.astype(np.float64) + 0.5) / 2.0**64
    step = np.floor(1 - np.log(-np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE) / math.log(BASE))
    return np.clip(step, 0, 255).astype(np.uint8)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per non-empty set of 64-bit hashes."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    k = 0
    while k < len(sets):
        stop, size = k, 0
        while stop < len(sets) and (stop == k or size + len(sets[stop]) <= RUN):
            size += len(sets[stop])
            stop += 1
        flat = sets[k] if stop == k + 1 else np.concatenate(sets[k:stop])
        if stop == k + 1:  # one set, maybe long: the registers of its runs merge by maximum
            for a in range(0, size, RUN):
                out[k] = np.maximum(out[k], registers(_minima(flat[a:a + RUN], np.zeros(1, np.int64)))[0])
        else:
            starts = np.cumsum([0] + [len(s) for s in sets[k:stop - 1]])
            out[k:stop] = registers(_minima(flat, starts))
        k = stop
    return out


def _minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out, held = np.empty((len(starts), REGISTERS), np.uint64), np.empty_like(flat)
    for i in range(REGISTERS):
        np.multiply(np.bitwise_xor(flat, _SEED[i], out=held), _FACTOR[i], out=held)
        out[:, i] = np.minimum.reduceat(held, starts)
    return out


def signatures(source: DataFrame, words: int) -> DataFrame:
    """``row, id, n, key, sketch, bands``: set size, digest of the whole set, registers, bucket keys (null for empty sets)."""
    place = np.uint64(1) << np.arange(0, 8 * ROWS, 8, dtype=np.uint64)

    def sign(batches):
        import xxhash

        for batch in batches:
            ids, sets, first = batch.column(0), [], 0
            for k, s in enumerate(shingle_sets(batch.column(1), words)):
                sets.append(s)
                if sum(map(len, sets[-1:])) > RUN or len(sets) >= 200 or k + 1 == len(ids):
                    yield _signed(ids.slice(first, len(sets)), sets, xxhash.xxh3_128_digest)
                    first, sets = first + len(sets), []

    def _signed(ids, sets, digest):
        full = [k for k, s in enumerate(sets) if len(s)]
        made = sketches([sets[k] for k in full])
        keys = (made.reshape(len(full), BANDS, ROWS).astype(np.uint64) * place).sum(axis=2).astype(np.int64) + (np.arange(BANDS, dtype=np.int64) << 48)
        sketch, bands = [None] * len(sets), [None] * len(sets)
        for at, k in enumerate(full):
            sketch[k], bands[k] = made[at].tobytes(), keys[at]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, sets), pa.int64()), pa.array([digest(s.tobytes()) for s in sets], pa.binary()),
                                           pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "key", "sketch", "bands"])

    kind = source.schema["id"].dataType.simpleString()
    return stored(source.mapInArrow(sign, f"id {kind}, n long, key binary, sketch binary, bands array<long>")
                  .withColumn("row", F.monotonically_increasing_id()), "sketches")


def _log_share(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, for the share of hashes that only the one set has."""
    return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)


def similarity_likelihood(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log likelihood of a Jaccard similarity, given set sizes and how many registers of a are larger and smaller."""
    u, v = na / (na + nb), nb / (na + nb)
    up, down = _log_share(u - v * similarity), _log_share(v - u * similarity)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-12))


def may_reach(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the registers leave the threshold possible: its likelihood against that of the likeliest similarity."""
    na, nb, goal = na.astype(float), nb.astype(float), percent / 100
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    low, high = np.zeros(len(na)), most.copy()
    for _ in range(40):  # the likelihood has one maximum
        third = (high - low) / 3
        rises = similarity_likelihood(na, nb, more, less, low + third) < similarity_likelihood(na, nb, more, less, high - third)
        low, high = np.where(rises, low + third, low), np.where(rises, high, high - third)
    best = (low + high) / 2
    loss = similarity_likelihood(na, nb, more, less, best) - similarity_likelihood(na, nb, more, less, np.full(len(na), goal))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((best >= goal) | (loss <= DEVIATIONS**2 / 2))


def centred(classes: DataFrame) -> DataFrame:
    """``c, row``: every class with the centres of its buckets."""
    bands = classes.select("row", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = stored(bands.join(crowded, "band"), "shared-bands")
    ranked = shared.join(shared.groupBy("row").agg(F.sum("k").alias("met")), "row")
    centres = ranked.groupBy("band").agg(F.max(F.struct("met", (-F.col("row")).alias("row"))).alias("top")).select("band", (-F.col("top.row")).alias("c"))
    return stored(shared.join(centres, "band").where("row != c").select("c", "row").distinct(), "centred")


def _verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links among the pairs ``c, row``, their full sets)."""

    @F.pandas_udf("boolean")
    def possible(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, REGISTERS) for v in (x, y))
        return pd.Series(may_reach(na.to_numpy(), nb.to_numpy(), a, b, percent))

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(a) - int(_absent(a, b).sum())
            out.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pd.Series(out, dtype=bool)

    own = classes.select("row", "n", "sketch")
    likely = stored(pairs.join(own, "row").join(own.toDF("c", "nc", "of_c"), "c").where(possible("n", "nc", "sketch", "of_c"))
                    .select(F.col("c").alias("a"), F.col("row").alias("b")), "likely")
    sets = whole_sets(source, classes, likely, words)
    both = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stored(both.where(linked("x", "y")).select("a", "b"), "links"), sets


def _absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of sorted ``a`` are not in sorted ``b``."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``c, nc, row, label, stray, n, lost, tokens``: every member as what it lacks (``lost`` many) and has beyond its centre."""

    def differ(batches):
        for batch in batches:
            lost, tokens = [], []
            for x, c in zip(batch.column("set"), batch.column("of_c"), strict=True):
                x, c = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint64)
                gone = c[_absent(c, x)]
                lost.append(len(gone))
                tokens.append(np.concatenate([gone, x[_absent(x, c)]]).tobytes())
            keep = ["c", "row", "label", "stray", "n", "nc"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lost, pa.int64()), pa.array(tokens, pa.binary())], names=[*keep, "lost", "tokens"])

    joined = members.join(sets, "row").join(sets.toDF("c", "of_c"), "c").select(
        "c", "row", "label", "stray", (F.length("set") / 8).cast("long").alias("n"), (F.length("of_c") / 8).cast("long").alias("nc"), "set", "of_c")
    return joined.mapInArrow(differ, "c long, row long, label long, stray boolean, n long, nc long, lost long, tokens binary")


def _blocks(members: DataFrame) -> DataFrame:
    """``block, c, stray, nc, size`` and the members' columns packed: up to ``BLOCK`` members of one centre each."""
    names = ("row", "label", "n", "lost")

    def pack(batches):
        held, key, tokens = [], None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (key != (r["c"], r["stray"]) or len(held) == BLOCK or tokens > BLOCK_TOKENS):
                    yield _packed(held)
                    held, tokens = [], 0
                key = (r["c"], r["stray"])
                held.append(r)
                tokens += len(r["tokens"]) // 8
        if held:
            yield _packed(held)

    def _packed(rows):
        cols = {c: pa.array([np.array([r[c] for r in rows], np.int64).tobytes()], pa.binary()) for c in names}
        ends = np.cumsum([0] + [len(r["tokens"]) // 8 for r in rows]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["c"]], pa.int64()), pa.array([rows[0]["stray"]]), pa.array([rows[0]["nc"]], pa.int64()), *cols.values(),
                                           pa.array([ends.tobytes()], pa.binary()), pa.array([b"".join(r["tokens"] for r in rows)], pa.binary())],
                                          names=["c", "stray", "nc", *cols, "ends", "tokens"])

    ordered = members.repartitionByRange("c", "stray", "label", "row").sortWithinPartitions("c", "stray", "label", "row")
    kinds = ", ".join(f"{c} binary" for c in (*names, "ends", "tokens"))
    return stored(ordered.mapInArrow(pack, f"c long, stray boolean, nc long, {kinds}").withColumn("block", F.monotonically_increasing_id()), "blocks")


def block_overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers of shared tokens of all pairs of two blocks, each (ends, tokens), by products of incidence matrices."""
    (xe, xt), (ye, yt) = x, y
    common = np.intersect1d(xt, yt)
    out = np.zeros((len(xe) - 1, len(ye) - 1), np.float32)
    places = []
    for ends, tokens in (x, y):
        at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
        hit = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        places.append((np.repeat(np.arange(len(ends) - 1), np.diff(ends))[hit], at[hit]))
    for a in range(0, len(common), _COLUMNS):
        parts = []
        for (rows, at), size in zip(places, out.shape, strict=True):
            part = np.zeros((size, min(_COLUMNS, len(common) - a)), np.float32)
            inside = (at >= a) & (at < a + _COLUMNS)
            part[rows[inside], at[inside] - a] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _stray_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links of strays to members of other components, at most one a block to each component."""
    names = ("row", "label", "n", "lost", "ends")

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = ({c: np.frombuffer(r[f"{side}_{c}"], np.int64) for c in names} for side in "xy")
                tx, ty = (np.frombuffer(r[f"{side}_tokens"], np.uint64) for side in "xy")
                shared = block_overlaps((x["ends"], tx), (y["ends"], ty)) + r["nc"] - x["lost"][:, None] - y["lost"][None, :]
                hit = (100 * shared >= percent * (x["n"][:, None] + y["n"][None, :] - shared)) & (x["label"][:, None] != y["label"][None, :])
                a, b = np.nonzero(hit)
                if len(a):
                    first = np.unique(np.stack([a, y["label"][b]], 1), axis=0, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(x["row"][a[first]]), pa.array(y["row"][b[first]])], names=["a", "b"])

    light = blocks.select("c", "block", "stray")
    pairs = light.where("stray").toDF("c", "x_block", "stray").drop("stray").join(light.toDF("c", "y_block", "y_stray"), "c").where("not y_stray or x_block <= y_block")
    side = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in (*names, "tokens")])
    joined = pairs.select("x_block", "y_block").repartition("x_block", "y_block").join(side("x").join(blocks.select(F.col("block").alias("x_block"), "nc"), "x_block"), "x_block").join(side("y"), "y_block")
    return stored(joined.mapInArrow(meet, "a long, b long"), "stray-links")


def similar_classes(source: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signatures with their class, component labels of classes)."""
    signed = signatures(source, words)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    classes = stored(signed.where("n > 0").groupBy("key").agg(first.alias("f"), *[F.first(c).alias(c) for c in ("n", "sketch", "bands")])
                     .select("key", F.col("f.row").alias("row"), F.col("f.id").alias("id"), "n", "sketch", "bands"), "classes")
    pairs = centred(classes.select("row", "bands"))
    links, _ = _verified(pairs, classes, source, words, percent)
    labels = components(links)

    named = pairs.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")).join(
        labels.toDF("c", "of_c"), "c", "left").select("c", "row", "label", (F.col("label") != F.coalesce("of_c", "c")).alias("stray"))
    named = stored(named, "centred-labels")
    # a centre with one member is decided; without strays so is any other
    mixed = named.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max("stray").alias("any")).where("k > 1 and any").select("c")
    members = stored(named.join(mixed, "c", "left_semi"), "mixed")
    if members.isEmpty():
        return signed.join(classes.select("key", F.col("row").alias("class")), "key", "left"), labels
    sets = whole_sets(source, classes, members.select(F.col("c").alias("a"), F.col("row").alias("b")), words)
    late = _stray_links(_blocks(_differences(members, sets)), percent)
    labels = labels if late.isEmpty() else components(links.unionByName(late))
    return signed.join(classes.select("key", F.col("row").alias("class")), "key", "left"), labels


def setsketch_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept`` for every row; the row whose id is the component's id is kept."""
    signed, labels = similar_classes(id_text(docs, id_col, text_col), words, percent)
    named = stored(signed.select("id", "n", "row", "class").join(labels.select(F.col("row").alias("class"), "label"), "class", "left")
                   .select("id", "n", F.coalesce("label", "class", "row").alias("c")), "members")
    ids = stored(named.groupBy("c").agg(F.min("id").alias("component_id")), "component-ids")
    return named.join(ids, "c").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
