"""N-gram Jaccard self-join by grouped prefixes; connected components of the links.

A document is the set of its distinct word shingles. Two link when their Jaccard similarity reaches a threshold.
Documents with equal sets collapse into one class first, and classes with the same prefix (their rarest shingles, as
many as the threshold leaves room for) and size into one group. Group pairs that share a prefix shingle pass the
length and the positional filter, and a bound on part counts that holds for every member (the largest count of each part);
only then are groups expanded to members, and members bounded by their own counts and verified on their whole sets.

Order. Any global order of shingles gives the right result; a good one puts rare shingles first. Frequencies are
estimated over all documents in a sketch of fixed size (``SKETCH_COUNTERS``, 4 MB, broadcast), ties broken by hash.

Scale and skew. The largest group of copies is one class after a partially aggregated grouping. Groups meet pair by pair only at
a shingle that at most ``WIDE`` of them have; at any other shingle they meet one pivot. So candidates grow with the postings.
Not all are verified: first each class against its smallest candidate and its pivots, then components are formed. What may then still
link, members of groups that met the same group or pivot, makes that one's family; of families that lie in several
components only members that can reach the threshold with one of another component are kept, and their exact overlaps
come from their differences from the centre, block by block (:mod:`urlsift.llm.setsketch_dedup`). A block gives one link
to a component at most, so a large group of near copies is never paired out as rows, and no link is lost. Whole sets are
made again from the text, and only for classes that have a candidate, found by a bit filter of bounded size. Components
come from label propagation with pointer jumping over stored tables; nothing but filter blocks and counts reaches the driver.

Defined results. Fewer words than a shingle: the whole sequence is the one shingle. No words or null text: empty set,
linked with nothing, alone in its component. Null ids are never a component's id unless the component has no other.
Rows that share an id are separate documents of that id. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import id_text, partitions_for, stored

WORDS = 3
PERCENT = 90
SKETCH_COUNTERS = 1 << 20
SKETCH_BLOCK = 1 << 14
PARTS = 64
_PART_SHIFT = np.uint64(58)
WIDE = 16
MAX_FILTER_BITS = 1 << 28
CHUNK_BYTES = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunk_shingles(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in a run of UTF-8 bytes; ``ends`` are the texts' end offsets.

    A word's hash is a polynomial over its bytes, mixed with its length; all words of the run are hashed at once."""
    n, begins = len(data), np.concatenate([[0], ends[:-1]])
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = begins[begins < n]
    first[edge] = solid[edge]  # a text's first byte never continues the word before
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(ends)
    place = np.arange(n) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[~solid] = 0
    power = _powers(int(place.max()) + 1)
    value = np.where(solid, (low.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0))
    size = np.add.reduceat(solid.astype(np.int64), starts).astype(np.uint64)
    h = _mix(np.add.reduceat(value, starts) + size * np.uint64(0x8CB92BA72F3D8DD7))
    word_begin, word_end = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    windows = {k: _windows(h, k) for k in {words, *(int(w) for w in word_end - word_begin if 0 < w < words)}}
    out = []
    for b, e in zip(word_begin.tolist(), word_end.tolist(), strict=True):
        k = min(words, e - b)
        s = np.sort(windows[k][b:e - k + 1]) if k else np.zeros(0, np.uint64)
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(3) + h[j:j + n])
    return out


_POWER = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    while len(_POWER) < n:
        step = np.uint64(int(_POWER[-1]) * 0xC2B2AE3D27D4EB4F % 2**64)
        _POWER = np.concatenate([_POWER, _POWER * step])
    return _POWER


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingle_sets(texts: pa.Array, words: int):
    """Sorted 64-bit hashes of the distinct shingles of each text (no nulls), in order, about a megabyte at a time."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, side="right")) - 1)
        yield from _chunk_shingles(data[offsets[k]:offsets[stop]], offsets[k + 1:stop + 1] - offsets[k], words)
        k = stop


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(7)).astype(np.int64) & (SKETCH_COUNTERS - 1)


def prefix_length(n: int, percent: int) -> int:
    """A set of n linked with another shares one of its first so many elements in any global order."""
    return n - -(-percent * n // 100) + 1


def short_prefix_length(n: int, percent: int) -> int:
    """The same for the smaller of the two sets: the overlap is then at least 2 p / (100 + p) of its size."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def frequency_sketch(source: DataFrame, words: int) -> np.ndarray:
    """Estimated document frequency of a shingle by its slot, over all documents."""

    def count(batches):
        total, held, size = np.zeros(SKETCH_COUNTERS, np.int64), [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0), words):
                held.append(_slot(own))
                size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=SKETCH_COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SKETCH_COUNTERS)
        for k in range(SKETCH_COUNTERS // SKETCH_BLOCK):
            part = total[k * SKETCH_BLOCK:(k + 1) * SKETCH_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "n": pa.array([zlib.compress(part.tobytes(), 1)])})

    def add(batches):
        block, total = None, None
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(zlib.decompress(n), np.int64)
                if k != block:
                    if block is not None:
                        yield _sum(block, total)
                    block, total = k, n.copy()
                else:
                    total += n
        if block is not None:
            yield _sum(block, total)

    def _sum(k, n):
        return pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()),
                                           "n": pa.array([zlib.compress(np.minimum(n, 2**31 - 1).astype(np.int32).tobytes(), 1)])})

    kind = "block int, n binary"
    summed = (source.select("text").mapInArrow(count, kind).repartition(SKETCH_COUNTERS // SKETCH_BLOCK, "block")
              .sortWithinPartitions("block").mapInArrow(add, kind))
    out = np.zeros(SKETCH_COUNTERS, np.int32)
    for r in summed.toLocalIterator():  # 4 MB in all
        out[r.block * SKETCH_BLOCK:(r.block + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(r.n), np.int32)
    return out


def signatures(source: DataFrame, words: int, percent: int) -> DataFrame:
    """``row, id, n, key, group_key, parts, prefix``: set size, digests of the set and of (size, prefix), the number of
    shingles in each of ``PARTS`` parts of the hash space (255 stands for more), and the prefix in global order."""
    sketch = source.sparkSession.sparkContext.broadcast(frequency_sketch(source, words))

    def sign(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            size, key, group, parts, tokens, ends = [], [], [], [], [], [0]
            for s in shingle_sets(batch.column(1), words):
                size.append(len(s))
                key.append(digest(s.tobytes()))
                parts.append(np.minimum(np.bincount((s >> _PART_SHIFT).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                c = sketch.value[_slot(s)]
                take = prefix_length(len(s), percent) if len(s) else 0
                order = np.argsort(c, kind="stable")[:take]  # shingles are sorted, so ties stay in their order
                group.append(digest(s[order].tobytes() + len(s).to_bytes(8, "little")))
                tokens.append(s[order].view(np.int64))
                ends.append(ends[-1] + take)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(group, pa.binary()),
                                              pa.array(parts, pa.binary()), prefix], names=["id", "n", "key", "group_key", "parts", "prefix"])

    kind = source.schema["id"].dataType.simpleString()
    return stored(source.mapInArrow(sign, f"id {kind}, n long, key binary, group_key binary, parts binary, prefix array<long>")
                  .withColumn("row", F.monotonically_increasing_id()), "signatures")


def _size(name: str) -> Column:
    return F.shiftright(name, 32)


def _place(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << 32) - 1))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for postings ``a`` (the smaller set) and ``b`` that meet at one shingle."""
    na, nb, pa_, pb = _size(f"{a}.na"), _size(f"{b}.na"), _place(f"{a}.na"), _place(f"{b}.na")
    overlap = F.least(na - pa_, nb - pb)
    return (100 * na >= percent * nb) & ((100 + percent) * overlap >= percent * (na + nb))


def _ahead(a: str, b: str) -> Column:
    """Each pair once, the smaller set (or the smaller group) first."""
    na, nb = _size(f"{a}.na"), _size(f"{b}.na")
    return (na < nb) | ((na == nb) & (F.col(f"{a}.g") < F.col(f"{b}.g")))


def _meet(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    on = (F.col("x.t") == F.col("y.t")) & _ahead("x", "y") & _may_link("x", "y", percent)
    n = _size("na")
    short = small.where(_place("na") < n - F.ceil(2 * percent * n / (100 + percent)) + 1)  # enough for the smaller set
    return short.alias("x").join(large.alias("y"), on).select(
        F.col("x.g").alias("a"), F.col("y.g").alias("b"))


def _bit_filter(keys: DataFrame, n: int):
    """A test of membership of long keys: one hashed bit each, in at most ``MAX_FILTER_BITS`` bits (32 MB)."""
    bits = min(MAX_FILTER_BITS, partitions_for(32 * n, 1 << 15) << 15)
    at = F.pmod(F.xxhash64("k"), F.lit(bits))
    blocks = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(
        F.collect_set(F.col("at").bitwiseAND(F.lit((1 << 15) - 1)).cast("int")).alias("on"))  # at most 32,768 values
    plane = np.zeros(bits, bool)
    for r in blocks.toLocalIterator():
        plane[r.block << 15 | np.array(r.on, np.int64)] = True
    shared = keys.sparkSession.sparkContext.broadcast(np.packbits(plane, bitorder="little"))

    @F.pandas_udf("boolean")
    def test(position):
        import pandas as pd

        p = position.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return lambda key: test(F.pmod(F.xxhash64(key), F.lit(bits)))


def whole_sets(source: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``row, set`` (sorted hashes as bytes) of every class in a pair, made from the texts again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = stored(classes.join(ends, "row", "left_semi").select("row", "key", F.xxhash64("id").alias("k")), "needed")
    test = _bit_filter(needed.select("k"), needed.count())

    def sets(batches):
        import xxhash

        for batch in batches:
            own = [s.tobytes() for s in shingle_sets(batch.column(0), words)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array(own, pa.binary())], names=["key", "set"])

    made = source.where(test(F.xxhash64("id"))).select("text").mapInArrow(sets, "key binary, set binary")
    return stored(made.join(needed.select("row", "key"), "key").dropDuplicates(["row"]).select("row", "set"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd

        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pd.Series(out, dtype=bool)

    joined = (pairs.join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
              .join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a"))
    return stored(joined.where(linked("x", "y")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """``row, label`` for all rows with a link: the smallest row that can be reached. Every round takes the smallest
    label of the neighbours, then the label of the label, so rounds grow with the logarithm of a chain's length."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("row", "other"), "edges")
    labels = stored(edges.groupBy("row").agg(F.min("other").alias("m")).select("row", F.least("row", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("row").alias("other"), "label"), "other").groupBy("row").agg(F.min("label").alias("m"))
        lower = stored(labels.join(near, "row").select("row", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        jumped = lower.join(lower.select(F.col("row").alias("label"), F.col("label").alias("up")), "label").select("row", "old", F.least("label", "up").alias("label"))
        new = stored(jumped, "labels")
        labels = new.select("row", "label")
        if new.where("old != label").isEmpty():
            return labels


def _group_parts(heads: DataFrame, member_of: DataFrame, classes: DataFrame) -> DataFrame:
    """``row, n, parts`` of each head: for a group the largest count of each part over its members, who have one size."""
    of_groups = member_of.join(classes.select("row", "n", "parts"), "row").groupBy("g").agg(
        F.first("n").alias("n"), *[F.max(F.expr(f"substring(parts, {k + 1}, 1)")).alias(f"p{k}") for k in range(PARTS)])
    of_groups = of_groups.select(F.col("g").alias("row"), "n", F.concat(*[f"p{k}" for k in range(PARTS)]).alias("parts"))
    alone = heads.select("row", "n", "parts").join(of_groups.select("row"), "row", "left_anti")
    return stored(alone.unionByName(of_groups), "group-parts")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap can reach the threshold: in each part of the hash space two sets share no more than
    the smaller of their counts. Short digests meet here, so whole sets need not."""

    @F.pandas_udf("boolean")
    def possible(na, nb, x, y):
        import pandas as pd

        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, PARTS).astype(np.int64) for v in (x, y))
        n = na.to_numpy(np.int64) + nb.to_numpy(np.int64)
        most = np.where((x == 255) & (y == 255), n[:, None], np.minimum(x, y)).sum(axis=1)
        return pd.Series((100 + percent) * most >= percent * n)

    own = classes.select("row", "n", "parts")
    joined = (pairs.join(own.toDF("a", "na", "x"), "a").join(own.toDF("b", "nb", "y"), "b"))
    return stored(joined.where(possible("na", "nb", "x", "y")).select("a", "b"), "possible")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in two components."""
    out = pairs.join(labels.select(F.col("row").alias("a"), F.col("label").alias("la")), "a", "left").join(
        labels.select(F.col("row").alias("b"), F.col("label").alias("lb")), "b", "left")
    return out.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def similar_classes(source: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signatures with their class, component labels of classes): the join itself."""
    signed = signatures(source, words, percent)
    full = signed.where("n > 0")  # copies keep their place in a class, the rest of the work is on classes
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    # what depends on the set alone is the same in all rows of a class, so any row gives it
    classes = stored(full.groupBy("key").agg(first.alias("f"), *[F.first(c).alias(c) for c in ("n", "group_key", "parts", "prefix")])
                     .select("key", F.col("f.row").alias("row"), F.col("f.id").alias("id"), "n", "group_key", "parts", "prefix"), "classes")
    of_class = classes.select("key", F.col("row").alias("class"))
    groups = stored(classes.groupBy("group_key").agg(F.min("row").alias("g"), F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    member_of = stored(classes.select("row", "group_key").join(groups, "group_key").select("row", "g"), "group-members")
    heads = classes.join(member_of.where("row != g").select("row"), "row", "left_anti")
    # size and place share one long, so a posting is three of them
    postings = heads.select(F.col("row").alias("g"), "n", F.posexplode("prefix").alias("at", "t")).select(
        "g", (F.shiftleft("n", 32) + F.col("at")).alias("na"), "t")
    met_at = postings.groupBy("t").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(_place("na"), _size("na"), "g")).alias("pivot")).where("k > 1")
    shared = stored(postings.join(met_at.select("t", "k", F.col("pivot.g").alias("c")), "t"), "shared-postings")
    narrow = shared.where(F.col("k") <= WIDE)
    group_parts = _group_parts(heads, member_of, classes)
    met = _possible(_meet(narrow, narrow, percent).distinct(), group_parts, percent)
    at_pivot = stored(shared.where((F.col("k") > WIDE) & (F.col("c") != F.col("g"))).select("c", "g").distinct(), "at-pivot")
    in_group = member_of.where("row != g").select(F.col("g").alias("a"), F.col("row").alias("b"))
    nearest = _possible(met, classes, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    to_pivot = _possible(at_pivot.select(F.col("c").alias("a"), F.col("g").alias("b")), classes, percent)

    first_pairs = stored(nearest.unionByName(to_pivot).unionByName(in_group).distinct(), "first-pairs")
    sets = whole_sets(source, classes, first_pairs.unionByName(met), words)
    links = _verify(first_pairs, sets, percent)
    labels = components(links)
    # other candidates that still lie in two components, heads alone: those of groups are members of families
    second = _possible(_labelled(met.join(first_pairs, ["a", "b"], "left_anti"), labels), classes, percent)
    links = links.unionByName(_verify(second, sets, percent))
    families = _families(at_pivot, met, in_group, member_of)
    late = _family_links(source, classes, families, labels, words, percent)
    return signed.join(of_class, "key", "left"), components(links if late is None else links.unionByName(late))


def _families(at_pivot: DataFrame, met: DataFrame, in_group: DataFrame, member_of: DataFrame) -> DataFrame:
    """``c, row``: all classes that may link with one another because their groups meet at c: c and the members of its group,
    of the groups whose shingles have c as their pivot, and of the groups that met c's group where either has members."""
    grouped = member_of.select("g").distinct()
    of_groups = met.join(grouped.withColumnRenamed("g", "a"), "a", "left_semi").unionByName(met.join(grouped.withColumnRenamed("g", "b"), "b", "left_semi")).distinct()
    centres = at_pivot.select("c", "g").unionByName(of_groups.select(F.col("a").alias("c"), F.col("b").alias("g")))
    own = centres.select("c").distinct().select("c", F.col("c").alias("g"))
    of_centres = centres.unionByName(own).join(member_of, "g", "left").select("c", F.coalesce("row", "g").alias("row"))
    groups = in_group.select(F.col("a").alias("c"), F.col("b").alias("row"))
    return stored(of_centres.unionByName(groups).unionByName(groups.select("c", F.col("c").alias("row"))).distinct(), "families")


def _family_links(source: DataFrame, classes: DataFrame, families: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between members of a family that lie in two components; only families with a member outside the centre's
    component are looked at, and in them only members that can reach the threshold with one of another component."""
    from urlsift.llm.setsketch_dedup import _blocks, _differences, _stray_links

    named = families.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")).join(
        labels.toDF("c", "of_c"), "c", "left").select("c", "row", "label", (F.col("label") != F.coalesce("of_c", "c")).alias("stray"))
    named = stored(named, "family-labels")
    mixed = named.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max("stray").alias("any")).where("k > 1 and any").select("c")
    members = _with_partners(named.join(mixed, "c", "left_semi").join(classes.select("row", "n", "parts"), "row"), percent)
    if members.isEmpty():
        return None
    sets = whole_sets(source, classes, members.select(F.col("c").alias("a"), F.col("row").alias("b")), words)
    return _stray_links(_blocks(_differences(members, sets)), percent)


PARTNER_BLOCK = 512


def _with_partners(members: DataFrame, percent: int) -> DataFrame:
    """The members (c, row, label, stray, n, parts) that may link with a member of another component, one of the two a
    stray: in blocks of one family by size, by the smaller counts of each part."""
    names = ("row", "label", "n")

    def pack(batches):
        held, key = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if held and (key != (r["c"], r["stray"]) or len(held) == PARTNER_BLOCK):
                    yield _packed(held)
                    held = []
                key = (r["c"], r["stray"])
                held.append(r)
        if held:
            yield _packed(held)

    def _packed(rows):
        sizes = [r["n"] for r in rows]
        cols = [pa.array([np.array([r[c] for r in rows], np.int64).tobytes()], pa.binary()) for c in names]
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["c"]], pa.int64()), pa.array([rows[0]["stray"]]), pa.array([min(sizes)], pa.int64()), pa.array([max(sizes)], pa.int64()),
                                           *cols, pa.array([b"".join(r["parts"] for r in rows)], pa.binary())], names=["c", "stray", "low", "high", *names, "parts"])

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = ({c: np.frombuffer(r[f"{side}_{c}"], np.int64) for c in names} for side in "xy")
                px, py = (np.frombuffer(r[f"{side}_parts"], np.uint8).reshape(-1, PARTS).astype(np.int32) for side in "xy")
                partner = np.zeros(len(py), bool)
                found = []
                for k in range(len(px)):
                    both = x["n"][k] + y["n"]
                    most = np.minimum(px[k], py).sum(axis=1)
                    full = (px[k] == 255) & (py == 255)  # 255 stands for more
                    most = np.where(full.any(axis=1), both, most)
                    may = ((100 + percent) * most >= percent * both) & (x["label"][k] != y["label"])
                    if may.any():
                        partner |= may
                        found.append(x["row"][k])
                rows = np.concatenate([np.array(found, np.int64), y["row"][partner]])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), r["c"])), pa.array(rows)], names=["c", "row"])

    members = stored(members, "mixed")
    ordered = members.repartitionByRange("c", "stray", "n", "row").sortWithinPartitions("c", "stray", "n", "row")
    blocks = stored(ordered.mapInArrow(pack, "c long, stray boolean, low long, high long, row binary, label binary, n binary, parts binary")
                    .withColumn("block", F.monotonically_increasing_id()), "partner-blocks")
    light = blocks.select("c", "block", "stray", "low", "high")
    near = (F.lit(100) * F.col("x_high") >= percent * F.col("y_low")) & (F.lit(100) * F.col("y_high") >= percent * F.col("x_low"))
    pairs = light.where("stray").toDF("c", "x_block", "x_stray", "x_low", "x_high").join(light.toDF("c", "y_block", "y_stray", "y_low", "y_high"), "c").where(
        near & F.expr("not y_stray or x_block <= y_block"))
    side = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in (*names, "parts")])
    joined = pairs.select("c", "x_block", "y_block").repartition("x_block", "y_block").join(side("x"), "x_block").join(side("y"), "y_block")
    found = joined.mapInArrow(meet, "c long, row long").distinct()
    return stored(members.join(found, ["c", "row"], "left_semi").select("c", "row", "label", "stray"), "partners")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``<id_col>, n_shingles, component_id`` for every row."""
    signed, labels = similar_classes(id_text(docs, id_col, text_col), words, percent)
    named = stored(signed.select("id", "n", "row", F.col("class")).join(labels.select(F.col("row").alias("class"), "label"), "class", "left")
                   .select("id", "n", F.coalesce("label", "class", "row").alias("c")), "members")
    # a component's id is its smallest document id; rows of small components name themselves in the same aggregation
    ids = stored(named.groupBy("c").agg(F.min("id").alias("component_id")), "component-ids")
    return named.join(ids, "c").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (rows without words all stay)."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    out = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(out, docs[id_col].eqNullSafe(out["__gone"]), "left_anti")
