"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Wider patterns propose further spans
(secrets, account and identity numbers, local phone numbers, titled names). On each proposal labelers of three sorts
vote for, against or not at all: shape patterns, gazetteers of words that announce a kind, and the context around the
span. Votes are counted by pattern; expectation-maximisation over those counts estimates each labeler's reliability
and the probability of every vote pattern. These probabilities are the soft labels of the final classifier, a
naive-Bayes model over span features, which decides which proposals are spans.

Scale. Everything per document is DataFrame expressions in one scan without a shuffle. Matches come with their
positions from splitting the text at the same pattern. Only proposals leave the scan; the driver sees vote patterns
(at most 3 to the number of labelers) and feature counts (a fixed set), never spans. Patterns are written so that a long
run of letters or digits costs linear time, and positions, overlaps and cuts of a text with very many matches are
running folds in blocks, which copy at most a block for each match.

Defined results. Null or empty text: no spans, and the digest of nothing. Positions are code points, end exclusive.
Ids may be null or repeat: results go by row. An empty table gives an empty result. Without proposals no model is
fitted and the base spans are all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import let, stored, text_of

# fixed values: the base patterns. A match can only begin where a run of its characters begins or the last match
# ended, which the look-behind says, so that runs are not tried again from each of their characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without this cannot hold the kind
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

# proposals of the method, by kind
PROPOSALS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
PROPOSAL_HINTS = {"secret": r"[A-Za-z0-9+/_=-]{20}", "ssn": r"[0-9]-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "local_phone": r"[0-9][ .-][0-9]{4}",
                  "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]"}
KINDS = [*BASE, *PROPOSALS]

# gazetteer: words that announce a kind
ANNOUNCED = {
    "secret": "token|secret|passwd|password|api[_ -]?key|key|bearer|credential|auth",
    "ssn": "ssn|social security|identity|tax id",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local_phone": "phone|tel|telephone|mobile|call|fax|contact",
    "name": "name|signed|contact|regards|by|from|author",
}
_BEFORE = 40  # characters of context kept on either side
_BLOCK = 256  # elements that running folds append to one another
_CHUNK = 4096  # characters of a text from which a piece is cut

_SPAN = "array<struct<kind:string,s:int,e:int,m:string,before:string,after:string>>"


def _running(values: Column, combine) -> Column:
    """``values`` (ints) folded from the first to each one, in blocks, so that appending copies no more than a block."""

    def few(block):
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(
            F.coalesce(combine(F.get(acc, F.size(acc) - 1), v), v))))

    def blocks(a):
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(_BLOCK))
        return F.transform(starts, lambda at: few(F.slice(a, at + 1, F.lit(_BLOCK))))

    def join(folded):
        def shift(before):
            return F.flatten(F.transform(folded, lambda block, k: let(F.get(before, k - 1), lambda own: F.transform(
                block, lambda v: F.coalesce(combine(own, v), v)))))

        return let(few(F.transform(folded, lambda block: F.element_at(block, -1))), shift)

    return F.when(F.size(values) == 0, values).otherwise(let(let(values, blocks), join))


def _spans(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All matches with positions: the text is split at the pattern, and the lengths of gaps and matches add up."""

    def place(t):
        gaps, found = t["gaps"], t["found"]
        ends = _running(F.transform(found, lambda m, k: F.char_length(F.get(gaps, k)) + F.char_length(m)), lambda x, y: x + y)
        return let(ends, lambda end: F.transform(found, lambda m, k: F.struct(
            F.lit(kind).alias("kind"), (F.get(end, k) - F.char_length(m)).alias("s"), F.get(end, k).alias("e"), m.alias("m"),
            F.right(F.get(gaps, k), F.lit(_BEFORE)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(_BEFORE)).alias("after"))))

    split = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    has = text.contains(hint) if kind == "email" else text.rlike(hint)
    return F.when(has, let(split, place).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def add(total, k):
        d = F.substring(digits, k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.char_length(bare) <= 3) & (F.coalesce(F.when(bare == "", F.lit(0)).otherwise(F.left(bare, F.lit(3)).cast("int")), F.lit(0)) <= 255)


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["m"], r"\."), _byte),
    "card": lambda x: F.when(F.char_length(_digits(x["m"])).between(13, 19), _luhn(x["m"])).otherwise(F.lit(False)),
    "phone": lambda x: F.char_length(_digits(x["m"])).between(9, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    return {k: F.filter(_spans(text, k, p, HINTS[k]), _VALID[k]) for k, p in BASE.items()}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes() -> Column:
    """One vote (1, -1 or 0) of each labeler on a proposal."""
    m, before, after, kind = (F.col(f"x.{c}") for c in ("m", "before", "after", "kind"))
    announced = F.lit(False)
    for k, words in ANNOUNCED.items():
        announced = announced | ((kind == k) & before.rlike(rf"(?i)(?<![a-z])(?:{words})[^a-z0-9\n]{{0,12}}$"))
    other = F.lit(False)
    for k, words in ANNOUNCED.items():
        other = other | ((kind != k) & before.rlike(rf"(?i)(?<![a-z])(?:{words})[^a-z0-9\n]{{0,12}}$"))
    secret = kind == "secret"
    shape = _vote(F.when(secret, m.rlike("[0-9]") & m.rlike("[A-Za-z]")).otherwise(m.rlike("[0-9]")),
                  F.when(secret, ~m.rlike("[0-9]") | m.rlike(r"^[-_=+/]+$") | m.rlike("/.*/.*/")).otherwise(F.lit(False)))
    dense = _vote(F.when(secret, m.rlike("^[0-9a-f]{32,}$") | m.rlike("(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])^[A-Za-z0-9+/_=-]{24,}$"))
                  .when(kind == "iban", F.char_length(m).between(15, 42)).otherwise(F.lit(False)),
                  secret & m.rlike("^[a-z]+(?:[-_][a-z0-9]+)+$"))
    assigned = _vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("[/.@#&?]$") | after.rlike("^[@/]"))
    quoted = _vote(before.rlike("[\"'`(<]$") & after.rlike("^[\"'`)>]"), F.lit(False))
    return F.array(_vote(announced, other), shape, dense, assigned, quoted)


def _features() -> Column:
    m, before, after, kind = (F.col(f"x.{c}") for c in ("m", "before", "after", "kind"))
    size = F.when(F.char_length(m) < 24, "short").when(F.char_length(m) < 48, "middle").otherwise("long")
    mix = F.concat(*[F.when(m.rlike(p), F.lit(c)).otherwise(F.lit("")) for p, c in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9"), ("[^A-Za-z0-9]", "-"))])

    def edge(c):
        return F.when(c == "", "none").when(c.rlike(r"^\s$"), "space").when(c.rlike("^[\"'`]$"), "quote").when(c.rlike("^[A-Za-z0-9]$"), "word").otherwise("mark")

    return F.array(F.concat(F.lit("kind:"), kind), F.concat(F.lit("size:"), kind, size), F.concat(F.lit("mix:"), kind, mix),
                   F.concat(F.lit("before:"), edge(F.right(before, F.lit(1)))), F.concat(F.lit("after:"), edge(F.left(after, F.lit(1)))))


def fit_labelers(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """EM over vote patterns with counts: the probability of each pattern and the reliability of each labeler.

    Abstentions say nothing. Reliabilities begin at 0.8 and stay within 0.55 and 0.99, which keeps the meaning of the
    two classes; one imagined right and wrong vote smooths each."""
    if not patterns:
        return {}, []
    labelers = len(next(iter(patterns)))
    reliability, prior = [0.8] * labelers, 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in patterns:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, reliability, strict=True))
            posterior[votes] = 1 / (1 + math.exp(-odds))
        total = sum(patterns.values())
        prior = min(0.95, max(0.05, (1 + sum(n * posterior[v] for v, n in patterns.items())) / (2 + total)))
        for j in range(labelers):
            right = sum(n * (posterior[v] if v[j] > 0 else 1 - posterior[v]) for v, n in patterns.items() if v[j])
            cast = sum(n for v, n in patterns.items() if v[j])
            reliability[j] = min(0.99, max(0.55, (1 + right) / (2 + cast)))
    return posterior, reliability


def _literal_map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])


def classify(proposals: DataFrame) -> DataFrame:
    """Adds ``accepted`` to proposals with ``votes`` and ``features``: EM on votes, then the span classifier."""
    counts = {tuple(r.votes): r.n for r in proposals.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = fit_labelers(counts)
    if not posterior:
        return proposals.withColumn("accepted", F.lit(False))
    soft = _literal_map({",".join(map(str, v)): p for v, p in posterior.items()})
    labelled = proposals.withColumn("p", F.element_at(soft, F.array_join(F.col("votes").cast("array<string>"), ",")))
    seen = labelled.select(F.explode("features").alias("f"), "p").groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes = sum(n * posterior[v] for v, n in counts.items())
    no = sum(counts.values()) - yes
    weights = {r.f: math.log((r.yes + 1) / (yes + 2)) - math.log((r.no + 1) / (no + 2)) for r in seen}
    odds = F.aggregate("features", F.lit(math.log((yes + 1) / (no + 1))), lambda a, f: a + F.element_at(_literal_map(weights), f))
    # the votes are evidence on the span itself, so they count beside its features
    own = F.log(F.col("p") / (1 - F.col("p")))
    return labelled.withColumn("accepted", odds + own > 0).drop("p")


def _scan(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    base = base_spans(text)
    wide = F.concat(*[_spans(text, k, p, PROPOSAL_HINTS[k]) for k, p in PROPOSALS.items()])
    return docs.select(*keep, *[c.alias(k) for k, c in base.items()], wide.alias("wide"))


def _apart(base: Column, wide: Column) -> Column:
    """The elements of ``wide`` that overlap no element of ``base``: in the order of starts, no base span before one may
    reach beyond its start, and none behind it may start before its end."""
    last = F.lit(2147483647)
    mixed = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("k"))),
                                  F.transform(wide, lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), k.alias("k")))))

    def pick(items):
        reach = _running(F.transform(items, lambda x: F.when(x["k"] < 0, x["e"]).otherwise(F.lit(0))), F.greatest)
        following = F.reverse(_running(F.reverse(F.transform(items, lambda x: F.when(x["k"] < 0, x["s"]).otherwise(last))), F.least))
        return let(F.struct(reach.alias("reach"), following.alias("next")), lambda t: F.transform(F.filter(
            items, lambda x, i: (x["k"] >= 0) & (F.get(t["reach"], i) <= x["s"]) & (F.get(t["next"], i) >= x["e"])), lambda x: F.get(wide, x["k"])))

    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(let(mixed, pick))


def _found(scanned: DataFrame) -> DataFrame:
    """``row, method``: accepted proposals that do not overlap a base span, as (kind, s, e)."""
    base = F.concat(*[_bare(k) for k in BASE])
    proposals = stored(scanned.where(F.size("wide") > 0).select("row", F.explode(_apart(base, F.col("wide"))).alias("x"))
                       .select("row", "x.kind", "x.s", "x.e", _votes().alias("votes"), _features().alias("features")), "proposals")
    return classify(proposals).where("accepted").groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("method"))


def _in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    keyed = F.transform(spans, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _bare(name: str) -> Column:
    return F.transform(name, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


_NONE = "array<struct<kind:string,s:int,e:int>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_email, n_ip, n_card, n_phone, base_spans, spans`` for every row; spans as ``kind:start:end`` lists."""
    scanned = stored(_scan(docs, [F.col(f"`{id_col}`").alias("id")], text_of(text_col)).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    base = F.concat(*[_bare(k) for k in BASE])
    return scanned.join(_found(scanned), "row", "left").select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], _in_order(base).alias("base_spans"),
        _in_order(F.concat(base, F.coalesce("method", F.array().cast(_NONE)))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; spans that touch or overlap are replaced together, by the mark
    of the first. Rows without spans keep their text as it is (null stays null)."""
    columns = docs.columns
    held = stored(_scan(docs, [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")], text_of(text_col))
                  .withColumn("row", F.monotonically_increasing_id()), "pii-docs")
    joined = held.join(_found(held), "row", "left")
    spans = F.array_sort(F.transform(F.concat(*[_bare(k) for k in BASE], F.coalesce("method", F.array().cast(_NONE))),
                                     lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), F.lit(0))

    def piece(held, a, b):
        first = F.floor(a / _CHUNK).cast("int")
        own = F.slice(held, first + 1, F.floor((b - 1) / _CHUNK).cast("int") - first + 1)
        return F.when(a >= b, F.lit("")).otherwise(F.substring(F.array_join(own, ""), a % _CHUNK + 1, b - a))

    def cut(t):
        marks, held, reach = t["spans"], t["chunks"], t["reach"]

        def replaced(x, k):
            at = F.coalesce(F.get(reach, k - 1), F.lit(0))
            return F.when(x["s"] < at, F.lit("")).otherwise(F.concat(piece(held, at, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))

        return F.concat(F.array_join(F.transform(marks, replaced), ""), piece(held, F.get(reach, F.size(reach) - 1), t["size"]))

    whole = F.struct(F.col("all").alias("spans"), chunks.alias("chunks"), F.char_length(text).alias("size"),
                     _running(F.transform("all", lambda x: x["e"]), F.greatest).alias("reach"))
    clean = F.when(F.size("all") == 0, F.col("doc")[text_col]).otherwise(let(whole, cut))
    return joined.withColumn("all", spans).withColumn("clean", clean).select(
        *[F.col("clean").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in columns])
