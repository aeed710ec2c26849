"""Personal-data spans against a plain regular-expression reading, on awkward rows and on texts with very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from urlsift.llm import pii_weak
from urlsift.llm.common import text_of

# fixed values: the base patterns as the contract writes them
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if _good(k, m.group())]


def plain_wide(text):
    return [(k, m.start(), m.end()) for k, p in pii_weak.PROPOSALS.items() for m in re.finditer(p, text or "")]


def plain_redact(text, spans):
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _parsed(spans):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def _made(rng, n):
    parts = ["mail a.b@c.example.org", "x@y", "10.0.0.3", "10.0.0.300", "4539 1488 0343 6467", "4539 1488 0343 6468", "+1 (212) 555-0100", "+1 2",
             "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", "ssn 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "call 212 555 0100", "Dr. Ada Lovelace",
             "12345@678.90", "aaaaaaaaaaaaaaaaaaaaaaaa@b.cc", "+49 4539148803436467", "日本 😀 é", "\n", "plain words"]
    return rng.choice([" ", ", ", "", "\n"]).join(rng.choice(parts) for _ in range(n))


def _texts():
    rng = random.Random(11)
    return [None, "", " \n", "a@b.cc", "no data", *(_made(rng, rng.choice([1, 3, 12, 60])) for _ in range(150)), _made(rng, 1500), "x@y.zz " * 700]


def test_spans_and_redaction_equal_a_plain_reading(spark):
    texts = dict(enumerate(_texts()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    wide = F.concat(*[pii_weak._spans(text_of("text"), k, p, pii_weak.PROPOSAL_HINTS[k]) for k, p in pii_weak.PROPOSALS.items()])
    base = F.concat(*[pii_weak._bare(k) for k in pii_weak.BASE])
    scanned = docs.select("doc_id", *[c.alias(k) for k, c in pii_weak.base_spans(text_of("text")).items()], wide.alias("wide"))
    for r in scanned.select("doc_id", "wide", base.alias("base"), pii_weak._apart(base, F.col("wide")).alias("apart")).collect():
        text, own = texts[r.doc_id] or "", plain_base(texts[r.doc_id])
        assert [(x.kind, x.s, x.e) for x in r.base] == own
        proposed = plain_wide(text)
        assert sorted((x.kind, x.s, x.e) for x in r.wide) == sorted(proposed)
        assert all(x.m == text[x.s:x.e] and text[:x.s].endswith(x.before) and text[x.e:].startswith(x.after) for x in r.wide)
        free = [(k, s, e) for k, s, e in proposed if not any(s < f and b < e for _, b, f in own)]
        assert sorted((x.kind, x.s, x.e) for x in r.apart) == sorted(free)
    spans = {r.doc_id: _parsed(r.spans) for r in pii_weak.find_personal_data(docs).collect()}
    assert len(spans) == len(texts) and all(set(plain_base(t)) <= set(spans[k]) for k, t in texts.items())
    assert any(len(spans[k]) > len(plain_base(t)) for k, t in texts.items())
    for r in pii_weak.redact(docs).collect():
        text = texts[r.doc_id]
        assert r.text == (text and plain_redact(text, [(s, e, k) for k, s, e in spans[r.doc_id]]))


def test_time_follows_the_number_of_matches(spark):
    def seconds(n):
        text = " ".join(f"name{k}@example.org 123-45-{k % 10000:04d}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii_weak.find_personal_data(docs).first()
        cleaned = pii_weak.redact(docs).first().text
        assert row.n_email == n and len(_parsed(row.spans)) >= n and "@" not in cleaned and cleaned.count("[EMAIL]") == n
        return time.time() - began

    seconds(10)
    small, large = seconds(1_000), seconds(12_000)
    assert large < 8 * small + 20  # a square would be 144 times
