"""Training-data operators on small fixtures: brute force, round trips and awkward rows (nulls, empty and long texts,
ties, repeated rows, empty tables, clashing column names)."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex

from urlsift.llm import bloom_lm, bpe_transducer, exact_dedup, jaccard_groupjoin, license_setjoin, packing, pii_weak, quality_divergence, simple8b, template_extract
from urlsift.llm.queries import split_pattern, vocabulary

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "river", "stone", "cloud", "Zürich", "été", "x1", "don't"]


def _texts():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(400)) * rng.randrange(2) for _ in range(n))
    base = say(120)
    out = [None, "", " \t\n", "one", "two words", base, base, base.replace(" ", "  ", 5), base + " end", say(30), "日本語 テキスト x y \r\n a\x1cb",
           "a  b\n\n\nc ", "word " * 3000, "MIT License and GNU General Public License\nLicensed under CC BY-NC 4.0.", "😀" * 50 + " é̀",
           'mail a.b@c.example.org, 10.0.0.300 1.2.3.4, 4539 1488 0343 6467 +1 (212) 555-0100 token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "+1 2", "x@y",
           "one <|endoftext|>two  <|endoftext|> <|startoftext|><|ENDOFTEXT|> \n<|endoftext|>"]
    return [(k, t) for k, t in enumerate(out + [say(200)] * 3)] + [(None, "no id"), (4, "two words")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "kept", 1, "row") for i, t in _texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n long, row string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_exact_dedup_against_brute_force(docs, empty):
    groups = defaultdict(list)
    for i, t in _texts():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.dedup_decisions(docs).collect()
    assert len(got) == len(_texts())
    for r in got:
        own = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(own)[3], len(own)) and r.kept == (r.doc_id == r.keep_id)
    stay = exact_dedup.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.dedup_decisions(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_full_filter_lets_rows_through_but_stays_exact(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BLOCK_BITS)
    assert exact_dedup.filter_bits(10**9) == exact_dedup.BLOCK_BITS
    assert exact_dedup.dedup_decisions(docs).where("group_size > 1").count() >= 9


def _ids(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


def test_packing_places_every_id_once(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, split_pattern(), max_tokens=64).collect()
    total = sum(len(_ids(path, t or "")) + 1 for _, t in _texts())
    assert sum(r.length for r in rows) == total
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    ids = np.array(_ids(path, _texts()[5][1]) + [1], "<u4")
    assert crc[5, 0] == zlib.crc32(ids[:64].tobytes()) and crc[5, 64] == zlib.crc32(ids[64:128].tobytes())
    assert packing.pack_documents(empty, path, split_pattern()).count() == 0


def test_pack_histogram_places_all_lengths():
    rng = random.Random(3)
    hist = {rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(300)} | {1: 5000, 2048: 3}
    patterns = packing.pack_histogram(hist, 2048)
    placed = Counter()
    for count, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            placed[n] += k * count
    assert placed == Counter(hist)
    least = max(sum(n * k for n, k in hist.items()) / 2048, sum(k for n, k in hist.items() if n > 1024))
    assert sum(c for c, _ in patterns) <= 1.15 * least + 1  # few distinct lengths in lumps; natural lengths leave under 1 %


def test_transducer_equals_rank_encoder_and_round_trips(docs, empty):
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bpe_transducer.TransducerCodec(path, split_pattern())
    rng = random.Random(5)
    odd = ["".join(rng.choice("aeiouthsn rl'1 \n\t.é日😀 ") for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in [*odd, "a" * 3000, "the" * 500, *(t or "" for _, t in _texts())]:
        ids = codec.encode(text)
        assert ids == enc.encode_ordinary(text) and codec.decode(ids) == text
    small = bpe_transducer.MergeTransducer(ranks, max_states=50)  # the table is dropped again and again
    for piece in regex.findall(split_pattern(), " ".join(odd[:100])):
        assert small.encode_piece(piece.encode()) == enc.encode_ordinary(piece)
    back = bpe_transducer.decode_documents(bpe_transducer.encode_documents(docs, path, split_pattern()), path, split_pattern())
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in _texts())
    assert bpe_transducer.code_digests(empty, path, split_pattern()).count() == 0


def test_words_and_marks_behind_a_space_equal_the_pattern():
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
    codec = bpe_transducer.TransducerCodec(path, split_pattern())
    assert bpe_transducer._words_are_pieces(regex.compile(split_pattern()).findall)
    assert not bpe_transducer._words_are_pieces(regex.compile(r"\S+|\s+").findall)  # another pattern goes the general way
    rng = random.Random(7)
    parts = ["abc", "it's", "we're", "ÉtéÇ", "ªº", "ɏɐ", "x1", "12", "日本", "don't'", "'ll"]
    for _ in range(3000):
        text = " ".join(rng.choice(parts) + "".join(rng.choices("'.,!?-_\"*\n\t", k=rng.randrange(4))) for _ in range(6))
        assert codec.encode(text) == enc.encode_ordinary(text)


def test_utf8_stream_keeps_split_characters():
    text = "aé日😀z" * 5
    for size in (1, 2, 3, 5):
        s, raw = bpe_transducer.Utf8Stream(), text.encode()
        assert "".join([s.feed(raw[k:k + size]) for k in range(0, len(raw), size)] + [s.feed(b"", True)]) == text


def test_quality_counts_against_brute_force(docs, empty):
    got = quality_divergence.quality_rules(docs).collect()
    assert len(got) == len(_texts())
    counts = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed) for r in got)
    for i, t in _texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, marks = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if seen[tuple(w[k:k + 8])] > 1:
                marks.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert counts[i, len(w), len(marks), len(lines) - len(set(lines)), len(w) < 20 or 100 * len(marks) > 30 * len(w)]
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_divergence.keep_passing(docs).columns == docs.columns
    assert quality_divergence.quality_rules(empty).count() == 0
    assert quality_divergence.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0


def test_main_text_of_awkward_pages(spark):
    page = ('<html><head><title>t</title></head><body><nav>menu</nav><div class="sidebar">side</div><article><h1>A &amp; B</h1><p>one\n two<br>three'
            '<p>four <b>five</b></p><div class="comments"><p>reader</p></div><form><p>f</p></form><script>var a="<p>x</p>";</script></article><footer>foot</footer>')
    shell = "<body><div>Site name</div><div>Log in</div><div>About us</div><p>Text {k} here</p></body>"
    rows = [(k, "http://h.example.org/a", shell.replace("{k}", str(k))) for k in range(6)] + [(9, None, None), (10, None, ""), (3, "http://z.example.org", page)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in template_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3, "http://z.example.org"][0] == "A & B\none two three\nfour five"
    assert got[2, "http://h.example.org/a"] == ("Text 2 here", 11) and got[9, None] == ("", 0)
    assert template_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_in_furniture_do_not_hide_the_main_text(spark):
    body = "<div><p>" + "A long first paragraph of page {k}. " * 5 + "</p><p>Second of {k}</p></div>"
    comments = '<section class="comments"><article><p>reader {k}</p></article></section>'
    shapes = (body + comments, body + "<article><p>teaser {k}</p></article>" + comments)
    rows = [(k, "http://h.example.org/a", f"<body>{shapes[k % 2]}</body>".replace("{k}", str(k))) for k in range(6)]
    for r in template_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        want = " ".join([f"A long first paragraph of page {r.page_id}."] * 5) + f"\nSecond of {r.page_id}"
        assert r.text == want + f"\nteaser {r.page_id}" * (r.page_id % 2)


def test_lm_base_score_is_exact_and_model_learns(spark, docs, empty, monkeypatch):
    import math

    monkeypatch.setattr(bloom_lm, "TOP_WORDS", 5)
    tokens = [(i, [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]) for i, t in _texts()]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for _, t in tokens)
    got = bloom_lm.lm_scores(docs).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and all(r.train_tokens == n for r in got)
    assert bloom_lm.lm_scores(empty).count() == 0
    keys, counts = np.arange(1000, dtype=np.uint64) * 16, np.arange(1, 1001)
    bloom = bloom_lm.LogBloom([bloom_lm.LogBloom.build(keys, bloom_lm.levels_of(counts), 64_000)] * 16, 16)
    assert (bloom.levels(keys) >= bloom_lm.levels_of(counts)).all()


def test_lm_scores_do_not_depend_on_the_broadcast_bound(docs, empty, monkeypatch):
    monkeypatch.setattr(bloom_lm, "RUN_TOKENS", 300)  # several runs
    rows = lambda **own: sorted(map(repr, bloom_lm.lm_scores(docs, **own).collect()))
    assert rows(max_bits=1024) == rows() and len(rows(max_bits=1024)) == len(_texts())
    assert bloom_lm.lm_scores(empty, max_bits=0).count() == 0


def test_lm_stores_bigrams_seen_once(spark):
    lines = ["w1 w2", "w1 w3", "w2 w3 w2"] * 3 + ["w3 w1"]
    inside = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [*zip(inside, lines, strict=False), (next(i for i in range(100) if i not in inside), "w3 w1")]
    got = {r.doc_id: r.score for r in bloom_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    c = Counter(w for t in lines for w in [*t.split(), "\n"])
    pairs = Counter(p for t in lines for p in zip(["\n", *t.split()], [*t.split(), "\n"], strict=True))
    assert pairs["w3", "w1"] == 1
    n, v = sum(c.values()), len(c)
    read = lambda k: float(bloom_lm.count_of(bloom_lm.levels_of(np.array([k])))[0]) if k else 0.0
    p = lambda a, b: (read(pairs[a, b]) + bloom_lm.MU * (read(c[b]) + 0.5) / (n + 0.5 * (v + 1))) / (max(read(c[a]), read(pairs[a, b])) + bloom_lm.MU)
    want = sum(np.log10(min(p(a, b), 1.0)) for a, b in (("\n", "w3"), ("w3", "w1"), ("w1", "\n")))
    assert abs(got[rows[-1][0]] - want) < 1e-9


def test_license_labels_against_brute_force(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in license_setjoin.scan_licenses(docs).collect()}
    r = next(v for (i, _), v in got.items() if i == 13)
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (3, 0, 9, "cc-by,gpl,mit", "cc-by,cc-by-nc,gpl,mit")
    assert license_setjoin.scan_licenses(docs).count() == len(_texts()) and license_setjoin.scan_licenses(empty).count() == 0
    plain = license_setjoin.scan_licenses(docs, templates=[])
    assert plain.where("labels != base_labels").count() == 0


def test_simple8b_round_trip_with_escapes(spark, docs, empty):
    rng = np.random.default_rng(1)
    for bits in (1, 3, 9, 16, 31, 59, 64):
        values = rng.integers(0, 1 << bits, 3000, dtype=np.uint64) if bits < 64 else rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
        sizes = [0, 1, 1000, 0, 1999]
        words, counts = simple8b.pack_words(values, sizes)
        assert (simple8b.unpack_words(words) == values).all() and sum(counts) == len(words)
        image = simple8b.write_segment(sizes, counts, words.tobytes())
        assert (simple8b.segment_document(image, 2) == values[1:1001]).all()
    path = vocabulary("word_bpe_49k.json")
    rows = simple8b.read_token_files(simple8b.write_token_files(docs, path, 2, segment_ids=500), with_ids=True).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        at += r.n_tokens
    assert Counter(tuple(r.token_ids) for r in rows) == Counter((*_ids(path, t or ""), 2) for _, t in _texts())
    assert simple8b.read_token_files(simple8b.write_token_files(empty, path, 2)).count() == 0


def test_personal_data_spans_and_redaction(docs, empty):
    got = [r for r in pii_weak.find_personal_data(docs).collect()]
    assert len(got) == len(_texts())
    r = next(r for r in got if r.doc_id == 15)
    text = _texts()[15][1]
    kinds = {k: text[int(a):int(b)] for k, a, b in (x.split(":") for x in r.spans.split(","))}
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert kinds["email"] == "a.b@c.example.org" and kinds["ip"] == "1.2.3.4" and kinds["card"] == "4539 1488 0343 6467" and kinds["phone"] == "+1 (212) 555-0100"
    assert kinds["secret"] == "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    clean = {(x.doc_id, x.text) for x in pii_weak.redact(docs).collect()}
    assert (15, 'mail [EMAIL], 10.0.0.300 [IP], [CARD] [PHONE] token = "[SECRET]"') in clean and (0, None) in clean
    assert pii_weak.find_personal_data(empty).count() == 0 and pii_weak.redact(empty).count() == 0


def test_em_finds_the_unreliable_labeler():
    posterior, reliability = pii_weak.fit_labelers({(1, 1, 1): 50, (1, 1, -1): 45, (-1, -1, 1): 50, (-1, -1, -1): 55})
    assert reliability[0] > 0.9 and reliability[2] < 0.65 and posterior[1, 1, -1] > 0.9 > 0.1 > posterior[-1, -1, 1]


def test_jaccard_components_against_brute_force(spark, empty, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(60):  # a large group of near copies, some too far from each other
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [texts[7]] * 3 + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[k] = {tuple(w[j:j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {k: (len(sets[k]), find(k)) for k in sets}
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    for wide in (1000, 4):  # the second sends the group through pivots
        monkeypatch.setattr(jaccard_groupjoin, "WIDE", wide)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groupjoin.near_duplicates(frame).collect()} == want
    stay = jaccard_groupjoin.drop_near_duplicates(frame)
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c in want.values()}) and stay.columns == frame.columns
    assert jaccard_groupjoin.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("wide", [1000, 1])  # the second sends the groups through pivots
def test_members_link_where_group_heads_do_not(spark, monkeypatch, wide):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_groupjoin, "WIDE", wide)
    # a constant sketch orders shingles by hash alone, so texts with the same first hashes and size form a group
    monkeypatch.setattr(jaccard_groupjoin, "frequency_sketch", lambda *_: np.full(jaccard_groupjoin.SKETCH_COUNTERS, 10, np.int32))
    sets, want = [], []
    for letter, shorter, own in (("w", (1,), [0, 1, 1]), ("v", (0, 1), [3, 4, 3, 4])):
        words = [f"{letter}{k}" for k in range(1000)]
        hashes = [int(s[0]) for s in jaccard_groupjoin.shingle_sets(pa.array(words), 1)]
        words = [w for _, w in sorted(zip(hashes, words, strict=True))]
        pair = [words[:31] + words[100:369], words[:31] + words[500:769]]  # 300 words each, the same prefix
        sets += pair + [pair[k][:295] for k in shorter]
        want += own
    rows = [(k, " ".join(s)) for k, s in enumerate(sets)]
    got = jaccard_groupjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), words=1).collect()
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in got)] == want


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in _texts()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert kept <= {i for i, t in _texts() if len((t or "").split()) >= 20} and len(kept) >= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
