"""Template deduction (op5): classes against a plain recount, and pages whose text a template must not take or leave."""

from collections import Counter, defaultdict

from urlsift.llm import template_extract as te

SCHEMA = "page_id long, url string, html string"


def _texts(spark, rows):
    return {r.page_id: r.text for r in te.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def _page(k, host="h"):
    menu = "".join(f"<div>entry {j}</div>" for j in range(30))
    return k, f"http://{host}.example.org/{k}", f"<body>{menu}<article><p>Short {k}</p></article><div>Imprint of all</div></body>"


def test_short_article_under_a_plain_menu(spark):
    got = _texts(spark, [_page(k) for k in range(5)] + [_page(9, "single")])
    assert all(got[k] == f"Short {k}" for k in (0, 1, 2, 3, 4, 9))


def test_copies_keep_their_text(spark):
    body = "<body><div>Site</div><div><p>First of the copies, a long line of words.</p><p>Second one.</p><p>Third one.</p></div></body>"
    other = "<body><div>Site</div><div><p>Another page, with other words in its text.</p></div></body>"
    got = _texts(spark, [(k, "http://c.example.org/", body) for k in range(3)] + [(3, "http://c.example.org/x", other)])
    assert all("First of the copies, a long line of words.\nSecond one.\nThird one." in got[k] for k in range(3))
    assert "Another page, with other words in its text." in got[3]


def test_each_layout_has_its_own_wording(spark):
    def page(k):
        bar = "".join(f"<div>{'abc'[k % 3]} item {j}</div>" for j in range(3))
        return k, "http://l.example.org/", f'<body><section class="bar{"xyz"[k % 3]}">{bar}</section><section class="t"><p>Text number {k} here</p></section></body>'

    assert _texts(spark, [page(k) for k in range(12)]) == {k: f"Text number {k} here" for k in range(12)}


def test_passage_shared_by_articles_stays(spark):
    shared = "".join(f"<p>Shared line {j} of a passage that several articles quote.</p>" for j in range(4))
    rows = [(k, "http://p.example.org/", f"<body><article><h1>Title {k}</h1>{shared if k < 4 else ''}<p>Own {k}</p></article></body>") for k in range(6)]
    got = _texts(spark, rows)
    assert all(("Shared line 0" in got[k]) == (k < 4) and got[k].startswith(f"Title {k}\n") and got[k].endswith(f"Own {k}") for k in range(6))


def test_wording_inside_articles_of_many_pages_goes(spark):
    fixed = "".join(f"<span class='x'><div>Fixed {j}</div></span>" for j in range(3))
    rows = [(k, "http://f.example.org/", f"<body><article><h1>Title {k}</h1><p>Own text {k}</p>{fixed}</article></body>") for k in range(25)]
    assert _texts(spark, rows) == {k: f"Title {k}\nOwn text {k}" for k in range(25)}


def test_classes_against_a_plain_recount(spark):
    rows = [_page(k) for k in range(5)] + [_page(2)] + [
        (20 + k, "http://o.example.org/", f"<body>{'<i>a</i><div>b</div>' if k % 2 else '<div>b</div><i>a</i>'}<div class='n{k}'>c</div><p>{k}</p></body>") for k in range(6)] + [(40, None, None)]
    got = {(r.host, r.token, r.is_text) for r in te.templates(te.parsed_pages(spark.createDataFrame(rows, SCHEMA), "page_id", "url", "html")).collect()}
    pages = defaultdict(dict)
    for _, url, html in rows:
        copy, own = te.page_tokens(*te.parse(html or ""))
        pages[url.split("/")[2] if url else ""][copy] = own
    want = set()
    for host, distinct in pages.items():
        vectors, about = defaultdict(list), {}
        for copy, own in sorted(distinct.items()):
            for token, parent, is_text, main, times, at in own:
                vectors[token].append((copy, times))
                about[token] = (parent, is_text, main or about.get(token, (0, 0, False))[2])
        classes = defaultdict(list)
        for token, vector in vectors.items():
            classes[tuple(vector)].append(token)
        for vector, members in classes.items():
            orders = {tuple(t[0] for t in sorted(distinct[copy], key=lambda t: t[5]) if t[0] in members) for copy, _ in vector}
            if len(vector) >= te.MIN_PAGES and len(members) >= te.MIN_TOKENS and len(orders) == 1:
                for token in members:
                    parent, is_text, main = about[token]
                    pages_around = len(vectors[parent]) if parent in vectors and not about[parent][1] else len(vector)
                    share = len(vector) / pages_around
                    if not is_text or (len(vector) >= te.MAIN_PAGES and share >= te.MAIN_SHARE if main else share >= te.MIN_SHARE):
                        want.add((host, token, is_text))
    assert got == want and Counter(t for _, _, t in got)[True] >= 31


def test_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 1), (1, "u", "<p>a</p>", "y", 2), (None, None, None, None, None)],
                               "page_id long, url string, html string, host string, row long")
    assert sorted((r.page_id or 0, r.text) for r in te.extract_main_text(df).collect()) == [(0, ""), (1, "a"), (1, "a")]


def test_blocks_stay_where_they_are_and_any_list_gives_the_same(spark, monkeypatch):
    rows = [_page(k) for k in range(5)] + [_page(10 + k, "other") for k in range(4)] + [_page(20, "single"), (30, None, None)]
    rows += [(40 + k, "http://few.example.org/", f"<body><div>One</div><div>Two</div><div>Three</div><article><p>Own {k}</p></article></body>") for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = te.extract_main_text(df)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan and "SortMergeJoin" not in plan
    want = sorted(map(tuple, out.collect()), key=str)
    assert len(want) == len(rows) and (0, "http://h.example.org/0", "Short 0", 7) in want
    for host_wording, listed in ((10, te.LISTED), (0, te.LISTED), (te.HOST_WORDING, 0)):
        monkeypatch.setattr(te, "HOST_WORDING", host_wording)
        monkeypatch.setattr(te, "LISTED", listed)
        assert sorted(map(tuple, te.extract_main_text(df).collect()), key=str) == want
