"""Main text of HTML pages by template deduction.

Tokens of a page are its start tags (by their path of open elements with their classes, digits left out) and its text
blocks (by path and text). Over the distinct pages of a host, copies counting once, tokens with the same occurrence
vector (the same number of times on the same pages) form an equivalence class. A class is valid if it is on at least
``MIN_PAGES`` distinct pages, has ``MIN_TOKENS`` tokens and these come in one order on every page. Valid classes nest: a
token hangs from the start tag of the element it stands in. Tag tokens of valid classes are the template's skeleton;
a text token is its fixed wording if it is on at least ``MIN_SHARE`` of the pages that have its element, so that several
layouts on one host each have their own wording; inside an article wording needs more support (``MAIN_PAGES``, ``MAIN_SHARE``),
for the copies of a passage are not a template. What is left of a page, wording taken out, are the slots, each under the
innermost skeleton element around it.

Which slots are the main text is checked by what elements mean (names, classes, roles): never those of menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments; of the others, those in article or main
elements. If these hold no first-level heading and under ``MIN_MARKED`` of the running text (blocks of ``RUNNING_WORDS`` words) they
are teasers or the like, and all slots are the main text.

Scale. Every page is parsed once. An occurrence vector is never gathered: its fingerprint is the sum of hash(page, count)
over pages, so classes come from one aggregation per (host, token) with partial sums, and a host with a third of all pages
is no special case. Copies are found by a hash of a page's tokens. Order is checked the same way, from one hash of a class's
token order for each page. Only token hashes move; a page's blocks wait for the list of those that are wording. The lists of
all hosts are sent to the stored blocks, up to ``LISTED`` entries and ``HOST_WORDING`` tokens a host. Beyond these bounds lists
and blocks meet by page in a join, with the same result: there the text outside furniture moves once, of the hosts with longer
lists only or, with more entries, of all.

Defined results. Null or empty html: empty text. Null urls share one host. Repeated page ids are judged one by one, by
row. White space inside a block becomes one space; blocks are joined in page order by a line feed. Hosts with under
``MIN_PAGES`` distinct pages have no template: their pages are one slot. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsift.llm.common import narrow_batches, stored

MIN_PAGES = 3  # distinct pages of a host a class must cover
MIN_TOKENS = 3
MIN_SHARE = 0.5  # of the pages that have its element, the share with a text that is wording
MAIN_PAGES, MAIN_SHARE = 20, 0.9  # the same two bounds for wording inside an article
MIN_MARKED = 0.25  # share of the running text that marked text without a first-level heading must have
RUNNING_WORDS = 8
HOST_WORDING = 1000  # wording tokens of a host that are looked through for each block
LISTED = 2_000_000  # hosts and wording tokens that are sent to all tasks

# elements without an end tag, elements that end a block, elements whose content is not text, and furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
                   "table tbody td tfoot th thead title tr ul").split())
SILENT = frozenset("script style noscript template iframe object svg math head title textarea select datalist canvas audio video".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
FURNITURE_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?|disqus|footer|header|menu|modal|"
    r"nav\w*|newsletter|notice|notices|alert|popup|promo\w*|related|share|sharing|sidebar|side-?bar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
MAIN_MARKS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[_-]?(?:body|content|text)(?:$|[\s_-])", re.I)

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"
                     r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<!\S)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/>]|\Z)", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
# an open paragraph or list item is closed by the start of these
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol menu dl table tbody thead tfoot select".split())


class Block:
    __slots__ = ("text", "path", "furniture", "main", "heading", "at")

    def __init__(self, text, path, furniture, main, heading, at):
        self.text, self.path, self.furniture, self.main, self.heading, self.at = text, path, furniture, main, heading, at


def _traits(name: str, attributes: str) -> tuple[bool, bool, str]:
    """(furniture, main, label) of an element by its name, class, id and role."""
    furniture, main, label = name in FURNITURE, name in ("article", "main"), name
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                furniture |= FURNITURE_MARKS.search(value) is not None and name not in ("body", "html", "article", "main")
                main |= MAIN_MARKS.search(value) is not None
                if key == "class" and name not in ("body", "html"):
                    label = f"{name}.{_DIGITS.sub('', value)}"
            elif key == "role":
                furniture |= value.lower() in FURNITURE_ROLES
                main |= value.lower() in ("main", "article")
            elif key == "itemprop":
                main |= value.lower() == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                furniture = True
    return furniture, main, label


def parse(html: str) -> tuple[list[Block], list[tuple[str, int]]]:
    """Text blocks in page order and the start tags (path, place) of a page; places count both. Unclosed, crossing and cut-off
    markup is read leniently: an end tag without a start is ignored."""
    blocks, tags = [], []
    stack = [("", False, False, False, False, "")]  # name, silent, furniture, main, heading, path
    run: list[str] = []

    def close_block():
        if run:
            text = _SPACE.sub(" ", htmllib.unescape("".join(run)).replace("\x00", "")).strip()
            run.clear()
            _, silent, furniture, main, heading, path = stack[-1]
            if text and not silent:
                blocks.append(Block(text, path, furniture, main, heading, len(blocks) + len(tags)))

    def pop_to(k: int):
        del stack[k:]

    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            run.append(html[at:])
            break
        if m.start() > at:
            run.append(html[at:m.start()])
        at = m.end()
        cdata, closing, opening = m[1], m[2], m[3]
        if cdata is not None:
            run.append(htmllib.escape(cdata))
        elif closing:
            name = closing.lower()
            if name in BLOCK:
                close_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if any(s[0] in BLOCK for s in stack[k:]):
                        close_block()
                    pop_to(k)
                    break
        elif opening:
            name = opening.lower()
            if name == "br":
                run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    close_block()
                continue
            if name in BLOCK or name in SILENT:
                close_block()
                if name in BLOCK and name not in ("body", "html"):
                    for k in range(len(stack) - 1, 0, -1):  # a block start ends an open paragraph with what it holds
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] in BLOCK:
                            break
                for k in range(len(stack) - 1, 0, -1) if name in _CLOSES else ():
                    if stack[k][0] in _SCOPE and stack[k][0] != name:
                        break
                    if stack[k][0] in _CLOSES[name]:
                        pop_to(k)
                        break
            attributes = m[4] or ""
            if attributes.rstrip().endswith("/") and name in ("svg", "math", "path", "iframe", "script"):
                continue
            if name in _RAW_END:
                stop = _RAW_END[name].search(html, at)
                at = stop.end() if stop else end
                tags.append((f"{stack[-1][5]}/{name}", len(blocks) + len(tags)))
                continue
            furniture, main, label = _traits(name, attributes)
            _, silent, in_furniture, in_main, in_heading, path = stack[-1]
            path = f"{path}/{label}"
            stack.append((name, silent or name in SILENT, furniture or in_furniture, main or in_main, in_heading or name == "h1", path))
            tags.append((path, len(blocks) + len(tags)))
    close_block()
    return blocks, tags


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_tokens(blocks: list[Block], tags: list[tuple[str, int]]) -> tuple[int, list[tuple[int, int, bool, bool, int, int]]]:
    """(hash of the whole token list, its distinct tokens as (token, token of the element around it, is text, in main
    content, times on the page, first place))"""
    every = sorted([(at, _hash("tag", path), _hash("tag", path.rpartition("/")[0]), False, False) for path, at in tags]
                   + [(b.at, _hash("text", b.path, b.text), _hash("tag", b.path), True, b.main) for b in blocks])
    seen: dict[int, list] = {}
    for at, token, parent, is_text, main in every:
        seen.setdefault(token, [parent, is_text, main, 0, at])[3] += 1
    return _hash(*(str(t[1]) for t in every)), [(token, *own) for token, own in seen.items()]


TOKEN = "struct<token: bigint, parent: bigint, is_text: boolean, main: boolean, times: int, at: int>"
BLOCK_ROW = "struct<token: bigint, text: string, furniture: boolean, main: boolean, heading: boolean, running: boolean>"


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``row, id, url, host, copy, tokens, blocks``, stored: each page's tokens and text blocks; ``copy`` is the hash of its tokens."""
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), _host(url_col).alias("host"),
                          F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    own_types = [pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("is_text", pa.bool_()), ("main", pa.bool_()), ("times", pa.int32()), ("at", pa.int32())]),
                 pa.struct([("token", pa.int64()), ("text", pa.string()), ("furniture", pa.bool_()), ("main", pa.bool_()), ("heading", pa.bool_()), ("running", pa.bool_())])]

    def read(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            copies, tokens, texts = [], [], []
            for html in batch.column(3):
                blocks, tags = parse(html.as_py())
                copy, own = page_tokens(blocks, tags)
                copies.append(copy)
                tokens.append([dict(zip(("token", "parent", "is_text", "main", "times", "at"), t, strict=True)) for t in own])
                texts.append([{"token": _hash("text", b.path, b.text), "text": b.text, "furniture": b.furniture, "main": b.main, "heading": b.heading,
                               "running": len(b.text.split(None, RUNNING_WORDS)) >= RUNNING_WORDS} for b in blocks])
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *(batch.column(k) for k in range(3)), pa.array(copies, pa.int64()), pa.array(tokens, pa.list_(own_types[0])),
                                              pa.array(texts, pa.list_(own_types[1]))], names=["row", "id", "url", "host", "copy", "tokens", "blocks"])

    return stored(source.mapInArrow(read, f"row long, id {kinds['id']}, url {kinds['url']}, host string, copy long, tokens array<{TOKEN}>, blocks array<{BLOCK_ROW}>"),
                  "page-blocks")


def templates(parsed: DataFrame) -> DataFrame:
    """``host, token, parent, is_text, class``: the template of each host, from the pages of ``parsed_pages``. ``parent`` is
    the start tag a token hangs from; of the text tokens only wording is listed."""
    first = parsed.groupBy("host", "copy").agg(F.min("row").alias("row"))
    seen = parsed.select("row", "tokens").join(first.select("row", "host"), "row").select("host", F.col("row").alias("page"), F.inline("tokens"))
    # the fingerprint of the occurrence vector: two sums of 31-bit hashes that cannot overflow
    vector = stored(seen.groupBy("host", "token").agg(
        F.first("parent").alias("parent"), F.first("is_text").alias("is_text"), F.max("main").alias("main"), F.count(F.lit(1)).alias("support"),
        F.sum(F.shiftrightunsigned(F.xxhash64("page", "times"), 33)).alias("f1"),
        F.sum(F.shiftrightunsigned(F.xxhash64("times", "page", F.lit(7)), 33)).alias("f2")).where(F.col("support") >= MIN_PAGES), "vectors")
    member = vector.withColumn("class", F.xxhash64("support", "f1", "f2"))
    sizes = member.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_TOKENS)
    member = stored(member.join(sizes.select("host", "class"), ["host", "class"], "left_semi"), "classes")
    # one order on every page: a class's tokens by first place on a page, hashed; one hash per class if valid
    per_page = seen.select("host", "page", "token", "at").join(member.select("host", "class", "token"), ["host", "token"]).groupBy("host", "class", "page").agg(
        F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    valid = per_page.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b")
    member = member.join(valid.select("host", "class"), ["host", "class"], "left_semi")
    around = vector.where("not is_text").select("host", F.col("token").alias("parent"), F.col("support").alias("pages"))
    share = F.col("support") / F.col("pages")
    wording = F.when(F.col("main"), (F.col("support") >= MAIN_PAGES) & (share >= MAIN_SHARE)).otherwise(share >= MIN_SHARE)
    # text outside any element hangs from nothing and is held against its own pages
    return member.join(around, ["host", "parent"], "left").withColumn("pages", F.coalesce("pages", "support")).where(~F.col("is_text") | wording).select(
        "host", "token", "parent", "is_text", "class")


def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wording_lists(wording: DataFrame) -> DataFrame:
    """``host, fixed``, stored: the wording of each host that has any, null if it is more than ``HOST_WORDING`` tokens."""
    counts = wording.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    short = wording.join(counts.where(F.col("n") <= HOST_WORDING).select("host"), "host", "left_semi").groupBy("host").agg(F.collect_list("token").alias("fixed"))
    return stored(short.unionByName(counts.where(F.col("n") > HOST_WORDING).select("host", F.lit(None).cast("array<bigint>").alias("fixed"))), "host-wording")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` for every row of ``pages``."""
    narrow_batches(pages.sparkSession)
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    wording = stored(templates(parsed).where("is_text").select("host", "token"), "wording")
    lists = wording_lists(wording)
    hosts, tokens, long = lists.agg(F.count("host"), F.coalesce(F.sum(F.size("fixed")), F.lit(0)), F.count(F.when(F.col("fixed").isNull(), 1))).first()

    def joined(blocks):
        return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")

    def slots_of(df):
        return df.select("id", "url", F.filter("blocks", lambda b: ~b["furniture"] & ~F.coalesce(F.array_contains("fixed", b["token"]), F.lit(False))).alias("slots"))

    def moved(df):
        """Pages to which their own wording, at most their tokens, comes by a join."""
        fixed = df.select("row", "host", F.inline("tokens")).where("is_text").join(wording, ["host", "token"]).groupBy("row").agg(F.collect_set("token").alias("fixed"))
        return df.select("row", "id", "url", F.filter("blocks", lambda b: ~b["furniture"]).alias("blocks")).join(fixed, "row", "left")

    if hosts + tokens > LISTED:
        slots = slots_of(moved(parsed))
    else:
        known = F.broadcast(lists.withColumn("long", F.col("fixed").isNull()))
        slots = slots_of(parsed.select("host", "id", "url", "blocks").join(known, "host", "left").where("long is not true"))
        if long:
            slots = slots.unionByName(slots_of(moved(parsed.join(F.broadcast(lists.where("fixed is null").select("host")), "host", "left_semi"))))
    marked = slots.select("id", "url", "slots", F.filter("slots", lambda b: b["main"]).alias("marked"))
    main, every = joined(F.col("marked")), joined(F.col("slots"))
    running = F.char_length(joined(F.filter("slots", lambda b: b["running"] & ~b["main"])))
    enough = F.exists("marked", lambda b: b["heading"]) | (F.size("marked") > 0) & (F.char_length(main) >= MIN_MARKED * (F.char_length(main) + running))
    return marked.select("id", "url", F.when(enough, main).otherwise(every).alias("text")).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
