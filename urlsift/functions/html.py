"""HTML feature extraction (inventory I1-I8).

The per-page parse (I1-I4) is the one place where Python runs per row: markup in the wild is not well-formed XML,
so Spark's ``xpath`` functions cannot read it. It is an Arrow-batched ``pandas_udf`` over the stdlib
``html.parser`` (one pass, no tree; the word budget of I3 is applied outside, in Spark); everything around it — URL path, unpivot to content rows (I5),
pivot back (I6), content maps (I7), the root-title cache (I8) — is built-in DataFrame work.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsift.functions.scalars import HTML_CONTENT_TYPES, add_https, root_url, squeeze_ws, url_path

# Header levels, and the default budget of div words (characters: ten times as many).
HEADER_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
DIV_WORDS = 500
DIV_CHARS_PER_WORD = 10

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr", "keygen", "command"}
# strings inside these elements are not document text
RAW_TEXT = {"script", "style", "template"}
_SPANNED = {*HEADER_TAGS, "div"}

PARSED = T.StructType([*[T.StructField(n, T.StringType()) for n in ["title", "description", *HEADER_TAGS]],
                       T.StructField("divs", T.ArrayType(T.StringType()))])


class _PageScan(HTMLParser):
    """One pass without a tree. All document strings go into one list; a header or div is the span of that list between
    its start and end tag, so nested elements share their strings. An end tag closes up to its nearest open match and
    is ignored when nothing matches; what is open at the end of the page ends there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.spans: list[list] = []  # [tag, first string, end, holds a link], in order of the start tags
        self.description: str | None = None
        self.title: str | None = None
        self._open: list[tuple[str, list | None]] = []
        self._count: dict[str, int] = {}
        self._data: list[str] = []
        self._title_state = 0  # 0: not seen, 1: open, 2: done
        self._leaves = 0  # strings and childless elements of the title
        self._childless: list[bool] = []

    def _title_child(self, opens: bool) -> None:
        if self._title_state != 1:
            return
        self._leaves += 1
        if self._childless and self._childless[-1]:
            self._childless[-1] = False
            self._leaves -= 1
        if opens:
            self._childless.append(True)

    def _flush(self) -> None:
        if not self._data:
            return
        text = "".join(self._data)
        self._data.clear()
        self._title_child(False)
        raw = any([self._count.get(t) for t in RAW_TEXT])
        if self._title_state == 1:
            self.title = None if raw else text
        if not raw and (text := text.strip()):
            self.strings.append(text)

    def handle_data(self, data):
        self._data.append(data)

    def _element(self, tag, attrs, opens: bool) -> list | None:
        self._flush()
        self._title_child(opens)
        if tag == "title" and self._title_state == 0:
            self._title_state = 1 if opens else 2
        if tag == "meta" and self.description is None:
            named = dict(attrs)
            if named.get("name") == "description":
                self.description = named.get("content") or ""
        if tag == "a":
            for _, span in self._open:
                if span is not None:
                    span[3] = True
        if tag not in _SPANNED:
            return None
        self.spans.append([tag, len(self.strings), None if opens else len(self.strings), False])
        return self.spans[-1]

    def handle_starttag(self, tag, attrs):
        opens = tag not in VOID
        span = self._element(tag, attrs, opens)
        if opens:
            self._open.append((tag, span))
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._element(tag, attrs, False)

    def handle_endtag(self, tag):
        if self._count.get(tag):
            self._flush()
            while self._close_last() != tag:
                pass

    def _close_last(self) -> str:
        tag, span = self._open.pop()
        self._count[tag] -= 1
        if span is not None:
            span[2] = len(self.strings)
        if self._title_state == 1:
            if self._childless:
                self._childless.pop()
            elif tag == "title":
                self._title_state = 2
        return tag

    def finish(self) -> None:
        self.close()
        self._flush()
        while self._open:
            self._close_last()

    def text(self, span: list) -> str:
        return " ".join(self.strings[span[1]:span[2]])


def scan_page(html: str | None) -> dict:
    """Title (its only string), meta description, h1-h6 (JSON lists of the headers without links) and the text of every
    div, of one page. Nothing is cut; a null page is an empty one."""
    page = _PageScan()
    page.feed(html or "")
    page.finish()
    row = {"title": page.title if page._leaves == 1 else None, "description": page.description or "",
           "divs": [page.text(s) for s in page.spans if s[0] == "div"]}
    for tag in HEADER_TAGS:
        texts = [page.text(s) for s in page.spans if s[0] == tag and not s[3]]
        row[tag] = json.dumps(texts, ensure_ascii=False) if texts else None
    return row


def div_text(divs: Column, words: int | None = DIV_WORDS) -> Column:
    """The leading divs that together hold at most ``words`` words, each followed by a space, cut at ten characters
    a word; ``None`` takes every div whole."""
    if words is None:
        return F.when(F.size(divs) > 0, F.concat(F.array_join(divs, " "), F.lit(" "))).otherwise(F.when(divs.isNotNull(), ""))
    counts = F.transform(divs, lambda d: F.size(F.filter(F.split(d, r"\s+"), lambda w: w != "")).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("kept"))
    kept = F.aggregate(counts, start, lambda acc, n: F.struct(  # totals only grow, so what fits is a leading part
        (acc["total"] + n).alias("total"), (acc["kept"] + F.when(acc["total"] + n <= words, 1).otherwise(0)).alias("kept")))["kept"]
    text = F.concat(F.array_join(F.slice(divs, F.lit(1), kept), " "), F.lit(" "))
    return F.when(kept > 0, F.substring(text, 1, words * DIV_CHARS_PER_WORD)).otherwise(F.when(divs.isNotNull(), ""))


@F.pandas_udf(PARSED)
def _parse_batch(html: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    rows = []
    for doc, ct in zip(html, content_type):
        ct = ct or ""
        if "html" in ct or "xml" in ct:
            rows.append(scan_page(doc))
        else:
            rows.append({})
    return pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])


def parse_html(pages: DataFrame, html: str = "html", content_type: str = "content_type", div_words: int | None = DIV_WORDS,
               spread: int | None = None) -> DataFrame:
    """Pages (url_id, url, html, content_type) -> url_id, url, url_path + parsed fields. Pages whose content
    type mentions neither html nor xml get null fields. ``div_words``: see ``div_text``. ``spread`` repartitions the
    pages first, for tables whose few large row groups would leave cores idle."""
    ct = F.col(content_type) if content_type in pages.columns else F.lit("text/html")
    full = add_https(F.col("url"))
    if spread:
        pages = pages.repartition(spread)
    parsed = pages.select("url_id", full.alias("url"), url_path(full).alias("url_path"), _parse_batch(F.col(html), ct).alias("_p"))
    return parsed.select("url_id", "url", "url_path", squeeze_ws(F.col("_p.title")).alias("title"),
                         squeeze_ws(F.col("_p.description")).alias("description"), *[F.col(f"_p.{h}") for h in HEADER_TAGS],
                         div_text(F.col("_p.divs"), div_words).alias("div"))


def html_content_rows(parsed: DataFrame) -> DataFrame:
    """Unpivot to (url_id, content_type, content); null and blank values dropped."""
    cols = ["title", "description", *HEADER_TAGS, "div"]
    stacked = parsed.select("url_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("content_type"), F.col(c).alias("content"))
        for name, c in zip(HTML_CONTENT_TYPES, cols)])).alias("_r")).select("url_id", "_r.*")
    return stacked.where(F.col("content").isNotNull() & (F.trim(F.col("content")) != ""))


def html_content_wide(rows: DataFrame) -> DataFrame:
    """Rows back to one record per URL (pivot over the nine fixed content types, no distinct-values scan)."""
    wide = rows.groupBy("url_id").pivot("content_type", HTML_CONTENT_TYPES).agg(F.first("content"))
    return wide.select("url_id", *[F.col(n).alias(n.lower()) for n in HTML_CONTENT_TYPES])


def root_titles(df: DataFrame, cache: DataFrame, parsed_roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """I8: attach the cached title of each URL's root page (``""`` when unknown) and return the cache rows to add
    for roots not cached yet (first title per root wins). ``cache``: (url, page_title)."""
    r = df.withColumn("_root", root_url(add_https(F.col("url"))))
    c = cache.select(F.col("url").alias("_root"), "page_title")
    out = r.join(c, "_root", "left").withColumn("root_page_title", squeeze_ws(F.coalesce("page_title", F.lit(""))))
    new_rows = None
    if parsed_roots is not None:
        fresh = parsed_roots.select(root_url(add_https(F.col("url"))).alias("url"),
                                    F.coalesce("title", F.lit("")).alias("page_title"), "url_id")
        fresh = fresh.join(cache.select("url"), "url", "left_anti")
        new_rows = fresh.groupBy("url").agg(F.min_by("page_title", "url_id").alias("page_title"))
    return out.drop("page_title", "_root"), new_rows
