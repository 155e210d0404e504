"""Page extraction (B1-B11, A2, A3): one parser pass per page, then Catalyst columns.

``parsed`` turns a page into a struct (title, description, robots, canonical
and link attributes, visible text, its blocks) in one event-driven pass over the
markup, in Arrow batches; URLs are resolved, statuses decided and the main content
picked by Column expressions over that struct.

Main content (B8) is the first article, else the first main element, that holds
text. On other pages blocks of text are scored by length, links, sentence marks and
what their elements are called; scores are smoothed over neighbouring blocks, and
the run of blocks of the largest sum is the content. Where no run is worth it, the
whole page is.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import urls as U

# Elements whose text is never collected, and block-level
# elements (plus li) that put a line break before and after their text.
NON_TEXT = {"head", "meta", "script", "style", "noscript", "object", "svg"}
BLOCK = {"html", "body", "p", "address", "article", "aside", "div", "footer", "header", "hgroup",
         "main", "nav", "section", "blockquote", "figcaption", "figure", "center", "hr", "h1",
         "h2", "h3", "h4", "h5", "h6", "tr", "ul", "ol", "dd", "dl", "dt", "menu", "dir", "form",
         "legend", "fieldset", "optgroup", "option", "pre", "xmp", "plaintext", "listing",
         "dialog", "li"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr", "param"}

# Elements that may stand in a page's head.
HEAD_CONTENT = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}

ROBOTS_MESSAGE = 'Disallowed by <meta name="robots">'
FEED_ERROR = "Invalid feed content"

# Content types of link alternates.
ALTERNATE_TYPES = {"application/atom+xml", "application/rss+xml", "text/html"}


# Names of elements, classes and ids that hold page parts around the content, or the content.
AROUND = re.compile(r"nav|menu|foot|header|aside|side-?bar|breadcrumb|comment|share|social|promo|banner|advert|cookie|related|pager|login", re.I)
INSIDE = re.compile(r"article|content|story|post|entry|body-?text|main", re.I)
AROUND_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}

BLOCKS = "array<struct<at:int,chars:int,links:int,marks:int,around:boolean,inside:boolean>>"
DOC = ("struct<title:string,heading:string,description:string,robots:string,canonical:string,"
       f"anchors:array<string>,alternates:array<string>,text:string,main:boolean,pieces:array<string>,blocks:{BLOCKS}>")


class PageParser(HTMLParser):
    """Collects the fields and the visible text of one page while its markup streams by.

    Visible text is a list of pieces. Blanks that follow a piece wait in ``gap``
    and are written only when another piece follows inside the same element;
    closing an element that held text replaces them by its own gap. So no
    piece is copied twice, and depth is bounded by an explicit stack only.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title = self.description = self.robots = self.canonical = None
        self.anchors, self.alternates = [], []
        self.pieces, self.gap, self.hidden = [], "", 0
        self.stack = []  # (tag, pieces and gap at the start, title attributes)
        self.depth_of = {}  # tag -> open elements of that tag
        self.regions = {}  # article / main -> first (start, end) in pieces
        self.heading = self.named = None  # text of the first h1, og:title
        self.blocks, self.new_block = [], True  # [first piece, characters, of links, sentence marks, around, inside]
        self.around = self.inside = 0

    # -- text

    def _write(self, text, after):
        core = text.lstrip()
        if core:
            body = core.rstrip()
            self._count(body)
            self.pieces.append(self.gap + body)
            self.gap = core[len(body):] + after

    def _count(self, body):
        """Text for the block that is open, or a new one."""
        if self.new_block:
            self.blocks.append([len(self.pieces), 0, 0, 0, self.around > 0, self.inside > 0])
            self.new_block = False
        block = self.blocks[-1]
        block[1] += len(body)
        block[2] += len(body) if self.depth_of.get("a") else 0
        block[3] += sum(map(body.count, ".!?,;"))

    def _close(self):
        tag, start, gap, labels, part = self.stack.pop()
        self.depth_of[tag] -= 1
        self.around -= part < 0
        self.inside -= part > 0
        self.new_block |= tag in BLOCK
        if tag in NON_TEXT:
            self.hidden -= 1
        if len(self.pieces) > start:
            self.gap = " \n" if tag in BLOCK else " "
            for v in labels:  # a label keeps its own leading blanks after text
                self._count(v)
                self.pieces.append(self.gap + v.rstrip())
                self.gap = v[len(v.rstrip()):] + " "
        else:
            self.gap = gap
            for v in labels:
                self._write(v, " ")
        if tag in self.regions and self.regions[tag][1] is None:
            if self.regions[tag][2] == len(self.stack):
                self.regions[tag][1] = len(self.pieces)

    # -- events

    def handle_starttag(self, tag, attrs, closed=False):
        values = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        self._field(tag, values)
        if self.depth_of.get("head") and tag not in HEAD_CONTENT:
            self.handle_endtag("head")  # an unclosed head ends where page content begins
        if tag in ("p", "li", "option") and self.depth_of.get(tag):
            for i in range(len(self.stack) - 1, -1, -1):
                t = self.stack[i][0]
                if t == tag:
                    while len(self.stack) > i:
                        self._close()
                    break
                if t in BLOCK and t not in ("p", "li"):
                    break
        labels = [v for k, v in attrs if k == "title" and v and v.strip()] if not self.hidden else []
        if closed or tag in VOID:
            if not self.hidden:
                own = "".join(f"{v} " for v in labels)
                if tag == "img" and values.get("alt", "").strip():
                    own += values["alt"] + "\n"
                self._write(own, "")
            return
        if tag in ("article", "main") and tag not in self.regions:
            self.regions[tag] = [len(self.pieces), None, len(self.stack)]
        name = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}"
        part = -1 if tag in AROUND_TAGS or AROUND.search(name) else 1 if INSIDE.search(name) else 0
        self.around += part < 0
        self.inside += part > 0
        self.new_block |= tag in BLOCK
        self.stack.append((tag, len(self.pieces), self.gap, labels, part))
        self.depth_of[tag] = self.depth_of.get(tag, 0) + 1
        if tag in NON_TEXT:
            self.hidden += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        if self.depth_of.get(tag):
            while self.stack[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.title is not None and self.stack and self.stack[-1][0] == "title" and self.depth_of["title"] == 1 and not self.titled:
            self.title += data
        if not self.hidden:
            if self.depth_of.get("h1") and not self.headed:
                self.heading = (self.heading or "") + data
            elif self.heading is not None:
                self.headed = True
            self._write(data, " ")

    headed = False
    titled = False

    def _field(self, tag, values):
        if tag == "title":
            self.titled = self.title is not None
            self.title = self.title or ""
        elif tag == "meta" and "content" in values:
            name = values.get("name", "").lower()
            if values.get("property", "").lower() == "og:title" and self.named is None:
                self.named = values["content"]
            if name == "description" and self.description is None:
                self.description = values["content"]
            elif name == "robots" and self.robots is None:
                self.robots = values["content"]
        elif tag == "link" and "href" in values:
            rel = values.get("rel", "").lower()
            if rel == "canonical" and self.canonical is None:
                self.canonical = values["href"]
            elif rel == "alternate" and values.get("type") in ALTERNATE_TYPES:
                self.alternates.append(values["href"])
        elif tag == "a" and "href" in values and "nofollow" not in values.get("rel", ""):
            self.anchors.append(values["href"])

    def finish(self) -> tuple[str, bool]:
        """(text, whether it is that of an article or main element)."""
        self.close()
        while self.stack:
            self._close()
        for tag in ("article", "main"):
            if tag in self.regions:
                start, end, _ = self.regions[tag]
                main = "".join(self.pieces[start:end]).strip()
                if main:
                    return main, True
        return "".join(self.pieces).strip(), False


def parse_page(html: str | None) -> dict:
    p = PageParser()
    p.feed(html or "")
    text, main = p.finish()
    blocks = [] if main else [dict(zip(("at", "chars", "links", "marks", "around", "inside"), b)) for b in p.blocks]
    return {"title": (p.title or "").strip(), "heading": " ".join((p.named or p.heading or "").split()), "description": p.description or "",
            "robots": p.robots or "", "canonical": p.canonical, "anchors": p.anchors, "alternates": p.alternates, "text": text,
            "main": main, "pieces": [] if main else p.pieces, "blocks": blocks}


def visible_text(html: str | None) -> str:
    """Visible text of the first article, else main element, else of the whole page."""
    return parse_page(html)["text"]


_BLOCK = pa.struct([("at", pa.int32()), ("chars", pa.int32()), ("links", pa.int32()), ("marks", pa.int32()),
                    ("around", pa.bool_()), ("inside", pa.bool_())])
_DOC = pa.struct([(c, pa.string()) for c in ("title", "heading", "description", "robots", "canonical")]
                 + [("anchors", pa.list_(pa.string())), ("alternates", pa.list_(pa.string())), ("text", pa.string()),
                    ("main", pa.bool_()), ("pieces", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK))])


PARSE_PAGES = 32  # pages whose fields are Python objects at once


def _parse(html: pa.Array) -> pa.Array:
    parts = [pa.array([parse_page(h.as_py()) for h in html[lo:lo + PARSE_PAGES]], _DOC) for lo in range(0, len(html), PARSE_PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], _DOC)


_parse.__annotations__ = {"html": pa.Array, "return": pa.Array}


def parsed(html: Column) -> Column:
    """All fields of a page, from one pass over its markup."""
    return F.arrow_udf(_parse, returnType=DOC)(html)


def robots_blocked(doc: Column) -> Column:
    """meta[name=robots] content contains 'noindex' or 'none' (substring)."""
    return doc["robots"].contains("noindex") | doc["robots"].contains("none")


def canonical_link(doc: Column, base: Column) -> Column:
    """link[rel=canonical]@href made absolute; NULL when absent."""
    return F.when(doc["canonical"].isNotNull(), U.resolve(base, doc["canonical"]))


def anchor_hrefs(doc: Column, base: Column) -> Column:
    """Absolute, canonical-guessed hrefs of a[href] without rel~nofollow, as a set."""
    urls = F.transform(doc["anchors"], lambda h: U.canonical_guess(U.resolve(base, h)))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def alternate_hrefs(doc: Column, base: Column) -> Column:
    """link[rel=alternate] of feed or HTML type."""
    urls = F.transform(doc["alternates"], lambda h: U.canonical_guess(U.resolve(base, h)))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def truncate_bytes(items: list[Column], budget: Column) -> list[Column]:
    """One byte budget spent over the items in order; a cut drops a split character."""
    out, remaining = [], budget
    for it in items:
        it = F.coalesce(it, F.lit(""))
        n = F.octet_length(it)
        raw = it.cast("binary")

        def prefix(k: Column) -> Column:
            s = F.substring(raw, F.lit(1), k).cast("string")
            return F.when((k >= 0) & F.is_valid_utf8(s), s)

        cut = F.coalesce(prefix(remaining), prefix(remaining - 1), prefix(remaining - 2),
                         prefix(remaining - 3), F.lit(""))
        out.append(F.when(n <= remaining, it).when(remaining > 0, cut).otherwise(F.lit("")))
        remaining = F.when(n <= remaining, remaining - n).otherwise(F.lit(0))
    return out


LEAST_RUN = 150.0  # what a run of blocks must score to be the content


def block_scores(blocks: Column) -> Column:
    """array<double>: long blocks with sentences score high, links, short blocks and parts around the content low."""
    def one(b: Column) -> Column:
        own = b["chars"] - 2.5 * b["links"] + 10.0 * b["marks"] - 40.0
        return F.when(b["around"], -b["chars"] - 40.0).when(b["inside"] & (own > 0), 1.25 * own).otherwise(own).cast("double")

    return F.transform(blocks, one)


def best_run(scores: Column) -> Column:
    """struct(first, last, sum) of the run of smoothed scores with the largest sum, counted from 0; sum 0 where there is none."""
    n, edge = F.size(scores), F.array(F.lit(0.0))
    before = F.concat(edge, F.slice(scores, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(scores, F.lit(2), F.greatest(n - 1, F.lit(0))), edge)
    sides = F.zip_with(before, after, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    smooth = F.zip_with(scores, sides, lambda s, t: (2 * s + t) / 4)
    none = F.lit(-1).cast("int")
    start = F.struct(none.alias("first"), none.alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("run"),
                     F.lit(0).alias("since"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        fresh = a["run"] <= 0
        run, since = F.when(fresh, s).otherwise(a["run"] + s), F.when(fresh, a["i"]).otherwise(a["since"])
        better = run > a["sum"]
        pick = lambda x, y: F.when(better, x).otherwise(y)
        return F.struct(pick(since, a["first"]).alias("first"), pick(a["i"], a["last"]).alias("last"), pick(run, a["sum"]).alias("sum"),
                        run.alias("run"), since.alias("since"), (a["i"] + 1).alias("i"))

    return F.aggregate(smooth, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"), a["sum"].alias("sum")))


def main_content(doc: Column) -> Column:
    """struct(text, found): text of an article or main element, else of the best run of blocks, else of the page."""
    blocks, pieces = doc["blocks"], doc["pieces"]
    run = best_run(block_scores(blocks))

    def text_of(r: Column) -> Column:
        first = blocks[r["first"]]["at"]
        end = F.when(r["last"] + 1 < F.size(blocks), F.get(blocks, r["last"] + 1)["at"]).otherwise(F.size(pieces))
        cut = F.btrim(F.array_join(F.slice(pieces, first + 1, end - first), ""), F.lit(" \n\t\r"))
        return F.when(r["sum"] >= LEAST_RUN, F.struct(cut.alias("text"), F.lit(True).alias("found"))).otherwise(
            F.struct(doc["text"].alias("text"), F.lit(False).alias("found")))

    whole = F.struct(doc["text"].alias("text"), doc["main"].alias("found"))
    return F.when(doc["main"] | (F.size(blocks) == 0), whole).otherwise(F.transform(F.array(run), text_of)[0])


def page_fields(raw: DataFrame) -> DataFrame:
    """B1-B8, B11 columns of raw pages (page_id, url, html); a blocked page stops at its status."""
    j = raw.withColumn("_doc", parsed(F.col("html"))).withColumn("_main", main_content(F.col("_doc")))
    doc, u = F.col("_doc"), F.col("url")
    title = F.when((doc["title"] == "") & F.col("_main.found"), doc["heading"]).otherwise(doc["title"])
    blocked = robots_blocked(doc)
    none = F.array().cast("array<string>")
    open_ = lambda c, other: F.when(blocked, other).otherwise(c)
    return j.select(
        *raw.columns,
        open_(title, F.lit("")).alias("title"),
        open_(doc["description"], F.lit("")).alias("description"),
        open_(F.coalesce(canonical_link(doc, u), u), u).alias("canonical"),
        open_(F.lit(S.FINISHED), F.lit(S.ERROR)).cast("tinyint").alias("status"),
        open_(F.lit(""), F.lit(ROBOTS_MESSAGE)).alias("error_info"),
        open_(F.array_union(anchor_hrefs(doc, u), alternate_hrefs(doc, u)), none).alias("links"),
        open_(F.col("_main.text"), F.lit("")).alias("content"))


def extract_text(raw: DataFrame) -> DataFrame:
    """(page_id, content) for raw pages (page_id, html)."""
    return raw.select("page_id", parsed(F.col("html"))["text"].alias("content"))


def extract_pages(raw: DataFrame, size_limit: int | None = None) -> DataFrame:
    """Full extraction: fields + visible text, one row per raw page, one scan; cut only to a byte budget that is given."""
    f = page_fields(raw)
    texts = [F.col("title"), F.col("description"), F.col("content")]
    tt, dd, cc = texts if size_limit is None else truncate_bytes(texts, F.lit(size_limit))
    return f.select("page_id", "url", "canonical", "status", "error_info", tt.alias("title"),
                    dd.alias("description"), cc.alias("content"), "links")


# ------------------------------------------------------------- sitemaps and feeds


def _xml_links(body: str | None) -> dict | None:
    """Links by kind, or None when the body is not well-formed XML."""
    import xml.etree.ElementTree as ET
    try:
        root = ET.fromstring(body or "")
    except (ET.ParseError, ValueError):
        return None
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = {"loc": [], "rss": [], "atom": []}
    for e in root.iter():
        if local(e) == "loc" and e.text:
            out["loc"].append(e.text.strip())
        elif local(e) in ("item", "entry"):
            for x in e:
                if local(x) == "link":
                    if local(e) == "item" and x.text:
                        out["rss"].append(x.text.strip())
                    if local(e) == "entry" and x.get("href") is not None:
                        out["atom"].append(x.get("href").strip())
    return out


_XML = pa.struct([("loc", pa.list_(pa.string())), ("rss", pa.list_(pa.string())), ("atom", pa.list_(pa.string()))])


def _xml(body: pa.Array) -> pa.Array:
    return pa.array([_xml_links(b) for b in body.to_pylist()], _XML)


_xml.__annotations__ = {"body": pa.Array, "return": pa.Array}


def xml_links(body: Column) -> Column:
    """struct(loc, rss, atom) of an XML body; NULL when it is not well-formed (one bad body never fails a job)."""
    return F.arrow_udf(_xml, returnType="struct<loc:array<string>,rss:array<string>,atom:array<string>>")(body)


def sitemap_locs(body: Column, base: Column) -> Column:
    """A2: every <loc> of a urlset or sitemapindex, made absolute; NULL for a malformed body."""
    return F.transform(xml_links(body)["loc"], lambda x: U.resolve(base, x))


def feed_links(body: Column, content_type: Column, base: Column) -> Column:
    """A3: links of every item of an RSS, Atom or JSON feed (absolute); NULL for a malformed body."""
    xml = xml_links(body)
    js = F.from_json(body, "items array<struct<url: string, external_url: string>>")
    jlinks = F.filter(F.transform(js["items"], lambda i: F.coalesce(i["url"], i["external_url"])),
                      lambda x: x.isNotNull())
    links = (F.when(content_type.startswith("application/rss+xml"), xml["rss"])
             .when(content_type.startswith("application/atom+xml"), xml["atom"])
             .when(content_type.startswith("application/feed+json"), jlinks))
    return F.transform(links, lambda x: U.resolve(base, F.trim(x)))


def fetched(raw: DataFrame, size_limit: int | None = None) -> DataFrame:
    """Status, fields and links of fetched bodies (page_id, url, content_type, html, fetch_error) by content type.

    B11: a fetch error is Error with its message; HTML is Finished, or Error when
    its robots tag blocks it; a sitemap or feed gives links and stays Unindexable,
    a malformed feed is Error; any other type is Unindexable.
    """
    ct, u = F.lower(F.coalesce("content_type", F.lit(""))), F.col("url")
    is_html = ct.startswith("text/html")
    is_map = ct.startswith("application/xml") | ct.startswith("text/xml")
    is_feed = ct.startswith("application/rss+xml") | ct.startswith("application/atom+xml") | ct.startswith("application/feed+json")
    ok = F.col("fetch_error").isNull()
    page = extract_pages(raw.select("page_id", "url", F.when(ok & is_html, F.col("html")).alias("html")), size_limit)
    other = raw.select("page_id", "content_type", "fetch_error", F.when(ok & is_map, sitemap_locs(F.col("html"), u))
                       .when(ok & is_feed, feed_links(F.col("html"), ct, u)).alias("_more"))
    j = page.join(other, "page_id")
    ct = F.lower(F.coalesce("content_type", F.lit("")))
    is_feed = ct.startswith("application/rss+xml") | ct.startswith("application/atom+xml") | ct.startswith("application/feed+json")
    bad_feed = is_feed & F.col("_more").isNull()
    failed = F.col("fetch_error").isNotNull()
    status = (F.when(failed | bad_feed, F.lit(S.ERROR)).when(ct.startswith("text/html"), F.col("status"))
              .otherwise(F.lit(S.UNINDEXABLE)))
    more = F.transform(F.coalesce("_more", F.array().cast("array<string>")), lambda x: U.canonical_guess(x))
    return j.select(
        "page_id", "url", "canonical", status.cast("tinyint").alias("status"),
        F.when(failed, F.col("fetch_error")).when(bad_feed, F.lit(FEED_ERROR)).otherwise(F.col("error_info")).alias("error_info"),
        "title", "description", "content", F.array_union("links", F.filter(more, lambda x: x.isNotNull())).alias("links"))
