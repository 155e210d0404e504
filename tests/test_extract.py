"""Extraction (B, A2, A3) on literal HTML, XML and JSON rows (the provided pages lack these branches)."""
from pyspark.sql import functions as F

from quarry.operators import extract as ex

HTML = """<html><head><title> T &amp; t </title><meta name="description" content="About &quot;it&quot;">
<meta name="robots" content="{robots}"><link rel="canonical" href="/canon/">
<link rel="alternate" type="application/rss+xml" href="/feed.xml"><style>x{{}}</style></head>
<body><nav><ul><li>One</li><li>Two</li></ul></nav><div title="Tip">Block <b>bold</b></div>
<img alt="A picture"><script>var s;</script><svg><text>no</text></svg>
<a href="/a/">a</a><a href="/b" rel="nofollow">b</a><a href="https://x.org/c#frag">c</a></body></html>"""


def _raw(spark, robots="index"):
    return spark.createDataFrame([(1, "https://site.com/p", HTML.format(robots=robots))],
                                 "page_id long, url string, html string")


def test_fields(spark):
    r = ex.page_fields(_raw(spark)).first()
    assert r.title == "T & t" and r.description == 'About "it"' and r.status == 2
    assert r.canonical == "https://site.com/canon/"
    assert set(r.links) == {"https://site.com/a", "https://x.org/c", "https://site.com/feed.xml"}


def test_robots(spark):
    for content, status in [("noindex, nofollow", 3), ("none", 3), ("index", 2)]:
        r = ex.page_fields(_raw(spark, content)).first()
        assert r.status == status and (r.error_info != "") == (status == 3)


def test_visible_text():
    t = ex.visible_text(HTML.format(robots="index"))
    assert "One" in t and "Two" in t and "Tip" in t and "A picture" in t and "bold" in t
    assert "var s" not in t and "no" not in t.split() and "x{}" not in t


def test_sitemaps_and_feeds(spark):
    rows = [
        ("application/xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a/1</loc></url><url><loc>/2</loc></url></urlset>'),
        ("text/xml", '<sitemapindex><sitemap><loc>https://a/s1.xml</loc></sitemap><sitemap><loc>https://a/s2.xml</loc></sitemap></sitemapindex>'),
    ]
    df = spark.createDataFrame(rows, "ct string, body string")
    got = [r[0] for r in df.select(ex.sitemap_locs(F.col("body"), F.lit("https://a/x"))).collect()]
    assert got == [["https://a/1", "https://a/2"], ["https://a/s1.xml", "https://a/s2.xml"]]
    feeds = [
        ("application/rss+xml", "<rss><channel><item><link>https://a/r1</link></item><item><link>/r2</link></item></channel></rss>"),
        ("application/atom+xml", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://a/t1"/></entry><entry><link href="/t2"/></entry></feed>'),
        ("application/feed+json", '{"items": [{"url": "https://a/j1"}, {"url": "/j2"}]}'),
    ]
    df = spark.createDataFrame(feeds, "ct string, body string")
    got = [r[0] for r in df.select(ex.feed_links(F.col("body"), F.col("ct"), F.lit("https://a/x"))).collect()]
    assert got == [["https://a/r1", "https://a/r2"], ["https://a/t1", "https://a/t2"], ["https://a/j1", "https://a/j2"]]


def test_attribute_forms(spark):
    page = ("<head><META name=description content=\"Don't stop &eacute;\"></head><a title=\"a>b\" href=\"/gt\">1</a><a href=/plain>2</a>"
            "<a href='/dots/./x/../y/'>3</a><a href='../../up'>4</a>")
    r = ex.page_fields(spark.createDataFrame([(1, "https://h/p/q", page)], "page_id long, url string, html string")).first()
    assert r.description == "Don't stop é"
    assert set(r.links) == {"https://h/gt", "https://h/plain", "https://h/dots/y", "https://h/up"}


def test_blocked_page_stops(spark):
    r = ex.page_fields(_raw(spark, "noindex")).first()
    assert (r.canonical, r.links, r.content, r.title) == ("https://site.com/p", [], "", "")


def test_deep_nesting_and_unclosed_head():
    assert ex.visible_text("<div>" * 10_000 + "deep" + "</div>" * 10_000) == "deep"
    assert ex.visible_text("<html><head><title>t</title><body><article>kept</article>") == "kept"


def test_malformed_bodies_do_not_fail_the_job(spark):
    rows = [(1, "https://h/", "application/rss+xml", "<rss><item>", None), (2, "https://h/", "application/xml", "<urlset><loc>", None),
            (3, "https://h/", "application/rss+xml", "<rss><item><link>/ok</link></item></rss>", None), (4, "https://h/", None, "x", None),
            (5, "https://h/", "text/html", "<title>t</title>", None), (6, "https://h/", "text/html", None, "HTTP 500"),
            (7, "https://h/", "application/feed+json", "{", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, content_type string, html string, fetch_error string")
    got = {r.page_id: (r.status, r.error_info, r.links) for r in ex.fetched(df).collect()}
    assert got == {1: (3, ex.FEED_ERROR, []), 2: (4, "", []), 3: (4, "", ["https://h/ok"]), 4: (4, "", []), 5: (2, "", []),
                   6: (3, "HTTP 500", []), 7: (3, ex.FEED_ERROR, [])}


SENTENCES = ["The river rose slowly, and by noon the lower meadows were under water.", "Nobody had seen it so high since the old bridge fell; the miller said so himself.",
             "Three boats were tied to the church door, which had never happened before.", "When the rain stopped, the valley was a lake, quiet and brown.",
             "It took nine days until the road could be used again, and a month until it was dry."]


def _page(kind, i):
    """A page without article or main element, and the sentences that are its content."""
    own = [f"{s} Entry {i}." for s in SENTENCES]
    links = "".join(f"<li><a href='/{k}'>Section {k} of the site</a></li>" for k in range(12))
    ps = "".join(f"<p>{s}</p>" for s in own)
    foot = "<div class=footer><p>Copyright by the publisher, all rights reserved, printed in the valley.</p><p>Terms. Privacy. Contact.</p></div>"
    body = {
        "divs": f"<div id=menu><ul>{links}</ul></div><div class=story>{ps}</div>{foot}",
        "table": f"<table><tr><td><ul>{links}</ul></td><td>{''.join(f'<div>{s}</div>' for s in own)}</td></tr></table>{foot}",
        "heading": f"<nav>{links}</nav><h1>Flood {i}</h1><h2>Day one</h2>{ps[:len(ps) // 2]}</p><h2>After</h2>{ps}{foot}",
        "links inside": f"<div class=sidebar><p>Subscribe to our letter, it is free, weekly and short.</p></div>{ps.replace('river', '<a href=/r>river</a>')}<ul>{links}</ul>",
        "bare": "<br>".join(own) + f"<ul>{links}</ul>",
    }[kind]
    return f"<html><head><title></title></head><body>{body}</body></html>", own


def test_main_content_of_pages_without_article_or_main(spark):
    kinds = ["divs", "table", "heading", "links inside", "bare"]
    rows = [(n, "https://h/", _page(k, n)[0]) for n, k in enumerate(kinds)]
    got = {r.page_id: r for r in ex.page_fields(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, k in enumerate(kinds):
        text = " ".join(got[n].content.split())
        assert all(s in text for s in _page(k, n)[1]), (k, text)
        assert "Section 3" not in text and "Copyright" not in text and "Subscribe" not in text, (k, text)
    assert got[2].title == "Flood 2" and got[0].title == ""


def test_title_and_content_fall_back_as_surveyed(spark):
    rows = [(1, "<title> Own </title><h1>Heading</h1><article>Text of the article.</article>"),
            (2, "<title></title><article><h1>Head <b>ing</b></h1>Text of the article.</article><h1>Other</h1>"),
            (3, "<meta property='og:title' content='Named  so'><main>Some text.</main><h1>Heading</h1>"),
            (4, "<h1>Short</h1><p>Too little.</p>"),
            (5, "<article> \n </article><main>Hidden no more.</main><p>around</p>"),
            (6, "<article></article><main></main><p>whole page</p>"), (7, ""), (8, None)]
    df = spark.createDataFrame([(i, "https://h/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.content) for r in ex.page_fields(df).collect()}
    assert got[1] == ("Own", "Text of the article.") and got[2][0] == "Head ing" and got[3] == ("Named so", "Some text.")
    assert got[4] == ("", "Short \nToo little.") and got[5] == ("", "Hidden no more.") and got[6] == ("", "whole page")
    assert got[7] == got[8] == ("", "")
