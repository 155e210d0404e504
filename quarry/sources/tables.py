"""Scans of the provided tables and the views derived from them.

Every view is a lazy projection over a Parquet scan, so Catalyst prunes
columns and pushes filters into the reader. The same definitions exist as
DuckDB SQL in ``quarry.plans.oracle`` for the correctness check.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import pin

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# The "now" used by time-based frontier rules (never the clock)
# and the epoch of the derived crawl times.
NOW = "2024-03-01 00:00:00"
CRAWL_EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def doc_url(source: Column, lang: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".example.com/"), lang, F.lit("/"),
                    doc_id.cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages-shaped corpus: (page, source, url, title, description, content, depth, status, crawled_at)."""
    d = read(spark, sf_dir, "documents")
    status = (F.when(F.col("doc_id") % 17 == 0, F.lit(S.ERROR))
              .when(F.col("doc_id") % 23 == 0, F.lit(S.UNINDEXABLE))
              .otherwise(F.lit(S.FINISHED)))
    return d.select(
        F.col("doc_id").alias("page"),
        F.col("source"),
        doc_url(F.col("source"), F.col("lang"), F.col("doc_id")).alias("url"),
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 81, 160).alias("description"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 5).cast("int").alias("depth"),
        status.cast("tinyint").alias("status"),
        (F.to_timestamp(F.lit(CRAWL_EPOCH)) + F.make_dt_interval(hours=F.col("doc_id").cast("int")))
        .alias("crawled_at"),
    )


def chunks(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Vector chunks: (id, page, chunk_index, source, status, embedding)."""
    e = read(spark, sf_dir, "embeddings")
    pages = pages if pages is not None else corpus(spark, sf_dir)
    c = e.select(
        F.col("vec_id").alias("id"),
        F.floor(F.col("vec_id") / 4).cast("long").alias("page"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        F.col("embedding"),
    )
    return c.join(pages.select("page", "source", "status", "content"), "page", "inner").select(
        "id", "page", "chunk_index", "source", "status", "embedding",
        # chunk text: the chunk_index-th quarter of the page text
        F.substring("content", F.col("chunk_index") * F.ceil(F.length("content") / 4).cast("int") + 1,
                    F.ceil(F.length("content") / 4).cast("int")).alias("chunk"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch: every vector whose vec_id is divisible by 100."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return e.select(F.floor(F.col("vec_id") / 100).cast("long").alias("query_id"), "embedding")


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch over all vectors: element-wise mean of vectors 2i and 2i + 1, for every i; one without the other is the query itself."""
    e = read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("query_id"), (F.col("vec_id") % 2).alias("half"), "embedding")
    a = e.filter("half = 0").select("query_id", F.col("embedding").alias("a"), F.lit(True).alias("has_a"))
    b = e.filter("half = 1").select("query_id", F.col("embedding").alias("b"), F.lit(True).alias("has_b"))
    mean = F.zip_with("a", "b", lambda x, y: ((x.cast("double") + y.cast("double")) / 2).cast("float"))
    return a.join(b, "query_id", "full_outer").select(
        "query_id", F.when(F.col("has_b").isNull(), F.col("a")).when(F.col("has_a").isNull(), F.col("b")).otherwise(mean).alias("embedding"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch of whole benchmark texts: (query_id, q)."""
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of every benchmark text as a one-word (prefix) query."""
    b = read(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.split("text", r"\W")).alias("q")).filter("q <> ''").distinct()
    return words.select(F.col("q").alias("query_id"), "q")


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark text as one phrase (non-word runs joined by '_')."""
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.regexp_replace("text", r"\W+", "_").alias("q"))


def link_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): anchors (page_id, url) parsed from every page, and (id, url) of the pages and of all they link to.

    A url that is no page's gets the next free id, in order of the urls.
    """
    from ..operators import extract as ex
    from ..operators.store import dense_number
    p = read(spark, sf_dir, "pages")
    links = pin(p.select("page_id", F.explode(ex.anchor_hrefs(ex.parsed(F.col("html")), F.col("url"))).alias("url")).distinct())
    own = p.select(F.col("page_id").alias("id"), "url")
    last = p.agg(F.coalesce(F.max("page_id"), F.lit(-1))).first()[0]
    far = dense_number(links.select("url").distinct().join(own.select("url"), "url", "left_anti"), ["url"], F.lit(last), "id")
    return links, own.unionByName(far.select("id", "url"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link graph (src, dest) of the parsed anchors over page and url ids; self edges kept."""
    links, nodes = link_nodes(spark, sf_dir)
    return links.join(nodes, "url").select(F.col("page_id").alias("src"), F.col("id").cast("long").alias("dest"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl frontier rows derived from ``events``."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/"),
                 (F.col("event_id") % 50).cast("string")).alias("url"),
        (F.col("event_id") % 4).cast("int").alias("status"),
        (F.col("event_id") % 7).cast("int").alias("depth"),
        F.col("ts").alias("added_at"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 120).cast("int")))
        .alias("updated_at"),
    )


def aliases(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Alias rows (source, url, canonical, crawled_at): http form of every 4th page."""
    pages = pages if pages is not None else corpus(spark, sf_dir)
    return pages.filter(F.col("page") % 4 == 0).select(
        "source",
        F.replace(F.col("url"), F.lit("https://"), F.lit("http://")).alias("url"),
        F.col("url").alias("canonical"),
        "crawled_at",
    )


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def sources_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dimension derived from the corpus: one row per source id."""
    from ..functions import urls as U
    d = read(spark, sf_dir, "documents").select("source").distinct()
    return d.select(
        F.col("source").alias("id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/")).alias("url"),
        F.array(F.concat(F.col("source"), F.lit(".example.com"))).alias("allowed_domains"),
        F.lit(3).alias("max_depth"), F.lit(2000).alias("size_limit"), F.lit(5).alias("speed"),
        F.lit(30).alias("min_age"))


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with robots, canonical, description and alternate tags, which the provided markup lacks."""
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    tags = F.concat(
        F.when(i % 7 == 3, F.lit("<META NAME=robots CONTENT='noindex, follow'>")).otherwise(F.lit("")),
        F.when(i % 3 == 0, F.concat(F.lit("<link rel=canonical href=https://canon.example.com/"), s, F.lit(">"))).otherwise(F.lit("")),
        F.when(i % 4 == 1, F.concat(F.lit("<meta name='description' content='About \"page\" "), s, F.lit(" &amp; more'>"))).otherwise(F.lit("")),
        F.when(i % 5 == 2, F.concat(F.lit('<link type="application/rss+xml" title="a>b" rel="alternate" href="//feeds.example.com/x/../'), s,
                                    F.lit('.xml">'))).otherwise(F.lit("")))
    # the scheme of a page and of its feed differ in the data; fixed here so that the twin is plain
    html = F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), F.replace(tags, F.lit("//feeds"), F.lit("https://feeds"))))
    return read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def fetched_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch results (page_id, url, content_type, html, fetch_error) of six kinds derived from ``pages``."""
    i, s = F.col("page_id") % 6, F.col("page_id").cast("string")
    loc = F.concat(F.lit("https://listed.example.com/"), s)
    body = (F.when(i == 1, F.concat(F.lit("<urlset><url><loc>"), loc, F.lit("</loc></url></urlset>")))
            .when(i == 2, F.concat(F.lit("<rss><channel><item><link>"), loc, F.lit("</link></item></channel></rss>")))
            .when(i == 3, F.concat(F.lit("<rss><channel><item><link>"), loc, F.lit("</channel></rss>"))).otherwise(F.col("html")))
    kind = (F.when(i == 0, F.lit("text/html; charset=utf-8")).when(i == 1, F.lit("application/xml"))
            .when((i == 2) | (i == 3), F.lit("application/rss+xml")).when(i == 4, F.lit("image/png")).otherwise(F.lit("text/html")))
    return read(spark, sf_dir, "pages").select(
        "page_id", "url", kind.alias("content_type"), body.alias("html"), F.when(i == 5, F.lit("timeout")).alias("fetch_error"))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"<title[^>]*>(.*?)</title>", 1)


def recrawl_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl-result batch derived from ``labels`` (updates, some twice) and
    ``pages`` (new documents of source 'web'); ``seq`` orders arrivals."""
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels").join(d, "doc_id")
    exact = doc_url(F.col("source"), F.col("lang"), F.col("doc_id"))
    upper = doc_url(F.upper("source"), F.col("lang"), F.col("doc_id"))
    base = dict(source=F.col("source"),
                url=F.when(F.col("quality") == 0, upper).otherwise(exact),
                status=F.lit(S.FINISHED).cast("tinyint"),
                description=F.substring("text", 81, 160), content=F.col("text"),
                error_info=F.lit(""))
    first = lab.select(*[v.alias(k) for k, v in base.items()],
                       (F.col("doc_id") % 5 + 1 - 2 * F.col("toxic")).cast("int").alias("depth"),
                       F.concat(F.lit("v2 "), F.substring("text", 1, 80)).alias("title"),
                       (F.col("doc_id") * 2).alias("seq"))
    second = lab.filter(F.col("toxic") == 1).select(
        *[v.alias(k) for k, v in base.items()], F.lit(0).alias("depth"),
        F.concat(F.lit("v3 "), F.substring("text", 1, 80)).alias("title"),
        (F.col("doc_id") * 2 + 1).alias("seq"))
    p = read(spark, sf_dir, "pages").withColumn("body", F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    fresh = p.select(F.lit("web").alias("source"), "url", F.lit(S.FINISHED).cast("tinyint").alias("status"),
                     F.substring("body", 1, 160).alias("description"), F.col("body").alias("content"),
                     F.lit("").alias("error_info"), F.lit(1).alias("depth"),
                     title_of(F.col("html")).alias("title"),
                     (F.lit(1_000_000_000) + F.col("page_id")).alias("seq"))
    return first.unionByName(second).unionByName(fresh)


def http_url(url: Column) -> Column:
    return F.replace(url, F.lit("https://"), F.lit("http://"))


def alias_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New alias writes (source, url, canonical, seq) derived from ``labels``."""
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels").join(d, "doc_id")
    exact = doc_url(F.col("source"), F.col("lang"), F.col("doc_id"))
    can = (F.when(F.col("toxic") == 1, F.concat(exact, F.lit("/")))
           .when(F.col("quality") == 1, http_url(exact)).otherwise(exact))
    a = lab.select("source", http_url(exact).alias("url"), can.alias("canonical"),
                   F.col("doc_id").alias("seq"))
    b = lab.filter(F.col("quality") == 0).select(
        "source", F.replace(exact, F.lit("https://"), F.lit("HTTP://")).alias("url"),
        exact.alias("canonical"), (F.col("doc_id") + 1_000_000).alias("seq"))
    return a.unionByName(b)


def embed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding queue rows derived from ``embeddings``."""
    e = read(spark, sf_dir, "embeddings")
    added = F.to_timestamp(F.lit("2024-02-29 23:50:00")) + F.make_dt_interval(
        secs=F.col("vec_id").cast("int"))
    return e.select(
        F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).cast("long").alias("page"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        (F.col("label") % 5).cast("int").alias("status"),
        added.alias("added_at"),
        (added + F.make_dt_interval(secs=(F.col("label") * 10).cast("int"))).alias("updated_at"))


def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found while crawling, derived from ``events``: (source, url, depth, seq)."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("https://H"), F.col("user_id").cast("string"), F.lit(".example.com/"),
                 ((F.col("event_id") + 1) % 50).cast("string")).alias("url"),
        (F.col("event_id") % 7 + 1).cast("int").alias("depth"),
        F.col("event_id").alias("seq"))


# What a source id may look like.
SOURCE_ID = "^[A-Za-z0-9_]+$"


def invalid_sources(sources: DataFrame) -> DataFrame:
    """A4: rows of the source dimension whose id is missing, repeated or not made of letters, digits and _."""
    n = sources.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 or id is null").select("id")
    bad = ~F.coalesce(F.col("id").rlike(SOURCE_ID), F.lit(False))
    return sources.filter(bad).unionByName(sources.filter(~bad).join(n, "id", "left_semi"))


def write_by_source(df: DataFrame, path: str) -> DataFrame:
    """A5: a table as one Parquet folder per source; a task's rows of a source are one file."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_source(spark: SparkSession, path: str, source: str) -> bool:
    """Delete one source's folder of a table written by source; False when it has none."""
    from urllib.parse import quote
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/source={quote(source, safe='')}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
