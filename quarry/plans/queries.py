"""Registered queries: one per operator of the inventory, each reading the
provided tables (or data Spark derives from them) at ``sf_dir``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import search as srch
from ..session import pin
from ..sources import tables as tb
from . import oracle as O
from .registry import cached, register


def corpus_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The corpus index, written once per session to the shared folder."""
    return cached(spark, sf_dir, "index",
                  lambda: ix.build_index(tb.corpus(spark, sf_dir), materialize=True))


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --------------------------------------------------------------------------- E


# Benchmark texts corrected word by word: ``fixed(query_id, q, corrected)``.
CORRECTION = rf"""{O.DICTIONARY},
qw AS (SELECT item_id, text, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT item_id, text, regexp_split_to_array(text, '\W') AS ws FROM benchmark)),
keyed AS (SELECT w, substr(k, 1, CASE WHEN length(k) > 3 THEN 3 WHEN length(k) > 2 THEN length(k) - 1 ELSE length(k) END) AS prefix
  FROM (SELECT w, {O.phonetic_key('w')} AS k FROM (SELECT DISTINCT w FROM qw WHERE w <> ''))),
dict_bits AS (SELECT *, length(bin(rank)) AS bits FROM dict),
own AS (SELECT k.w, max(d.bits) AS least_bits FROM keyed k JOIN dict_bits d ON d.a = lower(k.w) AND starts_with(d.k2, k.prefix) GROUP BY k.w),
near_words AS (SELECT k.w, d.word, d.a, d.k2, d.bits FROM keyed k LEFT JOIN own o USING (w) JOIN dict_bits d ON starts_with(d.k2, k.prefix)
  WHERE o.least_bits IS NULL OR d.bits >= o.least_bits),
pairs AS (SELECT DISTINCT w AS a, a AS b FROM near_words), {O.edit_cost_ctes()},
best AS (SELECT c.w, arg_min(c.word, (t.cost + 32 - c.bits, c.k2, c.word)) AS word FROM near_words c JOIN costs t ON t.a = c.w AND t.b = c.a GROUP BY c.w),
fixed AS (SELECT b.item_id AS query_id, b.text AS q, coalesce(string_agg(coalesce(best.word, qw.w), ' ' ORDER BY qw.pos) FILTER (qw.w <> ''), '') AS corrected
FROM benchmark b LEFT JOIN qw ON qw.item_id = b.item_id LEFT JOIN best ON best.w = qw.w GROUP BY b.item_id, b.text)"""


@register("tokenize_corpus", ops="E1", sql=f"""
WITH t AS (SELECT doc_id, unnest({O.tokens('text')}) AS term FROM documents)
SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term""")
def tokenize_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_counts(tb.read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("postings", ops="E2 E4", sql=f"""
WITH {O.INDEX}
SELECT p.term, p.page, p.col, p.tf, d.dl FROM postings p JOIN doc_len d USING (page)""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = ix.build_index(tb.corpus(spark, sf_dir))
    return idx.postings.join(idx.doc_len, "page").select("term", "page", "col", "tf", "dl")


@register("vocab_stats", ops="E5", sql=f"""
WITH {O.INDEX}
SELECT term, count(DISTINCT page) AS doc, sum(tf) AS cnt FROM postings GROUP BY term""")
def vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_index(tb.corpus(spark, sf_dir)).vocabulary()


@register("corpus_stats", ops="E4", sql=f"""
WITH {O.INDEX}
SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = ix.build_index(tb.corpus(spark, sf_dir)).stats
    return st.select("n_docs", r6("avgdl"))


# ------------------------------------------------------------------------- F-Q


def _page(spark, sf_dir, queries, page=1):
    out = srch.search(corpus_index(spark, sf_dir), queries, page=page)
    return out.select("query_id", "rn", "page", "url", r6("rank"), r6("score"), "total",
                      "page_count")


@register("bm25_search", ops="F-Q1 F-Q2 F-Q5 F-Q6 F-Q7 F-Q8 F-Q9 F-Q14",
          sql=O.search_page_sql(O.QUERY_TEXTS))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, tb.query_texts(spark, sf_dir))


@register("search_page2", ops="F-Q8", sql=O.search_page_sql(O.WORD_QUERIES, page=2))
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, tb.word_queries(spark, sf_dir), page=2)


@register("prefix_search", ops="F-Q3", sql=O.search_page_sql(O.WORD_QUERIES))
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, tb.word_queries(spark, sf_dir))


@register("phrase_search", ops="F-Q4", sql=O.search_page_sql(O.PHRASE_QUERIES))
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, tb.phrase_queries(spark, sf_dir))


@register("bm25_two_ranks", ops="F-Q5 F-Q6", sql=f"""
WITH {O.search_ctes(O.QUERY_TEXTS)}
SELECT query_id, page, round(rank, 6) AS rank, round(score, 6) AS score FROM matches""")
def bm25_two_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = corpus_index(spark, sf_dir)
    m = srch.filter_pages(srch.score(idx, tb.query_texts(spark, sf_dir)), idx.pages, None)
    return m.select("query_id", "page", r6("rank"), r6("score"))


@register("search_total", ops="F-Q9 F-Q14", sql=f"""
WITH {O.search_ctes(O.WORD_QUERIES)}
SELECT query_id, count(*) AS total, CAST(greatest(1, ceil(count(*) / 10)) AS BIGINT) AS page_count
FROM matches GROUP BY query_id""")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = corpus_index(spark, sf_dir)
    return srch.page_counts(srch.match(idx, tb.word_queries(spark, sf_dir)).totals)


@register("scored_pages", ops="F-Q5 F-Q8")
def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its matches each one-word query scores for its first page of results."""
    idx = corpus_index(spark, sf_dir)
    m = srch.match(idx, tb.word_queries(spark, sf_dir))
    totals = pin(m.totals)
    scored = srch.best_scores(idx, m, pin(m.live), totals, 10).groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    return totals.join(scored, "query_id").select("query_id", "total", "scored")


@register("search_by_source", ops="F-Q7", sql=f"""
WITH {O.search_ctes(O.QUERY_TEXTS)}
SELECT m.query_id, m.page, c.source, round(m.rank, 6) AS rank FROM matches m JOIN corpus c ON c.page = m.page
WHERE c.source IN (SELECT source FROM corpus GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)""")
def search_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in the three largest sources."""
    idx = corpus_index(spark, sf_dir)
    top = [r.source for r in idx.pages.groupBy("source").count().orderBy(F.desc("count"), "source").limit(3).collect()]
    m = srch.filter_pages(srch.score(idx, tb.query_texts(spark, sf_dir)), idx.pages, top)
    return m.join(idx.pages.select("page", "source"), "page").select("query_id", "page", "source", r6("rank"))


@register("search_entry", ops="F-Q13 J9", sql=O.search_page_sql("SELECT query_id, corrected AS q FROM fixed")
          .replace("WITH ", "WITH RECURSIVE ", 1).replace(f"{O.INDEX},", f"{O.INDEX},\n{CORRECTION},", 1))
def search_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First results page of every benchmark text, corrected word by word."""
    out = srch.search_entry(corpus_index(spark, sf_dir), _dictionary(spark, sf_dir), tb.query_texts(spark, sf_dir))
    return out.select("query_id", "rn", "page", "url", r6("rank"), r6("score"), "total", "page_count")


def _chunk_texts(spark, sf_dir):
    """Chunks of the whole corpus with their text (G1-G3), written once."""
    return cached(spark, sf_dir, "chunk texts", lambda: pin(_page_chunks(spark, sf_dir)))


def _embedder(spark, sf_dir):
    """Vectors of the corpus's own: hashed TF-IDF of its chunks, projected."""
    from ..operators import embedding as em
    return cached(spark, sf_dir, "embedder", lambda: em.fit(_chunk_texts(spark, sf_dir), "chunk"))


def _embedded_chunks(spark, sf_dir):
    """Chunks of the whole corpus with their text and vectors, written once."""
    from ..operators import chunks as ch
    from ..operators import store as st

    def make():
        pages, text = tb.corpus(spark, sf_dir), _chunk_texts(spark, sf_dir)
        vec = ch.embed_chunks(text, embedder=_embedder(spark, sf_dir)).filter("status = 2").select("page", "chunk_index", "embedding")
        rows = text.join(vec, ["page", "chunk_index"]).join(pages.select("page", "source", "status"), "page")
        return pin(st.dense_number(rows, ["page", "chunk_index"], F.lit(0), "id"))
    return cached(spark, sf_dir, "chunks", make)


@register("similarity_entry", ops="H5 H13")
def similarity_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of every benchmark text, from its text."""
    from ..operators import vectors as vx
    res = vx.similarity_entry(_embedded_chunks(spark, sf_dir), tb.corpus(spark, sf_dir),
                              tb.query_texts(spark, sf_dir), _embedder(spark, sf_dir))
    return res.select("query_id", "source", "id", "page", "url", "title", r6("similarity"))


@register("hybrid_entry", ops="H5 H11 H12")
def hybrid_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused results of every benchmark text: corrected lexical side, embedded raw text, shown text."""
    from ..operators import hybrid as hy
    out = hy.hybrid_entry(corpus_index(spark, sf_dir), _embedded_chunks(spark, sf_dir), _dictionary(spark, sf_dir),
                          tb.query_texts(spark, sf_dir), _embedder(spark, sf_dir))
    return out.select("query_id", "page", "url", "fts_rank", "vec_rank", r6("vec_distance"), r6("combined_rank"), "title", "content")


@register("knn_skipped", ops="H1")
def knn_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of the corpus each benchmark text is and is not compared with for its ten nearest."""
    from ..operators import vectors as vx
    q = vx.embed_queries(tb.query_texts(spark, sf_dir), _embedder(spark, sf_dir))
    return vx.knn_work(_embedded_chunks(spark, sf_dir).select("id", "embedding"), q, 10)


@register("parse_query", ops="F-Q1", sql=f"""
SELECT item_id AS query_id, '"' || array_to_string({O.words('text')}, '" "') || '"*' AS expr
FROM benchmark""")
def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import match_expression
    b = tb.read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), match_expression(F.col("text")).alias("expr"))


# ----------------------------------------------------------------------- H


def _chunks(spark, sf_dir):
    return tb.chunks(spark, sf_dir)


@register("knn_cosine", ops="H1", sql=f"""
WITH {O.PAIR_BASE}
SELECT query_id, id, rn, round(distance, 6) AS distance FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn
  FROM dist) WHERE rn <= 10""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import vectors as vx
    near = vx.knn(_chunks(spark, sf_dir), tb.pair_vectors(spark, sf_dir), k=10)
    return near.select("query_id", "id", "rn", r6("distance"))


@register("similarity_by_source", ops="H1 H2 H3 H4 H13", sql=f"""
WITH {O.PAIR_BASE}, {O.NEAR_BY_SOURCE}
SELECT n.query_id, n.source, n.id, n.page, c.url, round(n.distance, 6) AS similarity
FROM near n JOIN corpus c ON c.page = n.page WHERE c.status = 2""")
def similarity_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import vectors as vx
    pages = tb.corpus(spark, sf_dir)
    res = vx.similarity(tb.chunks(spark, sf_dir, pages), pages, tb.pair_vectors(spark, sf_dir), k=10)
    return res.select("query_id", "source", "id", "page", "url", r6("similarity"))


@register("best_chunk_per_page", ops="H6 H8", sql=f"""
WITH {O.VEC_BASE}, {O.NEAR_BY_SOURCE}, {O.BEST_CHUNK}
SELECT query_id, source, page, round(distance, 6) AS distance, chunk, rank_number FROM ranked_best""")
def best_chunk_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import vectors as vx
    res = vx.best_chunk_per_page(_chunks(spark, sf_dir), tb.query_vectors(spark, sf_dir), k=10)
    return res.select("query_id", "source", "page", r6("distance"), "chunk", "rank_number")


HYBRID_QUERIES = f"""SELECT b.item_id AS query_id, b.text AS q FROM benchmark b
  WHERE b.item_id IN (SELECT query_id FROM ({O.QVEC_SELECT}))"""


@register("rrf_hybrid", ops="H7 H8 H9 H10 H11 H12", sql=f"""
WITH {O.search_ctes(HYBRID_QUERIES)}, {O.CHUNKS}, {O.QVEC}, {O.DIST},
near AS (
  SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.query_id, d.source ORDER BY d.distance, d.id) AS rn
                 FROM dist d WHERE d.query_id IN (SELECT query_id FROM queries)) WHERE rn <= 10),
{O.BEST_CHUNK},
vec AS (SELECT r.query_id, r.page, r.rank_number AS vec_rank, r.distance AS vec_distance, r.chunk
        FROM ranked_best r JOIN corpus c ON c.page = r.page WHERE c.status = 2),
lex0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), page) AS pick FROM matches),
lex AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), page) AS fts_rank
        FROM lex0 WHERE pick <= 10),
fused AS (
  SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.page, v.page) AS page,
         l.fts_rank, v.vec_rank, v.vec_distance
  FROM lex l FULL OUTER JOIN vec v ON l.query_id = v.query_id AND l.page = v.page)
SELECT f.query_id, f.page, c.url, f.fts_rank, f.vec_rank, round(f.vec_distance, 6) AS vec_distance,
       round(coalesce(0.5 / (60 + f.vec_rank), 0.0) + coalesce(1.0 / (60 + f.fts_rank), 0.0), 6) AS combined_rank
FROM fused f JOIN corpus c ON c.page = f.page""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import hybrid as hy
    idx = corpus_index(spark, sf_dir)
    qv = tb.query_vectors(spark, sf_dir)
    q = tb.query_texts(spark, sf_dir).join(qv, "query_id")
    res = hy.hybrid_search(idx, tb.chunks(spark, sf_dir, idx.pages), q, limit=10)
    return res.select("query_id", "page", "url", "fts_rank", "vec_rank", r6("vec_distance"),
                      r6("combined_rank"))


# ------------------------------------------------------------------------- C


def _epoch(c: str):
    return F.unix_timestamp(F.col(c)).alias(c)


@register("upsert_pages", ops="C5", sql=f"""
WITH {O.CORPUS}, {O.UPSERT}
SELECT page, source, url, depth, status, title, {O.epoch_s('crawled_at')} AS crawled_at FROM upserted""")
def upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir).withColumn("error_info", F.lit(""))
    out = st.upsert(pages, tb.recrawl_batch(spark, sf_dir), tb.now())
    return out.select("page", "source", "url", "depth", "status", "title", _epoch("crawled_at"))


@register("latest_alias", ops="C11", sql=f"""
WITH {O.CORPUS}, {O.ALIASES}, {O.ALIAS_WRITES},
w AS (SELECT * FROM writes WHERE canonical <> url),
latest AS (SELECT source, {O.url_key('url')} AS url_key, arg_max(url, seq) AS url,
                  arg_max(canonical, seq) AS canonical
           FROM w GROUP BY source, {O.url_key('url')})
SELECT source, url, canonical FROM aliases a
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.source = a.source AND l.url_key = {O.url_key('a.url')})
UNION ALL SELECT source, url, canonical FROM latest""")
def latest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    out = st.set_aliases(tb.aliases(spark, sf_dir), tb.alias_writes(spark, sf_dir), tb.now())
    return out.select("source", "url", "canonical")


@register("lookup_via_alias", ops="C3 C4", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
req AS (SELECT page AS req_id, source, {O.http('url')} AS url FROM corpus
        UNION ALL SELECT -page - 1, source, url FROM corpus),
targets AS (SELECT req_id, source, url FROM req
            UNION ALL SELECT r.req_id, r.source, a.canonical FROM req r JOIN aliases a ON a.url = r.url)
SELECT DISTINCT t.req_id, c.page, c.title FROM targets t JOIN corpus c ON c.source = t.source AND c.url = t.url""")
def lookup_via_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    req = pages.select(F.col("page").alias("req_id"), "source", tb.http_url(F.col("url")).alias("url")) \
        .unionByName(pages.select((-F.col("page") - 1).alias("req_id"), "source", "url"))
    return st.lookup(req, pages.select("page", "source", "url", "title"), tb.aliases(spark, sf_dir, pages)) \
        .select("req_id", "page", "title")


@register("alias_collapse", ops="C13", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
old AS (SELECT page, source, url FROM corpus
        UNION ALL SELECT -l.doc_id - 1, c.source, {O.http('c.url')} FROM labels l JOIN corpus c ON c.page = l.doc_id),
batch AS (SELECT c.source, c.url FROM labels l JOIN corpus c ON c.page = l.doc_id),
doomed AS (SELECT a.source, a.url FROM batch b JOIN aliases a ON a.source = b.source AND a.canonical = b.url)
SELECT page, source, url FROM old o
WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.source = o.source AND d.url = o.url)""")
def alias_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    lab = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"))
    mine = pages.join(lab, "page")
    old = pages.select("page", "source", "url").unionByName(
        mine.select((-F.col("page") - 1).alias("page"), "source", tb.http_url(F.col("url")).alias("url")))
    return st.collapse_aliases(old, mine.select("source", "url"), tb.aliases(spark, sf_dir, pages))


ANCHOR_SQL = f"""a AS (SELECT page_id, url AS base, unnest({O.anchors('html', 'url')}) AS url FROM pages)"""


# the link graph of the anchors: a url that is no page's gets the next free id, in order of the urls
EDGES_SQL = f"""{ANCHOR_SQL},
nodes AS (
  SELECT page_id AS id, url FROM pages
  UNION ALL SELECT (SELECT max(page_id) FROM pages) + row_number() OVER (ORDER BY url) AS id, url
  FROM (SELECT DISTINCT url FROM a WHERE url NOT IN (SELECT url FROM pages))),
edges AS (SELECT DISTINCT a.page_id AS src, n.id AS dest FROM a JOIN nodes n ON n.url = a.url)"""


@register("delete_cascade", ops="C10", sql=f"""
WITH {O.INDEX}, {O.ALIASES}, {O.CHUNKS}, {EDGES_SQL}, {O.FRONTIER}, {O.LINKS}, {O.EMBED_QUEUE},
q AS (SELECT id, source, {O.url_key('url')} AS k FROM frontier),
refs AS (SELECT DISTINCT q.id AS queue_item, l.seq % 97 AS referrer FROM links l JOIN q ON q.source = l.source AND q.k = {O.url_key('l.url')}),
gone AS (SELECT page, source, url FROM corpus WHERE status = 3),
left_chunks AS (SELECT * FROM chunks WHERE page NOT IN (SELECT page FROM gone))
SELECT 'alias' AS kind, a.url AS key FROM aliases a
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = a.source AND g.url = a.canonical)
UNION ALL SELECT 'page', url FROM corpus WHERE page NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'chunk', CAST(id AS VARCHAR) FROM left_chunks
UNION ALL SELECT 'vector', CAST(e.vec_id AS VARCHAR) FROM embeddings e
  WHERE e.vec_id NOT IN (SELECT id FROM chunks) OR e.vec_id IN (SELECT id FROM left_chunks)
UNION ALL SELECT 'edge', src || '>' || dest FROM edges WHERE src NOT IN (SELECT page FROM gone) AND dest NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'referrer', queue_item || '<' || referrer FROM refs WHERE referrer NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'embed', CAST(id AS VARCHAR) FROM eq WHERE page NOT IN (SELECT page FROM gone)
UNION ALL SELECT 'posting', page || ':' || count(*) FROM postings WHERE page NOT IN (SELECT page FROM gone) GROUP BY page
UNION ALL SELECT 'position', page || ':' || count(*) FROM positions WHERE page NOT IN (SELECT page FROM gone) GROUP BY page
UNION ALL SELECT 'length', page || ':' || CAST(dl AS BIGINT) FROM doc_len WHERE page NOT IN (SELECT page FROM gone)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every table, one row kind each, when the pages in error are deleted."""
    from .. import schema as S
    from ..operators import frontier as fr
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    idx = corpus_index(spark, sf_dir)
    refs = fr.referrer_pairs(_fr(spark, sf_dir), tb.discovered_links(spark, sf_dir).withColumn("referrer", F.col("seq") % 97))
    tables = {"pages": pages, "aliases": tb.aliases(spark, sf_dir, pages), "edges": tb.edges(spark, sf_dir), "referrers": refs,
              "embed_queue": tb.embed_queue(spark, sf_dir), "chunks": tb.chunks(spark, sf_dir, pages),
              "vectors": tb.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")),
              "postings": idx.postings, "doc_len": idx.doc_len}
    out = st.delete_pages(tables, pages.filter(F.col("status") == S.ERROR))
    per = out["postings"].groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pos")).alias("p"))
    text = lambda c: F.col(c).cast("string")
    rows = {"alias": (out["aliases"], F.col("url")), "page": (out["pages"], F.col("url")), "chunk": (out["chunks"], text("id")),
            "vector": (out["vectors"], text("id")), "edge": (out["edges"], F.concat_ws(">", "src", "dest")),
            "referrer": (out["referrers"], F.concat_ws("<", "queue_item", "referrer")), "embed": (out["embed_queue"], text("id")),
            "posting": (per, F.concat_ws(":", "page", "n")), "position": (per, F.concat_ws(":", "page", "p")),
            "length": (out["doc_len"], F.concat_ws(":", "page", "dl"))}
    parts = [df.select(F.lit(kind).alias("kind"), key.alias("key")) for kind, (df, key) in rows.items()]
    left = parts[0]
    for part in parts[1:]:
        left = left.unionByName(part)
    return left


@register("references_out", ops="C8", sql=f"""
WITH {EDGES_SQL},
deg AS (SELECT src, count(*) AS n_references FROM edges GROUP BY src)
SELECT e.src AS page, e.dest AS reference, d.n_references FROM edges e JOIN deg d USING (src)""")
def references_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    return st.references(tb.edges(spark, sf_dir))


@register("pages_by_id", ops="C4 A7", sql=f"""
WITH {O.CORPUS}
SELECT page, url, title FROM corpus WHERE page IN (SELECT doc_id FROM labels)""")
def pages_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    ids = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"))
    return st.by_ids(tb.corpus(spark, sf_dir), ids).select("page", "url", "title")


@register("apply_redirects", ops="C14 C11", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
req AS (SELECT page AS req_id, source, {O.http('url')} AS url, url AS final_url FROM corpus),
known AS (SELECT source, url FROM aliases),
fresh AS (SELECT * FROM req r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = r.source AND k.url = r.url))
SELECT 'alias' AS kind, source, url AS a, final_url AS b FROM fresh
UNION ALL SELECT 'alias', source, url, canonical FROM aliases
UNION ALL SELECT 'insert', source, final_url, '' FROM req WHERE req_id NOT IN (SELECT req_id FROM fresh)""")
def apply_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases written and pages still to insert after every page was also fetched by its http url."""
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    req = pages.select(F.col("page").alias("req_id"), "source", tb.http_url(F.col("url")).alias("url"), F.col("url").alias("final_url"))
    batch = req.select("req_id", "source", "final_url")
    a, b = st.apply_redirects(req, pages.select("page", "source", "url"), tb.aliases(spark, sf_dir, pages), batch, tb.now())
    return a.select(F.lit("alias").alias("kind"), "source", F.col("url").alias("a"), F.col("canonical").alias("b")).unionByName(
        b.select(F.lit("insert").alias("kind"), "source", F.col("final_url").alias("a"), F.lit("").alias("b")))


@register("queue_referrers", ops="D2", sql=f"""
WITH {O.FRONTIER}, {O.LINKS},
q AS (SELECT id, source, {O.url_key('url')} AS k FROM frontier)
SELECT DISTINCT q.id AS queue_item, l.seq % 97 AS referrer FROM links l JOIN q ON q.source = l.source AND q.k = {O.url_key('l.url')}""")
def queue_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    links = tb.discovered_links(spark, sf_dir).withColumn("referrer", F.col("seq") % 97)
    return fr.referrer_pairs(_fr(spark, sf_dir), links)


@register("claim_referrers", ops="D5", sql=f"""
WITH {O.FRONTIER}, {O.LINKS},
q AS (SELECT id, source, {O.url_key('url')} AS k FROM frontier),
pairs AS (SELECT DISTINCT q.id, l.seq % 97 AS referrer FROM links l JOIN q ON q.source = l.source AND q.k = {O.url_key('l.url')}),
speed AS (SELECT source, count(*) % 7 + 1 AS n FROM frontier GROUP BY source),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY added_at, id) AS rn FROM frontier WHERE status = 0)
SELECT c.id, c.source, p.referrer FROM c JOIN speed s ON s.source = c.source AND c.rn <= s.n LEFT JOIN pairs p ON p.id = c.id""")
def claim_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's oldest rows, as many as its speed, with their referrers."""
    from ..operators import frontier as fr
    q = _fr(spark, sf_dir)
    links = tb.discovered_links(spark, sf_dir).withColumn("referrer", F.col("seq") % 97)
    speed = q.groupBy("source").agg((F.count(F.lit(1)) % 7 + 1).alias("n"))
    return fr.claim_with_referrers(q, fr.referrer_pairs(q, links), speed, tb.now()).select("id", "source", "referrer")


@register("invalid_sources", ops="A4", sql=f"""
WITH h AS (SELECT DISTINCT {O.hostname('url')} AS id FROM pages UNION SELECT DISTINCT source FROM documents)
SELECT id FROM h WHERE id IS NULL OR NOT regexp_matches(id, '^[A-Za-z0-9_]+$')""")
def invalid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids among all hosts and document sources that may not name a source."""
    from ..functions import urls as U
    ids = _raw_pages(spark, sf_dir).select(U.hostname(F.col("url")).alias("id")).union(
        tb.read(spark, sf_dir, "documents").select("source")).distinct()
    return tb.invalid_sources(ids)


@register("drop_source_vectors", ops="A5 A8", sql=f"""
WITH {O.CORPUS}, {O.CHUNKS}
SELECT id, source FROM chunks WHERE source <> (SELECT min(source) FROM chunks)""")
def drop_source_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table, written by source, after one source was dropped."""
    from ..session import scratch_path
    path = scratch_path(spark, "vectors")
    c = tb.chunks(spark, sf_dir).select("id", "embedding", "source")
    tb.write_by_source(c, path)
    tb.drop_source(spark, path, c.agg(F.min("source")).first()[0])
    return spark.read.schema("id long, source string").parquet(path).select("id", "source")


@register("source_sinks", ops="A5", sql=f"""
WITH {O.CORPUS}, {O.CHUNKS}, {O.FRONTIER}, {O.LINKS}
SELECT 'chunks' AS name, source, count(*) AS n FROM chunks GROUP BY source
UNION ALL SELECT 'queue', source, count(*) FROM frontier GROUP BY source
UNION ALL SELECT 'links', source, count(*) FROM links GROUP BY source""")
def source_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, queue and links written by source, and what a reader of each table then finds."""
    from ..session import scratch_path
    tables = {"chunks": tb.chunks(spark, sf_dir), "queue": _fr(spark, sf_dir), "links": tb.discovered_links(spark, sf_dir)}
    parts = [tb.write_by_source(df, scratch_path(spark, name)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(name).alias("name"), "source", "n") for name, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("orphans", ops="C9", sql=f"""
WITH {EDGES_SQL}
SELECT page_id FROM pages WHERE page_id NOT IN (SELECT dest FROM edges)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    p = tb.read(spark, sf_dir, "pages").select("page_id")
    return st.orphans(p, tb.edges(spark, sf_dir), id_col="page_id")


@register("referrers_in", ops="C8", sql=f"""
WITH {EDGES_SQL},
deg AS (SELECT dest, count(*) AS n_referrers FROM edges GROUP BY dest)
SELECT e.dest AS page, e.src AS referrer, d.n_referrers FROM edges e JOIN deg d USING (dest)""")
def referrers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    return st.referrers(tb.edges(spark, sf_dir))


@register("add_edges", ops="C6 C7", sql=f"""
WITH {EDGES_SQL}
SELECT DISTINCT src, dest FROM (
  SELECT src, dest FROM edges WHERE src <> dest
  UNION ALL SELECT dest AS src, src AS dest FROM edges WHERE src <> dest)
WHERE NOT (src < dest AND (src + dest) % 5 = 0)""")
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    e = tb.edges(spark, sf_dir)
    base = e.filter(F.col("src") != F.col("dest"))
    both = st.add_edges(base, e.select(F.col("dest").alias("src"), F.col("src").alias("dest")))
    doomed = both.filter((F.col("src") < F.col("dest")) & ((F.col("src") + F.col("dest")) % 5 == 0))
    return st.remove_edges(both, doomed)


@register("relink", ops="C12", sql=f"""
WITH {EDGES_SQL}
SELECT src, dest FROM edges
UNION SELECT dest AS src, src AS dest FROM edges WHERE dest NOT IN (SELECT page_id FROM pages)""")
def relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's links again: all urls of the link graph are indexed, every fourth under an alias; the edges of
    before, the graph turned round, stay where they leave from what is no crawled page."""
    from ..operators import store as st
    links, nodes = tb.link_nodes(spark, sf_dir)
    nodes = pin(nodes.withColumn("source", F.lit("web")).withColumn("moved", F.col("id") % 4 == 0))
    pages = nodes.select(F.col("id").alias("page"), "source", F.when(F.col("moved"), F.concat("url", F.lit("?moved"))).otherwise(F.col("url")).alias("url"))
    aliases = nodes.filter("moved").select("source", "url", F.concat("url", F.lit("?moved")).alias("canonical"))
    old = tb.edges(spark, sf_dir)
    crawled = tb.read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"))
    found = links.select(F.col("page_id").alias("page"), F.lit("web").alias("source"), "url")
    return st.relink(old.select(F.col("dest").alias("src"), F.col("src").alias("dest")), crawled, found, pages, aliases)


@register("redirect_alias", ops="C14", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
req AS (SELECT page AS req_id, source, {O.http('url')} AS url, url AS final_url FROM corpus),
t1 AS (SELECT req_id, source, url FROM req UNION ALL
       SELECT r.req_id, r.source, a.canonical FROM req r JOIN aliases a ON a.url = r.url),
t2 AS (SELECT req_id, source, final_url AS url FROM req UNION ALL
       SELECT r.req_id, r.source, a.canonical FROM req r JOIN aliases a ON a.url = r.final_url),
h1 AS (SELECT DISTINCT req_id FROM t1 JOIN corpus c USING (source, url)),
h2 AS (SELECT DISTINCT req_id FROM t2 JOIN corpus c USING (source, url))
SELECT req_id, req_id IN (SELECT req_id FROM h1) AS orig_indexed, req_id IN (SELECT req_id FROM h2) AS final_indexed,
       (req_id NOT IN (SELECT req_id FROM h1)) AND (req_id IN (SELECT req_id FROM h2)) AS alias_only
FROM req""")
def redirect_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    req = pages.select(F.col("page").alias("req_id"), "source", tb.http_url(F.col("url")).alias("url"),
                       F.col("url").alias("final_url"))
    r = st.redirect_alias(req, pages.select("page", "source", "url"), tb.aliases(spark, sf_dir, pages))
    return r.select("req_id", "orig_indexed", "final_indexed", "alias_only")


# --------------------------------------------------------------- B, C1, C2, C15


def _raw_pages(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages")


@register("canonicalize_urls", ops="C1", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
inp AS (SELECT {O.hostname('url')} AS source, url FROM pages
        UNION ALL SELECT source, {O.http('url')} FROM corpus
        UNION ALL SELECT source, url || '/#a' FROM corpus)
SELECT i.source, i.url, coalesce(a.canonical, {O.canonical_guess('i.url')}) AS canonical
FROM inp i LEFT JOIN aliases a ON a.source = i.source AND a.url = i.url""")
def canonicalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls as U
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir)
    inp = (_raw_pages(spark, sf_dir).select(U.hostname(F.col("url")).alias("source"), "url")
           .unionByName(pages.select("source", tb.http_url(F.col("url")).alias("url")))
           .unionByName(pages.select("source", F.concat("url", F.lit("/#a")).alias("url"))))
    return st.canonicalize(inp, tb.aliases(spark, sf_dir, pages)).select("source", "url", "canonical")


@register("anchor_links", ops="B5 B10", sql=f"""
WITH {ANCHOR_SQL} SELECT page_id, url FROM a""")
def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    p = _raw_pages(spark, sf_dir)
    return p.select("page_id", F.explode(ex.anchor_hrefs(ex.parsed(F.col("html")), F.col("url"))).alias("url"))


@register("domain_filter", ops="C2 A4", sql=f"""
WITH {ANCHOR_SQL},
l AS (SELECT page_id, regexp_replace({O.hostname('base')}, '^m\\.', '') AS source, url FROM a),
src AS (SELECT DISTINCT source AS id, [source] AS allowed_domains FROM l)
SELECT l.page_id, l.source, l.url FROM l JOIN (SELECT id, unnest(allowed_domains) AS host FROM src) s
  ON s.id = l.source AND s.host = {O.hostname('l.url')}""")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls as U
    from ..operators import extract as ex
    from ..operators import store as st
    p = _raw_pages(spark, sf_dir)
    links = p.select("page_id", F.regexp_replace(U.hostname(F.col("url")), r"^m\.", "").alias("source"),
                     F.explode(ex.anchor_hrefs(ex.parsed(F.col("html")), F.col("url"))).alias("url"))
    sources = links.select(F.col("source").alias("id")).distinct().select(
        "id", F.array("id").alias("allowed_domains"))
    return st.domain_filter(links, sources).select("page_id", "source", "url")


@register("page_fields", ops="B1 B2 B3 B4 B6 B11", sql=f"""
WITH {O.TAGGED}
SELECT page_id, CASE WHEN blocked THEN '' ELSE trim({O.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) END AS title,
  CASE WHEN blocked OR NOT described THEN '' ELSE 'About "page" ' || page_id || ' & more' END AS description,
  CASE WHEN blocked OR NOT canonised THEN url ELSE 'https://canon.example.com/' || page_id END AS canonical,
  CAST(CASE WHEN blocked THEN 3 ELSE 2 END AS TINYINT) AS status
FROM tagged""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    f = ex.page_fields(tb.tagged_pages(spark, sf_dir))
    return f.select("page_id", "title", "description", "canonical", "status")


@register("robots_status", ops="B3 B11", sql=f"""
WITH {O.TAGGED}
SELECT page_id, CAST(CASE WHEN blocked THEN 3 ELSE 2 END AS TINYINT) AS status,
  CASE WHEN blocked THEN 'Disallowed by <meta name="robots">' ELSE '' END AS error_info FROM tagged""")
def robots_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    return ex.page_fields(tb.tagged_pages(spark, sf_dir)).select("page_id", "status", "error_info")


@register("alternate_links", ops="B5 B6", sql=f"""
WITH {O.TAGGED}
SELECT page_id, 'https://feeds.example.com/' || page_id || '.xml' AS url FROM tagged WHERE alternate AND NOT blocked""")
def alternate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed alternates among the links of pages; blocked pages give none."""
    from ..operators import extract as ex
    f = ex.page_fields(tb.tagged_pages(spark, sf_dir)).select("page_id", F.explode("links").alias("url"))
    return f.filter(F.col("url").startswith("https://feeds.example.com/"))


@register("page_status", ops="A2 A3 B11", sql=f"""
WITH {O.FETCHED}
SELECT page_id, CAST(CASE WHEN kind IN ('error', 'bad_feed') THEN 3 WHEN kind = 'html' THEN 2 ELSE 4 END AS TINYINT) AS status,
  CASE kind WHEN 'error' THEN 'timeout' WHEN 'bad_feed' THEN 'Invalid feed content' ELSE '' END AS error_info,
  CASE kind WHEN 'map' THEN 1 WHEN 'feed' THEN 1 WHEN 'html' THEN 0 ELSE 0 END AS listed
FROM fetched""")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by content type: HTML, sitemap, feed, malformed feed, other type, fetch error."""
    from ..operators import extract as ex
    f = ex.fetched(tb.fetched_bodies(spark, sf_dir))
    return f.select("page_id", "status", "error_info",
                    F.exists("links", lambda u: u.startswith("https://listed.example.com/")).cast("int").alias("listed"))


@register("truncate_budget", ops="B9 A4", sql=f"""
WITH {O.CORPUS}, {O.SOURCES}
SELECT c.page, {', '.join(f'{e} AS {n}' for e, n in zip(O.truncate(['c.title', 'c.description', 'c.content'], 's.size_limit'), ['title', 'description', 'content']))}
FROM corpus c JOIN sources s ON s.id = c.source""")
def truncate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    pages = tb.corpus(spark, sf_dir)
    src = tb.sources_dim(spark, sf_dir).select(F.col("id").alias("source"), "size_limit")
    j = pages.join(src, "source")
    t, d, c = ex.truncate_bytes([F.col("title"), F.col("description"), F.col("content")], F.col("size_limit"))
    return j.select("page", t.alias("title"), d.alias("description"), c.alias("content"))


@register("url_levels", ops="C15", sql=f"""
WITH p AS (SELECT url, list_filter(string_split({O.url_part('url', 4)}, '/'), lambda s: trim(s) <> '') AS segs,
                  {O.origin('url')} AS o, {O.url_part('url', 3)} AS host FROM pages WHERE {O.is_url('url')}),
lv AS (SELECT url, o AS level_url, host AS text, 0 AS depth FROM p
       UNION ALL
       SELECT url, o || '/' || array_to_string(segs[1:i], '/'), segs[i], i
       FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM p))
SELECT level_url, text, depth, count(*) AS n_pages FROM lv GROUP BY level_url, text, depth""")
def url_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls as U
    p = _raw_pages(spark, sf_dir)
    lv = p.select(F.posexplode(U.levels(F.col("url"))).alias("depth", "lvl"))
    return lv.groupBy(F.col("lvl.url").alias("level_url"), F.col("lvl.text").alias("text"),
                      F.col("depth")).agg(F.count(F.lit(1)).alias("n_pages"))


@register("visible_text", ops="B7 B8")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    return ex.extract_text(_raw_pages(spark, sf_dir))


@register("main_text", ops="B7 B8", sql=r"""
SELECT doc_id AS page_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ' || chr(10)) AS content
FROM documents WHERE text IS NOT NULL""")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked up as articles among other page parts, and read back."""
    from ..operators import extract as ex
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("<p class=a>"), _xml_escape(x), F.lit("</p>")))
    d = tb.read(spark, sf_dir, "documents").where("text is not null").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("<head><title>t</title><style>p{}</style></head><body><nav>menu</nav><main><article>"), F.array_join(lines, ""),
                 F.lit("<svg><text>no</text></svg></article><p>aside</p></main><footer>end</footer></body>")).alias("html"))
    return ex.extract_text(d)


@register("extract_pages", ops="A1 B1-B11")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extract as ex
    return ex.extract_pages(_raw_pages(spark, sf_dir))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


@register("sitemap_links", ops="A2", sql=f"""
SELECT DISTINCT page_id, {O.canonical_guess('u')} AS url
FROM (SELECT page_id, unnest({O.resolved_anchors('html', 'url')}) AS u FROM pages)""")
def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's anchors written as a urlset and a sitemapindex, parsed back (A2)."""
    from ..operators import extract as ex
    from ..functions import urls as U
    p = _raw_pages(spark, sf_dir).withColumn("doc", ex.parsed(F.col("html")))
    locs = F.transform(F.col("doc.anchors"), lambda h: U.resolve(F.col("url"), h))
    body_set = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                        F.array_join(F.transform(locs, lambda u: F.concat(F.lit("<url><loc>"), _xml_escape(u),
                                                                          F.lit("</loc></url>"))), ""),
                        F.lit("</urlset>"))
    body_idx = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                        F.array_join(F.transform(locs, lambda u: F.concat(F.lit("<sitemap><loc>"), _xml_escape(u),
                                                                          F.lit("</loc></sitemap>"))), ""),
                        F.lit("</sitemapindex>"))
    docs = p.select("page_id", "url", F.explode(F.array(body_set, body_idx)).alias("body"))
    found = docs.select("page_id", F.explode(ex.sitemap_locs(F.col("body"), F.col("url"))).alias("u"))
    return found.select("page_id", U.canonical_guess(F.col("u")).alias("url")).distinct()


@register("feed_links", ops="A3", sql=f"""
SELECT DISTINCT page_id, kind, {O.canonical_guess('u')} AS url
FROM (SELECT page_id, unnest({O.resolved_anchors('html', 'url')}) AS u FROM pages),
     (SELECT unnest(['rss', 'atom', 'json']) AS kind)""")
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's anchors written as RSS, Atom and JSON feeds, parsed back (A3)."""
    from ..operators import extract as ex
    from ..functions import urls as U
    p = _raw_pages(spark, sf_dir).withColumn("doc", ex.parsed(F.col("html")))
    locs = F.transform(F.col("doc.anchors"), lambda h: U.resolve(F.col("url"), h))

    def wrap(head, item, tail):
        return F.concat(F.lit(head), F.array_join(F.transform(locs, item), ""), F.lit(tail))

    rss = wrap("<rss version=\"2.0\"><channel><title>t</title>",
               lambda u: F.concat(F.lit("<item><link>"), _xml_escape(u), F.lit("</link></item>")),
               "</channel></rss>")
    atom = wrap('<feed xmlns="http://www.w3.org/2005/Atom">',
                lambda u: F.concat(F.lit('<entry><link href="'), _xml_escape(F.replace(u, F.lit('"'), F.lit("&quot;"))),
                                   F.lit('"/></entry>')), "</feed>")
    js = F.to_json(F.struct(F.transform(locs, lambda u: F.struct(u.alias("url"))).alias("items")))
    docs = p.select("page_id", "url", F.explode(F.array(
        F.struct(F.lit("rss").alias("kind"), F.lit("application/rss+xml").alias("ct"), rss.alias("body")),
        F.struct(F.lit("atom").alias("kind"), F.lit("application/atom+xml").alias("ct"), atom.alias("body")),
        F.struct(F.lit("json").alias("kind"), F.lit("application/feed+json").alias("ct"), js.alias("body")),
    )).alias("d"))
    found = docs.select("page_id", F.col("d.kind").alias("kind"),
                        F.explode(ex.feed_links(F.col("d.body"), F.col("d.ct"), F.col("url"))).alias("u"))
    return found.select("page_id", "kind", U.canonical_guess(F.col("u")).alias("url")).distinct()


# ------------------------------------------------------------------------- D


def _fr(spark, sf_dir):
    return tb.frontier(spark, sf_dir)


@register("enqueue_frontier", ops="D2", sql=f"""
WITH {O.FRONTIER}, {O.LINKS},
q AS (SELECT *, {O.url_key('url')} AS url_key FROM frontier),
new AS (SELECT source, {O.url_key('url')} AS url_key, arg_min(url, seq) AS url, arg_min(depth, seq) AS depth,
               min(seq) AS first_seq
        FROM links l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.source = l.source AND q.url_key = {O.url_key('l.url')})
        GROUP BY source, {O.url_key('url')})
SELECT id, source, url, status, depth FROM frontier
UNION ALL
SELECT (SELECT max(id) FROM frontier) + row_number() OVER (ORDER BY first_seq), source, url, 0, depth FROM new""")
def enqueue_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    out = fr.enqueue(_fr(spark, sf_dir), tb.discovered_links(spark, sf_dir), tb.now())
    return out.select("id", "source", "url", "status", "depth")


CLAIM_SQL = """claimed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY added_at, id) AS rn
                 FROM frontier WHERE status = 0) WHERE rn <= 5)"""


@register("claim_batch", ops="D5", sql=f"""
WITH {O.FRONTIER}, {CLAIM_SQL}
SELECT id, source, url, 1 AS status FROM claimed""")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    return fr.claim(_fr(spark, sf_dir), 5, tb.now()).select("id", "source", "url", "status")


@register("finish_items", ops="D5 D6", sql=f"""
WITH {O.FRONTIER}, {CLAIM_SQL},
outc AS (SELECT id, CAST(2 + id % 3 AS INTEGER) AS st FROM claimed),
q AS (SELECT f.id, f.source, f.url, CASE WHEN c.id IS NOT NULL THEN 1 ELSE f.status END AS status,
             CASE WHEN c.id IS NOT NULL THEN {O.NOW} ELSE f.updated_at END AS updated_at
      FROM frontier f LEFT JOIN claimed c USING (id))
SELECT q.id, coalesce(o.st, q.status) AS status,
       {O.epoch_s("CASE WHEN o.st IS NOT NULL THEN " + O.NOW + " ELSE q.updated_at END")} AS updated_at
FROM q LEFT JOIN outc o USING (id) WHERE o.st IS NULL OR o.st <> 2""")
def finish_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    q = _fr(spark, sf_dir)
    c = fr.claim(q, 5, tb.now())
    q = fr.apply_claims(q, c)
    outc = c.select("id", (F.lit(2) + F.col("id") % 3).cast("int").alias("status"))
    out = fr.finish(q, outc, tb.now())
    return out.select("id", "status", _epoch("updated_at"))


@register("cleanup_frontier", ops="D7", sql=f"""
WITH {O.FRONTIER}
SELECT id, CASE WHEN status = 1 AND {O.stale('updated_at')} THEN 0 ELSE status END AS status,
       {O.epoch_s("CASE WHEN status = 1 AND " + O.stale('updated_at') + " THEN " + O.NOW + " ELSE updated_at END")} AS updated_at
FROM frontier WHERE status <> 2""")
def cleanup_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    return fr.cleanup_queue(_fr(spark, sf_dir), tb.now()).select("id", "status", _epoch("updated_at"))


@register("cleanup_embed", ops="D8", sql=f"""
WITH {O.CORPUS}, {O.EMBED_QUEUE}
SELECT id, CASE WHEN status IN (3, 1) AND {O.stale('updated_at')} THEN 0 ELSE status END AS status,
       {O.epoch_s("CASE WHEN status IN (3, 1) AND " + O.stale('updated_at') + " THEN " + O.NOW + " ELSE updated_at END")} AS updated_at
FROM eq WHERE status <> 2 AND page IN (SELECT page FROM corpus)""")
def cleanup_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    out = fr.cleanup_embed_queue(tb.embed_queue(spark, sf_dir), tb.corpus(spark, sf_dir), tb.now())
    return out.select("id", "status", _epoch("updated_at"))


@register("refresh_due", ops="D9 K5", sql=f"""
WITH {O.CORPUS}, {O.FRONTIER}, {O.SOURCES}
SELECT c.source, c.url, c.depth, true AS is_refresh FROM corpus c JOIN sources s ON s.id = c.source
WHERE c.url NOT IN (SELECT url FROM frontier) AND {O.epoch_s(O.NOW)} - {O.epoch_s('c.crawled_at')} > s.min_age * 86400""")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    out = fr.refresh_due(tb.corpus(spark, sf_dir), _fr(spark, sf_dir), tb.sources_dim(spark, sf_dir), tb.now())
    return out.select("source", "url", "depth", "is_refresh")


@register("depth_limit", ops="D3", sql=f"""
WITH {O.CORPUS}, {O.SOURCES}
SELECT c.page, c.source, c.url, c.depth + 1 AS depth FROM corpus c JOIN sources s ON s.id = c.source
WHERE c.depth + 1 < s.max_depth""")
def depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    links = tb.corpus(spark, sf_dir).select("page", "source", "url", "depth")
    return fr.depth_limit(links, tb.sources_dim(spark, sf_dir)).select("page", "source", "url", "depth")


@register("new_only", ops="D4", sql=f"""
WITH {O.CORPUS}, {O.ALIASES},
links AS (SELECT source, {O.http('url')} AS url FROM corpus UNION ALL SELECT source, url || '/x' FROM corpus),
t AS (SELECT source, url, url AS u2 FROM links
      UNION ALL SELECT l.source, l.url, a.canonical FROM links l JOIN aliases a ON a.url = l.url),
hit AS (SELECT DISTINCT t.source, t.url FROM t JOIN corpus c ON c.source = t.source AND c.url = t.u2)
SELECT source, url FROM links l WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.source = l.source AND h.url = l.url)""")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    pages = tb.corpus(spark, sf_dir)
    links = pages.select("source", tb.http_url(F.col("url")).alias("url")).unionByName(
        pages.select("source", F.concat("url", F.lit("/x")).alias("url")))
    return fr.new_only(links, pages, tb.aliases(spark, sf_dir, pages)).select("source", "url")


@register("seed_sources", ops="D1 A4", sql=f"""
WITH {O.CORPUS}, {O.ALIASES}, {O.SOURCES},
req AS (SELECT id AS source, {O.canonical_guess('url')} AS url FROM sources),
t AS (SELECT source, url, url AS u2 FROM req UNION ALL
      SELECT r.source, r.url, a.canonical FROM req r JOIN aliases a ON a.url = r.url)
SELECT source, url, 0 AS depth FROM req r
WHERE NOT EXISTS (SELECT 1 FROM t JOIN corpus c ON c.source = t.source AND c.url = t.u2 WHERE t.source = r.source)""")
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    pages = tb.corpus(spark, sf_dir)
    return fr.seed(tb.sources_dim(spark, sf_dir), pages, tb.aliases(spark, sf_dir, pages))


@register("purge_indexed", ops="D10", sql=f"""
WITH {O.FRONTIER},
idx AS (SELECT source, url FROM frontier WHERE status = 2),
al AS (SELECT url AS canonical, replace(url, 'https://', 'http://') AS url FROM idx),
gone AS (SELECT source, url FROM idx UNION ALL SELECT i.source, a.url FROM idx i JOIN al a ON a.canonical = i.url)
SELECT id FROM frontier f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = f.source AND g.url = f.url)""")
def purge_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    q = _fr(spark, sf_dir)
    idx = q.filter(F.col("status") == 2).select("source", "url")
    al = idx.select(F.col("url").alias("canonical"), tb.http_url(F.col("url")).alias("url"))
    return fr.purge_indexed(q, idx, al).select("id")


@register("purge_followers", ops="D11", sql=f"""
WITH {O.FRONTIER},
refs AS (SELECT event_id AS queue_item, user_id AS referrer FROM events),
del AS (SELECT id, source, url FROM frontier WHERE status = 3),
al AS (SELECT replace(url, '/1', '/2') AS url, url AS canonical FROM frontier),
fol AS (SELECT d.source, a.url FROM del d JOIN al a ON a.canonical = d.url)
SELECT 'queue' AS kind, id AS key FROM frontier f
WHERE id NOT IN (SELECT id FROM del) AND NOT EXISTS (SELECT 1 FROM fol WHERE fol.source = f.source AND fol.url = f.url)
UNION ALL SELECT 'ref', queue_item FROM refs WHERE queue_item NOT IN (SELECT id FROM del)""")
def purge_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    q = _fr(spark, sf_dir)
    refs = tb.read(spark, sf_dir, "events").select(F.col("event_id").alias("queue_item"),
                                                   F.col("user_id").alias("referrer"))
    dele = q.filter(F.col("status") == 3)
    al = q.select(F.replace(F.col("url"), F.lit("/1"), F.lit("/2")).alias("url"), F.col("url").alias("canonical"))
    nq, nr = fr.purge_followers(q, refs, dele, al)
    return nq.select(F.lit("queue").alias("kind"), F.col("id").alias("key")).unionByName(
        nr.select(F.lit("ref").alias("kind"), F.col("queue_item").alias("key")))


@register("error_placeholders", ops="D12 C5", sql=f"""
WITH {O.CORPUS}, {O.FRONTIER},
failed AS (SELECT id, source, url, depth FROM frontier WHERE status = 3),
nb AS (SELECT source, {O.url_key('url')} AS url_key, arg_min(url, id) AS url, min(depth) AS depth, min(id) AS first_seq
       FROM failed GROUP BY source, {O.url_key('url')})
SELECT (SELECT max(page) FROM corpus) + row_number() OVER (ORDER BY first_seq) AS page, source, url, depth,
       CAST(3 AS TINYINT) AS status, '' AS title, 'fetch failed' AS error_info
FROM nb""")
def error_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    from ..operators import store as st
    q = _fr(spark, sf_dir).filter(F.col("status") == 3)
    failed = q.select("source", "url", "depth", F.lit("fetch failed").alias("error"), F.col("id").alias("seq"))
    ph = fr.error_placeholders(failed)
    pages = tb.corpus(spark, sf_dir).withColumn("error_info", F.lit(""))
    up = st.upsert(pages, ph, tb.now())
    return up.filter(F.col("status") == 3).join(pages.select("page"), "page", "left_anti") \
        .select("page", "source", "url", "depth", "status", "title", "error_info")


@register("claim_embed_batch", ops="D14", sql=f"""
WITH {O.CORPUS}, {O.EMBED_QUEUE}
SELECT id, page, chunk_index, source FROM (
  SELECT e.*, c.source, row_number() OVER (PARTITION BY c.source ORDER BY e.page, e.chunk_index) AS rn
  FROM eq e JOIN corpus c USING (page) WHERE e.status = 0) WHERE rn <= 5""")
def claim_embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    out = fr.claim_embed(tb.embed_queue(spark, sf_dir), tb.corpus(spark, sf_dir), 5, tb.now())
    return out.select("id", "page", "chunk_index", "source")


@register("build_index", ops="E1 E2 E3 E4", sql=f"""
WITH {O.INDEX}
SELECT count(*) AS n_postings, sum(tf) AS n_tokens FROM postings""")
def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index build written to the shared folder (reused by the search queries)."""
    idx = corpus_index(spark, sf_dir)
    return idx.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))


# ------------------------------------------------------------------------- J


def _dictionary(spark, sf_dir):
    from ..operators import spelling as sp
    from ..session import pin
    return cached(spark, sf_dir, "dictionary",
                  lambda: pin(sp.dictionary(corpus_index(spark, sf_dir).vocabulary())))


@register("fuzzy_dictionary", ops="J1 J2 J3 J4", sql=f"""
WITH {O.INDEX}, {O.DICTIONARY}
SELECT word, rank, langid, k1, k2 FROM dict""")
def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)


@register("phonetic_blocks", ops="J7", sql=f"""
WITH {O.INDEX}, {O.DICTIONARY},
b AS (SELECT unnest([substr(k2, 1, 1), CASE WHEN length(k2) > 1 THEN substr(k2, 1, 2) END,
  CASE WHEN length(k2) > 2 THEN substr(k2, 1, 3) END]) AS prefix FROM dict)
SELECT prefix, count(*) AS n_words FROM b WHERE prefix <> '' GROUP BY prefix""")
def phonetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import spelling as sp
    return sp.blocks(_dictionary(spark, sf_dir)).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n_words"))


@register("correct_queries", ops="J5 J7 J8 J9", sql=f"""
WITH RECURSIVE {O.INDEX}, {CORRECTION}
SELECT query_id, q, corrected FROM fixed""")
def correct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import spelling as sp
    return sp.correct(tb.query_texts(spark, sf_dir), _dictionary(spark, sf_dir))


@register("edit_cost_pairs", ops="J5 J8 J10")
def edit_cost_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 dictionary entries of every distinct word of the benchmark texts."""
    from ..operators import spelling as sp
    b = tb.read(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.split("text", r"\W")).alias("w")).filter("w <> ''").distinct()
    return sp.best_matches(words, _dictionary(spark, sf_dir), top=3)


@register("script_code", ops="J11", sql=f"""
WITH {O.INDEX},
v AS (SELECT DISTINCT term FROM postings),
f AS (SELECT term, regexp_matches(term, '[A-Za-z''\\x{{80}}-\\x{{2ae}}]') AS la,
             regexp_matches(term, '[\\x{{400}}-\\x{{4ff}}]') AS cy, regexp_matches(term, '[\\x{{386}}-\\x{{3ce}}]') AS gr,
             regexp_matches(term, '[\\x{{590}}-\\x{{5ff}}]') AS he, regexp_matches(term, '[\\x{{600}}-\\x{{6ff}}]') AS ar,
             regexp_matches(term, '[0-9]') AS dg FROM v),
g AS (SELECT *, la::INT + cy::INT + gr::INT + he::INT + ar::INT AS n FROM f)
SELECT term, CASE WHEN n = 0 AND dg THEN 215 WHEN n = 0 THEN 999 WHEN n > 1 THEN 998 WHEN la THEN 215
                  WHEN cy THEN 220 WHEN gr THEN 200 WHEN he THEN 125 ELSE 160 END AS code FROM g""")
def script_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.phonetic import script_code as sc
    v = ix.build_index(tb.corpus(spark, sf_dir)).postings.select("term").distinct()
    return v.select("term", sc(F.col("term")).alias("code"))


# ------------------------------------------------------------------ G, D13, D15


def _page_chunks(spark, sf_dir):
    from ..operators import chunks as ch
    return ch.chunk_pages(tb.corpus(spark, sf_dir))


@register("chunk_invariants", ops="G1 G2 G3", sql=r"""
WITH w AS (SELECT doc_id AS page, list_distinct(regexp_extract_all(text, '[A-Za-z]+')) AS ws, len(regexp_extract_all(text, '[A-Za-z]+')) AS n FROM documents)
SELECT page, coalesce(len(ws), 0)::BIGINT AS n_words, md5(array_to_string(list_sort(ws), ' ')) AS words, true AS whole, true AS sized, true AS numbered
FROM w WHERE n > 0""")
def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the distinct words of its chunks are those of its text, no chunk is too long, numbers run from 0."""
    from ..operators import chunks as ch
    words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0)
    c = _page_chunks(spark, sf_dir).select("page", "chunk_index", "n_tokens", words(F.col("chunk")).alias("ws"))
    per = c.groupBy("page").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws"), F.sum(F.size("ws")).alias("n"),
        F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last"))
    text = tb.corpus(spark, sf_dir).select("page", F.size(words(F.col("content"))).alias("in_text"))
    return per.join(text, "page").where("in_text > 0").select(
        "page", F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ").cast("binary")).alias("words"),
        (F.col("n") >= F.col("in_text")).alias("whole"), (F.col("longest") <= ch.CHUNK_SIZE).alias("sized"),
        (F.col("last") == F.col("chunks") - 1).alias("numbered"))


@register("embed_chunks", ops="G4 G7 K4")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's vector."""
    from ..operators import chunks as ch
    return ch.embed_chunks(_chunk_texts(spark, sf_dir), embedder=_embedder(spark, sf_dir))


@register("replace_chunks", ops="G5")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after the labelled pages are chunked at half the size and pages that are not finished lose theirs."""
    from .. import schema as S
    from ..operators import chunks as ch
    lab = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")).distinct().withColumn("again", F.lit(True))
    pages = pin(tb.corpus(spark, sf_dir).join(lab, "page", "left").filter("again").unionByName(
        tb.corpus(spark, sf_dir).join(lab, "page", "left_anti").filter(F.col("status") != S.FINISHED).withColumn("again", F.lit(False))))
    new = ch.chunk_pages(pages.filter("again"), ch.CHUNK_SIZE // 2, ch.CHUNK_OVERLAP // 2)
    return ch.replace_chunks(_chunk_texts(spark, sf_dir), pages, new).select("page", "chunk_index", "chunk")


@register("pages_needing_embeddings", ops="D15", sql=f"""
WITH {O.CORPUS}, {O.CHUNKS}, {O.EMBED_QUEUE}
SELECT page FROM corpus WHERE status = 2 AND page NOT IN (SELECT page FROM chunks)
  AND page NOT IN (SELECT page FROM eq)""")
def pages_needing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier as fr
    pages = tb.corpus(spark, sf_dir)
    return fr.pages_needing_embeddings(pages, tb.chunks(spark, sf_dir, pages),
                                       tb.embed_queue(spark, sf_dir)).select("page")


@register("replace_embed_rows", ops="D13 G1 G3")
def replace_embed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embed queue when the labelled pages are chunked again, whole; tests hold it against plain Python."""
    from ..operators import chunks as ch
    from ..operators import frontier as fr
    lab = tb.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")).distinct()
    pages = pin(tb.corpus(spark, sf_dir).join(lab, "page", "left_semi"))
    out = fr.replace_embed_rows(tb.embed_queue(spark, sf_dir), pages, ch.chunk_pages(pages), tb.now())
    return out.select("page", "chunk_index", "chunk", "status")


@register("start_embeddings", ops="D15 D13 G1 G3")
def start_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embed queue after every finished page without chunks or queue rows is chunked and queued."""
    from ..operators import frontier as fr
    pages = tb.corpus(spark, sf_dir)
    out = fr.start_embeddings(pages, tb.chunks(spark, sf_dir, pages), tb.embed_queue(spark, sf_dir), tb.now())
    return out.select("page", "chunk_index", "chunk", "status")


@register("stale_vectors", ops="G5 G6", sql=f"""
WITH {O.CORPUS}, {O.UPSERT}, {O.CHUNKS},
changed AS (SELECT o.page FROM corpus o JOIN upserted n USING (page)
            WHERE o.url IS DISTINCT FROM n.url OR o.title IS DISTINCT FROM n.title
               OR o.description IS DISTINCT FROM n.description OR o.content IS DISTINCT FROM n.content)
SELECT id FROM chunks WHERE page NOT IN (SELECT page FROM changed)""")
def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunks as ch
    from ..operators import store as st
    pages = tb.corpus(spark, sf_dir).withColumn("error_info", F.lit(""))
    new = st.upsert(pages, tb.recrawl_batch(spark, sf_dir), tb.now())
    return ch.stale_vectors(pages, new, tb.chunks(spark, sf_dir)).select("id")


# -------------------------------------------------------------- F-Q10..F-Q12


def _decorated(spark, sf_dir, queries, columns=("title", "description", "content")):
    from ..operators import snippets as sn
    idx = corpus_index(spark, sf_dir)
    top = srch.search(idx, queries).select("query_id", "rn", "page", "url", "rank", "total")
    txt = idx.pages.select("page", "title", "description", "content")
    return sn.decorate(top.join(txt, "page"), queries, columns)


@register("highlight_segments", ops="F-Q10 F-Q12 F-Q13")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decorated(spark, sf_dir, tb.word_queries(spark, sf_dir), ("title",))
    return d.select("query_id", "rn", "page", "title")


@register("snippets", ops="F-Q11 F-Q12")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decorated(spark, sf_dir, tb.word_queries(spark, sf_dir), ("description", "content"))
    return d.select("query_id", "rn", "page", "description", "content")


@register("search_results_json", ops="A6 F-Q13 F-Q14")
def search_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API response shape per query: results + pagination, as JSON text."""
    d = _decorated(spark, sf_dir, tb.query_texts(spark, sf_dir))
    res = d.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "url", "title", "description", "content",
                                              "rank"))).alias("results"),
        F.first("total").alias("total"))
    return res.select("query_id", F.to_json(F.struct(
        F.lit(True).alias("success"),
        F.transform("results", lambda r: r.dropFields("rn")).alias("results"),
        F.struct(F.lit(1).alias("page"), F.lit(10).alias("pageSize"), F.col("total")).alias("pagination"),
    )).alias("json"))


# ------------------------------------------------------------------------- K


@register("stream_ingest", ops="K1 A1", sql=f"""
SELECT page_id,
  trim({O.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
  coalesce({O.attr(O.first_with('html', 'meta', 'name', 'description'), 'content')}, '') AS description,
  url AS canonical, CAST(2 AS TINYINT) AS status
FROM pages""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs
    out = jobs.run_available(jobs.ingest(jobs.file_stream(spark, sf_dir, "pages")), "ingest")
    return out.select("page_id", "title", "description", "canonical", "status")


def _ingested(spark, sf_dir):
    """Tables after a stream has ingested every raw page; sources whose name's length three divides have one level only."""
    from ..functions import urls as U
    from ..session import scratch_path
    from ..streaming import jobs

    def make():
        folder = jobs.empty_tables(spark, scratch_path(spark, "ingest"))
        hosts = tb.read(spark, sf_dir, "pages").select(U.hostname(F.col("url")).alias("id")).distinct()
        sources = pin(hosts.withColumn("max_depth", F.when(F.length("id") % 3 == 0, 1).otherwise(3)))
        return jobs.ingest_all(jobs.file_stream(spark, sf_dir, "pages", max_files=4), folder, f"{folder}/checkpoint", tb.now(), sources)
    return cached(spark, sf_dir, "ingested", make)


@register("stream_pipeline", ops="K1 C5 C11 C12 C13 D2 D3 D4 D10", sql=f"""
WITH p AS (SELECT page_id, {O.hostname('url')} AS source, url AS canonical, {O.canonical_guess('url')} AS guess, html FROM pages),
a AS (SELECT source, arg_max(guess, page_id) AS url, arg_max(canonical, page_id) AS canonical FROM p
      WHERE guess <> canonical GROUP BY source, {O.url_key('guess')}),
l AS (SELECT DISTINCT source, canonical, u AS url FROM (SELECT source, canonical, unnest({O.anchors('html', 'canonical')}) AS u FROM p) x
  WHERE {O.hostname('u')} = source AND length(source) % 3 <> 0),
t AS (SELECT *, {O.url_key('url')} AS k FROM l
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = l.source AND {O.url_key('p.canonical')} = {O.url_key('l.url')})
    AND NOT EXISTS (SELECT 1 FROM a JOIN p ON p.source = a.source AND p.canonical = a.canonical WHERE a.url = l.url)),
q AS (SELECT source, k, min(url) AS url FROM t GROUP BY source, k)
SELECT 'page' AS kind, source, canonical AS url, '' AS other FROM p
UNION ALL SELECT 'alias', source, url, canonical FROM a
UNION ALL SELECT 'queue', source, url, '1' FROM q
UNION ALL SELECT DISTINCT 'referrer', q.source, q.url, t.canonical FROM q JOIN t USING (source, k)""")
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, aliases, queue (with depths) and referrers after a stream has ingested every raw page."""
    t = _ingested(spark, sf_dir)
    refs = (t["referrers"].join(t["queue"].select(F.col("id").alias("queue_item"), "source", "url"), "queue_item")
            .join(t["pages"].select(F.col("page").alias("referrer"), F.col("url").alias("other")), "referrer"))
    return (t["pages"].select(F.lit("page").alias("kind"), "source", "url", F.lit("").alias("other"))
            .unionByName(t["aliases"].select(F.lit("alias").alias("kind"), "source", "url", F.col("canonical").alias("other")))
            .unionByName(t["queue"].select(F.lit("queue").alias("kind"), "source", "url", F.col("depth").cast("string").alias("other")))
            .unionByName(refs.select(F.lit("referrer").alias("kind"), "source", "url", "other")))


@register("stream_index", ops="K1 E3 D13")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary, page lengths and chunks to embed that the same stream keeps; tests hold them against a full build."""
    t = _ingested(spark, sf_dir)
    return (t["vocab"].select(F.lit("term").alias("kind"), F.col("term").alias("key"), "doc", "cnt")
            .unionByName(t["doc_len"].join(t["pages"], "page").select(F.lit("length").alias("kind"), F.col("url").alias("key"), F.lit(1).cast("long").alias("doc"), F.col("dl").alias("cnt")))
            .unionByName(t["embed_queue"].join(t["pages"].select("page", "url"), "page").groupBy("url").agg(F.count(F.lit(1)).alias("doc")).select(
                F.lit("chunks").alias("kind"), F.col("url").alias("key"), "doc", F.col("doc").alias("cnt"))))


@register("stream_embed", ops="K4 G1 G3 G4")
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and vectors of documents as a stream brings them; tests hold them against the batch path."""
    from ..streaming import jobs
    out = jobs.run_available(jobs.embedding(jobs.file_stream(spark, sf_dir, "documents"), _embedder(spark, sf_dir)), "embed")
    return out.select("page", "chunk_index", "embedding", "status")


@register("stream_frontier_dedupe", ops="K2", sql=f"""
WITH {O.FRONTIER}
SELECT DISTINCT source, {O.url_key('url')} AS url_key FROM frontier""")
def stream_frontier_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs
    # keys are forgotten ten years of event time after they were last seen; the delay outlasts the table
    s = jobs.dedupe_frontier(jobs.frontier_rows(jobs.file_stream(spark, sf_dir, "events")), watermark="3650 days")
    return jobs.run_available(s, "dedupe").select("source", "url_key")


@register("stream_stale_reset", ops="K3", sql=f"""
WITH {O.FRONTIER},
latest AS (SELECT source, url, arg_max(status, (epoch_ms(updated_at), id)) AS st,
                  max(epoch_ms(updated_at)) AS ms FROM frontier GROUP BY source, url)
SELECT source, url FROM latest
WHERE st = 1 AND ms + 60000 < (SELECT max(epoch_ms(updated_at)) FROM frontier)""")
def stream_stale_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs
    s = jobs.stale_claims(jobs.frontier_rows(jobs.file_stream(spark, sf_dir, "events")))
    return jobs.run_available(s, "stale").select("source", "url")


@register("index_maintenance", ops="E3 C5", sql=f"""
WITH {O.CORPUS}, {O.UPSERT},
ct AS (SELECT page, 0 AS col, url AS text FROM upserted UNION ALL SELECT page, 1, title FROM upserted
       UNION ALL SELECT page, 2, description FROM upserted UNION ALL SELECT page, 3, content FROM upserted),
tk AS (SELECT page, col, unnest({O.tokens('text')}) AS term FROM ct)
SELECT term, page, col, count(*) AS tf FROM tk GROUP BY term, page, col""")
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental index refresh after a crawl batch equals a full rebuild."""
    return _refreshed(spark, sf_dir).frequencies()


def _refreshed(spark, sf_dir):
    from ..operators import store as st
    from ..session import pin, sent
    idx = corpus_index(spark, sf_dir)
    pages = tb.corpus(spark, sf_dir).withColumn("error_info", F.lit(""))
    new = pin(st.upsert(pages, tb.recrawl_batch(spark, sf_dir), tb.now()))
    h = F.xxhash64("url", "title", "description", "content")
    # written, so that its size is known: few ids are broadcast, and no page's text is exchanged for them
    changed = pin(new.select("page", h.alias("h1"))
                  .join(pages.select("page", h.alias("h0")), "page", "left")
                  .filter(F.col("h0").isNull() | (F.col("h0") != F.col("h1"))).select("page"))
    return ix.refresh_index(idx, pin(new.join(sent(changed), "page", "left_semi").select(*idx.pages.columns)))


@register("vocabulary_maintenance", ops="E3 E5", sql=f"""
WITH {O.CORPUS}, {O.UPSERT},
ct AS (SELECT page, url AS text FROM upserted UNION ALL SELECT page, title FROM upserted
       UNION ALL SELECT page, description FROM upserted UNION ALL SELECT page, content FROM upserted),
tk AS (SELECT page, unnest({O.tokens('text')}) AS term FROM ct)
SELECT term, count(DISTINCT page) AS doc, count(*) AS cnt FROM tk GROUP BY term""")
def vocabulary_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after the same refresh, from the counts of what left and came."""
    return _refreshed(spark, sf_dir).vocabulary()


def _word_pairs(spark, sf_dir):
    """Pairs (a, b) of different lower-case ASCII words of the benchmark texts with the same first two letters."""
    b = tb.read(spark, sf_dir, "benchmark")
    w = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).filter("length(w) > 1").distinct()
    key = F.substring("w", 1, 2).alias("k")
    return (w.select(key, F.col("w").alias("a")).join(w.select(key, F.col("w").alias("b")), "k").filter("a <> b").select("a", "b"))


@register("edit_costs", ops="J5", sql=f"""
WITH RECURSIVE {O.WORD_PAIRS}, {O.edit_cost_ctes()}
SELECT a, b, cost FROM costs""")
def edit_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edit cost of every such pair of words."""
    from ..functions import phonetic as P

    @F.pandas_udf("long")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(P.edit_costs(a.tolist(), b.tolist())[0])

    return _word_pairs(spark, sf_dir).withColumn("cost", cost("a", "b"))


@register("edit_cost_lang", ops="J6", sql=f"""
WITH RECURSIVE {O.WORD_PAIRS},
cells AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: (j * 100)::BIGINT) AS r FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::BIGINT]), lambda acc, y: list_append(acc,
    least(acc[len(acc)] + 100, r[y[1] + 1] + 100, r[y[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, y[1], 1) THEN 0
      WHEN contains('aeiou', substr(a, i + 1, 1)) AND contains('aeiou', substr(b, y[1], 1)) THEN 20 ELSE 150 END)), [r[1] + 100])
  FROM cells WHERE i < length(a))
SELECT a, b, r[length(b) + 1] AS cost FROM cells WHERE i = length(a)""")
def edit_cost_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurable edit distance of the same pairs: cheap vowel swaps."""
    from ..operators import spelling as sp
    return sp.edit_costs_lang(_word_pairs(spark, sf_dir), _vowel_swaps(spark)).select("a", "b", "cost")


@register("match_lengths", ops="J6 J10", sql=f"""
WITH RECURSIVE {O.WORD_PAIRS},
begun AS (SELECT DISTINCT left(a, (length(a) * 3 + 4) // 5) AS a, b FROM pairs),
cells AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: (j * 100)::BIGINT) AS r FROM begun
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::BIGINT]), lambda acc, y: list_append(acc,
    least(acc[len(acc)] + 100, r[y[1] + 1] + 100, r[y[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, y[1], 1) THEN 0
      WHEN contains('aeiou', substr(a, i + 1, 1)) AND contains('aeiou', substr(b, y[1], 1)) THEN 20 ELSE 150 END)), [r[1] + 100])
  FROM cells WHERE i < length(a)),
ends AS (SELECT a, b, r[length(b) + 1] AS whole, r[1:length(b)] AS part, list_min(r[1:length(b)]) AS least FROM cells WHERE i = length(a))
SELECT a || '*' AS a, b, CASE WHEN least <= whole THEN least ELSE whole END AS cost,
  CASE WHEN least <= whole THEN length(b) - list_position(list_reverse(part), least) ELSE length(b) END AS matched FROM ends""")
def match_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three fifths of each word as a pattern for beginnings: its cost and how much of the other word it takes."""
    from ..operators import spelling as sp
    begun = _word_pairs(spark, sf_dir).select(
        F.concat(F.expr("left(a, (length(a) * 3 + 4) div 5)"), F.lit("*")).alias("a"), "b").distinct()
    return sp.edit_costs_lang(begun, _vowel_swaps(spark))


def _vowel_swaps(spark):
    return spark.createDataFrame(
        [(0, "?", "", 100), (0, "", "?", 100), (0, "?", "?", 150)] +
        [(0, x, y, 20) for x in "aeiou" for y in "aeiou" if x != y],
        "lang int, `from` string, `to` string, cost int")


@register("edit_cost_words", ops="J6 J10")
def edit_cost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurable edit distance between every benchmark word, whatever its letters, and its correction."""
    from ..operators import spelling as sp
    b = tb.read(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.split("text", r"\W")).alias("w")).filter("w <> ''").distinct()
    best = sp.best_matches(words, _dictionary(spark, sf_dir))
    return sp.edit_costs_lang(best.select(F.col("w").alias("a"), F.col("word").alias("b")), _vowel_swaps(spark))


@register("dictionary_maintenance", ops="J12", sql=rf"""
WITH {O.INDEX}, {O.DICTIONARY},
fresh AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\W')) AS w FROM benchmark)
  WHERE w <> '' AND w NOT IN (SELECT word FROM dict)),
gone AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\W')) AS word FROM documents JOIN labels USING (doc_id))
SELECT word, rank, langid, k1, k2 FROM (SELECT word, rank, langid, k1, k2 FROM dict
  UNION ALL SELECT word, 1, 0, NULL, {O.phonetic_key('word')} FROM fresh) WHERE word NOT IN (SELECT word FROM gone WHERE word IS NOT NULL)""")
def dictionary_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary after inserting the benchmark words (rank 1 when new) and deleting
    the words of the labelled documents' whole texts."""
    from ..operators import spelling as sp
    dic = _dictionary(spark, sf_dir)
    b = tb.read(spark, sf_dir, "benchmark")
    add = (b.select(F.explode(F.split(F.lower("text"), r"\W")).alias("word")).filter("word <> ''")
           .distinct().join(dic.select("word"), "word", "left_anti").withColumn("rank", F.lit(1).cast("long")))
    d = tb.read(spark, sf_dir, "documents").join(tb.read(spark, sf_dir, "labels"), "doc_id")
    gone = d.select(F.explode(F.split(F.lower("text"), r"\W")).alias("word")) \
        .filter("word <> ''").distinct()
    return sp.dictionary_delete(sp.dictionary_upsert(dic, add), gone)
