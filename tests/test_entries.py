"""Entries from query text (F-Q13, H5, H10-H13): correction, one embedding per query, fusion arithmetic, shown text."""
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks as ch
from quarry.operators import hybrid as hy
from quarry.operators import index as ix
from quarry.operators import search as srch
from quarry.operators import spelling as sp
from quarry.operators import vectors as vx

ROWS = [(1, "north", "https://n/1", "Harbour seals", "", "Grey seals rest on the harbour wall.", 2),
        (2, "north", "https://n/2", "Sea birds", "", "Puffins nest above the harbour.", 2),
        (3, "south", "https://s/3", "Mountain goats", "", "Goats climb steep ridges in summer.", 2),
        (4, "south", "https://s/4", "Hidden", "", "Harbour harbour harbour.", 3)]


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame(ROWS, "page long, source string, url string, title string, description string, content string, status tinyint")
    idx = ix.build_index(pages)
    text = ch.chunk_pages(pages)
    vec = ch.embed_chunks(text).select("page", "chunk_index", "embedding")
    chunks = (text.join(vec, ["page", "chunk_index"]).join(pages.select("page", "source", "status"), "page")
              .withColumn("id", F.col("page") * 10 + F.col("chunk_index")).cache())
    return idx, chunks, sp.dictionary(idx.vocabulary())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "harbur sealz"), (2, "steep ridges")], "query_id long, q string")


def test_search_entry_corrects(corpus, queries):
    idx, _, dic = corpus
    got = {(r.query_id, r.page, r.corrected, r.total) for r in srch.search_entry(idx, dic, queries).collect()}
    assert got == {(1, 1, "harbour seals", 1), (2, 3, "steep ridges", 1)}
    assert srch.search_entry(idx, dic, queries, sources=["south"]).select("page").distinct().collect()[0].page == 3


def test_similarity_entry_skips_unfinished_pages(corpus, queries):
    idx, chunks, _ = corpus
    got = vx.similarity_entry(chunks, idx.pages, queries, ch.hashing_embedder, k=2).collect()
    assert {r.page for r in got} <= {1, 2, 3} and all(0 <= r.similarity <= 2 for r in got)
    best = min((r for r in got if r.query_id == 2), key=lambda r: r.similarity)
    assert best.page == 3 and best.chunk == ROWS[2][5]


def test_hybrid_entry_fuses_and_shows(corpus, queries):
    idx, chunks, dic = corpus
    got = hy.hybrid_entry(idx, chunks, dic, queries, ch.hashing_embedder, limit=5).collect()
    for r in got:
        want = (0.5 / (60 + r.vec_rank) if r.vec_rank else 0) + (1 / (60 + r.fts_rank) if r.fts_rank else 0)
        assert abs(r.combined_rank - want) < 1e-12
        shown = "".join(s.content for s in r.title)
        assert shown == next(x[3] for x in ROWS if x[0] == r.page)
    hit = next(r for r in got if (r.query_id, r.page) == (1, 1))
    assert [(s.highlighted, s.content) for s in hit.title] == [(True, "Harbour"), (False, " "), (True, "seals")]
    only = next(r for r in got if r.fts_rank is None)
    assert [(s.highlighted, s.content) for s in only.content] == [(False, next(x[5] for x in ROWS if x[0] == only.page))]


def test_json_entry_shape(spark):
    import __spark_entry__ as E

    from conftest import SF
    rows = E.queries()["search_results_json"](spark, SF).collect()
    for r in rows:
        d = json.loads(r.json)
        assert d["success"] is True and d["pagination"]["page"] == 1 and len(d["results"]) <= 10
        assert all(set(x) == {"url", "title", "description", "content", "rank"} for x in d["results"])
