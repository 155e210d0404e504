"""Store, link graph and frontier as DataFrame merges: several arrivals in a batch, case-folded keys, whole cascades, hubs."""
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks as ch
from quarry.operators import frontier as fr
from quarry.operators import index as ix
from quarry.operators import store as st

PAGES = ("page long, source string, url string, title string, description string, content string, "
         "depth int, status tinyint, crawled_at timestamp, error_info string")
BATCH = "source string, url string, depth int, status tinyint, title string, description string, content string, error_info string, seq long"


def now():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


def shelf(spark):
    rows = [(i, f"lib{i % 2}", f"https://lib{i % 2}.test/shelf/{i}", f"Shelf {i}", "", f"books about topic{i}", i, 2, None, "") for i in range(6)]
    return spark.createDataFrame(rows, PAGES)


def test_several_arrivals_of_a_key_in_one_batch(spark):
    batch = spark.createDataFrame([
        ("lib1", "HTTPS://LIB1.test/shelf/1", 4, 2, "second", "", "b", "", 20),
        ("lib1", "https://lib1.test/Shelf/1", 9, 2, "first", "", "a", "", 10),
        ("lib0", "https://lib0.test/new", 3, 2, "n1", "", "x", "", 11),
        ("lib0", "https://lib0.test/NEW", 1, 3, "n2", "", "y", "gone", 12),
        ("lib1", "https://lib0.test/new", 2, 2, "other source", "", "z", "", 5)], BATCH)
    out = {r.page: r for r in st.upsert(shelf(spark), batch, now()).collect()}
    assert len(out) == 8 and set(out) == set(range(8))
    old = out[1]
    assert (old.url, old.title, old.depth, old.content) == ("https://lib1.test/shelf/1", "second", 1, "b")
    assert (out[6].source, out[6].title) == ("lib1", "other source")  # ids in order of first arrival
    assert (out[7].url, out[7].title, out[7].status, out[7].depth, out[7].error_info) == ("https://lib0.test/new", "n2", 3, 1, "gone")
    assert out[2].crawled_at is None and out[7].crawled_at is not None
    part = st.upsert(shelf(spark).filter("page < 2"), batch, now(), F.lit(40))
    assert {r.page for r in part.collect()} == {0, 1, 41, 42}


def test_a_deleted_page_takes_everything_with_it(spark):
    pages = shelf(spark)
    text = ch.chunk_pages(pages).withColumn("id", F.col("page") * 2)
    idx = ix.build_index(pages)
    tables = {
        "pages": pages, "chunks": text, "vectors": text.select("id", F.array(F.lit(1.0)).alias("embedding")),
        "aliases": spark.createDataFrame([("lib0", "http://a", "https://lib0.test/shelf/2"), ("lib1", "http://a", "https://lib0.test/shelf/2"),
                                          ("lib0", "http://b", "https://lib0.test/shelf/4")], "source string, url string, canonical string"),
        "edges": spark.createDataFrame([(2, 4), (4, 2), (4, 0), (0, 0)], "src long, dest long"),
        "referrers": spark.createDataFrame([(70, 2), (70, 4), (71, 2)], "queue_item long, referrer long"),
        "embed_queue": spark.createDataFrame([(1, 2), (2, 3)], "id long, page long"),
        "postings": idx.postings, "doc_len": idx.doc_len}
    doomed = spark.createDataFrame([("lib0", "https://lib0.test/shelf/2"), ("lib0", "https://lib0.test/shelf/1"),
                                    ("lib0", "https://LIB0.test/shelf/4")], "source string, url string")
    out = st.delete_pages(tables, doomed)
    ids = lambda name, c: sorted({r[0] for r in out[name].select(c).collect()})
    assert ids("pages", "page") == ids("chunks", "page") == ids("doc_len", "page") == ids("postings", "page") == [0, 1, 3, 4, 5]
    assert ids("vectors", "id") == [0, 2, 6, 8, 10] and ids("embed_queue", "page") == [3]
    assert sorted(map(tuple, out["edges"].select("src", "dest").collect())) == [(0, 0), (4, 0)]
    assert sorted(map(tuple, out["referrers"].select("queue_item", "referrer").collect())) == [(70, 4)]
    assert {(r.source, r.url) for r in out["aliases"].collect()} == {("lib1", "http://a"), ("lib0", "http://b")}
    assert out["aliases"].columns and set(out["postings"].columns) == set(idx.postings.columns)
    few = st.delete_pages({"pages": pages}, doomed.limit(0))
    assert few["pages"].count() == 6


def test_lookup_follows_aliases_of_any_source(spark):
    pages = shelf(spark)
    aliases = spark.createDataFrame([("lib1", "http://old", "https://lib0.test/shelf/4", None)],
                                    "source string, url string, canonical string, crawled_at timestamp")
    req = spark.createDataFrame([(1, "lib0", "http://old"), (2, "lib1", "http://old"), (3, "lib0", "https://LIB0.test/shelf/4")],
                                "req_id long, source string, url string")
    assert {(r.req_id, r.page) for r in st.lookup(req, pages, aliases).collect()} == {(1, 4)}
    assert {r.req_id: r.indexed for r in st.exists(req, pages, aliases).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("hub", [50, 100_000])
def test_degrees_with_a_hub(spark, monkeypatch, hub):
    """A hub's edges are neither shuffled to one task nor lost; pages without an edge have no row."""
    monkeypatch.setattr(st, "HUB_EDGES", hub)
    edges = spark.range(0, 120_000).select(F.col("id").alias("src"), F.lit(7).cast("long").alias("dest")).unionByName(
        spark.createDataFrame([(1, 2), (3, 2), (2, 1)], "src long, dest long"))
    got = st.referrers(edges)
    assert got.count() == 120_003
    assert {(r.page, r.n_referrers) for r in got.select("page", "n_referrers").distinct().collect()} == {(7, 120_000), (2, 2), (1, 1)}
    out = st.references(edges).filter("page <= 3")
    assert sorted(map(tuple, out.collect())) == [(0, 7, 1), (1, 2, 2), (1, 7, 2), (2, 1, 2), (2, 7, 2), (3, 2, 2), (3, 7, 2)]
    lone = spark.createDataFrame([(2,), (7,), (9,)], "page long")
    assert [r.page for r in st.orphans(lone, edges).collect()] == [9]


QUEUE = "id long, source string, url string, status int, depth int, added_at timestamp, updated_at timestamp"


def queue(spark):
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame([(i, "ab"[i % 2], f"https://q/{i}", 0 if i < 6 else 2, 1, at(9 - i), at(0)) for i in range(8)], QUEUE)


def test_claims_take_the_oldest_of_each_source_once(spark):
    q = queue(spark)
    first = fr.claim(q, 2, now())
    assert {(r.source, r.id) for r in first.collect()} == {("a", 4), ("a", 2), ("b", 5), ("b", 3)}
    after = fr.apply_claims(q, first)
    assert {r.id for r in fr.claim(after, 2, now()).collect()} == {0, 1} and after.count() == 8
    per = spark.createDataFrame([("a", 1)], "source string, n int")
    assert [r.id for r in fr.claim(q, per, now()).collect()] == [4]


def test_refresh_waits_for_the_queue_of_any_source(spark):
    pages = shelf(spark).withColumn("crawled_at", F.to_timestamp(F.lit("2024-02-29 23:59:58")))
    none = spark.createDataFrame([], "id long, source string, url string")
    assert fr.refresh_due(pages, none, 0, now()).count() == 6
    held = spark.createDataFrame([(1, "elsewhere", "https://lib0.test/shelf/2")], "id long, source string, url string")
    due = fr.refresh_due(pages, held, 0, now()).collect()
    assert len(due) == 5 and all(r.is_refresh and r.url != "https://lib0.test/shelf/2" for r in due)
    assert fr.refresh_due(pages, none, 1, now()).count() == 0


def test_queued_links_keep_their_first_spelling(spark):
    links = spark.createDataFrame([("a", "https://Q/2", 7, 1), ("a", "https://q/new", 2, 9), ("a", "https://q/NEW", 5, 3), ("b", "https://q/2", 1, 4)],
                                  "source string, url string, depth int, seq long")
    out = {(r.source, r.url): r for r in fr.enqueue(queue(spark), links, now()).collect()}
    assert len(out) == 10 and out["a", "https://q/2"].depth == 1
    assert out["a", "https://q/NEW"].id == 8 and out["a", "https://q/NEW"].depth == 5 and out["b", "https://q/2"].id == 9


def test_pages_without_text_leave_the_embed_queue(spark):
    """Whole texts chunked; a page with no chunk any more keeps no row."""
    eq = spark.createDataFrame([(1, 0, "old", 2), (1, 1, "old", 2), (2, 0, "old", 0), (9, 0, "kept", 0)], "page long, chunk_index int, chunk string, status int")
    long = " ".join(f"w{i}" for i in range(900))
    pages = spark.createDataFrame([(1, long, 2), (2, " \n ", 2), (3, "never embedded", 2), (4, "unfinished", 3)], "page long, content string, status int")
    got = sorted(map(tuple, fr.replace_embed_rows(eq, pages.filter("page < 3"), ch.chunk_pages(pages.filter("page < 3")), now())
                     .select("page", "chunk_index", "chunk", "status").collect()))
    want = [(1, i, c, 0) for i, c in enumerate(ch.split_text(long))] + [(9, 0, "kept", 0)]
    assert got == want and len(want) > 5
    chunks = spark.createDataFrame([(1,)], "page long")
    started = fr.start_embeddings(pages, chunks, eq, now()).filter("page in (3, 4)").collect()
    assert [(r.page, r.chunk_index, r.chunk, r.status) for r in started] == [(3, 0, "never embedded", 0)]


def test_a_small_batch_moves_no_page_of_the_table(spark):
    batch = spark.createDataFrame([("lib1", "https://LIB1.test/shelf/1", 4, 2, "t", "", "b", "", 20), ("lib0", "https://lib0.test/x", 1, 2, "u", "", "c", "", 21),
                                   (None, "https://lib0.test/x", 1, 2, "v", "", "d", "", 22)], BATCH)
    out = st.upsert(shelf(spark), batch, now())
    assert "hashpartitioning(source" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page, r.source, r.title) for r in out.collect() if r.title in "tuv") == [(1, "lib1", "t"), (6, "lib0", "u"), (7, None, "v")]
