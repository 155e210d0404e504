"""Streams over tables stored as a folder of part files read the same rows as over a single file."""
import numpy as np
import pytest

from conftest import SF
from quarry.plans import queries  # noqa: F401  (registers queries)
from quarry.plans.registry import REGISTRY
from quarry.streaming import jobs


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    for name in ("pages", "documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", ["stream_ingest", "stream_pipeline", "stream_frontier_dedupe", "stream_stale_reset"])
def test_a_folder_of_part_files_streams_whole(spark, folders, name):
    rows = lambda at: sorted(map(str, REGISTRY[name].build(spark, at).collect()))
    got = rows(folders)
    assert got == rows(SF)
    assert got or name == "stream_stale_reset"


def test_streamed_vectors_equal_the_batch(spark, folders):
    streamed = {(r.page, r.chunk_index): r.embedding for r in REGISTRY["stream_embed"].build(spark, folders).collect()}
    batch = {(r.page, r.chunk_index): r.embedding for r in REGISTRY["embed_chunks"].build(spark, folders).collect()}
    assert streamed.keys() == batch.keys() and len(streamed) > 200
    for k in batch:
        assert np.allclose(streamed[k], batch[k], atol=1e-6) and abs(np.linalg.norm(batch[k]) - 1) < 1e-5


def test_partition_folders_keep_their_column(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(9)], "doc_id long, text string, lang string")
    df.write.partitionBy("lang").parquet(str(tmp_path / "documents.parquet"))
    got = jobs.run_available(jobs.file_stream(spark, str(tmp_path), "documents"), "parts").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [tuple(r) for r in df.collect()]


def test_ingest_in_batches_equals_a_full_build(spark, folders, tmp_path, monkeypatch):
    """Index, chunks and edges kept batch by batch, a batch run twice among them, equal those of all pages at once."""
    from pyspark.sql import functions as F

    from quarry.functions import urls as U
    from quarry.operators import chunks as ch
    from quarry.operators import index as ix
    from quarry.sources import tables as tb
    folder = jobs.empty_tables(spark, str(tmp_path / "t"))
    run = jobs.ingest_batch(folder, tb.now())
    raw = spark.read.parquet(f"{folders}/pages.parquet")
    # a page at another one's former address goes when that one comes later: leave such pages out
    guess = raw.select(U.canonical_guess(F.col("url")).alias("guess"), F.col("url").alias("by")).filter("guess <> by")
    raw = raw.join(guess, raw.url == guess.guess, "left_anti")
    for i in range(3):
        run(raw.filter(F.col("page_id") % 3 == i), i)
    sizes = {n: sorted(map(str, jobs.Table(spark, folder, n).read().drop("pos").collect())) for n in jobs.KINDS}
    run(raw.filter("page_id % 3 = 2"), 2)  # a replay changes nothing
    assert {n: sorted(map(str, jobs.Table(spark, folder, n).read().drop("pos").collect())) for n in jobs.KINDS} == sizes
    t = {n: jobs.Table(spark, folder, n).read() for n in jobs.KINDS}
    pages = t["pages"]
    assert pages.count() == raw.count()
    full = ix.build_index(pages)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(t["postings"], "term", "page", "col", "tf", "fw") == rows(full.postings, "term", "page", "col", "tf", "fw")
    assert rows(t["doc_len"], "page", "dl") == rows(full.doc_len, "page", "dl")
    vocab = t["vocab"].groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt"))
    assert rows(vocab, "term", "doc", "cnt") == rows(full.vocabulary(), "term", "doc", "cnt")
    want = ch.chunk_pages(pages.filter("status = 2"))
    assert rows(t["embed_queue"], "page", "chunk_index", "chunk") == rows(want, "page", "chunk_index", "chunk")
    one = str(tmp_path / "one")
    jobs.ingest_batch(jobs.empty_tables(spark, one), tb.now())(raw, 0)
    o = {n: jobs.Table(spark, one, n).read() for n in jobs.KINDS}
    url = lambda p: p.select("page", "url")
    refs = lambda x: rows(x["referrers"].join(x["queue"].select(F.col("id").alias("queue_item"), "url", "depth"), "queue_item").join(
        url(x["pages"]).toDF("referrer", "by"), "referrer"), "url", "by", "depth")
    assert refs(t) == refs(o) and len(refs(o)) > 20
    named = lambda x: rows(x["edges"].join(url(x["pages"]).toDF("src", "a"), "src").join(url(x["pages"]).toDF("dest", "b"), "dest"), "a", "b")
    assert named(t) == named(o)


def test_a_batch_writes_its_own_partitions(spark, folders, tmp_path):
    import glob
    import os

    from quarry.sources import tables as tb
    folder = jobs.empty_tables(spark, str(tmp_path / "t"))
    raw = spark.read.parquet(f"{folders}/pages.parquet")
    jobs.ingest_batch(folder, tb.now())(raw.filter("page_id > 2"), 0)
    stamp = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/pages/part=*")}
    jobs.ingest_batch(folder, tb.now())(raw.filter("page_id <= 2"), 1)
    touched = [f for f in glob.glob(f"{folder}/pages/part=*") if stamp.get(f) != os.path.getmtime(f)]
    assert 1 <= len(touched) <= 3


def test_late_events_reset_nothing_that_is_finished(spark, tmp_path):
    """K3 over several micro-batches: an older Processing event after Finished, a late one that leaves a timer alone."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    schema = "id long, source string, url string, status int, updated_at timestamp"
    batches = [[(1, "done", 1, 0), (2, "stuck", 1, 10), (3, "late", 1, 30)],
               [(4, "done", 2, 50), (5, "late", 0, 5)],   # 'late': an older Pending event must not stop its timer
               [(6, "done", 1, 20)],                      # older than Finished
               [(7, "clock", 2, 400)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n, "s", u, st, t0 + timedelta(seconds=s)) for n, u, st, s in rows], schema)
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        import os
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.url, r.updated_at) for r in jobs.run_available(jobs.stale_claims(stream, "100 seconds"), "late").collect()}
    assert got == {("stuck", t0 + timedelta(seconds=10)), ("late", t0 + timedelta(seconds=30))}


@pytest.mark.parametrize("groups", [1, 3])
def test_items_share_state_rows_and_leave_them_one_by_one(spark, tmp_path, monkeypatch, groups):
    """K3: the items of one group have their own times; null sources are items too."""
    from datetime import datetime, timedelta
    monkeypatch.setattr(jobs, "GROUPS", groups)
    t0 = datetime(2024, 1, 1)
    rows = [(i, None if i % 2 else "s", f"u{i}", i % 3, i) for i in range(30)] + [(99, "s", "last", 1, 75)] + [(50, "s", "u4", 2, 4), (51, "s", "u10", 1, 9)]
    df = spark.createDataFrame([(n, s, u, st, t0 + timedelta(seconds=x)) for n, s, u, st, x in rows],
                               "id long, source string, url string, status int, updated_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.stale_claims(stream), "grouped").collect()
    assert sorted((r.url, r.updated_at) for r in out) == sorted((f"u{i}", t0 + timedelta(seconds=i)) for i in (1, 7, 10, 13))
    assert {r.source for r in out if r.url != "u10"} == {None}
