"""Crawl frontier and embedding queue operators.

queue       (id, source, url, status, depth, added_at, updated_at[, is_refresh])
queue_refs  (queue_item, referrer)
embed_queue (id, page, chunk_index, chunk, status, added_at, updated_at)

Claims are set-based: a micro-batch owns its input, so "pop one row" becomes
"claim the first n rows per source" with a window (Catalyst adds a partial
window-group limit, so only n rows per source and task reach the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import urls as U
from . import chunks as ch
from . import store


def seed(sources: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each source's canonical base URL at depth 0, unless already indexed."""
    req = sources.select(F.col("id").alias("source"),
                         U.canonical_guess(F.col("url")).alias("url")).withColumn(
        "req_id", F.col("source"))
    done = store.lookup(req, pages.select("page", "source", "url"), aliases).select("req_id")
    return (req.join(done, "req_id", "left_anti")
            .select("source", "url", F.lit(0).alias("depth")))


def depth_limit(links: DataFrame, sources: DataFrame) -> DataFrame:
    """D3: links found at depth d are queued at d+1 only when d+1 < max_depth."""
    cfg = sources.select(F.col("id").alias("source"), "max_depth")
    return (links.join(cfg, "source")
            .filter(F.col("depth") + 1 < F.col("max_depth"))
            .withColumn("depth", F.col("depth") + 1).drop("max_depth"))


def new_only(links: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drop URLs already indexed, directly or through an alias."""
    req = links.withColumn("req_id", F.struct("source", "url"))
    hit = store.lookup(req.select("req_id", "source", "url"),
                       pages.select("page", "source", "url"), aliases).select("req_id")
    return req.join(hit, "req_id", "left_anti").drop("req_id")


def enqueue(queue: DataFrame, links: DataFrame, now: Column, after: Column | None = None) -> DataFrame:
    """Insert-or-keep on (source, url_key); an existing row keeps depth and status.

    links: (source, url, depth, seq). New rows take the first arrival's spelling
    and depth, status Pending, ids after the current maximum (``after``, where
    queue is only a part of the table).
    """
    k = ["source", "url_key"]
    q = queue.withColumn("url_key", U.url_key(F.col("url")))
    new = (links.withColumn("url_key", U.url_key(F.col("url")))
           .join(q.select(*k), k, "left_anti")
           .groupBy(*k).agg(F.min_by(F.struct("url", "depth"), F.col("seq")).alias("f"),
                            F.min("seq").alias("first_seq")))
    max_id = queue.select(F.max("id")).scalar() if after is None else after
    new = store.dense_number(new, ["first_seq"], F.coalesce(max_id, F.lit(0)), "id")
    added = new.select("id", "source", "f.url", F.lit(S.PENDING).alias("status"), "f.depth",
                       now.alias("added_at"), now.alias("updated_at"))
    return q.drop("url_key").unionByName(added, allowMissingColumns=True)


def referrer_pairs(queue: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(queue_item, referrer) pairs, one each, of the queued urls that links (source, url, referrer) found."""
    k = ["source", "url_key"]
    q = queue.select("source", U.url_key(F.col("url")).alias("url_key"), F.col("id").alias("queue_item"))
    found = (links.filter("referrer is not null").select("source", U.url_key(F.col("url")).alias("url_key"), "referrer").distinct()
             .join(q, k).select("queue_item", "referrer"))
    return found if known is None else known.select("queue_item", "referrer").unionByName(found).distinct()


def claim_with_referrers(queue: DataFrame, pairs: DataFrame, per_source: DataFrame | int, now: Column) -> DataFrame:
    """Claimed rows, a row for each of their referrers (null where a row has none)."""
    return claim(queue, per_source, now).join(pairs.withColumnRenamed("queue_item", "id"), "id", "left")


def claim(queue: DataFrame, per_source: DataFrame | int, now: Column) -> DataFrame:
    """Per source the oldest Pending rows by (added_at, id) -> Processing.

    ``per_source`` is an int or a (source, n) DataFrame (a source's speed).
    Returns (claimed rows, with status Processing and updated_at = now).
    """
    pend = queue.filter(F.col("status") == S.PENDING)
    w = Window.partitionBy("source").orderBy("added_at", "id")
    ranked = pend.withColumn("_rn", F.row_number().over(w))
    if isinstance(per_source, int):
        picked = ranked.filter(F.col("_rn") <= per_source)
    else:
        picked = ranked.join(per_source.withColumnRenamed("n", "_n"), "source") \
            .filter(F.col("_rn") <= F.col("_n")).drop("_n")
    return picked.drop("_rn").withColumn("status", F.lit(S.PROCESSING)).withColumn(
        "updated_at", now)


def apply_claims(queue: DataFrame, claimed: DataFrame) -> DataFrame:
    """Write claimed rows back over the queue (by id)."""
    return queue.join(claimed.select("id"), "id", "left_anti").unionByName(
        claimed.select(*queue.columns))


def finish(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Outcomes (id, status): Finished rows are deleted, others updated."""
    o = outcomes.select("id", F.col("status").alias("_new"))
    j = queue.join(o, "id", "left")
    j = j.filter(F.col("_new").isNull() | (F.col("_new") != S.FINISHED))
    return j.select(*[
        (F.coalesce(F.col("_new"), F.col("status")).alias("status") if c == "status"
         else F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")).alias(c)
         if c == "updated_at" else F.col(c)) for c in queue.columns])


def _stale(now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(F.col("updated_at"))) > S.STALE_SECONDS


def cleanup_queue(queue: DataFrame, now: Column) -> DataFrame:
    """Drop Finished; Processing older than 60 s -> Pending. Errors stay."""
    q = queue.filter(F.col("status") != S.FINISHED)
    reset = (F.col("status") == S.PROCESSING) & _stale(now)
    return _reset(q, reset, now)


def _reset(q: DataFrame, reset: Column, now: Column) -> DataFrame:
    return q.select(*[F.when(reset, F.lit(S.PENDING)).otherwise(F.col(c)).alias(c) if c == "status"
                      else F.when(reset, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
                      else F.col(c) for c in q.columns])


def cleanup_embed_queue(eq: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Drop Finished; Error or Processing older than 60 s -> Pending; drop rows
    whose page is gone."""
    q = eq.filter(F.col("status") != S.FINISHED)
    reset = F.col("status").isin(S.ERROR, S.PROCESSING) & _stale(now)
    q = _reset(q, reset, now)
    return q.join(pages.select("page"), "page", "left_semi")


def refresh_due(pages: DataFrame, queue: DataFrame, min_age_days: DataFrame | int,
                now: Column) -> DataFrame:
    """Pages older than min_age days (strictly), any status, whose url is in
    no source's queue -> refresh rows with the page's own depth, no referrer."""
    p = pages.join(queue.select("url"), "url", "left_anti")
    if isinstance(min_age_days, int):
        p = p.withColumn("_days", F.lit(min_age_days))
    else:
        p = p.join(min_age_days.select(F.col("id").alias("source"), F.col("min_age").alias("_days")),
                   "source")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("crawled_at"))
    return (p.filter(age > F.col("_days") * 86400)
            .select("source", "url", "depth", F.lit(True).alias("is_refresh")))


def purge_indexed(queue: DataFrame, indexed: DataFrame, aliases: DataFrame,
                  inserted: bool = True) -> DataFrame:
    """Indexing page U removes queue rows (same source) for U, and on insert
    also rows whose url is an alias of U (alias rows of any source)."""
    gone = indexed.select("source", "url")
    if inserted:
        via = (indexed.select("source", F.col("url").alias("canonical"))
               .join(aliases.select("url", "canonical"), "canonical").select("source", "url"))
        gone = gone.unionByName(via)
    return queue.join(gone, ["source", "url"], "left_anti")


def purge_followers(queue: DataFrame, refs: DataFrame, deleted: DataFrame,
                    aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting queue rows also deletes rows of the same source whose url is an
    alias of a deleted url, and the deleted rows' referrer pairs."""
    d = deleted.select("id", "source", "url")
    followers = (d.select("source", F.col("url").alias("canonical"))
                 .join(aliases.select("url", "canonical"), "canonical").select("source", "url"))
    q = (queue.join(d.select("id"), "id", "left_anti")
         .join(followers, ["source", "url"], "left_anti"))
    r = refs.join(d.select(F.col("id").alias("queue_item")), "queue_item", "left_anti")
    return q, r


def error_placeholders(failed: DataFrame) -> DataFrame:
    """Failed crawls become Error pages with empty text (not retried until refresh)."""
    return failed.select("source", "url", "depth", F.lit(S.ERROR).cast("tinyint").alias("status"),
                         F.lit("").alias("title"), F.lit("").alias("description"),
                         F.lit("").alias("content"), F.col("error").alias("error_info"), "seq")


def replace_embed_rows(eq: DataFrame, pages: DataFrame, new_chunks: DataFrame, now: Column) -> DataFrame:
    """Delete all queue rows of each of ``pages`` (page), insert their chunks (page, chunk_index, chunk) as
    Pending. A page that has no chunk any more is left without rows."""
    kept = eq.join(pages.select("page").distinct(), "page", "left_anti")
    add = new_chunks.select("page", "chunk_index", "chunk", F.lit(S.PENDING).alias("status"),
                            now.alias("added_at"), now.alias("updated_at"))
    return kept.unionByName(add, allowMissingColumns=True)


def claim_embed(eq: DataFrame, pages: DataFrame, n: int, now: Column) -> DataFrame:
    """Per source the first n Pending rows by (page, chunk_index) -> Processing."""
    j = eq.filter(F.col("status") == S.PENDING).join(pages.select("page", "source"), "page")
    w = Window.partitionBy("source").orderBy("page", "chunk_index")
    return (j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
            .withColumn("status", F.lit(S.PROCESSING)).withColumn("updated_at", now))


def pages_needing_embeddings(pages: DataFrame, chunks: DataFrame, eq: DataFrame) -> DataFrame:
    """Finished pages present in neither the chunk table nor the embed queue."""
    return (pages.filter(F.col("status") == S.FINISHED)
            .join(chunks.select("page").distinct(), "page", "left_anti")
            .join(eq.select("page").distinct(), "page", "left_anti"))


def start_embeddings(pages: DataFrame, chunks: DataFrame, eq: DataFrame, now: Column, size: int = ch.CHUNK_SIZE,
                     overlap: int = ch.CHUNK_OVERLAP) -> DataFrame:
    """The embed queue with the chunks of every page that needs embeddings: whole text chunked, blanks dropped."""
    need = pages_needing_embeddings(pages, chunks, eq)
    return replace_embed_rows(eq, need, ch.chunk_pages(need, size, overlap), now)
