"""Document store, URL aliases and the link graph (C1, C3-C14) as set operations.

Tables (all DataFrames, merged batch-wise, never mutated in place):

- pages   (page, source, url, title, description, content, depth, status, crawled_at, ...)
- aliases (source, url, canonical, crawled_at)
- edges   (src, dest)  page ids

Two URL equalities coexist: the unique key is ASCII case-insensitive
(``url_key``), while lookups compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import pin


def canonicalize(df: DataFrame, aliases: DataFrame, url_col: str = "url",
                 source_col: str = "source", out: str = "canonical") -> DataFrame:
    """A known alias for (source, exact url) wins; else the guessed form."""
    a = aliases.select(F.col("source").alias("_a_src"), F.col("url").alias("_a_url"),
                       F.col("canonical").alias("_a_can"))
    j = df.join(a, (F.col(source_col) == F.col("_a_src")) & (F.col(url_col) == F.col("_a_url")),
                "left")
    return j.withColumn(out, F.coalesce(F.col("_a_can"), U.canonical_guess(F.col(url_col)))) \
        .drop("_a_src", "_a_url", "_a_can")


def domain_filter(links: DataFrame, sources: DataFrame, url_col: str = "url") -> DataFrame:
    """Keep links whose hostname is an allowed domain of their source.

    ``sources`` is the source dimension (id, allowed_domains); it is exploded to
    (source, domain) pairs and equi-joined, so no array scan per row is needed.
    """
    allowed = sources.select(F.col("id").alias("source"),
                             F.explode("allowed_domains").alias("_host"))
    return (links.withColumn("_host", U.hostname(F.col(url_col)))
            .join(allowed, ["source", "_host"], "left_semi").drop("_host"))


def lookup(requests: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Page of each request (req_id, source, url): ``url = x`` or url is the
    canonical of an alias row with url x (alias rows of *any* source)."""
    via = (requests.join(aliases.select(F.col("url").alias("url"),
                                        F.col("canonical").alias("_target")), "url")
           .select("req_id", "source", F.col("_target").alias("url")))
    targets = requests.select("req_id", "source", "url").unionByName(via)
    return (targets.join(pages, ["source", "url"])
            .dropDuplicates(["req_id", "page"]))


def exists(requests: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """C3 exists: requests with a flag ``indexed``."""
    hit = lookup(requests, pages, aliases).select("req_id").distinct().withColumn("indexed", F.lit(True))
    return requests.join(hit, "req_id", "left").withColumn(
        "indexed", F.coalesce(F.col("indexed"), F.lit(False)))


def dense_number(df: DataFrame, order: list[str], start: Column, out: str,
                 parts: int | None = None) -> DataFrame:
    """Distributed dense numbering ``start + 1, start + 2, ...`` by ``order`` (unique key).

    Rows are range-partitioned and sorted on the key, tagged with their
    partition and position, and checkpointed so that the tagging is fixed;
    each row is then shifted by the row counts of earlier partitions (a table
    with one row per partition). No task ever sees more than its partition.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # pin the partition assignment: range bounds come from sampling, and a
    # recomputation could place rows differently in the two branches below
    d = pin(d)
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offs = counts.select("_pid", "_m0", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offs), "_pid")
            .withColumn(out, start + F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
            .drop("_pid", "_mid", "_m0", "_off"))


def upsert(pages: DataFrame, batch: DataFrame, now: Column, after: Column | None = None) -> DataFrame:
    """Merge a batch of crawl results into pages.

    batch: (source, url, depth, status, title, description, content, error_info, seq)
    where ``seq`` orders arrivals. On a (source, url_key) conflict the page id
    and stored url are kept, depth is the minimum over old and new, every
    other field comes from the last arrival and crawled_at becomes ``now``.
    New keys get ids after the current maximum (``after``, where pages is only a
    part of the table), in order of first arrival.
    """
    key = ["source", "url_key"]
    b = batch.withColumn("url_key", U.url_key(F.col("url")))
    last = F.max_by(F.struct("url", "status", "title", "description", "content", "error_info"),
                    F.col("seq"))
    merged_b = b.groupBy(*key).agg(
        last.alias("last"), F.min("depth").alias("b_depth"),
        F.min_by("url", F.col("seq")).alias("first_url"), F.min("seq").alias("first_seq"))
    old = pages.withColumn("url_key", U.url_key(F.col("url")))
    # only pages whose key is in the batch take part in the merge; the rest pass
    # through a semi/anti join against the batch keys (written, so that their size is
    # known and a small batch is broadcast), so the page table itself is never shuffled
    # for a crawl batch. The merge is written once for its new and its kept rows
    bkeys = pin(b.select(*key).distinct())
    untouched = old.join(bkeys, key, "left_anti").drop("url_key")
    touched = old.join(bkeys, key, "left_semi")
    j = pin(touched.join(merged_b, key, "full_outer"))
    max_id = pages.select(F.max("page")).scalar() if after is None else after
    is_new = F.col("page").isNull()
    fresh = j.filter(is_new).select(*merged_b.columns)
    fresh = (dense_number(fresh, ["first_seq"], F.coalesce(max_id, F.lit(-1)), "page")
             .select("page", F.col("source"), F.col("first_url").alias("url"),
                     F.col("b_depth").alias("depth"), F.col("last.status").alias("status"),
                     F.col("last.title").alias("title"),
                     F.col("last.description").alias("description"),
                     F.col("last.content").alias("content"),
                     F.col("last.error_info").alias("error_info"),
                     now.alias("crawled_at")))
    upd = F.col("b_depth").isNotNull()
    kept = j.filter(~is_new).select(
        F.col("page"), F.col("source"), F.col("url"),
        F.when(upd, F.least("depth", "b_depth")).otherwise(F.col("depth")).alias("depth"),
        F.when(upd, F.col("last.status")).otherwise(F.col("status")).alias("status"),
        *[F.when(upd, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c)
          for c in ("title", "description", "content", "error_info")],
        F.when(upd, now).otherwise(F.col("crawled_at")).alias("crawled_at"))
    return untouched.select(*kept.columns).unionByName(kept).unionByName(fresh)


def collapse_aliases(pages: DataFrame, batch: DataFrame, aliases: DataFrame) -> DataFrame:
    """Before inserting page U, drop pages whose url is an alias of U (same source)."""
    doomed = (batch.select("source", F.col("url").alias("canonical"))
              .join(aliases.select("source", "url", "canonical"), ["source", "canonical"])
              .select("source", "url"))
    return pages.join(doomed, ["source", "url"], "left_anti")


# What goes with a page: (table, its columns, the table it depends on, the columns they point to)
DEPENDENTS = [
    ("aliases", ["source", "canonical"], "pages", ["source", "url"]),
    ("edges", ["src"], "pages", ["page"]),
    ("edges", ["dest"], "pages", ["page"]),
    ("referrers", ["referrer"], "pages", ["page"]),
    ("embed_queue", ["page"], "pages", ["page"]),
    ("chunks", ["page"], "pages", ["page"]),
    ("vectors", ["id"], "chunks", ["id"]),
    ("postings", ["page"], "pages", ["page"]),
    ("doc_len", ["page"], "pages", ["page"]),
]


def delete_pages(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The tables without the pages doomed(source, url), exactly as spelled, and without all that depends on them.

    tables: "pages" and any of the tables in DEPENDENTS. The keys of what goes
    are written once for each table that others depend on; every other table
    meets them in an anti join on the columns that point there.
    """
    out = dict(tables)
    gone = {"pages": pin(tables["pages"].join(doomed.select("source", "url").distinct(), ["source", "url"], "left_semi")
                         .select("page", "source", "url"))}
    out["pages"] = tables["pages"].join(gone["pages"].select("page"), "page", "left_anti")
    parents = {parent for *_, parent, _ in DEPENDENTS}
    for name, columns, parent, keys in DEPENDENTS:
        if name not in out or parent not in gone:
            continue
        key = gone[parent].select(*[F.col(k).alias(c) for c, k in zip(columns, keys)]).distinct()
        if name in parents:
            held = tables[name].columns
            points = {k for _, _, p, ks in DEPENDENTS if p == name for k in ks}
            gone[name] = pin(tables[name].join(key, columns, "left_semi").select(*[c for c in held if c in points]))
        out[name] = out[name].join(key, columns, "left_anti")
    return out


def add_edges(edges: DataFrame, new: DataFrame, skip_self: bool = True) -> DataFrame:
    """Insert-or-ignore edges; self edges skipped on the document-insert path."""
    if skip_self:
        new = new.filter(F.col("src") != F.col("dest"))
    return edges.unionByName(new.select("src", "dest")).dropDuplicates(["src", "dest"])


def remove_edges(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Remove listed (src, dest) pairs."""
    return edges.join(doomed.select("src", "dest"), ["src", "dest"], "left_anti")


def remove_outgoing(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Remove every edge leaving the given pages."""
    return edges.join(pages.select(F.col("page").alias("src")), "src", "left_anti")


HUB_EDGES, MAX_HUBS = 100_000, 100_000


def _with_degree(edges: DataFrame, end: str, name: str) -> DataFrame:
    """edges with the number of edges that share their ``end``, in one more column.

    Degrees are counted in partial sums. A hub's edges would all meet its degree
    in one task: hubs, at most MAX_HUBS by the size a hub must have, are a
    broadcast table instead, so their edges stay where they are.
    """
    deg = pin(edges.groupBy(end).agg(F.count(F.lit(1)).alias(name)))
    total = deg.agg(F.sum(name)).first()[0] or 0
    hub = max(HUB_EDGES, total // MAX_HUBS)
    hubs = F.broadcast(deg.filter(F.col(name) > hub))
    return (edges.join(hubs, end, "left_anti").join(deg.filter(F.col(name) <= hub), end)
            .unionByName(edges.join(hubs, end)))


def referrers(edges: DataFrame) -> DataFrame:
    """(page, referrer) pairs with each page's in-degree (no per-page arrays)."""
    return _with_degree(edges.select("src", "dest"), "dest", "n_referrers").select(
        F.col("dest").alias("page"), F.col("src").alias("referrer"), "n_referrers")


def references(edges: DataFrame) -> DataFrame:
    """(page, reference) pairs with each page's out-degree."""
    return _with_degree(edges.select("src", "dest"), "src", "n_references").select(
        F.col("src").alias("page"), F.col("dest").alias("reference"), "n_references")


def by_ids(pages: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Pages by id: a list becomes a filter pushed to the scan, a table (page) a semi join."""
    if isinstance(ids, list):
        return pages.filter(F.col("page").isin(ids))
    return pages.join(ids.select("page"), "page", "left_semi")


def orphans(pages: DataFrame, edges: DataFrame, id_col: str = "page") -> DataFrame:
    """Pages that are never an edge destination (all sources)."""
    return pages.join(edges.select(F.col("dest").alias(id_col)).distinct(), id_col, "left_anti")


def set_aliases(aliases: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """C11: REPLACE per (source, url_key): the latest write wins; rows whose
    canonical equals the requested url are not written. new: (source, url, canonical, seq)."""
    new = new.filter(F.col("canonical") != F.col("url"))
    k = ["source", "url_key"]
    latest = (new.withColumn("url_key", U.url_key(F.col("url"))).groupBy(*k)
              .agg(F.max_by(F.struct("url", "canonical"), F.col("seq")).alias("w"))
              .select(*k, "w.url", "w.canonical", now.alias("crawled_at")))
    old = aliases.withColumn("url_key", U.url_key(F.col("url")))
    return (old.join(latest.select(*k), k, "left_anti").unionByName(latest)
            .drop("url_key"))


def relink(edges: DataFrame, crawled: DataFrame, links: DataFrame, pages: DataFrame,
           aliases: DataFrame) -> DataFrame:
    """Drop all outgoing edges of crawled pages, then link each allowed
    discovered URL that is an indexed document (self edges kept on this path).

    crawled: (page); links: (page, source, url) discovered on those pages.
    """
    req = links.select(F.col("page").alias("from_page"), "source", "url").withColumn(
        "req_id", F.struct(F.col("from_page").alias("p"), F.col("url").alias("u")))
    found = lookup(req, pages.select("page", "source", "url"), aliases)
    new = found.select(F.col("req_id.p").alias("src"), F.col("page").alias("dest")).distinct()
    return remove_outgoing(edges, crawled).unionByName(new).dropDuplicates(["src", "dest"])


def redirect_alias(requests: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """C14: requests (req_id, source, url, final_url): when the requested url is not
    indexed but the final one is, only an alias is recorded (insert skipped)."""
    orig = exists(requests.select("req_id", "source", "url"), pages, aliases) \
        .select("req_id", F.col("indexed").alias("orig_indexed"))
    fin = exists(requests.select("req_id", "source", F.col("final_url").alias("url")), pages,
                 aliases).select("req_id", F.col("indexed").alias("final_indexed"))
    r = requests.join(orig, "req_id").join(fin, "req_id")
    return r.withColumn("alias_only", ~F.col("orig_indexed") & F.col("final_indexed"))


def apply_redirects(requests: DataFrame, pages: DataFrame, aliases: DataFrame, batch: DataFrame,
                    now: Column) -> tuple[DataFrame, DataFrame]:
    """C14 in effect: (aliases, batch to insert). A requested url that redirects to an indexed page
    is written as its alias, and the page fetched for it is not inserted again.

    batch: (req_id, ...) the fetched pages.
    """
    r = redirect_alias(requests, pages, aliases).filter("alias_only")
    writes = r.select("source", "url", F.col("final_url").alias("canonical"), F.xxhash64("req_id").alias("seq"))
    return set_aliases(aliases, writes, now), batch.join(r.select("req_id"), "req_id", "left_anti")
