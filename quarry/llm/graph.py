"""Connected components over links, and components of candidates that share buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps: each step is two joins with
    pre-aggregated minima, so no task holds a component's members; the edge
    list is written to the shared folder after each round (no local
    checkpoint), and the driver sees only a row count and a checksum.
    Null ids and self links are ignored; no links give no rows.
    """
    e = C.pin(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
            .where("a is not null and b is not null and hi <> lo").distinct())
    mark = _mark(e)
    while mark[0]:
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (sym.join(least, "u").where("v > u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        j = large.join(low, "hi")
        e = C.pin(j.select("hi", F.col("m").alias("lo")).unionAll(
            j.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct())
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
        e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def bucket_components(members: DataFrame, centers: DataFrame,
                      prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
                      rest: Callable[[DataFrame, DataFrame, Callable], DataFrame]) -> DataFrame:
    """(id, component) over all verified links between ids that share a bucket.

    members: (key, id, center): two ids are candidates when they share a key and
    one of them is a center there; centers: (key, id), the members that are.
    ``prepare`` gets the ids (id) that share any bucket and returns
    verify(pairs) -> links.

    Round one compares each bucket's members with one center only, the one that
    shares most buckets with others, so a bucket of n copies costs n pairs.
    Round two gets the members of buckets that still hold several components,
    (key, id, center, comp), the pairs already compared and verify; it returns the
    links (a, b) among them. Pairs inside one component cannot change the
    result, so no link between components is lost and no bucket is expanded
    into all its pairs. Only centers are aggregated by key before the join, and
    all joins are plain equi-joins.
    """
    heads = centers.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    if centers is members:
        heads = heads.where("low <> high")
    met = C.pin(members.join(heads, "key").where("id <> low or low <> high"))
    # the one center of a bucket met nobody at its own row
    own = met.where("low = high").select("key", F.col("low").alias("id"), F.lit(True).alias("center")).distinct()
    live = met.groupBy("key", "id").agg(F.max("center").alias("center")).unionAll(own)
    size = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = C.pin(live.join(size, "key").groupBy("id").agg(F.sum("n").alias("degree")))
    verify = prepare(degree.select("id"))
    live = C.pin(live.join(degree, "id"))
    best = (live.where("center").groupBy("key")
            .agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("best"))
            .select("key", (-F.col("best.neg")).alias("head")))
    star = C.pin(live.join(best, "key").where("head <> id").select(
        F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    links = C.pin(verify(star))
    comp = C.pin(components(links))
    lab = C.pin(live.join(comp, "id", "left").select("key", "id", "center", F.coalesce("component", "id").alias("comp")))
    open_keys = (lab.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
                 .where("c0 <> c1").select("key"))
    more = C.pin(rest(lab.join(open_keys, "key", "left_semi"), star, verify))
    if more.isEmpty():
        return comp
    return components(links.select("a", "b").unionByName(more.select("a", "b")))


def blocked(left: DataFrame, size: int) -> DataFrame:
    """left(key, id, ...) dealt to the pairs of blocks of its bucket: (key, i, j, own, ...).

    A bucket of m members has m / size hash blocks; every two blocks, and every
    block with itself, meet in one group (key, i, j), so a group holds about
    2 * size members whatever the bucket's size.
    """
    blocks = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (left.join(blocks, "key").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks"))


PAIRS = 20_000  # pairs looked at together


def map_pairs(dealt: DataFrame, links: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``links`` keeps of the pairs of each block pair of blocked(left) rows that are in different components.

    ``links`` gets a run of rows (with columns id, comp and more) and the row
    numbers of up to PAIRS pairs, and returns the ids of those it keeps. Groups
    are runs of sorted rows, so thousands of small buckets cost no call each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            key, i, j, own, comp = (b.column(c).to_numpy() for c in ("key", "i", "j", "own", "comp"))
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            end = np.append(np.flatnonzero(new) + 1, len(key))
            end = end[np.searchsorted(end, np.arange(len(key)), "right")]  # where each row's group ends
            partners = end - np.arange(len(key)) - 1
            upto = np.cumsum(partners)
            for lo in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                at = np.arange(lo, min(lo + PAIRS, int(upto[-1])))
                x = np.searchsorted(upto, at, "right")
                y = x + 1 + at - (upto[x] - partners[x])
                # two blocks: only pairs across them, pairs inside one meet where i = j
                ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
                a, c = links(b, x[ok], y[ok])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    spark = dealt.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(run, "a long, b long").distinct())


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut only where (key, i, j) changes."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        if kept is not None:
            b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
        same = np.ones(b.num_rows, bool)
        for c in ("key", "i", "j"):
            v = b.column(c).to_numpy()
            same &= v == v[-1]
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            yield b.slice(0, first)
        kept = b.slice(first)
    if kept is not None:
        yield kept
