"""Operator 1: near-duplicate vectors by collision-counting projections.

Vectors are linked when their labels are equal and not null and their cosine, in
double precision, is at least `limit`. Every vector is projected on PROJECTIONS
random directions; each projection is a sorted list of the vectors for which it
is one of their TAIL most extreme ones. A query-centred window of half width
WINDOW around a vector's value in a list collides with other vectors; pairs are
counted over all lists, and pairs that reach the threshold are verified.

Calibration. For unit vectors with cosine c a Gaussian projection gives a
bivariate normal pair with correlation c, whatever the data. The threshold is
the largest count that simulated pairs at cosine `limit`, the hardest that must
be found, reach with probability RECALL.

Scale. Extreme projections make lists short: a list holds a TAIL / PROJECTIONS
part of a label's vectors, and unrelated vectors rarely share one. The window is
an equi-join on (label, projection, cell), a cell being one window wide, so a
list is sorted by ranges and a long one can be split. Equal vectors collapse to
their smallest vec_id before projection, so thousands of copies are one vector.
Counts are aggregated before verification. More vectors per label want more
PROJECTIONS (the count threshold follows by calibration).

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or vec_id, link with nothing (n_links 0,
their own component, kept); vectors of different length are not linked; a
repeated row is another vector with the same vec_id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

LIMIT = 0.93
PROJECTIONS = 4096
TAIL = 16
WINDOW = 1.2
RECALL = 0.9995


@lru_cache
def threshold(limit: float, projections: int = PROJECTIONS, tail: int = TAIL, window: float = WINDOW,
              recall: float = RECALL, pairs: int = 2000) -> int:
    """Collisions that pairs at cosine ``limit`` reach with probability ``recall`` (seeded simulation)."""
    rng = np.random.default_rng(1)
    counts = []
    for _ in range(0, pairs, 250):
        x = rng.standard_normal((250, projections))
        y = limit * x + (1 - limit * limit) ** 0.5 * rng.standard_normal((250, projections))
        in_x, in_y = (np.zeros(z.shape, bool) for z in (x, y))
        for z, hit in ((x, in_x), (y, in_y)):
            np.put_along_axis(hit, np.argpartition(np.abs(z), projections - tail, axis=1)[:, projections - tail:], True, axis=1)
        counts.append((in_x & in_y & (np.abs(x - y) <= window)).sum(axis=1))
    counts = np.sort(np.concatenate(counts))
    return max(1, int(counts[int((1 - recall) * len(counts))]))


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([7, dim]).standard_normal((dim, projections), dtype=np.float32)


def _matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of a list column, for each length of vector."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[start[rows][:, None] + np.arange(d)]))
    return out


def entries(vectors: DataFrame) -> DataFrame:
    """(label, list, cell, x, id): a vector's entries in the lists of its most extreme projections."""
    def run(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column("id").to_numpy()
            labels = b.column("label").to_numpy()
            for rows, v in _matrix(b.column("embedding")):
                d = v.shape[1]
                if d not in made:
                    made[d] = directions(d)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for lo in range(0, len(rows), 500):
                    r = rows[lo:lo + 500]
                    p = v[lo:lo + 500].astype(np.float32) @ made[d]
                    j = np.argpartition(np.abs(p), PROJECTIONS - TAIL, axis=1)[:, PROJECTIONS - TAIL:]
                    x = np.take_along_axis(p, j, axis=1)
                    side = (d * PROJECTIONS + j) * 2 + (x > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(labels[r], TAIL)), pa.array(side.ravel().astype(np.int64)),
                         pa.array(np.floor(x.ravel() / WINDOW).astype(np.int32)), pa.array(x.ravel()), pa.array(np.repeat(ids[r], TAIL))],
                        names=["label", "list", "cell", "x", "id"])

    return vectors.select("id", "label", "embedding").mapInArrow(run, "label long, list long, cell int, x float, id long")


def candidates(e: DataFrame, least: int) -> DataFrame:
    """(a, b) with a < b of the vectors that collide in at least ``least`` windows."""
    centred = e.withColumn("at", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    u, v = centred.alias("u"), e.alias("v")
    j = u.join(v, (F.col("u.label") == F.col("v.label")) & (F.col("u.list") == F.col("v.list")) & (F.col("u.at") == F.col("v.cell")))
    # within one cell each pair once; across cells the lower cell looks up
    j = j.where("abs(u.x - v.x) <= %r and u.id <> v.id and (u.cell < v.cell or u.id < v.id)" % WINDOW)
    return (j.groupBy(F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b"))


def _cosine(x: pa.Array, y: pa.Array) -> pa.Array:
    out = np.zeros(len(x))
    for (rows, a), (_, b) in zip(_matrix(x), _matrix(y)):
        # scaled by the largest component, so that squares neither overflow nor vanish
        a = a / np.abs(a).max(axis=1, keepdims=True)
        b = b / np.abs(b).max(axis=1, keepdims=True)
        out[rows] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return pa.array(out)


_cosine.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}


def near_duplicates(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
          & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    groups = C.pin(rows.where(ok).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    pairs = candidates(entries(groups), threshold(limit))
    one = groups.select("id", "embedding", "copies")
    a = one.select(F.col("id").alias("a"), F.col("embedding").alias("ea"), F.col("copies").alias("ca"))
    b = one.select(F.col("id").alias("b"), F.col("embedding").alias("eb"), F.col("copies").alias("cb"))
    links = C.pin(pairs.join(a, "a").join(b, "b").where(F.size("ea") == F.size("eb"))
                  .where(F.arrow_udf(_cosine, returnType="double")("ea", "eb") >= limit).select("a", "b", "ca", "cb"))
    degree = (links.select(F.col("a").alias("id"), F.col("cb").alias("n"))
              .unionAll(links.select(F.col("b").alias("id"), F.col("ca").alias("n")))
              .groupBy("id").agg(F.sum("n").alias("n")))
    known = (groups.join(degree, "id", "left").join(components(links), "id", "left")
             .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id")).where("n_links > 0"))
    return (rows.withColumn("_ok", ok).alias("r").join(
        known.alias("k"), F.col("_ok") & (F.col("r.label") == F.col("k.label")) & (F.col("r.embedding") == F.col("k.embedding")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


@C.query("op1_embedding_dedup", SQL)
def op1(spark, sf_dir):
    """Every vector against all of its label."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
