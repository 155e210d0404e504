"""Operator 10: near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct k-word shingles (words are runs of non-space
characters, A-Z folded; fewer than k words: the whole sequence; no words: the
empty set). Documents are linked when 100 * |A and B| >= percent * |A or B|.

Method. Each set is sketched by rounds of hashed bin placement: in round i
every element draws a bin and a value i + u; a bin keeps its least value and
the rounds stop once every bin is filled (after t random rounds, round t + b
forces every element into bin b, so all coordinates are always filled). Bands
of the sketch are candidate buckets; candidates are confirmed on full sets.

Scale. Documents with equal sets (128-bit set hash) collapse to their smallest
doc_id before any bucket is built, and near copies meet only their bucket's
best connected member first (``graph.bucket_components``), so a group of n
copies costs n comparisons. Members of a bucket that are still in different
components are compared on sketches, in bounded blocks of numpy rows: only
pairs whose sketches agree in about as many coordinates as the limit asks for
leave a block, once, and are confirmed on full sets. The first 125 of 500
coordinates are banded: 25 bands of 5 rows miss a pair at similarity 0.85 with
probability 4e-7, one at 0.8 with 5e-5; the agreement limit lies 4.3 standard
deviations below the mean (1e-5). Full sets are fetched once, for documents
that share a bucket (bounded Bloom filter, then an exact join).

Defined cases: null and empty texts have the empty set and are linked with
nothing; repeated rows (same doc_id) are one node and all get its component;
rows with a null doc_id are linked with nothing, component_id is null and they
are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import common as C
from .graph import blocked, bucket_components, map_pairs

BANDS, ROWS = 25, 5
COORDINATES = 500
BLOCK = 512  # members of one bucket that meet in one block


def sketch(values: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches (rows x t) of the sets values[off[i]:off[i + 1]]."""
    n = len(off) - 1
    size = np.diff(off)
    none = np.iinfo(np.uint64).max
    out = np.full(n * t, none, np.uint64)
    values = C.mix(values)
    salts = C.mix(np.arange(1, 2 * t + 1, dtype=np.uint64))
    row = np.repeat(np.arange(n), size)
    open_row = size > 0
    for i in range(2 * t):
        h = C.mix(values ^ salts[i])
        if i < t:
            at = ((h >> C.U64(32)) * C.U64(t) >> C.U64(32)).astype(np.int64)
        else:
            at = np.full(len(h), i - t)
        value = (C.U64(i) << C.U64(52)) | (C.mix(h) >> C.U64(12))
        at += row * t
        if i:  # later rounds have larger values: only empty bins can change
            free = out[at] == none
            at, value = at[free], value[free]
        np.minimum.at(out, at, value)
        if i < t:
            open_row = (out.reshape(n, t) == none).any(axis=1) & (size > 0)
            go = open_row[row]
            values, row = values[go], row[go]
        if not len(values):
            break
    return out.reshape(n, t)


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(s), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(s), (b + 1) * 0x51AFD7ED558CCD % (1 << 64), np.uint64)
        for j in range(rows):
            h = C.mix(h * C.U64(31) + s[:, b * rows + j])
        out[:, b] = h
    return out


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = C.text_bytes(batch.column("text"))
    n = batch.num_rows
    return C.distinct_sets(*C.shingles(*C.word_hashes(data, off, C.SPACE_WORDS), n, k), n)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, sketch): set size, 128-bit set hash, band hashes, low byte of each coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, off = _sets(b, k)
            n = b.num_rows
            row = np.repeat(np.arange(n), np.diff(off))
            sums = []
            for salt in (0x1234567, 0x89ABCDEF01):
                s = np.zeros(n, np.uint64)
                np.add.at(s, row, C.mix(v ^ C.U64(salt)))
                sums.append(pa.array(s.view(np.int64)))
            sk = sketch(v, off, COORDINATES)
            keys = band_hashes(sk, BANDS, ROWS).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            low = pa.array([x.tobytes() for x in (sk & C.U64(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off)), *sums, keys, low],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary")


def block_pairs(left: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one bucket in different components whose sketches agree closely enough.

    left: (key, id, comp, ...) of the open buckets; sketched: (id, n, bands, sketch).
    A bucket of m members is dealt to m / BLOCK hash blocks; every pair of
    blocks meets once. A pair that shares several bands is named only in the
    first of them.
    """
    share = percent / 100
    agree = COORDINATES * (share + (1 - share) / 256) - 4.3 * (COORDINATES * share * (1 - share)) ** 0.5
    dealt = blocked(left.select("key", "id", "comp"), BLOCK).join(sketched, "id")

    def links(rows: pa.RecordBatch, x: np.ndarray, y: np.ndarray):
        key, ids, n = (rows.column(c).to_numpy() for c in ("key", "id", "n"))
        sk = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = rows.column("bands").flatten().to_numpy().reshape(len(ids), -1)
        size = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[size], y[size]
        near = (sk[x] == sk[y]).sum(axis=1) >= agree
        x, y = x[near], y[near]
        here = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key[x]
        return ids[x[here]], ids[y[here]]

    return map_pairs(dealt, links)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles): sorted distinct shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, off = _sets(b, k)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.LargeListArray.from_arrays(pa.array(off), pa.array(v.view(np.int64)))
                 .cast(pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, shingles array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    t = C.pin(sketches(docs, k))
    full = t.where("n_shingles > 0 and doc_id is not null")
    # equal sets: one representative, the smallest doc_id
    classes = C.pin(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    # a doc_id with several different texts represents several sets: they are one node
    reps = classes.select("rep", "s1", "s2")
    sketched = full.join(reps, (F.col("doc_id") == F.col("rep")) & (full.s1 == reps.s1) & (full.s2 == reps.s2), "left_semi")
    sketched = C.pin(sketched.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch")
                     .dropDuplicates(["id", "n"]))
    members = sketched.select(F.explode("bands").alias("key"), "id", F.lit(True).alias("center"))

    def prepare(ids: DataFrame):
        ids = C.pin(ids.select(F.col("id").alias("doc_id")))
        words = bloom.build(ids, "doc_id")
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(bloom.maybe(spark, words, F.col("doc_id")))
        sets = C.pin(shingle_sets(text.join(ids, "doc_id", "left_semi"), k).where("size(shingles) > 0").distinct())
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        return lambda pairs: (
            pairs.join(a, "a").join(b, "b").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both")))
            .select("a", "b").distinct())

    def rest(left: DataFrame, star: DataFrame, verify) -> DataFrame:
        return verify(C.pin(block_pairs(left, sketched, percent).join(star, ["a", "b"], "left_anti")))

    comp = bucket_components(members, members, prepare, rest)
    # only classes with copies or links need a row; all other documents stand alone
    named = (classes.join(comp, F.col("rep") == F.col("id"), "left")
             .select("s1", "s2", "n_shingles", "rep", "last", F.coalesce("component", "rep").alias("component_id"))
             .where("last <> rep or component_id <> rep").drop("rep", "last"))
    keep = t.drop("bands", "sketch")
    return (keep.join(named, ["s1", "s2", "n_shingles"], "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies: the smallest doc_id of each group stays, with all its columns."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return C.unpacked(C.packed(docs, ["doc_id"]).join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti"), docs.columns, ["doc_id"])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN rare USING (g) JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


@C.query("op10_minhash", SQL)
def op10(spark, sf_dir):
    """Every document against all others: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(C.table(spark, sf_dir, "documents"), k=3, percent=85)
