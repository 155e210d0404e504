r"""Operator 11: exact substring dedup by level-wise doubling.

Words are `[^\x20\x09-\x0D]+`, unchanged. A window is ``length`` consecutive
words of one document; a word goes when it lies in a window whose words also
start somewhere in a document with a smaller doc_id. Windows are judged on the
input, never on what other removals leave.

Method. The lengths double: a quarter of ``length``, half of it, ``length``
(13, 25, 50). Of every run of neighbouring quarter windows inside one whole
window only those of smallest hash stand for it, the same ones wherever the
window occurs. Those that occur in one document only (copies of it aside) are
dropped, and with them every longer window they stand for. The others are
extended to both sides to half windows, repeated ones alone survive, and only
whole windows that hold nothing but survivors are hashed (128 bits) and grouped;
each level ends what has no candidate left. Names of twice a length are made
from two names of the length, so a document is hashed in log(length) steps.

Scale. Documents of equal words are one class (SHA-256) before any window is
named: its smallest doc_id stands for it, all others of at least ``length``
words are removed whole. The first level names about two in forty positions,
so nothing near the size of the text is shuffled; keys are counted with partial
minima and joined back by plain equi-joins that adaptive execution can split.
Texts are fetched twice, by doc_id and only for documents with candidates, then
with removals (a bounded Bloom filter over the scan, then an exact join).
Positions are gathered per document, never per key.

Defined cases: null and empty texts have no words; documents of fewer than
``length`` words lose nothing; rows with a null doc_id lose nothing and count
for nothing; repeated rows of one doc_id do not remove each other and are judged
alike; several texts under one doc_id are judged each by itself; an empty table
gives no rows; extra columns are kept by ``drop_repeats`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import common as C

LENGTH = 50


def levels(length: int) -> tuple[int, int]:
    """The two lengths that double to ``length``."""
    half = -(-length // 2)
    return -(-half // 2), half


def window_names(words: np.ndarray, lengths: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """Hashes of the windows at every position (meaningless where one runs over the end), for lengths that double to the last one."""
    steps, want = [], lengths[-1]
    while want > 1:
        steps.append(want)
        want = -(-want // 2)
    names, out, m = C.mix(words ^ C.U64(seed)), {}, 1
    out[1] = names
    for step in reversed(steps):
        n = max(0, len(words) - step + 1)
        longer = names.copy()
        longer[:n] = C.mix(names[:n] * C.U64(31) + names[step - m:step - m + n] + C.U64(step))
        names = out[step] = longer
        m = step
    return [out[x] for x in lengths]


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over a[i:i + width] at every i, cut at the end."""
    out, done = a.copy(), 1
    while done < width:
        step = min(done, width - done)
        if step < len(out):
            out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


def anchors(names: np.ndarray, left: np.ndarray, length: int, short: int) -> np.ndarray:
    """Positions whose short window has the smallest hash of all those inside some whole window.

    ``left`` is how many words remain in the document from each position on.
    """
    width = length - short + 1
    whole = left >= length
    if not whole.any():
        return np.zeros(0, np.int64)
    least = np.where(whole, _slide(names, width, np.minimum), C.U64(0))
    over = _slide(least[::-1], width, np.maximum)[::-1]  # the largest minimum of the windows that hold a position
    near = _slide(whole[::-1], width, np.maximum)[::-1]
    return np.flatnonzero((over == names) & near & (left >= short))


def _words(batch: pa.RecordBatch, column: str = "text"):
    """(hashes, row, first word of each row, words left from each position) of a batch's texts."""
    data, off = C.text_bytes(batch.column(column))
    words, row = C.word_hashes(data, off, C.SPACE_WORDS, fold=False)
    count = np.bincount(row, minlength=batch.num_rows)
    first = np.cumsum(count) - count
    return words, row, first, (first + count)[row] - np.arange(len(words))


def _digest(text: str | None) -> bytes:
    return hashlib.sha256(b" ".join((text or "").encode().split())).digest()


def _lists(row: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    off = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(off, pa.array(v)) for v in values]


def _named(docs: DataFrame, length: int) -> DataFrame:
    """Per row of docs: n_words, digest of its words and first 8 bytes of it (k), its anchors and the half windows around them."""
    short, half = levels(length)

    def run(batches):
        for b in batches:
            words, row, first, left = _words(b)
            names, halves = window_names(words, (short, half) if half > short else (short,) * 2, 11)
            at = anchors(names, left, length, short)
            pos = at - first[row[at]]
            before = np.maximum(at - (half - short), 0)
            # a half window that leaves the document is never asked for
            lkey, rkey = halves[before] ^ C.U64(0x5BD1), halves[at]
            digest = [_digest(t) for t in b.column("text").to_pylist()]
            k = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 4)[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.bincount(row, minlength=b.num_rows)), pa.array(digest, pa.binary()), pa.array(k)]
                + _lists(row[at], b.num_rows, pos.astype(np.int32), names[at].view(np.int64), lkey.view(np.int64), rkey.view(np.int64)),
                names=["doc_id", "n_words", "digest", "k", "pos", "name", "lkey", "rkey"])

    return docs.mapInArrow(run, "doc_id long, n_words long, digest binary, k long, pos array<int>, name array<long>, "
                                "lkey array<long>, rkey array<long>")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The keys that different documents (by their words) hold, as a table: a plain side of a join can be split."""
    return C.pin(rows.groupBy(key).agg(F.min("k").alias("k0"), F.max("k").alias("k1")).where("k0 <> k1").select(key))


def _starts(spots: list[dict], n: int, length: int) -> np.ndarray:
    """Starts of the whole windows that hold surviving half windows around an anchor: marks of n positions."""
    short, half = levels(length)
    edge = np.zeros(n + 1, np.int32)
    for s in spots:
        p = s["pos"]
        # offsets of the anchor in the window: below half - short only the right extension lies inside,
        # above length - half only the left one
        lo = 0 if s["right"] else length - half + 1
        hi = length - short if s["left"] else half - short - 1
        a, b = max(0, p - hi), p - lo + 1
        if a < b:
            edge[a] += 1
            edge[min(b, n)] -= 1
    on = np.cumsum(edge[:n]) > 0
    on[max(0, n - length + 1):] = False
    return np.flatnonzero(on)


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, ...) with the texts of its documents: a bounded Bloom filter over the scan, then an exact join."""
    words = bloom.build(wanted, "id")
    return docs.where(bloom.maybe(docs.sparkSession, words, F.col("doc_id"))).join(wanted, F.col("doc_id") == F.col("id")).drop("id")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(h1, h2, doc_id, k, pos): the whole windows that are still candidates. texts: (doc_id, text, k, spots)."""
    def run(batches):
        for b in batches:
            words, row, first, _ = _words(b)
            h1, h2 = (window_names(words, (length,), seed)[0] for seed in (0xA11CE, 0xB0B))
            ends = np.append(first[1:], len(words))
            at, of = [], []
            for i, (t, k, spots) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "k", "spots")))):
                if int.from_bytes(_digest(t)[:8], "big", signed=True) == k:  # else another text of the same doc_id
                    on = _starts(spots, int(ends[i] - first[i]), length) + first[i]
                    at.append(on)
                    of.append(np.full(len(on), i))
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            of = np.concatenate(of) if of else np.zeros(0, np.int64)
            for lo in range(0, len(at), C.BATCH_ROWS * 16):
                a, o = at[lo:lo + C.BATCH_ROWS * 16], of[lo:lo + C.BATCH_ROWS * 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[a].view(np.int64)), pa.array(h2[a].view(np.int64)), b.column("doc_id").take(pa.array(o)),
                     b.column("k").take(pa.array(o)), pa.array((a - first[o]).astype(np.int32))], names=["h1", "h2", "doc_id", "k", "pos"])

    return texts.mapInArrow(run, "h1 long, h2 long, doc_id long, k long, pos int")


def _removed(starts: list[int], n: int, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.minimum(np.array(starts, np.int64) + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, k, n_removed, kept): what is left of the documents with removals. texts: (doc_id, text, k, starts)."""
    def run(batches):
        for b in batches:
            out = []
            for i, t, k, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "k", "starts"))):
                words = t.encode().split()
                if int.from_bytes(_digest(t)[:8], "big", signed=True) == k:
                    gone = _removed(starts, len(words), length)
                    out.append((i, k, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "k", "n_removed", "kept"])

    return texts.mapInArrow(run, "doc_id long, k long, n_removed long, kept string").dropDuplicates(["doc_id", "k"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): every row's (doc_id, k, n_words, digest), and of those that lose words (doc_id, k, n_removed, kept).

    k names a document's words, so (doc_id, k) names a row up to exact repeats;
    kept is the text of the words that stay, joined by one space.
    """
    docs = _narrow(docs)
    t = C.pin(_named(docs, length))
    known = t.where(f"doc_id is not null and n_words >= {int(length)}")
    classes = (known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
               .where("rep < last").select("digest", "rep"))
    copies = C.pin(known.select("doc_id", "k", "n_words", "digest").join(classes, "digest").where("doc_id > rep")
                   .select("doc_id", "k", F.col("n_words").alias("n_removed")).distinct())
    spots = known.select("doc_id", "k", "n_words", F.explode(F.arrays_zip("pos", "name", "lkey", "rkey")).alias("s")).select(
        "doc_id", "k", "n_words", "s.*")
    # a quarter of the length: repeated ones alone go on
    spots = C.pin(spots.join(_repeated(spots, "name"), "name", "left_semi").drop("name"))
    # half of it, to both sides
    short, half = levels(length)
    sides = spots.select("doc_id", "k", "pos", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.when(F.col("pos") >= half - short, F.col("lkey")).alias("key")),
        F.struct(F.lit(False).alias("left"), F.when(F.col("pos") + half <= F.col("n_words"), F.col("rkey")).alias("key")))).alias("s")
        ).select("doc_id", "k", "pos", "s.*").where("key is not null")
    alive = sides.join(_repeated(sides, "key"), "key", "left_semi").groupBy("doc_id", "k", "pos").agg(
        F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right"))
    alive = alive.join(copies, ["doc_id", "k"], "left_anti").groupBy(F.col("doc_id").alias("id"), "k").agg(
        F.collect_list(F.struct("pos", "left", "right")).alias("spots"))
    # the whole length
    windows = C.pin(_windows(_fetched(docs, C.pin(alive)), length))
    first = (windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("h1", "h2", "first"))
    starts = C.pin(windows.join(first, ["h1", "h2"]).where("doc_id > first")
                   .groupBy(F.col("doc_id").alias("id"), "k").agg(F.collect_list("pos").alias("starts")))
    changed = _cut(_fetched(docs, starts), length).unionByName(copies.withColumn("kept", F.lit("")))
    return t.select("doc_id", "k", "n_words", "digest"), changed


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs."""
    rows, changed = repeats(docs, length)
    changed = changed.select("doc_id", "k", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("sha"))
    return rows.join(changed, ["doc_id", "k"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", F.lower(F.hex("digest"))).alias("kept_sha256"))


def _key(text: pa.Array) -> pa.Array:
    return pa.array([int.from_bytes(_digest(t)[:8], "big", signed=True) for t in text.to_pylist()], pa.int64())


_key.__annotations__ = {"text": pa.Array, "return": pa.Array}


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (all columns) with the repeated words cut from text: texts that lose words keep the others joined by one space."""
    _, changed = repeats(docs, length)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.arrow_udf(_key, returnType="long")(F.coalesce("text", F.lit(""))).alias("key"))
    j = rows.join(changed, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("k")), "left")
    return j.select(*[F.coalesce("kept", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, r, i, array_to_string(ws[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, r, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM g JOIN f USING (g) WHERE doc_id > first),
x AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""


@C.query("op11_substring_dedup", SQL)
def op11(spark, sf_dir):
    """Every document: its words, how many lie in 50-word windows of earlier documents, and the digest of the others."""
    return report(C.table(spark, sf_dir, "documents"))
