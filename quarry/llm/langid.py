"""Operator 9: language identification, multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut into character n-grams of 1 to 3 characters,
hashed into BUCKETS buckets. Training adds the counts of each language and
turns them into a (buckets x languages) matrix of smoothed log probabilities,
which is broadcast; scoring gathers matrix rows for the n-grams of a batch and
adds them up per document in numpy. The score is the posterior probability of
the predicted language with equal priors.

Training reads a bounded sample: about SAMPLE_DOCS documents per language,
chosen by a hash of the document id (all of them where a language has fewer);
counting and sampling are Spark jobs, and only the matrix, whose size is
languages x BUCKETS, reaches the driver. Every document is scored, whole; a
text of any length is scored in pieces.

Defined cases: null texts and texts without a letter are `und` with score 0;
null lang, null id or empty text rows teach nothing; with nothing to learn from
everything is `und`; ties go to the language that sorts first; repeated rows
each get a row; extra columns are ignored (op9) or kept (`keep_known`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16
ORDERS = 3
SAMPLE_DOCS = 10_000
MATRIX_BYTES = 256 << 20
PIECE = 1 << 18  # characters scored at a time

_MUL = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each of the first len - order + 1 characters."""
    n = len(codes) - order + 1
    h = np.full(n, order * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for j in range(order):
        h = (h ^ codes[j:j + n]) * C.U64(_MUL[j])
        h ^= h >> C.U64(29)
    return (h >> C.U64(64 - 16)).astype(np.int64)


def _pieces(texts: list[str | None]):
    """(codes, row of each character, characters that start an n-gram here) for bounded runs of text."""
    buf, rows, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t = " " + t.lower() + " "
        for lo in range(0, len(t), PIECE):
            part = t[lo:lo + PIECE + ORDERS - 1]
            own = min(PIECE, len(t) - lo)
            buf.append(part)
            rows.append((i, len(part), own))
            size += len(part)
            if size >= PIECE:
                yield _codes(buf, rows)
                buf, rows, size = [], [], 0
    if buf:
        yield _codes(buf, rows)


def _codes(buf, rows):
    codes = np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([n for _, n, _ in rows])
    row = np.repeat(np.array([i for i, _, _ in rows]), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.repeat(np.array([o for _, _, o in rows]), sizes)
    return codes, row, end, at < own


def _grams(texts):
    """(row, bucket) arrays of all n-grams of the texts, piece by piece and order by order."""
    for codes, row, end, own in _pieces(texts):
        here = np.arange(len(codes))
        for order in range(1, ORDERS + 1):
            if len(codes) < order:
                continue
            b = _buckets(codes, order)
            n = len(b)
            ok = own[:n] & (here[:n] + order <= end[:n])
            yield row[:n][ok], b[ok]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def has_letter(col):
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (buckets x languages) from rows(doc_id, text, lang)."""
    known = rows.where("lang is not null and doc_id is not null and text <> ''").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.limit(MATRIX_BYTES // (4 * BUCKETS) + 1).collect()}
    langs = sorted(sizes)
    if 4 * BUCKETS * len(langs) > MATRIX_BYTES:
        raise ValueError("more languages than the matrix bound allows: raise MATRIX_BYTES or map the labels")
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < rate[F.col("lang")])

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs_of = b.column("lang").to_pylist()
            texts = b.column("text").to_pylist()
            for lang in set(langs_of):
                c = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket in _grams([t for t, x in zip(texts, langs_of) if x == lang]):
                    c += np.bincount(bucket, minlength=BUCKETS)
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    total = (sample.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[total["bucket"], total["lang"].map({k: i for i, k in enumerate(langs)})] = total["n"]
    p = counts + alpha
    return langs, np.log(p / p.sum(axis=0)).astype(np.float32)


def predictor(spark, langs: list[str], matrix: np.ndarray):
    """Arrow function (text, has_letter) -> struct(lang_pred, score)."""
    model = spark.sparkContext.broadcast((langs, matrix))

    def predict(text: pa.Array, letter: pa.Array) -> pa.Array:
        names, m = model.value
        n = len(text)
        if not names:
            return pa.StructArray.from_arrays([pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))],
                                              names=["lang_pred", "score"])
        ok = letter.to_numpy(zero_copy_only=False).astype(bool)
        total = np.zeros((n, len(names)))
        for row, bucket in _grams([t if k else None for t, k in zip(text.to_pylist(), ok)]):
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            if len(cut):
                total[row[cut]] += np.add.reduceat(m[bucket], cut, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        odds = np.exp(total - total[np.arange(n), best][:, None])
        score = np.where(ok, 1.0 / odds.sum(axis=1), 0.0)
        return pa.StructArray.from_arrays([
            pa.array([names[b] if k else "und" for b, k in zip(best, ok)], pa.string()), pa.array(score)],
            names=["lang_pred", "score"])

    predict.__annotations__ = {"text": pa.Array, "letter": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, returnType="struct<lang_pred:string,score:double>")


def identify(docs: DataFrame) -> DataFrame:
    """docs with one more column `_lang`: struct(lang_pred, score); learns from rows that are not held out."""
    langs, matrix = train(docs.where(~held_out()))
    udf = predictor(docs.sparkSession, langs, matrix)
    return docs.withColumn("_lang", udf("text", has_letter("text")))


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """docs (all columns) whose language is known: not `und`, and no other outcome as likely as min_score allows."""
    own = ["doc_id", "text", "lang"]
    known = identify(C.packed(docs, own)).where((F.col("_lang.lang_pred") != "und") & (F.col("_lang.score") >= min_score))
    return C.unpacked(known, docs.columns, own)


@C.query("op9_langid")
def op9(spark, sf_dir):
    """Language of every whole document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "_lang.lang_pred", "_lang.score")
