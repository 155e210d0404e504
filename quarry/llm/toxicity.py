"""Operator 5: toxicity, a counterfactual-regularised classifier.

A document's features are the words it holds and their first 4 to 8 bytes
(inflected forms share them), each once, and again where it holds them at least
REPEATS times, hashed; words are runs of letters and digits, A-Z folded. The features that labels speak for or against most clearly (a chi-square
on document counts) get a logistic regression. For every training document
that names a group, sentences with the group's term swapped for each other
term of its kind are added: squared differences of the two scores are
penalised, so the weights of group terms are driven to what does not depend on
the group, and a neutral mention is not held against a text.

Training reads a bounded sample, at most about SAMPLE_DOCS documents of each
label, drawn by a hash of doc_id (weighted back to their true share); features
are counted and selected in Spark jobs, and the driver gets at most MAX_FEATURES
columns of it. Every document is scored, whole, in a narrow pass.

Defined cases: null and empty texts have no features and get the intercept's
score; labels that are null, contradict one another or have no document teach
nothing; with labels of one kind or none every score is that share (0 without
any); repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_DOCS = 8_000
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
REPEATS = (2, 4)
MAX_FEATURES = 4096
MIN_DOCS = 3
MIN_CHI2 = 20.0
L2 = 0.1
COUNTERFACTUAL = 10.0
CUT = 0.3

# Group terms by kind; terms of one kind are swapped for one another.
IDENTITY = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "queer", "homosexual", "heterosexual"],
    ["woman", "man"], ["women", "men"], ["girl", "boy"], ["girls", "boys"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous", "native"],
    ["immigrant", "refugee", "foreigner"], ["immigrants", "refugees", "foreigners"],
    ["disabled", "deaf", "blind"], ["old", "young", "elderly"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"], ["femme", "homme"], ["femmes", "hommes"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"], ["frau", "mann"], ["frauen", "männer"],
    ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo"], ["mujer", "hombre"], ["mujeres", "hombres"],
]


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row): a word's own feature and those of its longer prefixes; rows are not sorted."""
    h, row, start, end = C.word_hashes(data, off, C.ALNUM_WORDS, spans=True)
    shift = C.U64(64 - BITS)
    feats, rows = [h * C.U64(0x9E3779B97F4A7C15) >> shift], [row]
    folded = C._LOWER[data]
    size = end - start
    code = np.zeros(len(start), np.uint64)
    for j in range(max(PREFIXES)):
        code = (code << C.U64(8)) | np.where(size > j, folded[np.minimum(start + j, len(folded) - 1)], 0).astype(np.uint64)
        if j + 1 in PREFIXES:
            longer = size > j + 1
            feats.append(C.mix(code[longer] ^ C.U64((j + 1) << 56)) >> shift)
            rows.append(row[longer])
    return np.concatenate(feats).astype(np.int64), np.concatenate(rows)


def repeat_feature(f: np.ndarray, times: int) -> np.ndarray:
    """The feature of holding feature f at least ``times`` times."""
    return (C.mix(f.astype(np.uint64) + C.U64(times << 40)) >> C.U64(64 - BITS)).astype(np.int64)


def document_features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row) pairs, by row; ``wanted`` masks the words and prefixes to look at."""
    f, row = word_features(data, off)
    if wanted is not None:
        here = wanted[f]
        f, row = f[here], row[here]
    pairs, n = np.unique(row.astype(np.int64) << BITS | f, return_counts=True)
    more = [(pairs[n >= t] >> BITS << BITS) | repeat_feature(pairs[n >= t] & (1 << BITS) - 1, t) for t in REPEATS]
    pairs = np.unique(np.concatenate([pairs, *more]))
    return pairs & (1 << BITS) - 1, pairs >> BITS


def term_features(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return np.unique(word_features(data, np.array([0, len(data)]))[0])


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[int, float]]:
    """Written (toxic, features) rows of the bounded sample, and the weight of a row of each label."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic"))
    known = C.pin(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {k: min(1.0, sample_docs / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("toxic") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0)))
    chosen = known.where(draw < limit)

    def run(batches):
        for b in batches:
            data, off = C.text_bytes(b.column("text"))
            f, row = document_features(data, off)
            bound = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(f.astype(np.int32)))],
                                             names=["toxic", "features"])

    # the sample's ids are bounded by sample_docs per label, so they may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text")
    return C.pin(rows.mapInArrow(run, "toxic int, features array<int>")), {k: 1 / r for k, r in rate.items()}


def select_features(rows: DataFrame) -> np.ndarray:
    """Ids of the features with the largest chi-square against the labels, and of all group terms."""
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()

    def count(batches):
        c = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            y = np.repeat(b.column("toxic").to_numpy(), b.column("features").value_lengths().to_numpy())
            f = b.column("features").flatten().to_numpy()
            for k in (0, 1):
                c[k] += np.bincount(f[y == k], minlength=1 << BITS)
        at = np.flatnonzero(c.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[0][at]), pa.array(c[1][at])], names=["f", "c0", "c1"])

    seen = rows.mapInArrow(count, "f bigint, c0 bigint, c1 bigint").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    a, b = F.col("c1").cast("double"), F.col("c0").cast("double")
    total, miss1, miss0 = a + b, F.lit(float(n1)) - a, F.lit(float(n - n1)) - b
    cross = a * miss0 - b * miss1
    chi2 = F.lit(float(n)) * cross * cross / (total * (miss1 + miss0) * float(n1) * float(n - n1))
    best = (seen.where(total >= MIN_DOCS).withColumn("chi2", F.when(miss1 + miss0 > 0, chi2).otherwise(F.lit(0.0)))
            .where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "f").limit(MAX_FEATURES).select("f").toPandas()["f"].to_numpy(np.int64))
    terms = np.concatenate([term_features(t) for kind in IDENTITY for t in kind])
    return np.unique(np.concatenate([best, terms]))


def fit(rows: DataFrame, weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature ids, weights, intercept) of the regularised regression."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = 1.0 if sizes.get(1) else 0.0
        return np.zeros(0, np.int64), np.zeros(0), 40.0 if share else -40.0
    ids = select_features(rows)

    def narrow(batches):
        for b in batches:
            size = b.column("features").value_lengths().to_numpy()
            f = b.column("features").flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, f), len(ids) - 1)
            hit = ids[at] == f
            row = np.repeat(np.arange(b.num_rows), size)[hit]
            bound = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(at[hit].astype(np.int32)))],
                names=["toxic", "at"])

    got = rows.mapInArrow(narrow, "toxic int, at array<int>").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    lists = got.column("at").combine_chunks()
    size = lists.value_lengths().to_numpy()
    col, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), size)
    w_row = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    w_row = w_row / w_row.mean()
    d_row, d_col, d_val, n_diff = counterfactuals(row, col, len(y), ids)
    w, b = np.zeros(len(ids)), float(np.log((w_row * y).sum() / (w_row * (1 - y)).sum()))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 401):  # Adam on the whole sample
        z = b + np.bincount(row, w[col], len(y))
        g = w_row * (1 / (1 + np.exp(-z)) - y)
        gw = np.bincount(col, g[row], len(ids)) + L2 * w
        if n_diff:  # score(x) - score(x') of every swapped sentence
            gap = np.bincount(d_row, w[d_col] * d_val, n_diff)
            gw += COUNTERFACTUAL * np.bincount(d_col, gap[d_row] * d_val, len(ids))
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9 ** step)
        w -= rate * mw / (np.sqrt(vw / (1 - 0.999 ** step)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999 ** step)) + 1e-8)
    return ids, w, float(b)


def counterfactuals(row: np.ndarray, col: np.ndarray, n: int, ids: np.ndarray):
    """Sparse feature differences (pair, column, +-1) between documents and their swapped versions."""
    pairs, cols, vals, k = [], [], [], 0
    holds = [set() for _ in range(n)]
    named = {int(c) for kind in IDENTITY for t in kind for c in np.searchsorted(ids, term_features(t))}
    for r, c in zip(row[np.isin(col, list(named))], col[np.isin(col, list(named))]):
        holds[r].add(int(c))
    # the features of a term are the same for all documents
    kinds = [[{int(c) for c in np.searchsorted(ids, term_features(t))} for t in kind] for kind in IDENTITY]
    for r in range(n):
        if not holds[r]:
            continue
        for feats in kinds:
            for i, f in enumerate(feats):
                if f <= holds[r]:
                    for j, other in enumerate(feats):
                        if i != j:
                            for c in f - other:
                                pairs.append(k), cols.append(c), vals.append(1.0)
                            for c in other - holds[r]:
                                pairs.append(k), cols.append(c), vals.append(-1.0)
                            k += 1
    return np.array(pairs, np.int64), np.array(cols, np.int64), np.array(vals), k


def scorer(spark, ids: np.ndarray, w: np.ndarray, b: float):
    """Arrow function text -> probability."""
    table = np.zeros(1 << BITS, np.float32)
    table[ids] = w
    every = np.arange(1 << BITS)
    wanted = (table != 0) | np.logical_or.reduce([table[repeat_feature(every, t)] != 0 for t in REPEATS])
    model = spark.sparkContext.broadcast((table, b, wanted))

    def score(text: pa.Array) -> pa.Array:
        weights, bias, look = model.value
        data, off = C.text_bytes(text)
        z = np.full(len(text), bias)
        if len(data):
            f, row = document_features(data, off, look)  # presence, not frequency
            z += np.bincount(row, weights[f], len(text))
        return pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    score.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, returnType="double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from rows that are not held out."""
    ids, w, b = fit(*sample(docs, labels))
    out = docs.select("doc_id", held_out().alias("held_out"), scorer(docs.sparkSession, ids, w, b)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


@C.query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity of every whole document."""
    return toxicity(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "labels"))
