"""Line dedup with edits allowed by length, against all pairs."""
import collections
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm import linededup
from quarry.llm.queries import QUERIES


def most(n):
    return 0 if n < 20 else 1 if n < 40 else 2 if n < 300 else n // 100


def changed(rng, s, n):
    for _ in range(n):
        at = rng.randrange(len(s))
        s = s[:at] + rng.choice(["", "z", s[at] + "q"]) + s[at + 1:]
    return s


def test_edits_by_length_equal_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    sizes = [18, 19, 20, 21, 22, 38, 39, 40, 41, 150, 298, 299, 300, 301, 303, 399, 400, 500, 700, 1202, 2600]
    rows, i = [], 0
    for size in sizes:
        base = "".join(rng.choice("abcde") for _ in range(size))
        for n in [0, *range(1, most(size) + 3), most(size), most(size)]:
            rows.append((i, changed(rng, base, n)))
            i += 1
    n = len(rows)
    rng.shuffle(rows)
    names = sorted({t for _, t in rows})
    comp = {x: x for x in names}
    links = [(a, b) for a in names for b in names if a < b and (m := most(min(len(a), len(b)))) and linededup.within(a, b, m)]
    for _ in names:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    first = {}
    for d, t in sorted(rows):
        first.setdefault(comp[t], d)
    want = {d: [] if first[comp[t]] == d else [first[comp[t]]] for d, t in rows}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.first_docs for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == n
    linked = collections.Counter(0 if m < 2 else 1 if m == 2 else 2 for a, b in links for m in [most(min(len(a), len(b)))])
    assert min(linked.values()) > 3 and len(linked) == 3  # short, middle and long lines are linked


def test_headings_and_long_lines(spark):
    C.prepare(spark)
    words = " ".join(f"word{i}" for i in range(70))  # some 500 characters
    rows = [(1, "Copyright 2023 Example Ltd"), (2, "Copyright 2024 Example Ltd"), (3, "Chapter 1"), (4, "Chapter 2"),
            (5, words), (6, words.replace("word9 ", "Word9 ").replace("word30", "wort30").replace("word60", "w0rd60"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id for r in linededup.drop_lines(docs).collect())
    assert left == [1, 3, 4, 5]


def test_a_batch_of_pairs_is_its_pairs():
    rng = random.Random(6)
    x, y = [], []
    for _ in range(1500):
        size = rng.choice([18, 20, 25, 39, 40, 60, 299, 300, 310, 405, 3150])
        a = "".join(rng.choice("abé\U0001F600") for _ in range(size))
        x.append(a)
        y.append(changed(rng, a, rng.randrange(most(size) + 4)) if rng.random() < 0.9 else "".join(rng.choice("abé") for _ in range(size)))
    want = [(m := most(min(len(a), len(b)))) > 0 and linededup.within(a, b, m) for a, b in zip(x, y)]
    assert linededup.near_pairs(x, y).tolist() == want and 300 < sum(want) < 1400
    assert linededup.near_pairs([], []).tolist() == []


def test_runs_of_characters_hardly_ever_share_a_hash():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 123, 300_000).astype(np.uint32)
    codes[200_000:200_400] = codes[:400]
    runs = linededup.Runs(codes)
    at = np.arange(0, 299_000, 7)
    for n in (10, 32, 300):
        got = runs.span(at, at + n)
        assert len(np.unique(got)) > 0.99 * len(np.unique(np.lib.stride_tricks.sliding_window_view(codes, n)[at], axis=0))
        assert runs.span(np.array([5]), np.array([5 + n]))[0] == runs.span(np.array([200_005]), np.array([200_005 + n]))[0] or n > 300
    assert len(np.unique(runs.every(32))) > 299_000


def test_lines_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    C.prepare(spark)
    lines = [f"short line {i}" for i in range(12)]
    docs = spark.createDataFrame([(d, "\n".join(lines[(d * k) % 12] for k in range(1, 5))) for d in range(20)], "doc_id long, text string")
    want = sorted(map(tuple, linededup.repeats(docs).collect()))
    real = linededup.occurrences
    monkeypatch.setattr(linededup, "line_classes", lambda docs: spark.createDataFrame([], "id long, component long"))
    monkeypatch.setattr(linededup, "occurrences", lambda docs: real(docs).withColumn("h", F.col("h").bitwiseAND(F.lit(3))))
    assert sorted(map(tuple, linededup.repeats(docs).collect())) == want and len(want) > 40


def test_a_pair_is_given_by_one_of_its_keys(spark, monkeypatch):
    """Lines 0-9 share 40 keys; 20 and 21 share three, of which nobody is a center at the smallest; 30 and 31 share 30 above 20 of their own."""
    rows = [(k, i, True, i) for k in range(-20, 20) for i in range(10)]
    rows += [(k, i, k > 100 and i == 20, i) for k in (100, 105, 110) for i in (20, 21)]
    rows += [(k, 30, True, 30) for k in range(200, 220)] + [(k, 31, True, 31) for k in range(220, 240)]
    rows += [(k, i, True, i) for k in range(240, 270) for i in (30, 31)]
    left = spark.createDataFrame(rows, "key long, id long, center boolean, comp long")
    ids = sorted({r[1] for r in rows})
    text = spark.createDataFrame([(i, 1000, bytearray(linededup.CLASSES)) for i in ids], "h long, n int, counts binary")
    kept = {}
    whole = linededup.map_pairs
    monkeypatch.setattr(linededup, "map_pairs", lambda dealt, links: kept.update(dealt=dealt, links=links) or whole(dealt, links))
    every = {(a, b) for a in range(10) for b in range(a)} | {(21, 20), (31, 30)}
    assert {(r.b, r.a) for r in linededup._block_pairs(left, text).collect()} == every
    b = kept["dealt"].orderBy("key", "id").toArrow().combine_chunks().to_batches()[0]
    key = b.column("key").to_numpy()
    x, y = np.nonzero((key[:, None] == key) & (np.arange(len(key))[:, None] < np.arange(len(key))))
    a, c = kept["links"](b, x, y)
    met = collections.Counter(zip(np.maximum(a, c).tolist(), np.minimum(a, c).tolist()))
    assert set(met) == every and all(n == 1 for pair, n in met.items() if pair != (31, 30))
