"""Phrase collocations against plain Python, and that every phrase is counted for one cycle."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bloom
from quarry.llm import collocations as co
from quarry.llm import common as C

SCHEMA = "doc_id long, text string, lang string, key string, m int, n long, shard int"


def plain(rows, least, longest, top):
    f = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i:i + m])] += 1
    found = collections.defaultdict(list)
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    for (lang, g), a in cand.items():
        score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        inside = [n for (l2, h), n in cand.items() if l2 == lang and len(h) > len(g)
                  and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if not any(100 * n >= 50 * a for n in inside):
            found[lang].append((-score, -a, " ".join(g).encode(), a, f[lang, g[:k]], f[lang, g[k:]]))
    out = set()
    for lang, rs in found.items():
        n = sum(c for (l2, g), c in f.items() if l2 == lang and len(g) == 1)
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(rs)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, n, -score))
    return out


def corpus(rng):
    words = [f"w{i}" for i in range(25)] + ["Groß", "GROß", "é", "don't", "x-y", "\U0001F600"]
    sets = [["New", "York", "City"], ["new", "york"], ["a", "b", "a"], ["w1", "w2", "w3", "w4"]]
    rows = []
    for _ in range(150):
        ws = []
        for _ in range(rng.randrange(40)):
            ws += rng.choice(sets) if rng.random() < 0.3 else [rng.choices(words, range(len(words), 0, -1))[0]]
            if rng.random() < 0.1:
                ws[-1] += rng.choice([".", ",", "\n", "!?", "\x0b", " ; "])
        rows.append((rng.choice([" ", "\t", "  "]).join(ws), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [("same same same " * 30, "fr"), (None, "en"), ("", "en"), ("...,,\n", "es"), ("lone", "it"), ("w1 w2 " * 4000, "en")]


@pytest.mark.parametrize("least,longest,top,shards", [(10, 3, 2000, 3), (3, 3, 5, 1), (10, 4, 50, 2)])
def test_equals_plain(spark, least, longest, top, shards):
    C.prepare(spark)
    rows = corpus(random.Random(least + longest + shards))
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, t, g, "x", 1, 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(4)
    got = co.collocations(docs, least, longest, top, shards)
    assert {tuple(r) for r in got.collect()} == plain(rows, least, longest, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_empty_table(spark):
    C.prepare(spark)
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "en", "x", 1, 2, 3), (2, "a b", None, "x", 1, 2, 3)], SCHEMA)
    assert co.collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9_000_000_000_000_001, 9_100_000_000_000_003, 9_000_000_000_000_007
    d = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 3_000_000, 10)], "a long, l long, r long")
    assert [r[0] for r in d.select(co.score("a", "l", "r")).collect()] == [10**6 * x * x // (y * z) for x, y, z in
                                                                          [(a, left, right), (10, 10, 10), (10, 3_000_000, 10)]]


def test_phrases_stay_inside_pieces_and_rows():
    keys, row, start, end, data = co.word_keys(pa.array(["a b,c d", None, "B a b", "a"]), np.array([1, 1, 1, 2]))
    (one, _), (two, pairs), (three, _) = co.phrase_keys(keys, 3)
    assert one.tolist() == list(range(8)) and two.tolist() == [0, 2, 4, 5] and three.tolist() == [4]
    assert pairs[0] == pairs[3] != pairs[2] and keys[0] & ~C.U64(1) != keys[7]
    assert bytes(data[start[4]:end[6]]) == b"B a b" and row.tolist() == [0, 0, 0, 0, 2, 2, 2, 3]


def test_every_phrase_is_counted_for_one_cycle():
    """Whatever step its parts are told at, the steps at which a phrase is active meet every shard once."""
    rng = np.random.default_rng(2)
    keys = co.word_keys(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 9, 400))]), np.array([5]))[0]
    (_, words), (at2, pairs), (at3, triples) = co.phrase_keys(keys, 3)

    def one_filter(some):
        w = np.zeros((64, 8), np.uint64)
        block, bits = bloom._places(some.view(np.int64), len(w))
        for j in range(bloom.BITS):
            np.bitwise_or.at(w, (block, bits[:, j] >> 6), C.U64(1) << (bits[:, j] & 63).astype(np.uint64))
        return w

    shards = 3
    distinct = np.unique(words)
    told = {1: [(s + 1, one_filter(distinct[s::shards])) for s in range(shards)],
            2: [(s + 1, one_filter(np.unique(pairs)[s::5])) for s in range(1, 5)]}
    met = collections.defaultdict(list)
    for step in range(3 * shards):
        early = {m: [f for f in fs if f[0] <= step] for m, fs in told.items()}
        for m, (hashes, since) in co.active(keys, step, shards, 3, early).items():
            for k in set(hashes.tolist()):
                met[m, k].append(step % shards)
    assert all(sorted(x) == [0, 1, 2] for x in met.values())
    assert {k for m, k in met if m == 2} == set(pairs.tolist()) and {k for m, k in met if m == 3} <= set(triples.tolist())
