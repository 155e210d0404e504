"""Substring dedup against plain Python, and its parts."""
import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import common as C
from quarry.llm import substrings

SCHEMA = "doc_id long, text string, k string, id int, kept string, row string"


def plain(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for a in range(len(ws) - length + 1):
            if i is not None:
                w = tuple(ws[a:a + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for a in range(len(ws) - length + 1):
            if i is not None and first[tuple(ws[a:a + length])] < i:
                gone.update(range(a, a + length))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng, length):
    """Texts that share passages of all lengths around the window's, copies, near copies, periodic and awkward texts."""
    vocab = [f"w{i}" for i in range(40)] + ["É", "Wort", "wort", "\U0001F600"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length + 2)]
    rows = []
    for i in range(60):
        ws = text(rng.randrange(0, 3 * length))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = p if rng.random() < 0.5 else p[a:b]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(ws)))
    near = rows[7][1].split() + text(length)
    rows += [(100 + i, " ".join(near[:i] + ["changed"] + near[i:])) for i in range(0, len(near), 9)]
    rows += [(3, rows[50][1]), (3, rows[3][1]), (200, rows[20][1]), (201, rows[20][1]), (201, rows[20][1]), (-5, rows[21][1])]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, rows[5][1]), (None, None), (303, "a " * 400), (304, "a " * 300), (305, "a b " * 250)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,seed", [(50, 1), (7, 2), (2, 3)])
def test_equals_plain(spark, length, seed):
    C.prepare(spark)
    rows = corpus(random.Random(seed), length)
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in substrings.report(docs, length).collect()]
    want = plain(rows, length)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 100


def test_drop_repeats_keeps_columns_and_other_texts(spark):
    C.prepare(spark)
    rows = corpus(random.Random(9), 20)
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)
    out = substrings.drop_repeats(docs, 20)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = sorted((r.doc_id or -1, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect())
    assert got == sorted((i or -1, h) for i, _, _, h in plain(rows, 20))
    same = {(r.doc_id, r.text) for r in out.collect()} & set(rows)
    assert {i for i, n in ((i, n) for i, _, n, _ in plain(rows, 20)) if n == 0} <= {i for i, _ in same}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substrings.report(docs).count() == 0 and substrings.drop_repeats(docs).count() == 0


def test_every_whole_window_has_an_anchor():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 30, 400).astype(np.uint64)
    left = np.concatenate([np.arange(150, 0, -1), np.arange(250, 0, -1)])
    names = substrings.window_names(words, (5, 9), 1)[0]
    at = set(substrings.anchors(names, left, 18, 5).tolist())
    for i in np.flatnonzero(left >= 18):
        best = min(names[i:i + 14].tolist())
        assert any(j in at and names[j] == best for j in range(i, i + 14))


def test_names_follow_the_words():
    words = np.array([5, 6, 7, 8, 9, 5, 6, 7, 8, 1], np.uint64)
    two, four = substrings.window_names(words, (2, 4), 2)
    assert two[0] == two[5] and two[1] == two[6] != two[0] and four[0] == four[5] and len(set(four[:6].tolist())) == 5
