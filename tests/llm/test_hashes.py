"""Words and lines on which a polynomial hash modulo a power of two collides whatever its base."""
import numpy as np
import pyarrow as pa

from quarry.llm import common as C
from quarry.llm import decontaminate, linededup, minhash


def complementary(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


A, B = complementary(2048)


def test_products_and_spans_are_exact():
    p = (1 << 61) - 1
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, p, (2, 500)).astype(np.uint64)
    a[:3], b[:3] = [p - 1, 0, p - 1], [p - 1, 7, 1]
    assert C._times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    data = rng.integers(0, 256, 1_200_000).astype(np.uint8)
    for at in (524_200, 700_000, 1_048_500):  # across the borders of spans
        data[at:at + 300] = data[:300]
    s = np.array([0, 524_200, 700_000, 1_048_500, 1])
    h = C.Prefix(data)
    got = C.span_hash(h, s, s + 300)
    assert len(set(got[:4].tolist())) == 1 and got[4] != got[0]
    want, power = 0, 1
    for c in data[:700_100].tolist():
        want, power = (want + (c + 1) * power) % p, power * C._BASE % p
    assert h.at(np.array([700_100]))[0] == want


def test_words_hash_alike_wherever_they_stand():
    data, off = C.text_bytes(pa.array([A, B, "x" * 600_000 + " a " + "x" * 600_000, "A a"]))
    w, _ = C.word_hashes(data, off, C.SPACE_WORDS)
    assert w[0] != w[1] and w[2] == w[4] and w[3] == w[5] == w[6]
    w, _ = C.word_hashes(data, off, C.SPACE_WORDS, fold=False)
    assert w[5] != w[6] == w[3]


def test_operators_tell_the_texts_apart(spark):
    C.prepare(spark)
    docs = spark.createDataFrame([(1, A), (2, B), (3, A)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 1}
    assert {(r.doc_id, r.n_removed) for r in linededup.report(docs).collect()} == {(1, 0), (2, 0), (3, 1)}
    items = spark.createDataFrame([("i", A)], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.judge(docs, items).collect()} == {1: True, 2: False, 3: True}
