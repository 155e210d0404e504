"""Components and bucket candidates against plain union, and words hashed in chunks."""
import random

import numpy as np
import pyarrow as pa

from quarry.llm import common as C
from quarry.llm.graph import blocked, components, map_pairs


def union(n, links):
    comp = list(range(n))
    for _ in range(n):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_components_of_chains_stars_and_noise(spark):
    C.prepare(spark)
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    links = list(zip(ids[:120], ids[1:121])) + [(ids[130], x) for x in ids[131:180]] + [
        (rng.choice(ids[200:]), rng.choice(ids[200:])) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame([(a, b) for a, b in links] + [(None, 1)], "a long, b long")
    want = union(300, links)
    got = {r.id: r.component for r in components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(df.limit(0)).isEmpty()


def test_blocks_meet_every_pair_once(spark):
    rows = [(k, i, i % 3) for k, size in ((1, 40), (2, 7), (3, 2), (4, 1)) for i in range(size)]
    left = spark.createDataFrame(rows, "key long, id long, comp long")

    def both(batch: pa.RecordBatch, x, y):
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        return key[x] * 1000 + ids[x], key[y] * 1000 + ids[y]

    got = sorted((r.a, r.b) for r in map_pairs(blocked(left, 6), both).collect())
    want = sorted((k * 1000 + i, k * 1000 + j) for k, i, ci in rows for q, j, cj in rows if k == q and i < j and ci != cj)
    assert got == want


def test_words_longer_than_a_chunk_and_at_its_edges():
    for text in ["x" * (3 << 20) + " y", ("ab " * 400_000) + "tail", "q" * ((1 << 19) - 1) + " zz " + "q" * 10, ""]:
        data, off = C.text_bytes(pa.array([text, None, text]))
        h, row, s, e = C.word_hashes(data, off, C.SPACE_WORDS, spans=True)
        words = text.split()
        assert len(h) == 2 * len(words) and [e[i] - s[i] for i in range(min(5, len(words)))] == [len(w) for w in words[:5]]
        assert (h[:len(words)] == h[len(words):]).all()
        assert len(np.unique(h)) == len(set(words))
