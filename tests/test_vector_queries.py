"""The query batch of the k-NN queries: every vector takes part, none is passed over by its id."""
import numpy as np
import pytest

import __spark_entry__ as E

IDS = [0, 1, 2, 3, 4, 6, 9, 12, 13, 100, 101, 202]  # of 4, 6, 9 and 202 the other one of the two is missing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist(), 0) for i in IDS]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    docs = [(i, f"text {i}", "en", f"s{i % 2}", 6) for i in sorted({i // 4 for i in IDS})]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at, {i: np.array(e, np.float32) for i, e, _ in rows}


def _distances(vectors):
    """{query: {id: distance}}: the mean of vectors 2i and 2i + 1, or the one that there is, against all."""
    unit = lambda x: x / np.linalg.norm(x)
    out = {}
    for q in {i // 2 for i in vectors}:
        two = [vectors[i].astype(float) for i in (2 * q, 2 * q + 1) if i in vectors]
        mean = np.mean(two, axis=0).astype(np.float32).astype(float)
        out[q] = {i: round(1 - unit(mean) @ unit(v.astype(float)), 12) for i, v in vectors.items()}
    return out


def test_knn_cosine_asks_with_every_vector(spark, tables):
    at, vectors = tables
    got = E.queries()["knn_cosine"](spark, at).collect()
    want = {(q, rn + 1): i for q, d in _distances(vectors).items() for rn, i in enumerate(sorted(d, key=lambda i: (d[i], i))[:10])}
    assert {(r.query_id, r.rn): r.id for r in got} == want and len(got) == len(want)


def test_similarity_by_source_asks_with_every_vector(spark, tables):
    at, vectors = tables
    got = E.queries()["similarity_by_source"](spark, at).collect()
    want = set()
    for q, d in _distances(vectors).items():
        for s in (0, 1):
            near = sorted((i for i in d if i // 4 % 2 == s), key=lambda i: (d[i], i))[:10]
            want |= {(q, i) for i in near if (i // 4) % 17 and (i // 4) % 23}  # pages that are not finished are left out afterwards
    assert {(r.query_id, r.id) for r in got} == want and len(got) == len(want)
