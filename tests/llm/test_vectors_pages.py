"""Vector, URL and archive operators against plain Python on small tables with the awkward rows."""
import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from quarry.llm import bloom, urls, vectors, warc
from quarry.llm import common as C


def test_vectors_equal_all_pairs(spark):
    C.prepare(spark)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base, base[:30] + 0.25 * rng.standard_normal((30, 64)), base[:5] * 3.0, base[:20] + 0.36 * rng.standard_normal((20, 64))])
    rows = [(i, [float(np.float32(x)) for x in r], int(i % 60 % 3), "x") for i, r in enumerate(v)]
    rows += [(200 + i, rows[0][1], 0, "x") for i in range(40)]  # exact copies
    rows += [(300, None, 0, "x"), (301, [], 0, "x"), (302, [0.0] * 64, 0, "x"), (303, [float("nan")] + [1.0] * 63, 0, "x"),
             (304, [1.0, None] + [1.0] * 62, 0, "x"), (305, rows[0][1], None, "x"), (306, rows[0][1][:32], 0, "x"), (307, rows[0][1], 1, "x"),
             (308, [float("inf")] * 64, 0, "x"), (309, [1e30] * 64, 2, "x"), (310, [1e-30] * 64, 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    good = {}
    for i, e, label, _ in rows:
        if e and label is not None and None not in e:
            x = np.array(e, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                good[i] = (label, x / np.abs(x).max())
    links = {i: set() for i, *_ in rows}
    for i, (li, x) in good.items():
        for j, (lj, y) in good.items():
            if i != j and li == lj and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i].add(j)
    comp = {i: i for i in links}
    for _ in links:
        for i in links:
            for j in links[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert sum(map(len, links.values())) > 1000 and vectors.near_duplicates(df.limit(0)).isEmpty()


def test_calibration_finds_pairs_at_the_limit():
    assert vectors.threshold(0.93) >= 2  # unrelated pairs that share one window are not verified


URLS = [None, "", "nothing", "http://EXAMPLE.org/es/1", "https://www.example.org/en/123?x=1#y", "http://a.b.example.org/en/2", "http://notexample.org/es/",
        "http://org/", "http://org", "http://x.com/fr/1", "http://x.com/de/1?utm_source=a", "http://x.com:80/de/1", "ftp://u@x.com/de/1/", "http://x.com./de/1",
        "http://x.com/en", "http://com/de/", "http://net/org/", "x://" + "a." * 3000 + "com/fr/", "http://x.net://y.org/", "http://x.com/de/1", "://org/z", "http://é.org/É\n?q"]


def judged_plainly(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3:]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules(spark):
    C.prepare(spark)
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    out = urls.judge(pages, rules).collect()
    assert len(out) == len(rows)
    listed = {"http://x.com:80/de/1", "ftp://u@x.com/de/1/", "http://x.com./de/1"}  # other spellings of a blocked page
    for r in out:
        u = URLS[r.page_id]
        host, path, rule = judged_plainly(u)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), u
        assert r.verdict == (rule[1] if rule else "block" if u in listed else "allow"), u
    assert urls.judge(pages.limit(0), rules).isEmpty()
    assert urls.judge(pages, rules.limit(0)).where("verdict = 'block'").isEmpty()
    more = spark.createDataFrame([("x.com/en",)], "canonical string")
    assert {r.page_id for r in urls.judge(pages, rules, more).where("verdict = 'block'").collect()} >= {URLS.index("http://x.com/en")}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 20_000).selectExpr("xxhash64(id) as k")
    words = bloom.build(keys, "k")
    k = np.array([r.k for r in keys.collect()])
    assert bloom.contains(k, words).all()
    assert bloom.contains(np.arange(50_000, dtype=np.int64), words).mean() < 0.02


@pytest.mark.parametrize("file_bytes,min_bytes", [(64 << 20, 0), (2000, 1)])
def test_warc_round_trip(spark, monkeypatch, file_bytes, min_bytes):
    C.prepare(spark)
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    rows = [(i, f"http://h/{i}", f"page {i % 7} é " * (i % 5 + 1)) for i in range(40)]
    rows += [(50, None, None), (51, "http://h/\r\nX: y", ""), (None, "http://h", "page"), (None, "http://h", "rare"), (3, rows[3][1], rows[3][2]), (52, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in warc.archive(pages, None, min_bytes).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= min_bytes else None
        again = i is not None and first is not None and i > first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(map(str, want))


def test_normaliser_reads_one_stream_and_indexes_members():
    whole = b"".join(warc.record("response", i, "http://u", bytes([65 + i]) * 10_000 * i, None) for i in range(5))
    target, index = io.BytesIO(), io.BytesIO()
    rows = list(warc.normalise(io.BytesIO(gzip.compress(whole[:5000]) + gzip.compress(whole[5000:])), target, index))
    raw = target.getvalue()
    assert b"".join(gzip.decompress(raw[o:o + n]) for o, n, *_ in rows) == whole == gzip.decompress(raw)
    assert len(index.getvalue().splitlines()) == 5


def test_empty_archive(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
