"""The pipeline against a plain version of its stages, and its queries against the registry."""
import collections
import re

import corpus_pipeline as P
from quarry.llm import common as C
from quarry.llm import linededup
from quarry.llm.queries import QUERIES


def test_one_query_per_operator():
    numbers = collections.Counter(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == {n: 1 for n in range(1, 14)}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def smallest(nodes, links):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_stages_equal_a_plain_version(spark, tmp_path):
    src = C.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in src.collect()]
    long = next(r for r in rows if len(r[1].split("\n")) > 1 and len(r[1].split()) > 200)
    words = long[1].split(" ")
    rows += [(90_000, None, "en", "src0", 0), (90_001, "123 !!", "en", "src0", 6), (90_002, long[1], "en", None, long[4]),
             (90_003, " ".join(words[:50] + ["changed"] + words[51:]), "en", "src1", 1)]
    spark.createDataFrame(rows, src.schema).write.parquet(f"{tmp_path}/documents.parquet")
    bench = C.table(spark, "/root/testdata/sf0.001", "benchmark")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = C.pin(stage(spark, docs, str(tmp_path)))
        outs.append({r.doc_id: r for r in docs.collect()} if stage is not P.source_mix else docs.collect())
    for o in outs[:-1]:
        assert next(iter(o.values())).__fields__ == src.columns
    # language: only texts without a letter go
    assert set(outs[0]) == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    # lines
    occ = [(i, p, x.strip(" \t\r")) for i in sorted(outs[0]) for p, x in enumerate(outs[0][i].text.split("\n"))]
    occ = [o for o in occ if o[2]]
    names = sorted({x for *_, x in occ}, key=len)
    most = lambda n: 0 if n < 20 else 1 if n < 40 else 2 if n < 300 else n // 100
    bags = {x: collections.Counter(x) for x in names}
    links = [(a, b) for k, a in enumerate(names) if (m := most(len(a))) for b in names[k + 1:]
             if len(b) - len(a) <= m and sum((bags[a] - bags[b]).values()) <= m and linededup.within(a, b, m)]
    comp = smallest(names, links)
    first, gone = {}, collections.defaultdict(set)
    for i, p, x in occ:
        if first.setdefault(comp[x], (i, p)) != (i, p):
            gone[i].add(p)
    want = {}
    for i, r in outs[0].items():
        t = r.text if i not in gone else "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in gone[i])
        if i not in gone or t.strip(" \t\r\n"):
            want[i] = t
    assert {i: r.text for i, r in outs[1].items()} == want and gone
    # near copies
    sets = {i: shingles(r.text) for i, r in outs[1].items()}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = smallest(ids, near)
    assert set(outs[2]) == {i for i in ids if comp[i] == i}
    # benchmark
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = {tuple(w[j:j + min(13, len(w))]) for w in map(find, [r.text for r in bench.collect()]) if w for j in range(len(w) - min(13, len(w)) + 1)}
    sizes = {len(w) for w in wins}
    clean = set()
    for i, r in outs[2].items():
        ws = find(r.text)
        hit = {q for n in sizes for j in range(len(ws) - n + 1) if tuple(ws[j:j + n]) in wins for q in range(j, j + n)}
        if not hit or 20 * len(hit) < len(ws):
            clean.add(i)
    assert set(outs[3]) == clean and len(clean) < len(outs[2])
    # mix: every source comes to its target; whole copies but for one document a source
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, taken = collections.Counter(), collections.Counter()
    for r in outs[3].values():
        by[r.source] += size(r.text)
    cut = collections.Counter()
    for r in outs[4]:
        taken[r.source] += size(r.text)
        assert 1 <= r.copy <= 3 and outs[3][r.doc_id].text.startswith(r.text)
        cut[r.source] += r.text != outs[3][r.doc_id].text
    assert max(cut.values()) <= 1
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in capped]
        level = (sum(by.values()) - sum(3 * by[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    assert all(abs(taken[s] - (3 * by[s] if s in capped else level * weight[s])) <= 1 for s in order)
    assert P.run(spark, str(tmp_path)).count() == len(outs[4])
