"""Document operators against plain Python on small tables with the awkward rows."""
import collections
import hashlib
import re

import numpy as np
import pytest

from quarry.llm import bpe, decontaminate, langid, linededup, minhash, mix, toxicity
from quarry.llm import common as C

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a", 7, "x"), (2, BASE, "en", "a", 7, "x"), (2, BASE, "en", "a", 7, "x"),
    (3, BASE.replace("alpha60", "beta"), "en", "b", 7, "x"), (4, None, "en", "b", 7, "x"), (5, "", None, None, 7, "x"),
    (6, "  \t \n ", "fr", None, 7, "x"), (7, "one", "fr", "c", 7, "x"), (8, "ONE", "fr", "c", 7, "x"), (9, "one two", None, "c", 7, "x"),
    (10, LONG, "en", "a", 7, "x"), (11, LONG + " tail", "en", "a", 7, "x"), (12, "é" * 5000, "fr", "d", 7, "x"),
    (13, "\n".join(["same line"] * 4 + ["x" * 60, "x" * 59 + "y", "y" * 60]), "en", "d", 7, "x"),
    (None, "one two three", "en", "a", 7, "x"), (14, "### $$$ 123", "en", "a", 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, component_id int, size string"


@pytest.fixture(scope="module")
def docs(spark):
    C.prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash_equals_all_pairs(docs, k, percent):
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(docs, k, percent).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    sets = {i: shingles(t, k) for i, t, *_ in ROWS if i is not None}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    comp[i] = min(comp[i], comp[j])
    want = {i: {(len(s), comp[i], comp[i] == i)} for i, s in sets.items()}
    want[None] = {(1, None, True)}
    assert got == want
    assert minhash.near_duplicates(docs, k, percent).count() == len(ROWS)
    assert minhash.keep_one(docs, k, percent).columns == docs.columns


def test_sketch_fills_every_coordinate():
    import numpy as np
    v = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = minhash.sketch(np.concatenate([v, v[:1], v[:0], v[:50]]), np.array([0, 59, 60, 60, 110]), 125)
    none = np.iinfo(np.uint64).max
    assert (s[[0, 1, 3]] != none).all() and (s[2] == none).all()
    assert abs((s[0] == s[3]).mean() - 50 / 59) < 0.15


def test_dense_group_of_unlinked_variants(spark):
    """Variants of one text, some linked only through others, in blocks smaller than the group."""
    import random
    rng = random.Random(3)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(160):
        ws = list(base)
        for _ in range(rng.randint(0, 9)):
            ws[rng.randrange(80)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(ws)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    old, minhash.BLOCK = minhash.BLOCK, 50
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 3, 85).collect()}
    finally:
        minhash.BLOCK = old
    sets = [shingles(t, 3) for _, t in rows]
    comp = list(range(160))
    links = [(i, j) for i in range(160) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in range(160):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == dict(enumerate(comp))
    assert len(set(comp)) > 2  # the case is not trivial


ITEMS = [(1, "alpha3 alpha4 Alpha5 alpha6 alpha7 alpha8 alpha9 alpha10 alpha11 alpha12 alpha13 alpha14 alpha15 alpha16 zz"),
         (2, "ONE two"), (10, "one two"), (3, None), (4, "..."), (None, "alpha1"), (5, "w5x5"), (6, " ".join(f"alpha{i}" for i in range(40, 53)))]


def judge_plainly(text):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = words(text), set(), set()
    for i, t in ITEMS:
        it = words(t)
        n = min(13, len(it))
        if i is None or not it:
            continue
        wins = {tuple(it[j:j + n]) for j in range(len(it) - n + 1)}
        for j in range(len(ws) - n + 1):
            if tuple(ws[j:j + n]) in wins:
                hit.update(range(j, j + n))
                found.add(str(i))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("shard_words", [250_000, 12])
def test_decontaminate_equals_plain_search(spark, docs, monkeypatch, shard_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in decontaminate.judge(docs, items).collect())
    assert got == sorted((str(i), *judge_plainly(t)) for i, t, *_ in ROWS)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not judge_plainly(t)[4] for _, t, *_ in ROWS)


def test_decontaminate_cuts_spans(spark):
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    filler = " ".join(["x"] * 60)
    d = spark.createDataFrame([(1, f"{filler}, b; C! {filler}"), (2, "a")], "doc_id long, text string")
    assert [r.text for r in decontaminate.decontaminate(d, items, cut=True).sort("doc_id").collect()] == [f"{filler}, ! {filler}", "a"]


def test_empty_benchmark(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(docs, items).where("n_hit > 0").count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_equals_edit_distance():
    import random
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) if rng.random() < .5 else a[:5] + rng.choice("ab") + a[6:]
        for t in (1, 2, 3):
            assert linededup.within(a, b, t) == (edit_distance(a, b) <= t)


def test_line_dedup_equals_plain(spark, docs):
    import random
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcde ") for _ in range(rng.randint(38, 50))).strip() for _ in range(40)]
    rows = [(r[0], r[1]) for r in ROWS]
    for i in range(100, 160):
        part = []
        for _ in range(5):
            s = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s))
                s = s[:at] + rng.choice(["", "z", s[at] + "q"]) + s[at + 1:]
            part.append(rng.choice(["", "  "]) + s)
        rows.append((i, "\n".join(part)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    occ = sorted({(i, p, x.strip(" \t\r")) for i, t in rows if i is not None and t is not None for p, x in enumerate(t.split("\n"))})
    occ = [o for o in occ if o[2]]
    names = sorted({x for *_, x in occ})
    comp = {x: k for k, x in enumerate(names)}
    most = lambda n: 0 if n < 20 else 1 if n < 40 else 2 if n < 300 else n // 100
    links = [(a, b) for a in names for b in names if a < b and (m := most(min(len(a), len(b)))) and linededup.within(a, b, m)]
    for _ in names:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    first = {}
    for i, p, x in occ:
        first.setdefault(comp[x], (i, p))
    gone = collections.defaultdict(set)
    for i, p, x in occ:
        if first[comp[x]] != (i, p):
            gone[i].add((p, first[comp[x]][0]))
    got = {r.doc_id: (r.n_removed, r.first_docs) for r in linededup.report(d).collect()}
    assert got == {i: (len(gone[i]), sorted({f for _, f in gone[i]})) if i is not None else (0, []) for i, _ in rows}
    assert sum(n for n, _ in got.values()) > 100
    left = {r.doc_id: r.text for r in linededup.drop_lines(d).collect()}
    for i, t in rows:
        if i is None or t is None or not gone[i]:
            assert left[i] == t
        else:
            rest = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in {p for p, _ in gone[i]})
            assert left.get(i, "").strip() == rest.strip()


def test_mix_meets_its_targets(docs):
    p = mix.plan(docs).collect()
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in p:
        taken = r._whole * r._size + r._part
        assert 0 <= taken <= 3 * r._size and r._size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        per[r.source][0] += r._size
        per[r.source][1] += taken
        per[r.source][2] = r._target
    names = sorted((s for s in per if s is not None)) + [None]
    total = sum(v[0] for v in per.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * per[s][0] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s][0]}
        if not over:
            break
        capped |= over
    for s in names:
        want = 3 * per[s][0] if s in capped else level * weight[s]
        assert abs(per[s][2] - want) < 1e-6 and abs(per[s][1] - want) <= 1.5
    out = mix.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert out.select(mix.words().alias("n")).agg({"n": "sum"}).first()[0] == sum(v[1] for v in per.values())
    assert sorted(map(str, mix.plan(docs).collect())) == sorted(map(str, p))


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "a<|endoftext|>b  <|endoftext|> x", "en", "a", 1, ""), (101, "ab" * 3000 + "  \n\t 12's", "en", "a", 1, "")], SCHEMA)
    for r in bpe.token_counts(docs.unionAll(extra).select("doc_id", "text"), path).join(docs.unionAll(extra).select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024)


def test_language_held_out_accuracy(spark):
    d = C.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(d).select(langid.held_out().alias("held"), "lang", "_lang.*")
    held = got.where("held")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 100
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_pieces_and_awkward_rows(spark, docs, monkeypatch):
    got = {r.doc_id: r._lang for r in langid.identify(docs).collect()}
    assert {i for i, p in got.items() if p.lang_pred == "und"} == {4, 5, 6, 14}
    assert all(got[i].score == 0 for i in (4, 5, 6, 14))
    monkeypatch.setattr(langid, "PIECE", 1000)
    whole = sorted((int(r), int(b)) for r, b in pairs(langid._grams(["ab c" * 900, None, "x"])))
    monkeypatch.setattr(langid, "PIECE", 1 << 19)
    assert whole == sorted((int(r), int(b)) for r, b in pairs(langid._grams(["ab c" * 900, None, "x"])))


def pairs(grams):
    for row, bucket in grams:
        yield from zip(row, bucket)


def test_language_without_labels(docs):
    from pyspark.sql import functions as F
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("_lang.*").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = C.table(spark, sf, "labels")
    got = toxicity.toxicity(C.table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    truth = sum(r.toxic for r in got)
    caught = sum(r.toxic and r.predicted for r in got)
    assert caught >= 0.9 * truth > 0
    assert sum(r.predicted and not r.toxic for r in got) <= 0.05 * (len(got) - truth)


def test_toxicity_swapped_terms_and_awkward_rows(spark, docs, monkeypatch):
    rows = [(i, f"{'muslim' if i % 2 else 'christian'} people said {'moron scum' if i % 2 else 'hello there'} n{i % 7}") for i in range(400)]
    d = spark.createDataFrame(rows + [(1000 + k, f"a {t} person") for k, t in enumerate(["muslim", "christian", "hindu"])] + [(2000, None), (2001, "")],
                              "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    assert abs(got[1000] - got[1001]) < 0.01  # the term itself is not what labels are about
    assert got[1] > 0.9 > 0.1 > got[2] and 0 <= got[2000] == got[2001] <= 1
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    assert abs(got[1000] - got[1001]) > 0.2  # without the penalty it would be
    assert max(r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()) < 1e-9


def test_empty_tables(spark, empty):
    import public_tokenizers
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert minhash.near_duplicates(empty).isEmpty() and linededup.report(empty).isEmpty() and linededup.drop_lines(empty).isEmpty()
    assert decontaminate.judge(empty, items).isEmpty() and mix.plan(empty).isEmpty() and mix.mixed(empty).isEmpty()
    assert langid.identify(empty).isEmpty() and bpe.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).isEmpty()
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).isEmpty()


def test_term_features_are_looked_up_once_for_all_documents(monkeypatch):
    """op5: the driver's work on swapped terms does not repeat the hashing of the terms for every document."""
    from quarry.llm import toxicity as tx
    terms = [t for kind in tx.IDENTITY for t in kind]
    ids = np.unique(np.concatenate([tx.term_features(t) for t in terms]))
    cols = np.searchsorted(ids, tx.term_features(terms[0]))
    calls, real = [], tx.term_features
    monkeypatch.setattr(tx, "term_features", lambda t: calls.append(t) or real(t))
    n = 500
    pair, col, val, k = tx.counterfactuals(np.repeat(np.arange(n), len(cols)), np.tile(cols, n), n, ids)
    one = tx.counterfactuals(np.zeros(len(cols), np.int64), cols, 1, ids)
    assert k == n * one[3] > 0 and len(col) == n * len(one[1]) and val.tolist() == one[2].tolist() * n
    assert len(calls) <= 4 * len(terms)
