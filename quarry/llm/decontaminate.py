"""Operator 3: benchmark decontamination with a generalised suffix automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A
window is `length` consecutive words of an item; an item of fewer words (but
not none) is one window. Training words are streamed through the automaton of
all items, which tracks the longest match that ends at each word: a match of
`length` words or more ends a window, and a shorter item ends where its state
lies on the suffix chain of the match. Words inside any occurrence are hit; a
document is contaminated when its hits reach the coverage limit.

Scale. Items are cut into pieces (overlapping by length - 1 words, so no window
is lost) and dealt to shards of at most about SHARD_WORDS words; each shard's
automaton is built in an executor, written to the shared folder and broadcast
alone: its size is bounded whatever the size of the benchmark. One shard is
the usual case and judges documents in a narrow pass with no shuffle; further
shards are further passes whose hits (of hit documents only) are merged by
document. Word pairs that no item contains end a match, so only runs of known
pairs are streamed through the automaton.

Defined cases: null and empty texts have no words, no hits and are clean; items
without words or with a null id are ignored, an empty benchmark hits nothing;
items with one id count once; repeated rows each get their verdict; extra
columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 13
PIECE_WORDS = 20_000
SHARD_WORDS = 250_000

SPANS = "array<struct<start:int,end:int>>"
HITS = f"struct<n_words:bigint,spans:{SPANS},items:array<string>>"


class Automaton:
    """Generalised suffix automaton over word hashes, with window marks."""

    def __init__(self, pieces: list[tuple[str, np.ndarray]], length: int):
        self.length = length
        self.vocab = np.unique(np.concatenate([w for _, w in pieces])) if pieces else np.zeros(0, np.uint64)
        texts = [(i, np.searchsorted(self.vocab, w).tolist()) for i, w in pieces]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self.full: dict[int, set] = {}    # state of a full window -> its items
        self.short: dict[int, list] = {}  # state -> [(words, items)] of items shorter than a window
        for i, t in texts:
            v = 0
            for n, c in enumerate(t, 1):
                v = self.next[v][c]
                if n >= length:
                    self.full.setdefault(self._anchor(v), set()).add(i)
            if len(t) < length:
                at = self.short.setdefault(v, [])
                same = [s for n, s in at if n == len(t)]
                same[0].add(i) if same else at.append((len(t), {i}))
        self.shortest = min([length] + [len(t) for _, t in texts])
        pairs = [np.asarray(t[:-1], np.int64) * len(self.vocab) + np.asarray(t[1:], np.int64) for _, t in texts if len(t) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter strings that end at p followed by c."""
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _anchor(self, v: int) -> int:
        """The state of the last `length` words of a match that ends in v."""
        while self.len[self.link[v]] >= self.length:
            v = self.link[v]
        return v

    def runs(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers (-1: in no item), and the runs [a, b) that could hold a window."""
        n = len(words)
        if not n or not len(self.vocab):
            return np.zeros(0, np.int64), []
        tok = np.searchsorted(self.vocab, words)
        tok[tok == len(self.vocab)] = 0
        tok = np.where(self.vocab[tok] == words, tok, -1)
        joined = np.zeros(n, bool)  # a match can go on from the word before
        if len(self.pairs):
            cand = np.flatnonzero((tok[1:] >= 0) & (tok[:-1] >= 0) & (row[1:] == row[:-1]))
            key = tok[cand] * len(self.vocab) + tok[cand + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[cand[self.pairs[at] == key] + 1] = True
        starts = np.flatnonzero((tok >= 0) & ~joined)
        nxt = np.append(joined[1:], False)
        ends = np.flatnonzero((tok >= 0) & ~nxt) + 1
        long = ends - starts >= self.shortest
        return tok, list(zip(starts[long].tolist(), ends[long].tolist()))

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int, set]]:
        """(position, words, items) of the windows that end at each position."""
        v = matched = 0
        for at, c in enumerate(tokens):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            if matched >= self.length:
                yield at, self.length, self.full[self._anchor(v)]
            if self.short:
                u = v
                while u > 0:
                    for n, items in self.short.get(u, ()):
                        if n <= matched:
                            yield at, n, items
                    u = self.link[u]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _judge(col: pa.Array, auto: Automaton) -> pa.Array:
    data, off = C.text_bytes(col)
    words, row = C.word_hashes(data, off, C.ALNUM_WORDS)
    n = np.bincount(row, minlength=len(col))
    first = np.concatenate([[0], np.cumsum(n)])
    tok, runs = auto.runs(words, row)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for a, b in runs:
        r = int(row[a])
        base = a - int(first[r])
        for at, k, found in auto.stream(tok[a:b].tolist()):
            spans.setdefault(r, []).append((base + at - k + 1, base + at + 1))
            items.setdefault(r, set()).update(found)
    return pa.StructArray.from_arrays([
        pa.array(n.astype(np.int64)),
        pa.array([[{"start": a, "end": b} for a, b in merge_spans(spans[i])] if i in spans else []
                  for i in range(len(col))], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(items.get(i, ())) for i in range(len(col))], pa.list_(pa.string())),
    ], names=["n_words", "spans", "items"])


def _shard_udf(auto):
    """Arrow function text -> hits for one broadcast automaton."""
    def hits(text: pa.Array) -> pa.Array:
        return _judge(text, auto.value)
    hits.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(hits, returnType=HITS)


def build_shards(items: DataFrame, length: int = LENGTH) -> Iterator[Automaton]:
    """Automata of bounded size, one per shard of items(item_id, text)."""
    def cut(batches):
        for b in batches:
            data, off = C.text_bytes(b.column("text"))
            words, row = C.word_hashes(data, off, C.ALNUM_WORDS)
            bound = np.searchsorted(row, np.arange(b.num_rows + 1))
            ids, pieces = [], []
            for i, item in enumerate(b.column("item_id").to_pylist()):
                w = words[bound[i]:bound[i + 1]]
                for lo in range(0, max(1, len(w) - length + 1), PIECE_WORDS):
                    if len(w):
                        ids.append(item)
                        pieces.append(w[lo:lo + PIECE_WORDS + length - 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.list_(pa.int64()))],
                                             names=["item", "words"])

    pieces = C.pin(items.where("item_id is not null").select(F.col("item_id").cast("string"), "text")
                   .mapInArrow(cut, "item string, words array<bigint>"))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-2 * total // SHARD_WORDS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        auto = Automaton([(i, np.asarray(w, np.int64).view(np.uint64)) for i, w in zip(pdf["item"], pdf["words"])], length)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "automaton": [pickle.dumps(auto, protocol=5)]})

    path = C.scratch_path(items.sparkSession, "automata")
    (pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
     .groupBy("shard").applyInPandas(build, "shard bigint, automaton binary").write.parquet(path))
    built = items.sparkSession.read.parquet(path)
    for row in built.select("shard").sort("shard").toLocalIterator():
        yield pickle.loads(built.where(F.col("shard") == row.shard).first().automaton)  # one bounded shard at a time


def annotate(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with one more column `_hits`: struct(n_words, spans in words, items)."""
    sc = docs.sparkSession.sparkContext
    shards = build_shards(items, length)
    none = Automaton([], length)
    out = docs.withColumn("_hits", _shard_udf(sc.broadcast(next(shards, none)))("text"))
    rest = None
    for auto in shards:
        found = C.pin(docs.select("doc_id", F.xxhash64("text").alias("_th"), _shard_udf(sc.broadcast(auto))("text").alias("h"))
                      .where("size(h.items) > 0").distinct())
        rest = found if rest is None else rest.unionAll(found)
    if rest is None:
        return out

    def union(spans: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in merge_spans([(x["start"], x["end"]) for x in s or []])]
                         for s in spans.to_pylist()], kind)
    union.__annotations__ = {"spans": pa.Array, "return": pa.Array}
    merged = rest.groupBy(F.col("doc_id").alias("_id"), "_th").agg(
        F.flatten(F.collect_list("h.spans")).alias("_spans"), F.flatten(F.collect_list("h.items")).alias("_items"))
    j = out.join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    none_s, none_i = F.array().cast(SPANS), F.array().cast("array<string>")
    return j.withColumn("_hits", F.struct(
        F.col("_hits.n_words").alias("n_words"),
        F.arrow_udf(union, returnType=SPANS)(F.concat("_hits.spans", F.coalesce("_spans", none_s))).alias("spans"),
        F.array_distinct(F.concat("_hits.items", F.coalesce("_items", none_i))).alias("items"),
    )).select(*docs.columns, "_hits")


def n_hit(hits: str = "_hits"):
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))


def is_contaminated(hits: str = "_hits", coverage_inverse: int = 20):
    return (n_hit(hits) > 0) & (coverage_inverse * n_hit(hits) >= F.col(f"{hits}.n_words"))


def judge(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row."""
    a = annotate(docs.select("doc_id", "text"), items, length).select("doc_id", "_hits")
    return a.select(
        "doc_id", F.col("_hits.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_hits.items"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"), F.col("_hits.spans").alias("spans"))


def _cut_words(text: pa.Array, spans: pa.Array) -> pa.Array:
    data, off = C.text_bytes(text)
    _, row, starts, ends = C.word_hashes(data, off, C.ALNUM_WORDS, spans=True)
    first = np.searchsorted(row, np.arange(len(text) + 1))
    out = []
    for i, (t, sp) in enumerate(zip(text.to_pylist(), spans.to_pylist())):
        if not sp:
            out.append(t)
            continue
        raw, base = t.encode(), int(off[i])
        s, e = starts[first[i]:first[i + 1]] - base, ends[first[i]:first[i + 1]] - base
        pieces, at = [], 0
        for x in sp:
            pieces.append(raw[at:s[x["start"]]])
            at = int(e[x["end"] - 1])
        pieces.append(raw[at:])
        out.append(b"".join(pieces).decode())
    return pa.array(out, pa.string())


_cut_words.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH, cut: bool = False) -> DataFrame:
    """docs (all columns) without the documents over the coverage limit.

    ``cut`` also removes the hit spans of the documents that stay, word for
    word; otherwise documents below the limit are returned unchanged.
    """
    own = ["doc_id", "text"]
    a = annotate(C.packed(docs, own), items, length).where(~is_contaminated())
    if cut:
        a = a.withColumn("text", F.when(F.size("_hits.spans") > 0, F.arrow_udf(_cut_words, returnType="string")(
            "text", "_hits.spans")).otherwise(F.col("text")))
    return C.unpacked(a, docs.columns, own)


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM it WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM low, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, n, i FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT low.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN c USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@C.query("op3_decontaminate", SQL)
def op3(spark, sf_dir):
    """Every document against every benchmark item."""
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("spans")
