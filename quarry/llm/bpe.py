"""Operator 6: token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's special strings (one token each), each piece
is cut into pretokens by the vocabulary's pattern, and each pretoken's bytes
are merged: a heap holds the adjacent pairs by rank, a linked list the symbols;
the lowest-ranked pair (leftmost first) is popped and merged until none is
left. The count is initial symbols less merges; no identifiers are made.

Scale. Counting is a narrow pass over the text column alone; the merge table
(one entry per merge of the vocabulary file) is broadcast. Each Python worker
remembers the counts of short pretokens in a bounded table. A pretoken of n
bytes costs O(n log n), so long runs without blanks are no special case.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
each get a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LIMIT = 1024
_REMEMBER = 400_000  # pretokens a worker remembers
_REMEMBER_CHARS = 40

# The public pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def load(path: str) -> tuple[list[int], dict[int, tuple[int, int]], list[str]]:
    """(symbol of each byte, pair -> (rank, merged symbol), special strings) of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names: dict[str, int] = {}
    number = lambda s: names.setdefault(s, len(names))
    start = [number(s) for s in byte_symbols()]
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[number(a) << 32 | number(b)] = (rank, number(a + b))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
        raise ValueError("special strings with stripping or word rules are not supported")
    if not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only byte-level vocabularies with the usual pattern are supported")
    return start, merges, special


def merged_size(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        m = merges.get(symbols[i] << 32 | symbols[i + 1])
        if m:
            heap.append((m[0], i, m[1]))
    heapq.heapify(heap)
    gone = [False] * n
    count = n
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = right[i]
        if gone[i] or j >= n:
            continue
        now = merges.get(symbols[i] << 32 | symbols[j])
        if now is None or now[0] != rank:  # one of the two was merged meanwhile
            continue
        symbols[i] = new
        gone[j] = True
        count -= 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            m = merges.get(new << 32 | symbols[k])
            if m:
                heapq.heappush(heap, (m[0], i, m[1]))
        h = left[i]
        if h >= 0:
            m = merges.get(symbols[h] << 32 | new)
            if m:
                heapq.heappush(heap, (m[0], h, m[1]))
    return count


class Counts(dict):
    """Pretoken -> tokens; computes what it does not hold."""

    def __init__(self, start, merges, special):
        import regex
        self.start, self.merges = start, merges
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, token: str) -> int:
        start = self.start
        n = merged_size([start[b] for b in token.encode()], self.merges)
        if len(token) <= _REMEMBER_CHARS:
            if len(self) >= _REMEMBER:
                self.clear()
            self[token] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        special = self.special.findall(text) if self.special else []
        pieces = self.special.split(text) if special else [text]
        n = len(special)
        for p in pieces:
            if len(p) < 1 << 20:
                n += sum(map(self.__getitem__, self.pattern.findall(p)))
            else:
                it = (m.group() for m in self.pattern.finditer(p))
                while chunk := list(islice(it, 100_000)):
                    n += sum(map(self.__getitem__, chunk))
        return n


def counter(spark, path: str):
    """Arrow function text -> tokens for the vocabulary file at ``path``."""
    model = spark.sparkContext.broadcast(Counts(*load(path)))

    def tokens(text: pa.Array) -> pa.Array:
        counts = model.value  # one per worker, which keeps what it has counted
        return pa.array([counts.count(t) for t in text.to_pylist()], pa.int64())

    tokens.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(tokens, returnType="bigint")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text)."""
    n = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    counter(docs.sparkSession, path)("text").alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


@C.query("op6_token_counts")
def op6(spark, sf_dir):
    """Tokens of every whole document, as the 50k byte-level vocabulary counts them."""
    import public_tokenizers
    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
