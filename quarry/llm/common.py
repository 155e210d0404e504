"""Shared helpers: session settings, byte-level word hashing over Arrow batches, a query registry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, configure, pin, scratch_path  # noqa: F401  (re-exported)

# Text bytes in one Arrow batch: what bounds the memory of a Python worker.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the thin query of one operator, and its DuckDB twin where SQL can say it."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def prepare(spark: SparkSession) -> None:
    """Library settings, with Arrow batches bounded by bytes as well as rows."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, own: list[str]) -> DataFrame:
    """docs with its columns besides ``own`` in one struct, ``others``, so that no helper column can clash with them."""
    more = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(more or [F.lit(0).alias("none")])).alias("others"))


def unpacked(docs: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    """The columns of a table that was ``packed``, in their order."""
    return docs.select(*[F.col(c) if c in own else F.col(f"others.`{c}`").alias(c) for c in columns])


def fold_ascii(col):
    """A-Z to a-z and nothing else (``lower`` would also fold other alphabets)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- byte-level words ---------------------------------------------------------

U64 = np.uint64
_SPAN = 1 << 19  # positions whose limb sums stay below 2^64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = byte_class(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased)
ALNUM_WORDS = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

# Polynomial hashes modulo the prime 2^61 - 1: two different texts of n characters share
# a value for at most n of all bases (modulo 2^64 whole families of texts would collide).
_P = U64((1 << 61) - 1)
_BASE = int(np.random.default_rng(20240229).integers(1 << 60, (1 << 61) - 2))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 by 31-bit halves (2^62 is 2 there, 2^61 is 1)."""
    low, cut = U64((1 << 31) - 1), U64(31)
    a1, a0, b1, b0 = a >> cut, a & low, b >> cut, b & low
    mid = a1 * b0 + a0 * b1
    return _reduced(U64(2) * (a1 * b1) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << cut) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(n, np.uint64), 1
    while step < n:
        more = min(step, n - step)
        out[step:step + more] = _times(out[:more], np.full(more, pow(base, step, int(_P)), np.uint64))
        step += more
    return out


def _tables(n: int) -> None:
    """Powers of the base for n positions, as limbs of 31 bits, and their inverses."""
    global _POW, _INV
    power = _powers(_BASE, n)
    _POW = [power & U64((1 << 31) - 1), power >> U64(31)]
    _INV = _powers(pow(_BASE, -1, int(_P)), n + 1)


_tables(_SPAN)


class Prefix:
    """Sums of (byte + 1) * base^position up to every position, modulo 2^61 - 1."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n > len(_POW[0]):  # a single row can be longer than a span
            _tables(2 * n)
        codes = data.astype(np.uint64) + U64(1)
        self.sums = np.zeros((2, n + 1), np.uint64)
        self.carry = np.zeros(max(1, -(-n // _SPAN)), np.uint64)
        for b, lo in enumerate(range(0, n, _SPAN)):
            hi = min(n, lo + _SPAN)
            for k, power in enumerate(_POW):
                np.cumsum(codes[lo:hi] * power[lo:hi], out=self.sums[k, lo + 1:hi + 1])
            if hi < n:
                self.carry[b + 1] = self.at(np.array([hi]))[0]

    def at(self, e: np.ndarray) -> np.ndarray:
        low, high = (_reduced(x[e]) for x in self.sums)
        high = ((high << U64(31)) & _P) | (high >> U64(30))  # times 2^31: a rotation of 61 bits
        return _reduced(low + high + self.carry[np.maximum(e - 1, 0) // _SPAN])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    a = col.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def span_hash(h: Prefix, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the spans [s, e) of one run of codes, equal for equal contents wherever they stand."""
    own = _times(_reduced(h.at(e) + _P - h.at(s)), _INV[s])
    return mix(own + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray, spans: bool = False,
                fold: bool = True) -> tuple[np.ndarray, ...]:
    """Hashes of all words (A-Z folded unless told otherwise) and the index of each one's row.

    Words never cross rows; equal words have equal hashes wherever they stand
    and however long they are. ``spans`` adds byte starts and ends.
    """
    folded = _LOWER[data] if fold else data
    mask = inside[folded]
    edge = np.zeros(len(mask), bool)
    edge[1:] = mask[:-1]
    edge[off[:-1][off[:-1] < len(mask)]] = False
    starts = np.flatnonzero(mask & ~edge)
    edge[:] = False
    edge[:-1] = mask[1:]
    edge[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(mask & ~edge) + 1
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # runs of words that lie within _SPAN bytes, or one longer word, share their sums
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        h = Prefix(folded[base:ends[j - 1]])
        out[i:j] = span_hash(h, starts[i:j] - base, ends[i:j] - base)
        i = j
    row = np.searchsorted(off, starts, "right") - 1
    return (out, row, starts, ends) if spans else (out, row)


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each one's row; a row of fewer words is one shingle."""
    count = np.bincount(row, minlength=n_rows)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.copy()
    n = len(words)
    for j in range(1, k):
        h[:n - j] = mix(h[:n - j] * U64(31) + words[j:])
    end = np.cumsum(count)
    whole = end[row] - np.arange(n) >= k
    out, rows = h[whole], row[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = end[short] - count[short]
        acc = mix(words[at] + U64(0xA5A5))
        for j in range(1, k):
            more = count[short] > j
            acc[more] = mix(acc[more] * U64(37) + words[at[more] + j])
        out, rows = np.concatenate([out, acc]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def distinct_sets(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: (values, offsets). ``row`` ascends."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    parts, sizes = [], np.zeros(n_rows + 1, np.int64)
    for i in range(n_rows):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            continue
        s = np.sort(h[a:b])
        if b - a > 1:
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        parts.append(s)
        sizes[i + 1] = len(s)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return values, np.cumsum(sizes)
