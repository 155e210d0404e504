"""Blocked Bloom filter over 64-bit keys: built by an aggregation, probed in Arrow batches.

Each key sets BITS bits inside one 512-bit block. The filter's size follows the
key count up to MAX_BLOCKS blocks (a fixed byte bound: what is broadcast); beyond
it the filter only passes more false positives, which callers remove by an
exact join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 6
MAX_BLOCKS = 1 << 17  # x 64 bytes = 8 MiB


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its BITS bit numbers (0..511) in that block."""
    h = C.mix(keys.astype(np.int64).view(np.uint64))
    block = (h & C.U64(blocks - 1)).astype(np.int64)
    g = C.mix(h ^ C.U64(0x5851F42D4C957F2D))
    bits = np.stack([(g >> C.U64(9 * j)).astype(np.int64) & 511 for j in range(BITS)], axis=1)
    return block, bits


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Filter words (blocks x 8) of all non-null keys: one OR-aggregated row per touched word."""
    n = keys.agg(F.approx_count_distinct(column)).first()[0]
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 512 < 16 * n:
        blocks *= 2

    def words(batches):
        for b in batches:
            block, bits = _places(b.column(0).to_numpy(zero_copy_only=False), blocks)
            at = (block[:, None] * 8 + (bits >> 6)).ravel()
            bit = (C.U64(1) << (bits & 63).astype(np.uint64)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], names=["at", "bit"])

    got = (keys.select(F.col(column).cast("long").alias("k")).where("k is not null").mapInArrow(words, "at bigint, bit bigint")
           .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(blocks * 8, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out.reshape(blocks, 8)


def contains(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = C.mix(keys.astype(np.int64).view(np.uint64))
    at = (h & C.U64(len(words) - 1)).astype(np.int64) * 8
    g = C.mix(h ^ C.U64(0x5851F42D4C957F2D))
    flat, live = words.ravel(), np.arange(len(keys))
    for j in range(BITS):
        b = (g >> C.U64(9 * j)) & C.U64(511)
        on = flat[at + (b >> C.U64(6)).astype(np.int64)] >> (b & C.U64(63)) & C.U64(1) != 0
        if not on.all():  # keys that miss a bit are looked up no further
            at, g, live = at[on], g[on], live[on]
    hit = np.zeros(len(keys), bool)
    hit[live] = True
    return hit


def maybe(spark, words: np.ndarray, key: Column) -> Column:
    """Condition: the key may be in the filter (a null key is not)."""
    shared = spark.sparkContext.broadcast(words)

    def probe(k: pa.Array) -> pa.Array:
        here = k.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(contains(k.fill_null(0).to_numpy(zero_copy_only=False), shared.value) & here)

    probe.__annotations__ = {"k": pa.Array, "return": pa.Array}
    return F.arrow_udf(probe, returnType="boolean")(key)
