"""Operator 4: mixing sources to target weights by capped water-filling.

A document's size is its number of words (`[^\\x20\\x09-\\x0D]+`). Sources in
code-point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes.
A source is used at most MAX_EPOCHS times: while a share is above that, it is
clamped and the excess is shared again by weight among the others. A source's
target is then met by whole repetitions of all its documents and one fractional
repetition: documents in a seeded order, up to the words that are left; the last
of them gives only its first words, so that the source's taken words equal its
rounded target.

Scale. The driver sees one pair of sums per water-filling round; sources are
numbered by a range partitioning, not in one task. The fractional repetition
never sorts a source: words are added up in HASH_BUCKETS slices of the seeded
order, the slice in which the target falls is found from these sums, and only
its documents are ranked. What is left is one threshold per source, joined to
the documents by broadcast below SOURCES_BROADCAST sources, by a shuffle join
beyond, so texts are not sorted or grouped.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null
source is a source; an empty table gives no rows; rows that repeat one doc_id
and size share their part of the fractional repetition evenly (rounded down);
extra columns are kept by `mixed`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import dense_number
from . import common as C

MAX_EPOCHS = 3
HASH_DIGITS = 3  # hexadecimal digits of the seeded hash that number a slice: 4,096 slices
SOURCES_BROADCAST = 200_000
SEED = "mix"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of sized(source, size): capped water-filling."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = dense_number(per.withColumn("_last", F.col("source").isNull()), ["_last", "source"], F.lit(-1), "rank")
    per = C.pin(per.select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight")))
    cap = F.col("source_size") * max_epochs
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, share = -1.0, 0.0
    while share != level:  # each round clamps at least one more source, or ends
        level = share
        over = F.lit(level) * F.col("weight") > cap
        capped, free = per.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
                               F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        share = float(total - capped) / free if free else level
    return per.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def plan(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with `_size, _source_size, _target, _whole, _part`: whole copies and words of the fractional one."""
    narrow = C.pin(docs.select("doc_id", "source", words().alias("size"), seeded(seed).alias("h")))
    goal = F.floor(F.col("target") + 0.5)
    per = targets(narrow, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))).withColumn(
        "rest", goal - F.col("whole") * F.col("source_size"))
    per = C.pin(per)
    small = per.count() <= SOURCES_BROADCAST

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    # the slice of the seeded order in which the words that are left run out
    cell = F.substring("h", 1, HASH_DIGITS)
    sums = narrow.where("size > 0").groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))
    edge = (with_source(sums.withColumn("before", upto - F.col("n")), per.select("source", "rest"))
            .where("before <= rest and rest < before + n").select("source", "cell", "before"))
    per = C.pin(with_source(per, edge))
    # its documents in order: the first one that is not taken whole, and the words it gives
    inside = (with_source(narrow.where("size > 0"), per.select("source", F.col("cell").alias("_cell"), "before", "rest"))
              .where(cell == F.col("_cell"))
              .groupBy("source", "before", "rest", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")))
    upto = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("source").orderBy("h", "doc_id", "size"))
    left = F.col("rest") - F.col("before") - (upto - F.col("size") * F.col("rows"))
    stop = (inside.withColumn("left", left).where(F.col("left") < F.col("size") * F.col("rows"))
            .groupBy("source").agg(F.min_by(F.struct("h", "doc_id", "size", F.floor(F.col("left") / F.col("rows")).alias("part")),
                                            F.struct("h", "doc_id", "size")).alias("stop")))
    per = C.pin(with_source(per.select("source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                                       F.col("whole").alias("_whole")), stop.withColumnRenamed("stop", "_stop")))
    out = with_source(docs.withColumn("_size", words()), per)
    here = F.struct(seeded(seed).alias("h"), F.col("doc_id"), F.col("_size").alias("size"))
    stop_at = F.struct(F.col("_stop.h").alias("h"), F.col("_stop.doc_id").alias("doc_id"), F.col("_stop.size").alias("size"))
    part = (F.when(F.col("_stop").isNull() | (here > stop_at), 0).when(here < stop_at, F.col("_size"))
            .otherwise(F.col("_stop.part")))
    return out.withColumn("_part", part.cast("long")).drop("_stop")


def _first_words(text: pa.Array, n: pa.Array) -> pa.Array:
    out = []
    for t, k in zip(text.to_pylist(), n.to_pylist()):
        if t is not None:
            raw = t.encode()
            data, off = C.text_bytes(pa.array([t], pa.string()))
            ends = C.word_hashes(data, off, C.SPACE_WORDS, spans=True)[3]
            t = raw[:int(ends[k - 1])].decode() if 0 < k <= len(ends) else t
        out.append(t)
    return pa.array(out, pa.string())


_first_words.__annotations__ = {"text": pa.Array, "n": pa.Array, "return": pa.Array}


def mixed(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: a row of docs (all columns) for each repetition, numbered by one more column `copy`
    (`copy_` and so on where docs has a column of that name).

    The one document a source that ends its fractional repetition is cut after
    the words it gives; n_chars, where the table has it, follows.
    """
    own = ["doc_id", "source", "text"] + (["n_chars"] if "n_chars" in docs.columns else [])
    number = "copy"
    while number in docs.columns:
        number += "_"
    p = plan(C.packed(docs, own), seed, max_epochs)
    copies = (F.col("_whole") + (F.col("_part") > 0).cast("long")).cast("int")
    cut = (F.col("copy") > F.col("_whole")) & (F.col("_part") < F.col("_size"))
    p = (p.where((F.col("_size") > 0) & (copies > 0))
         .withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
         .withColumn("_cut", F.arrow_udf(_first_words, returnType="string")(F.when(cut, F.col("text")), "_part")))
    if "n_chars" in docs.columns:
        p = p.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(
            F.char_length("_cut").cast(docs.schema["n_chars"].dataType)))
    p = p.withColumn("text", F.coalesce("_cut", "text"))
    return p.select(*[F.col(c) if c in own else F.col(f"others.`{c}`").alias(c) for c in docs.columns], F.col("copy").alias(number))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
fill(k, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, (SELECT (SUM(source_size) - coalesce(SUM(3 * source_size) FILTER (fill.level * w > 3 * source_size), 0))::DOUBLE
                        / SUM(w) FILTER (fill.level * w <= 3 * source_size) FROM s) FROM fill WHERE k < (SELECT count(*) + 1 FROM s)),
t AS (SELECT source, source_size, least(w * (SELECT arg_max(level, k) FROM fill WHERE level IS NOT NULL), (3 * source_size)::DOUBLE) AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.h, p.*, floor(target + 0.5)::BIGINT - whole * source_size AS rest,
    sum(d.size) OVER (PARTITION BY p.source ORDER BY d.h, d.doc_id, d.size)::BIGINT AS upto,
    count(*) OVER (PARTITION BY p.source, d.h, d.doc_id, d.size) AS c
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, (rest - (upto - size * c)) // c))::BIGINT AS taken FROM r
"""


@C.query("op4_mix", SQL)
def op4(spark, sf_dir):
    """Every document: its size, its source's size and target, and the words that the mix takes of it."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                             F.col("_target").alias("target"), (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"))
