"""A corpus pipeline over ``documents``: five stages, each one of the operators in ``quarry.llm``.

Each stage takes (spark, docs, sf_dir), with docs the whole output of its
predecessor, and returns a DataFrame. ``run`` writes every stage's output as
Parquet in the shared folder and reads it back as the next one's docs, so a
later stage never recomputes an earlier one; what a stage wrote in between is
deleted when its output stands.

Defined cases: an empty table gives an empty mix; documents without a letter
have no known language and leave at the first stage; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, decontaminate, langid, linededup, minhash, mix
from quarry.session import clear_scratch, scratch_mark, scratch_path

# The line and near-duplicate stages have no SQL twin; tests hold run() against a plain version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: the others have no text, no letter or no likely language."""
    common.prepare(spark)
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines at their first occurrence; documents of which no line is left go."""
    common.prepare(spark)
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at 0.8 on five-word shingles."""
    common.prepare(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items."""
    common.prepare(spark)
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The repetitions of each document that the target weights of the sources ask for."""
    common.prepare(spark)
    return mix.mixed(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, path = scratch_mark(spark), scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_scratch(spark, before, keep=(path,))
        docs = spark.read.parquet(path)
    return docs
