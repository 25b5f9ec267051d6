"""The corpus pipeline: five stages over ``documents``, each written and reread.

quality classifier -> exact dedup -> SimHash near-dedup -> mixing -> encoding.
Each stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last adds the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm import exact, kneser_ney, mixing, sentencepieces, simhash
from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, free_name, keep_keys, materialize, row_key, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity lies in the range of their language's trusted
    text (``labels`` with quality 1)."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = kneser_ney.quality(spark, docs, trusted)
    # A text is judged as text of its language, so the language is part of the key.
    name = free_name(docs, "_key")
    key = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rejected = judged.filter("not kept").select(F.concat("rk", F.lit("|"), key).alias(name)).distinct()
    rejected, _ = bounded_broadcast(materialize(spark, rejected, "quality_rejects"), BROADCAST_ROWS)
    keyed = docs.withColumn(name, F.concat(row_key(), F.lit("|"), key))
    return keyed.join(rejected, name, "left_anti").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return keep_keys(docs, exact.exact_dedup(spark, docs).filter("kept").select("rk"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (3-word shingles, 3 bits)."""
    return keep_keys(docs, simhash.simhash_dedup(spark, docs, shingle=3, max_bits=3).filter("kept").select("rk"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix has it: as many tokens as there are, the
    entropy of the sources half way to uniform, at most four repetitions."""
    mixed, _ = mixing.mix(spark, docs, entropy_part=0.5, max_repeats=4.0)
    return mixing.mixed_rows(mixed, docs.columns).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their token ids."""
    return sentencepieces.encode(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Learned and iterative stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
