"""Documents to packed training pieces: the stages in order, each written and reread.

Documents go when their language is not known, their quality is low, or a near copy of
them stays; personal data are replaced by their kind; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import dart_minhash, personal_data, queries
from regionflow.session import cut_lineage, temporary_tables

#: Below this mean probability a language counts as not known.
LEAST_LANGUAGE_SCORE = 0.4


def beside(docs: DataFrame, added: set[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change(docs)`` with the columns of ``docs`` alone, also where one is named as an added one."""
    away = {c: f"__own_{c}" for c in docs.columns if c in added}
    made = change(docs.withColumnsRenamed(away))
    return made.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    def known(rows: DataFrame) -> DataFrame:
        return queries.identified(spark, sf_dir, rows).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))

    return beside(docs, {"lang_pred", "score"}, known)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    return beside(docs, {"score", "predicted"}, lambda rows: queries.scored_quality(spark, sf_dir, rows).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return beside(docs, {"near_key", "near_null", "near_hash"}, dart_minhash.without_copies)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced, and their new lengths."""
    model = personal_data.learn(docs)

    def clean(rows: DataFrame) -> DataFrame:
        length = F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return personal_data.find(rows, model, redacted="text").withColumn("n_chars", length.cast("long"))

    return beside(docs, {"found"}, clean)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 1024 tokens."""
    return queries.packed_pieces(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal),
    ("packing", packing),
]

#: Models and sketches are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary_tables(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))
