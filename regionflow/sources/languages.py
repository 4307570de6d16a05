"""Language names as small fixed dimensions (13 and 38 rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import code_as_name


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.LANGUAGES, "code string, name string")


def mt_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.MT_LANGUAGES, "code string, name string, chinese_name string")


def with_language_name(df: DataFrame, code: str) -> DataFrame:
    """Name of a target language; an unknown code is capitalised.

    The dimension has a fixed number of rows, so it is broadcast.
    """
    names = languages(df.sparkSession).select(F.col("code").alias("__code"), "name")
    return (
        df.join(F.broadcast(names), F.col(code) == F.col("__code"), "left")
        .withColumn("language", F.coalesce("name", code_as_name(code)))
        .drop("__code", "name")
    )


def with_mt_names(df: DataFrame, code: str) -> DataFrame:
    """English and Chinese name of a machine-translation target."""
    names = mt_languages(df.sparkSession).withColumnRenamed("code", "__code")
    fallback: Column = code_as_name(code)
    return (
        df.join(F.broadcast(names), F.col(code) == F.col("__code"), "left")
        .withColumns({
            "language": F.coalesce("name", fallback),
            "chinese_name": F.coalesce("chinese_name", fallback),
            "chinese_prompt": F.col(code).isin(C.CHINESE_TARGETS),
        })
        .drop("__code", "name")
    )
