"""Named queries and their SQL restatements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.session import without_leftovers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same with their own plans, before what they store is tidied up.
BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        BUILDS[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        QUERIES[name] = lambda spark, sf_dir: without_leftovers(spark, lambda: BUILDS[name](spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, whatever they were."""
    wide = {
        f.name: F.col(f.name).cast("bigint" if isinstance(f.dataType, T.IntegralType) else "double")
        for f in df.schema
        if isinstance(f.dataType, (T.IntegralType, T.DecimalType, T.FloatType))
    }
    return df.withColumns(wide) if wide else df
