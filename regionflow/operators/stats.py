"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regions_per_page(regions: DataFrame) -> DataFrame:
    return regions.groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("regions"))


def stage_timings(timings: DataFrame) -> DataFrame:
    """Milliseconds per stage plus a total row."""
    # A stage without a name stays a row of its own beside the total.
    summed = timings.rollup("stage").agg(F.sum("time_ms").alias("total_ms"), F.grouping("stage").alias("all"))
    return summed.withColumn("stage", F.when(F.col("all") == 1, "total").otherwise(F.col("stage"))).drop("all")


def call_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, total and mean time; zero when there was no call."""
    total = F.coalesce(F.sum("time_ms"), F.lit(0))
    n = F.count("time_ms")
    return calls.groupBy(*keys).agg(
        n.alias("calls"), total.alias("total_ms"),
        F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_ms"),
    )


def run_stats(
    pages: DataFrame, regions: DataFrame, lines: DataFrame, jobs: DataFrame, batch: int
) -> DataFrame:
    """One row per document; every part is counted on its own before the join."""
    def counted(df: DataFrame, **aggregates) -> DataFrame:
        return df.groupBy("doc_id").agg(*[v.alias(k) for k, v in aggregates.items()])

    one = F.lit(1)
    parts = [
        counted(pages, pages=F.count(one)),
        counted(
            regions,
            bubbles_detected=F.count_if(F.col("level") == 1),
            text_free_regions=F.count_if(F.col("level") == 2),
        ),
        counted(lines, ocr_lines=F.count(one)),
        counted(
            jobs, texts_to_translate=F.count(one), texts_l1=F.count_if(~F.col("is_l2")),
            texts_l2=F.count_if(F.col("is_l2")),
            translation_batches=F.ceil(F.count(one) / batch),
        ),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "doc_id", "left")
    return joined.fillna(0)


def backend_comparison(runs: DataFrame) -> DataFrame:
    """Time, lines and status per model."""
    return runs.groupBy("model").agg(
        F.sum("time_ms").alias("time_ms"), F.sum("line_count").alias("line_count"),
        F.when(F.count("error") > 0, "ERROR").otherwise("OK").alias("status"),
    )
