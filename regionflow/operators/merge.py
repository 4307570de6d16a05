"""Lines of a region to one text, and texts to translation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions import geometry as G
from regionflow.functions.text import should_translate, strip
from regionflow.session import by_key

REGION = ["doc_id", "page_idx", "level", "bubble_idx"]


def collect_texts(texts: DataFrame) -> DataFrame:
    """Text items of every region in line order, with plain concatenation and the
    area of their boxes.

    ``texts``: region key, line_no, text and box x1, y1, x2, y2 (nullable).
    """
    item = F.struct("line_no", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    return (
        texts.groupBy(*REGION)
        .agg(
            F.array_sort(F.collect_list(item)).alias("items"),
            F.sum(G.positive_area("x1", "y1", "x2", "y2")).alias("text_area"),
        )
        .withColumn("original_text", concat_texts(F.col("items")))
    )


def concat_texts(items: Column) -> Column:
    return F.array_join(
        F.transform(items, lambda i: F.coalesce(i.getField("text"), F.lit(""))), ""
    )


def merged_text(items: Column, text_area: Column, region_area: Column) -> Column:
    """Trimmed non-empty texts; joined by newline when the boxes are single lines
    (or no region box is known), else run together."""
    kept = F.filter(
        F.transform(items, lambda i: strip(F.coalesce(i.getField("text"), F.lit("")))),
        lambda t: t != "",
    )
    lines = F.coalesce(G.is_line_level(text_area, region_area), F.lit(True))
    return F.when(lines, F.array_join(kept, "\n")).otherwise(F.array_join(kept, ""))


def merge_regions(
    texts: DataFrame, regions: DataFrame, min_ratio: float | None = C.MIN_CJK_RATIO
) -> DataFrame:
    """Regions with their items, concatenated and merged text.

    Inner join on the region; with ``min_ratio`` regions without enough CJK go.
    """
    box = regions.select(
        *REGION, *[F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    joined = collect_texts(texts).join(by_key(box), REGION)
    if min_ratio is not None:
        joined = joined.filter(should_translate("original_text", min_ratio))
    region_area = G.area("rx1", "ry1", "rx2", "ry2")
    return joined.withColumns({
        "merged": merged_text(F.col("items"), F.col("text_area"), region_area),
        "bubble_box": F.array("rx1", "ry1", "rx2", "ry2"),
    }).drop("rx1", "ry1", "rx2", "ry2")


def regions_to_restore(regions: DataFrame, merged: DataFrame) -> DataFrame:
    """Second-level regions whose original pixels come back: all of them minus
    those with enough CJK text (regions without any OCR text are restored too)."""
    return regions.filter("level = 2").join(
        merged.filter("level = 2").select(*REGION), REGION, "left_anti"
    )


def jobs_of(merged: DataFrame) -> DataFrame:
    """Non-blank merged texts of both levels, ready to be numbered."""
    text = strip("merged")
    return merged.select(
        "doc_id", "page_idx", "bubble_idx", (F.col("level") == 2).alias("is_l2"),
        text.alias("text"),
    ).filter(F.col("text") != "")
