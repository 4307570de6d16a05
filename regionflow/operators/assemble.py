"""Nested page results and response rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import slug
from regionflow.session import by_key


def with_translations(merged: DataFrame, translations: DataFrame) -> DataFrame:
    """Regions with their translation, or the missing marker."""
    keys = ["doc_id", "page_idx", "level", "bubble_idx"]
    return merged.join(by_key(translations.select(*keys, "translated")), keys, "left").withColumn(
        "translated_text", F.coalesce("translated", F.lit(C.MISSING))
    ).drop("translated")


def text_only_regions(regions: DataFrame) -> DataFrame:
    """Region rows of the text result."""
    return regions.filter("level = 1").select(
        "doc_id", "page_idx", "bubble_idx", "bubble_box",
        F.transform(
            "items",
            lambda i: F.struct(i.getField("text").alias("text"), i.getField("bbox").alias("bbox")),
        ).alias("original_texts"),
        "original_text", "translated_text",
    )


def text_free_regions(regions: DataFrame) -> DataFrame:
    """Second-level rows the legacy result adds."""
    return regions.filter("level = 2").select(
        "doc_id", "page_idx", "bubble_idx",
        F.array("x1", "y1", "x2", "y2").alias("bubble_box"),
        F.lit(True).alias("is_text_free"), F.lit(False).alias("inpainted"),
    )


def nest_pages(rows: DataFrame) -> DataFrame:
    """One row per page with its regions in order.

    A detector finds a few hundred regions on a page at most, so a page's list is small;
    ``rows`` stays the flat form for whatever has more.
    """
    body = [c for c in rows.columns if c not in ("doc_id", "page_idx", "sort_level")]
    # Text-free rows follow the text rows of their page.
    level = F.col("sort_level") if "sort_level" in rows.columns else F.lit(1)
    item = F.struct(level.alias("level"), F.col("bubble_idx").alias("at"), F.struct(*body).alias("r"))
    return rows.groupBy("doc_id", "page_idx").agg(
        F.transform(
            F.sort_array(F.collect_list(item)), lambda s: s.getField("r")
        ).alias("regions")
    )


def legacy_rows(text_rows: DataFrame, free_rows: DataFrame) -> DataFrame:
    return text_rows.withColumn("sort_level", F.lit(1)).unionByName(
        free_rows.withColumn("sort_level", F.lit(2)), allowMissingColumns=True
    )


def one_line_base64(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), one_line_base64(content))


def full_page_results(pages: DataFrame) -> DataFrame:
    """Ordered page pictures as data URLs, one row per page."""
    return pages.select(
        "doc_id", "page_idx", F.lit(True).alias("success"), data_url(F.col("content")).alias("data_url")
    )


def speech_images(crops: DataFrame, texts: DataFrame, translations: DataFrame, inpainted: bool = False) -> DataFrame:
    """Rows of ``speech_image_only``: every region's picture with its place and its texts.

    ``crops``: region key, box, ``rgb`` bytes, width and height; ``texts``: region key, line_no, text;
    ``translations``: region key and ``translated``. A region without a translation says so.
    """
    key = ["doc_id", "page_idx", "region_id"]
    # A region has a few lines.
    said = texts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"]), "").alias("original_text"))
    return crops.join(said, key, "left").join(translations.select(*key, "translated"), key, "left").select(
        "doc_id", "page_idx", F.col("region_id").alias("bubble_idx"), F.array("x1", "y1", "x2", "y2").alias("bubble_box"),
        one_line_base64(F.col("rgb")).alias("image_base64"), "width", "height", F.coalesce("original_text", F.lit("")).alias("original_text"),
        F.coalesce("translated", F.lit(C.MISSING)).alias("translated_text"), F.lit(inpainted).alias("inpainted_background"),
    )


def speech_pages(rows: DataFrame) -> DataFrame:
    """``speech_images`` nested per page, in order of their number."""
    item = F.struct("bubble_idx", "bubble_box", "image_base64", "original_text", "translated_text", "inpainted_background")
    return rows.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(item)).alias("regions"))


def response_envelope(pages: DataFrame, output_type: str, stats: DataFrame) -> DataFrame:
    """Status row per document of any output type; counts the pages present in the result and,
    where pages have ``regions``, these."""
    regions = F.sum(F.size("regions")) if "regions" in pages.columns else F.lit(None).cast("bigint")
    counts = pages.groupBy("doc_id").agg(F.countDistinct("page_idx").alias("page_count"), regions.alias("bubble_count"))
    bubbles = F.coalesce("bubble_count", F.lit(0)) if "regions" in pages.columns else F.col("bubble_count")
    return stats.join(counts, "doc_id", "left").select(
        "doc_id", F.lit("success").alias("status"), F.lit(output_type).alias("output_type"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"), bubbles.alias("bubble_count"),
        F.to_json(F.struct(*[c for c in stats.columns if c != "doc_id"])).alias("stats"),
    )


def write_text_only(nested: DataFrame, path: str) -> None:
    nested.write.mode("errorifexists").json(path)


def save_pages(pages: DataFrame, path: str) -> None:
    """Page sets under ``stage`` (before, after), each ordered by slugged title.

    Titles are nearly as many as pages, so they share files: a title's rows lie together, and a
    reader that asks for one skips the rest by the files' ranges.
    """
    titled = pages.withColumn("tab_title", slug("tab_title"))
    # The page number parts a title that many pages have.
    order = ["stage", "tab_title", *[c for c in ("page_id",) if c in pages.columns]]
    titled.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("stage").parquet(path)
