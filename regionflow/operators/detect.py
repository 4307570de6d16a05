"""Detections to numbered regions with crop windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.operators.ordering import with_position

PAGE = ["doc_id", "page_idx"]


def keep_detections(
    det: DataFrame, label: int | None = None, threshold: float = C.DETECTION_THRESHOLD
) -> DataFrame:
    """Strictly above the threshold; both tests reach the Parquet scan."""
    kept = det.filter(F.col("score") > threshold)
    return kept if label is None else kept.filter(F.col("label") == label)


def boxes_from_logits(raw: DataFrame, pages: DataFrame, label: int) -> DataFrame:
    """Sigmoid score of one class and centre-size boxes in page pixels."""
    score = 1 / (1 + F.exp(-F.element_at("logits", label + 1)))

    def edge(centre: str, extent: str, side: str, sign: int):
        half = F.col(extent) / 2 * sign
        return ((F.col(centre) + half) * F.col(side)).cast("int")

    return (
        raw.withColumns({"score": score, "label": F.lit(label)})
        .join(pages.select(*PAGE, "width", "height"), PAGE)
        .withColumns({
            "x1": edge("cx", "w", "width", -1), "y1": edge("cy", "h", "height", -1),
            "x2": edge("cx", "w", "width", 1), "y2": edge("cy", "h", "height", 1),
        })
        .drop("logits", "cx", "cy", "w", "h", "width", "height")
    )


def reading_order(det: DataFrame) -> DataFrame:
    """Number regions per page and label: bands top down, right to left inside.

    A page with very many regions is split by band and 128-pixel slice, so it
    never sits in one window.
    """
    return with_position(
        det,
        keys=[*PAGE, "label"],
        levels={
            "__cell": F.struct(
                F.floor(F.col("y1") / C.ROW_BAND).alias("band"),
                (-F.floor(F.col("x1") / 128)).alias("slice"),
            ),
        },
        order=[F.col("x1").desc(), F.col("det_idx")],
        name="bubble_idx",
    )


def by_score(det: DataFrame) -> DataFrame:
    """Detections with their rank on the page, surest first."""
    order = Window.partitionBy(*PAGE).orderBy(F.col("score").desc(), "det_idx")
    return det.withColumn("rank", F.row_number().over(order) - 1)


def crop_window(regions: DataFrame, pad: int = C.CROP_PADDING) -> DataFrame:
    """Padded crop limited by the page; a negative corner keeps a negative pad."""
    pad_l, pad_t = F.least(F.lit(pad), F.col("x1")), F.least(F.lit(pad), F.col("y1"))
    return regions.withColumns({
        "pad_l": pad_l, "pad_t": pad_t,
        "crop_x1": F.col("x1") - pad_l, "crop_y1": F.col("y1") - pad_t,
        "crop_x2": F.least(F.col("width"), F.col("x2") + pad),
        "crop_y2": F.least(F.col("height"), F.col("y2") + pad),
    }).withColumns({
        "crop_w": F.col("crop_x2") - F.col("crop_x1"),
        "crop_h": F.col("crop_y2") - F.col("crop_y1"),
    })


def context_window(
    regions: DataFrame, pad: int = C.CROP_PADDING, context: int = C.CONTEXT_PAD
) -> DataFrame:
    """Region grown by ``pad``, then by ``context``; plus the local mask rectangle
    and the size padded to the model's multiple."""
    def low(name, by):
        return F.greatest(F.lit(0), F.col(name) - by)

    def high(name, limit, by):
        return F.least(F.col(limit), F.col(name) + by)

    def padded(size):
        return (F.ceil(size / C.MODEL_MULTIPLE) * C.MODEL_MULTIPLE).cast("bigint")

    return (
        regions.withColumns({
            "bx1": low("x1", pad), "by1": low("y1", pad),
            "bx2": high("x2", "width", pad), "by2": high("y2", "height", pad),
        })
        .withColumns({
            "cx1": low("bx1", context), "cy1": low("by1", context),
            "cx2": high("bx2", "width", context), "cy2": high("by2", "height", context),
        })
        .withColumns({
            "mx1": F.col("bx1") - F.col("cx1"), "my1": F.col("by1") - F.col("cy1"),
            "mx2": F.col("bx2") - F.col("cx1"), "my2": F.col("by2") - F.col("cy1"),
            "model_w": padded(F.col("cx2") - F.col("cx1")),
            "model_h": padded(F.col("cy2") - F.col("cy1")),
        })
        .drop("bx1", "by1", "bx2", "by2")
    )


def clamp_boxes(regions: DataFrame) -> DataFrame:
    """Cut boxes to the page and drop those left empty."""
    return regions.withColumns({
        "x1": F.greatest(F.lit(0), F.col("x1")), "y1": F.greatest(F.lit(0), F.col("y1")),
        "x2": F.least(F.col("width"), F.col("x2")),
        "y2": F.least(F.col("height"), F.col("y2")),
    }).filter("x2 > x1 AND y2 > y1")


def pages_with_regions(pages: DataFrame, *regions: DataFrame) -> DataFrame:
    """Only pages that have a region at all go on to segmentation."""
    touched = regions[0].select(*PAGE)
    for other in regions[1:]:
        touched = touched.union(other.select(*PAGE))
    return pages.join(touched.distinct(), PAGE, "left_semi")
