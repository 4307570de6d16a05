"""Boxes of regions on a page and the clearing plan.

Pictures are worked on as tile blocks (``blocks``), and so are masks (``masks``). A region
row carries doc_id, page_idx, region_id, x1, y1, x2, y2 and the page's width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions import geometry as G

PAGE = ["doc_id", "page_idx"]
REGION = [*PAGE, "region_id"]
BOX = ("x1", "y1", "x2", "y2")
RGB = ("r", "g", "b")


def clip_to_page(regions: DataFrame) -> DataFrame:
    return regions.withColumns({
        "x1": F.greatest(F.lit(0), "x1"), "y1": F.greatest(F.lit(0), "y1"),
        "x2": F.least("width", "x2"), "y2": F.least("height", "y2"),
    })


def _slim(regions: DataFrame) -> DataFrame:
    return regions.select(*REGION, *BOX)


def mask_source(regions: DataFrame, chars: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """What a region is inpainted from: its characters, the text mask, or its
    whole box; each only when it holds anything.  With a mask, an empty region
    without characters is skipped.

    ``facts``: region key and ``has_text``, whether its mask holds text.
    """
    char_hit = char_mask_boxes(chars, regions).groupBy(*REGION).agg(
        F.lit(True).alias("has_chars")
    )
    out = regions.join(char_hit, REGION, "left")
    ladder = F.when(F.col("has_chars"), "char_boxes")
    if facts is not None:
        out = out.join(facts.select(*REGION, "has_text"), REGION, "left")
        ladder = ladder.when(
            (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "skipped"
        ).when(F.col("has_text"), "text_mask")
    return out.withColumn("source", ladder.otherwise("whole_box")).drop("has_chars", "has_text")


def char_mask_boxes(chars: DataFrame, regions: DataFrame) -> DataFrame:
    """Character boxes that overlap their region."""
    return chars.join(_slim(regions), REGION).filter(
        "least(cx2, x2) > greatest(cx1, x1) AND least(cy2, y2) > greatest(cy1, y1)"
    )


def plan_clearing(
    texts: DataFrame, regions: DataFrame, has_mask: bool, prefer_mask: bool = False
) -> DataFrame:
    """Which boxes of which region are cleared, and how.

    ``regions``: region rows with ``translated``; ``texts``: region key, line_no,
    box x1..y2 and ``chars`` (array of 4-long boxes, maybe empty).  Rules:
    ``char`` and ``line`` (characters known, lines small), ``mask_line``,
    ``mask_region``, or ``line`` when there is no mask.  A region without a
    usable translation stays as it is.
    """
    from regionflow.functions.text import is_usable_translation

    lines = texts.filter("x2 > x1 AND y2 > y1").select(
        *REGION, "line_no", *[F.col(c).alias(f"l{c}") for c in BOX],
        F.filter(F.col("chars"), lambda b: F.size(b) == 4).alias("chars"),
    )
    facts = lines.groupBy(*REGION).agg(
        F.sum(G.area("lx1", "ly1", "lx2", "ly2")).alias("text_area"),
        F.max(F.size("chars") > 0).alias("any_chars"),
    )
    usable = regions.filter(is_usable_translation("translated")).join(facts, REGION, "left")
    small = F.coalesce(
        G.is_line_level("text_area", G.area(*BOX)) & F.col("text_area").isNotNull(), F.lit(False)
    )
    by_char = small & F.coalesce("any_chars", F.lit(False)) & F.lit(not prefer_mask)
    if has_mask:
        rule = F.when(by_char, "char").when(small, "mask_line").otherwise("mask_region")
    else:
        rule = F.when(by_char, "char").when(F.col("text_area").isNotNull(), "line")
    ruled = usable.withColumn("rule", rule).filter("rule IS NOT NULL")
    size = [F.col("width"), F.col("height")]

    def cut(prefix: str) -> dict[str, Column]:
        w, h = size
        return {
            "x1": F.greatest(F.lit(0), F.least(F.col(f"{prefix}x1"), w - 1)),
            "y1": F.greatest(F.lit(0), F.least(F.col(f"{prefix}y1"), h - 1)),
            "x2": F.greatest(F.lit(0), F.least(F.col(f"{prefix}x2"), w)),
            "y2": F.greatest(F.lit(0), F.least(F.col(f"{prefix}y2"), h)),
        }

    # A character goes along with the box of its line.
    none = {f"line_{c}": F.lit(None).cast("bigint") for c in BOX}
    keep = [*REGION, "rule", "line_no", "char_no", *BOX, "width", "height", *none]
    whole = ruled.filter("rule = 'mask_region'").withColumns({
        "line_no": F.lit(0).cast("bigint"), "char_no": F.lit(0), **none,
    }).select(*keep)
    per_line = ruled.filter("rule <> 'mask_region'").drop(*BOX).join(lines, REGION)
    as_line = per_line.filter("rule <> 'char' OR size(chars) = 0").withColumns({
        "rule": F.when(F.col("rule") == "char", "line").otherwise(F.col("rule")),
        "char_no": F.lit(0), **cut("l"), **none,
    }).select(*keep)
    line_ok = "greatest(0, least(lx2, width)) > greatest(0, least(lx1, width - 1)) AND " \
              "greatest(0, least(ly2, height)) > greatest(0, least(ly1, height - 1))"
    as_char = (
        per_line.filter("rule = 'char' AND size(chars) > 0").filter(line_ok)
        .select("*", F.posexplode("chars").alias("char_no", "box"))
        .withColumns({
            "cx1": F.col("box")[0], "cy1": F.col("box")[1],
            "cx2": F.col("box")[2], "cy2": F.col("box")[3],
        })
        .withColumns(cut("c")).withColumns({f"line_{c}": value.cast("bigint") for c, value in cut("l").items()}).select(*keep)
    )
    return whole.unionByName(as_line).unionByName(as_char).filter("x2 > x1 AND y2 > y1")
