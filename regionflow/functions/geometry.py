"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import col


def area(x1, y1, x2, y2) -> Column:
    return (col(x2) - col(x1)) * (col(y2) - col(y1))


def positive_area(x1, y1, x2, y2) -> Column:
    ok = (col(x2) > col(x1)) & (col(y2) > col(y1))
    return F.when(ok, area(x1, y1, x2, y2)).otherwise(F.lit(0))


def overlap_area(a, b) -> Column:
    """Shared area of two boxes given as 4-tuples of columns."""
    ax1, ay1, ax2, ay2 = map(col, a)
    bx1, by1, bx2, by2 = map(col, b)
    wide = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    high = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    return wide * high


def axis_distance(low, high, point) -> Column:
    """0 inside [low, high], else the distance to the nearer end."""
    return F.greatest(col(low) - col(point), F.lit(0.0), col(point) - col(high))


def inside(box, x, y, tolerance: float = 0) -> Column:
    x1, y1, x2, y2 = map(col, box)
    return (
        (col(x) >= x1 - tolerance) & (col(x) <= x2 + tolerance)
        & (col(y) >= y1 - tolerance) & (col(y) <= y2 + tolerance)
    )


def clamp(value, low, high) -> Column:
    return F.greatest(col(low), F.least(col(value), col(high)))


def is_line_level(text_area, region_area, limit: float = C.LINE_LEVEL_COVERAGE) -> Column:
    """Boxes cover so little of the region that they must be single lines."""
    return (col(region_area) > 0) & (col(text_area) < col(region_area) * limit)


def letterbox(width, height, size: int = 1024) -> dict[str, Column]:
    """Resize ratio, new size and the four pads; round half to even as usual."""
    w, h = col(width).cast("double"), col(height).cast("double")
    ratio = F.least(F.lit(float(size)) / h, F.lit(float(size)) / w)
    new_w, new_h = F.bround(w * ratio, 0), F.bround(h * ratio, 0)
    dw, dh = (F.lit(float(size)) - new_w) / 2, (F.lit(float(size)) - new_h) / 2
    return {
        "ratio": ratio,
        "new_w": new_w.cast("bigint"),
        "new_h": new_h.cast("bigint"),
        "pad_left": F.bround(dw - 0.1, 0).cast("bigint"),
        "pad_right": F.bround(dw + 0.1, 0).cast("bigint"),
        "pad_top": F.bround(dh - 0.1, 0).cast("bigint"),
        "pad_bottom": F.bround(dh + 0.1, 0).cast("bigint"),
    }


def letterbox_inverse(size: int = 1024) -> dict[str, Column]:
    """Window of the model mask that holds the picture, from the pads."""
    full = F.lit(size)

    def far(pad: str) -> Column:
        return F.when(F.col(pad) > 0, full - F.col(pad)).otherwise(full).cast("bigint")

    return {
        "mask_x1": F.col("pad_left"), "mask_y1": F.col("pad_top"),
        "mask_x2": far("pad_right"), "mask_y2": far("pad_bottom"),
    }


def tiles(x1, y1, x2, y2, size: int) -> Column:
    """Array of (ty, tx) tiles touched by the closed box."""
    def span(a, b):
        first = F.floor(col(a) / size).cast("bigint")
        last = F.floor(col(b) / size).cast("bigint")
        return F.sequence(first, F.greatest(first, last))

    return F.flatten(
        F.transform(
            span(y1, y2),
            lambda ty: F.transform(
                span(x1, x2), lambda tx: F.struct(ty.alias("ty"), tx.alias("tx"))
            ),
        )
    )
