"""Masks as tile blocks of run-length bytes, and masks of regions.

A mask block is a 64 x 64 tile ``(doc_id, page_idx, ty, tx, h, w, n, m)``, a region mask the
same for a region's box. ``m`` holds a byte per pixel, row by row, as runs where that is
shorter: text masks are mostly empty, so what moves is small. No pixel ever is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions import geometry as G
from regionflow.operators.pixels import BOX, PAGE, REGION
from regionflow.operators.runs import in_parts, whole_runs

TILE_KEY = [*PAGE, "ty", "tx"]
MASK_BLOCK = "doc_id bigint, page_idx bigint, ty bigint, tx bigint, h bigint, w bigint, n bigint, m binary"
_NAMES = [c.split()[0] for c in MASK_BLOCK.split(", ")]
_RUN = np.dtype([("length", "<u4"), ("value", "u1")])


def pack(mask: np.ndarray) -> bytes:
    """Bytes of a mask: (length, value) runs, or the plain bytes where these are no longer."""
    flat = np.ascontiguousarray(mask, np.uint8).reshape(-1)
    ends = np.append(np.flatnonzero(flat[1:] != flat[:-1]) + 1, len(flat)) if len(flat) else np.zeros(0, np.int64)
    if len(ends) * _RUN.itemsize >= len(flat):
        return flat.tobytes()
    runs = np.empty(len(ends), _RUN)
    runs["length"], runs["value"] = np.diff(ends, prepend=0), flat[ends - 1]
    return runs.tobytes()


def unpack(body: bytes, h: int, w: int) -> np.ndarray:
    """The mask of ``pack``; runs are always shorter than the plain bytes, which tells the two apart."""
    if len(body) == h * w:
        return np.frombuffer(body, np.uint8).reshape(h, w)
    runs = np.frombuffer(body, _RUN)
    return np.repeat(runs["value"], runs["length"]).reshape(h, w)


def mask_of(blocks: DataFrame) -> DataFrame:
    """The masks of picture blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            masks = [pack(np.frombuffer(b, np.uint8)[3::4]) for b in batch.column("px").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:-1]), pa.array(masks, pa.binary())], names=_NAMES)

    return blocks.select(*_NAMES[:-1], "px").mapInArrow(run, MASK_BLOCK)


def _each(blocks: DataFrame, change, value: str = "m") -> DataFrame:
    """``change(row)`` gives each block's new mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            masks = [pack(change(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:-1]), pa.array(masks, pa.binary())], names=_NAMES)

    return blocks.mapInArrow(run, MASK_BLOCK)


def normalise_mask(blocks: DataFrame, byte_values: bool = False) -> DataFrame:
    """Model mask to 0..255: bytes stay; a page within 0..1 is scaled; the rest is cut.

    Blocks of a model hold doubles in place of bytes. A page's maximum is taken over its
    tiles' maxima, so one number per tile is shuffled for it.
    """
    if byte_values:
        return _each(blocks, lambda r: unpack(r["m"], r["h"], r["w"]))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            tops = [float(np.frombuffer(m, np.float64)[:n].max(initial=-np.inf)) for m, n in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_idx"), pa.array(tops)], names=[*PAGE, "top"])

    tops = blocks.select(*PAGE, "n", "m").mapInArrow(highest, "doc_id bigint, page_idx bigint, top double").groupBy(*PAGE).agg(F.max("top").alias("top"))

    def scaled(r: dict) -> np.ndarray:
        values = np.frombuffer(r["m"], np.float64)
        return (values * 255 if r["top"] <= 1.0 else np.clip(values, 0, 255)).astype(np.uint8)

    return _each(blocks.join(tops, PAGE).select(*_NAMES, "top"), scaled)


def char_mask(chars: DataFrame, regions: DataFrame) -> DataFrame:
    """Mask of a region made from its character boxes: region key, box and ``m``. Regions that no
    character touches have none.

    ``chars``: region key and box cx1, cy1, cx2, cy2 in page pixels.
    """
    cut = chars.join(regions.select(*REGION, *BOX), REGION).select(
        *REGION, *BOX,
        (F.greatest("cx1", "x1") - F.col("x1")).alias("ax1"), (F.greatest("cy1", "y1") - F.col("y1")).alias("ay1"),
        (F.least("cx2", "x2") - F.col("x1")).alias("ax2"), (F.least("cy2", "y2") - F.col("y1")).alias("ay2"),
    ).filter("ax2 > ax1 AND ay2 > ay1")
    box = F.array(*[F.col(c).cast("bigint") for c in ("ay1", "ay2", "ax1", "ax2")])
    # A region has few distinct character boxes.
    lists = cut.groupBy(*REGION, *BOX).agg(F.collect_set(box).alias("boxes"))
    names = [*REGION, *BOX, "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            masks = []
            for r in batch.to_pylist():
                mask = np.zeros((r["y2"] - r["y1"], r["x2"] - r["x1"]), np.uint8)
                for a, b, c, d in r["boxes"]:
                    mask[a:b, c:d] = 255
                masks.append(pack(mask))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(masks, pa.binary())], names=names)

    wide = [F.col(c).cast("bigint").alias(c) for c in (*REGION, *BOX)]
    return lists.select(*wide, "boxes").mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:-1]) + ", m binary")


def rows_of_runs(masks: DataFrame, key: list[str], y0: str, x0: str, h: str, w: str) -> DataFrame:
    """(key, y, x1, x2, m): the runs of values above zero in each row, for looking at masks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            owner, found = [], []
            for k, (body, height, width, y, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "__h", "__w", "__y", "__x")))):
                mask = unpack(body, height, width)
                wide = np.pad(mask.astype(np.int64), ((0, 0), (1, 1)))
                row, start = np.nonzero((wide[:, 1:] != wide[:, :-1]) & (wide[:, 1:] > 0))
                end_row, end = np.nonzero((wide[:, 1:] != wide[:, :-1]) & (wide[:, :-1] > 0))
                owner.append(np.full(len(row), k))
                found.append(np.stack([y + row, x + start, x + end, mask[row, start].astype(np.int64)]))
            if owner:
                owner, found = np.concatenate(owner), np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in key), *map(pa.array, found)], names=[*key, "y", "x1", "x2", "m"])

    made = masks.select(*key, "m", *[F.expr(e).cast("bigint").alias(n) for n, e in (("__h", h), ("__w", w), ("__y", y0), ("__x", x0))])
    return made.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*key, "y", "x1", "x2", "m"]))


def _places(first: np.ndarray, a1: int, a2: int, b1: int, b2: int) -> np.ndarray:
    """Source places along one axis of the target places ``first``: the nearest pixel of a1..a2 for b1..b2."""
    return a1 + np.floor((first - b1 + 0.5) * (a2 - a1) / (b2 - b1)).astype(np.int64)


def grid_mask_to_pages(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """Mask blocks of packed grids back to mask blocks of pages; where regions overlap the larger
    value wins, and a cell of another size is resized by nearest pixel.

    ``grid``: mask blocks with ``batch_idx`` in place of ``page_idx``; ``cells``: grid box, page and
    region box bx1..by2. Each part of a target tile gathers from the source tiles it needs, so tiles
    meet tiles. Parts of a page that no cell covers are zero.
    """
    solid = cells.filter("bx2 > bx1 AND by2 > by1 AND gx2 > gx1 AND gy2 > gy1 AND bx1 >= 0 AND by1 >= 0")
    boxes = [f"{p}{c}" for p in "gb" for c in BOX]
    to = solid.select("doc_id", "batch_idx", "page_idx", *[F.col(c).cast("bigint").alias(c) for c in boxes]).withColumn(
        "t", F.explode(G.tiles("bx1", "by1", F.col("bx2") - 1, F.col("by2") - 1, C.TILE))
    ).select("*", F.col("t.ty").cast("bigint").alias("to_ty"), F.col("t.tx").cast("bigint").alias("to_tx")).drop("t")
    # The target's part inside its tile, and the source box it reads.
    for axis, tile in (("y", "to_ty"), ("x", "to_tx")):
        to = to.withColumn(f"p{axis}1", F.greatest(f"b{axis}1", F.col(tile) * C.TILE)).withColumn(f"p{axis}2", F.least(f"b{axis}2", (F.col(tile) + 1) * C.TILE))
        for name, at in ((f"s{axis}1", f"p{axis}1"), (f"s{axis}2", f"p{axis}2 - 1")):
            to = to.withColumn(name, F.expr(f"g{axis}1 + CAST(floor(({at} - b{axis}1 + 0.5D) * (g{axis}2 - g{axis}1) / (b{axis}2 - b{axis}1)) AS BIGINT)"))
    asked = to.withColumn("t", F.explode(G.tiles("sx1", "sy1", "sx2", "sy2", C.TILE))).select(
        "*", F.col("t.ty").cast("bigint").alias("ty"), F.col("t.tx").cast("bigint").alias("tx")
    ).drop("t", "sx1", "sy1", "sx2", "sy2")
    met = asked.join(grid.select("doc_id", "batch_idx", "ty", "tx", "h", "w", "m"), ["doc_id", "batch_idx", "ty", "tx"])

    names = [*PAGE, "to_ty", "to_tx", "y", "x", "h", "w", "m"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                tile = unpack(r["m"], r["h"], r["w"])
                ys, xs = np.arange(r["py1"], r["py2"]), np.arange(r["px1"], r["px2"])
                sy = _places(ys, r["gy1"], r["gy2"], r["by1"], r["by2"]) - r["ty"] * C.TILE
                sx = _places(xs, r["gx1"], r["gx2"], r["bx1"], r["bx2"]) - r["tx"] * C.TILE
                # Source places rise with target places, so what lies in this tile is one rectangle.
                rows, columns = np.flatnonzero((sy >= 0) & (sy < r["h"])), np.flatnonzero((sx >= 0) & (sx < r["w"]))
                if len(rows) and len(columns):
                    part = tile[np.ix_(sy[rows], sx[columns])]
                    for column, value in zip(out, (
                        r["doc_id"], r["page_idx"], r["to_ty"], r["to_tx"], int(ys[rows[0]]) - r["to_ty"] * C.TILE,
                        int(xs[columns[0]]) - r["to_tx"] * C.TILE, *part.shape, pack(part),
                    )):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:-1]), pa.array(out[-1], pa.binary())], names=names)

    pieces = met.mapInArrow(gather, ", ".join(f"{c} bigint" for c in names[:-1]) + ", m binary")
    key = [*PAGE, "to_ty", "to_tx"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(in_parts(batches), key):
            columns = [table.column(c).to_pylist() for c in ("y", "x", "h", "w", "m")]
            masks = []
            for at, size in zip(starts.tolist(), sizes.tolist()):
                tile = np.zeros((C.TILE, C.TILE), np.uint8)
                for y, x, h, w, m in zip(*(c[at : at + size] for c in columns)):
                    spot = tile[y : y + h, x : x + w]
                    np.maximum(spot, unpack(m, h, w), out=spot)
                masks.append(pack(tile))
            side = np.full(len(starts), C.TILE)
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks().take(pa.array(starts)) for c in key), pa.array(side), pa.array(side), pa.array(side * C.TILE), pa.array(masks, pa.binary())], names=_NAMES
            )

    return pieces.repartition(*key).sortWithinPartitions(*key).mapInArrow(merged, MASK_BLOCK)
