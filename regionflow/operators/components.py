"""Connected text areas of a mask.

Every mask block is labelled on its own, over the runs of text pixels in its rows; what
leaves it are the areas' boxes and sizes and, along its borders, runs of pixels with
their area. Areas that touch across a border are then joined up, a graph far smaller than
the picture. Every round is written out, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.operators.masks import unpack
from regionflow.operators.pixels import PAGE
from regionflow.operators.runs import in_parts
from regionflow.session import cut_lineage

_ROW = 1 << 24          # code of a pixel: y * _ROW + x
_PARTS = [*PAGE, "kind", "part", "x1", "y1", "x2", "y2", "pixels"]


def rows_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set pixels: row, first column, and the column after the last; in reading order."""
    wide = np.pad(text.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1]


def label_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run the first run of its area. One pass meets each run with the row above, the other
    follows the links down to their ends."""
    root = np.arange(len(row))
    width = int(end.max(initial=0)) + 1
    # Runs are in order by row and column, so those above that touch a run are one stretch.
    first = np.searchsorted(row * width + end, (row - 1) * width + start, side="right")
    last = np.searchsorted(row * width + start, (row - 1) * width + end, side="left")
    many = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # Roots are lowered, not only the runs, so a long chain halves in each round.
        for side in (a, b):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _runs_along(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one area along a border: first place, place after the last, label."""
    ends = np.flatnonzero(np.append(labels[1:] != labels[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    there = labels[starts] >= 0
    return starts[there], ends[there], labels[starts][there]


def label_tiles(masks: DataFrame, level: int = C.MASK_STRONG_LEVEL) -> DataFrame:
    """Per mask block its areas (``kind`` area), named by their first pixel, and its borders' runs:
    ``down`` and ``right`` where a neighbour follows, ``up`` and ``left`` where one went before.
    A border run has the neighbour's line as y1 (or x1) and its stretch in the other pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found: list[list[np.ndarray]] = [[] for _ in range(8)]
            kinds: list[str] = []
            for r in batch.to_pylist():
                text = (unpack(r["m"], r["h"], r["w"]) > level) & (np.arange(r["h"] * r["w"]) < r["n"]).reshape(r["h"], r["w"])
                row, start, end = rows_of(text)
                if not len(row):
                    continue
                y0, x0 = r["ty"] * C.TILE, r["tx"] * C.TILE
                area, of_run = np.unique(label_runs(row, start, end), return_inverse=True)
                names = (row[area] + y0) * _ROW + start[area] + x0
                n = len(area)
                box = [np.full(n, r["w"]), np.full(n, r["h"]), np.zeros(n, np.int64), np.zeros(n, np.int64)]
                for at, ufunc, value in ((0, np.minimum, start), (1, np.minimum, row), (2, np.maximum, end), (3, np.maximum, row + 1)):
                    ufunc.at(box[at], of_run, value)
                made = [("area", names, box[0] + x0, box[1] + y0, box[2] + x0, box[3] + y0, np.bincount(of_run, end - start, n).astype(np.int64))]
                labels = np.full(text.shape, -1)
                labels[text] = np.repeat(of_run, end - start)
                for kind, line, across in (("down", labels[-1], y0 + r["h"]), ("up", labels[0], y0), ("right", labels[:, -1], x0 + r["w"]), ("left", labels[:, 0], x0)):
                    a, b, label = _runs_along(line)
                    here = np.full(len(a), across)
                    none = np.zeros(len(a), np.int64)
                    rows = kind in ("down", "up")
                    made.append((kind, names[label], *((a + x0, here, b + x0, here) if rows else (here, a + y0, here, b + y0)), none))
                for kind, part, *rest in made:
                    kinds += [kind] * len(part)
                    for column, value in zip(found, (np.full(len(part), r["doc_id"]), np.full(len(part), r["page_idx"]), part, *rest)):
                        column.append(value)
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in found]
            yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(kinds, pa.string()), *columns[2:]], names=_PARTS)

    return masks.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'kind' else 'bigint'}" for c in _PARTS))


def _border_edges(labelled: DataFrame) -> DataFrame:
    """Pairs of parts that touch across a tile border: border runs that overlap on one line of a tile."""
    def across(before: str, after: str, line: str, a: str, b: str) -> DataFrame:
        def side(kind: str, name: str) -> DataFrame:
            spot = F.floor(F.col(a) / C.TILE).alias("spot")
            return labelled.filter(F.col("kind") == kind).select(*PAGE, F.col(line).alias("line"), spot, F.col(a).alias(f"{name}1"), F.col(b).alias(f"{name}2"), F.col("part").alias(name))

        return side(before, "a").join(side(after, "b"), [*PAGE, "line", "spot"]).filter("a1 < b2 AND b1 < a2").select(*PAGE, "a", "b")

    return across("down", "up", "y1", "x1", "x2").unionByName(across("right", "left", "x1", "y1", "y2")).distinct()


def merge_parts(edges: DataFrame) -> DataFrame:
    """Smallest part reachable from every part: neighbours' minimum, then a jump
    to that part's own minimum, until nothing changes."""
    both = edges.unionByName(edges.select(*PAGE, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both)
    state = both.groupBy(*PAGE, "a").agg(F.min("b").alias("m")).select(
        *PAGE, F.col("a").alias("part"), F.least("a", "m").alias("root")
    )
    state = cut_lineage(state)
    while True:
        around = (
            both.join(state.withColumnRenamed("part", "b"), [*PAGE, "b"])
            .groupBy(*PAGE, "a").agg(F.min("root").alias("near")).withColumnRenamed("a", "part")
        )
        lowered = state.join(around, [*PAGE, "part"]).withColumn("low", F.least("root", "near"))
        jump = state.select(*PAGE, F.col("part").alias("low"), F.col("root").alias("far"))
        stepped = cut_lineage(
            lowered.join(jump, [*PAGE, "low"], "left").select(
                *PAGE, "part", F.least("low", F.coalesce("far", "low")).alias("new"), "root"
            )
        )
        settled = stepped.filter("new <> root").isEmpty()
        state = stepped.select(*PAGE, "part", F.col("new").alias("root"))
        if settled:
            return state


def components(masks: DataFrame, level: int = C.MASK_STRONG_LEVEL, min_size: int = 0) -> DataFrame:
    """Box and pixel count of every 4-connected area of mask blocks with more than ``min_size`` pixels."""
    labelled = cut_lineage(label_tiles(masks, level))
    roots = merge_parts(_border_edges(labelled))
    return (
        labelled.filter("kind = 'area'").join(roots, [*PAGE, "part"], "left")
        .groupBy(*PAGE, F.coalesce("root", "part").alias("root"))
        .agg(
            F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
            F.sum("pixels").alias("pixels"),
        )
        .filter(F.col("pixels") > min_size)
        .drop("root")
    )
