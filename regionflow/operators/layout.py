"""Packing region crops into grids.

Row packing is a left-to-right rule: an item opens a row when it no longer fits
the open one.  All that is carried from item to item is where the open row
began, and a row holds a bounded number of items.  So a long document is cut
into blocks, and the effect of a block is a small table ``row start before ->
row start after, rows opened``.  Blocks run in parallel, the tables are chained
(blocks into super-blocks first), and every block then numbers its own items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.operators.ordering import preceding_totals, radix_levels
from regionflow.operators.runs import by_group
from regionflow.session import by_key, cut_lineage

BLOCK = 4096
SUPER_BLOCK = 1024
_TABLE = "exit array<bigint>, rows array<bigint>"


def _row_jumps(widths: np.ndarray, row_width: int, padding: int, extra: int) -> np.ndarray:
    """For a row opened at each item: the item that opens the following row."""
    total = np.concatenate([[0], np.cumsum(widths + padding)])
    limit = total[:-1] + (row_width - padding - extra)
    first_over = np.searchsorted(total, limit, side="right") - 1
    return np.maximum(np.arange(len(widths)) + 1, first_over)


def _block_effect(size: int, reach: int, row_width: int, padding: int, extra: int):
    """Table of one full block, indexed by how many items back the open row began
    (0: a row opens at the block's first item, as at the start of a document)."""
    def effect(keys: tuple, items: pd.DataFrame) -> pd.DataFrame:
        doc, block = keys
        items = items.sort_values("seq")
        n = len(items)
        jump = _row_jumps(items["w"].to_numpy(), row_width, padding, extra)
        goes_on = jump < n
        last, opened = np.where(goes_on, jump, np.arange(n)), goes_on.astype(np.int64)
        for _ in range(int(n).bit_length()):
            opened, last = opened + opened[last], last[last]
        offset = block * size - int(items["seq"].iloc[0])
        starts = offset - np.arange(reach + 1)
        known = starts >= 0
        at = np.where(known, starts, 0)
        rows = opened[at] + (np.arange(reach + 1) == 0)
        return pd.DataFrame({
            "doc_id": [doc], "block": [block],
            "exit": [np.where(known, n - last[at], 0).tolist()],
            "rows": [np.where(known, rows, 0).tolist()],
        })

    return effect


def _chain(reach: int, part: str, group: str):
    """Run the tables of one group in order from every possible entry."""
    def compose(keys: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        doc, number = keys
        parts = parts.sort_values(part)
        at = np.arange(reach + 1)
        rows = np.zeros(reach + 1, np.int64)
        entries, before = [], []
        for leave, opened in zip(parts["exit"], parts["rows"]):
            entries.append(at.tolist())
            before.append(rows.tolist())
            rows = rows + np.asarray(opened)[at]
            at = np.asarray(leave)[at]
        return pd.DataFrame({
            "doc_id": doc, group: number, part: parts[part].to_numpy(),
            "entry": entries, "before": before,
            "exit": [at.tolist()] * len(entries), "rows": [rows.tolist()] * len(entries),
        })

    return compose


def _number_rows(size: int, row_width: int, padding: int, extra: int):
    """Row and place of a block's own items, given where its open row began."""
    def number(keys: tuple, items: pd.DataFrame) -> pd.DataFrame:
        doc, block = keys
        items = items.sort_values("seq")
        n, seq = len(items), items["seq"].to_numpy()
        jump = _row_jumps(items["w"].to_numpy(), row_width, padding, extra)
        at = int(np.searchsorted(seq, block * size - int(items["entry"].iloc[0])))
        opens = np.zeros(n, bool)
        while at < n:
            opens[at] = True
            at = int(jump[at])
        opener = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        own = seq >= block * size
        return pd.DataFrame({
            "doc_id": doc, "seq": seq[own],
            "row_idx": int(items["row_base"].iloc[0]) + np.cumsum(opens & own)[own] - 1,
            "row_ord": (np.arange(n) - opener)[own],
        })

    return number


def shelf_rows(
    items: DataFrame,
    row_width: int = C.GRID_WIDTH,
    padding: int = C.GRID_PADDING,
    separators: bool = False,
    block: int = BLOCK,
    super_block: int = SUPER_BLOCK,
) -> DataFrame:
    """(doc_id, seq, w) to (doc_id, seq, row_idx, row_ord).

    ``seq`` counts from 0 inside a document.  ``separators`` leaves room for the
    drawn line when testing the fit, but never adds it to the row.  The items are
    read more than once: hand in a stored table or cut their lineage first.
    """
    extra = C.SEPARATOR_WIDTH if separators else 0
    reach = row_width // padding + 2      # every item takes at least the padding
    block = max(block, reach)
    slim = items.select(
        F.col("doc_id").cast("bigint"), F.col("seq").cast("bigint"), F.col("w").cast("bigint")
    ).withColumn("block", F.floor(F.col("seq") / block))
    # A block's tail is also shown to the next block, which may continue its row.
    in_tail = F.pmod(F.col("seq"), F.lit(block)) >= block - reach
    shown = slim.withColumn(
        "block",
        F.explode(
            F.when(in_tail, F.array(F.col("block"), F.col("block") + 1))
            .otherwise(F.array("block"))
        ),
    )
    numbering = _number_rows(block, row_width, padding, extra)
    numbered = "doc_id bigint, seq bigint, row_idx bigint, row_ord bigint"
    # Only a full block can be followed by another one.
    key = ["doc_id", "block"]
    full = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == block).select(*key)
    effects = cut_lineage(
        by_group(
            shown.join(by_key(full), key, "left_semi"), key,
            _block_effect(block, reach, row_width, padding, extra),
            f"doc_id bigint, block bigint, {_TABLE}", "seq",
        ).withColumn("sblock", F.floor(F.col("block") / super_block))
    )
    steps = "entry array<bigint>, before array<bigint>"
    # Stored, as it is chained and looked up again.
    inner = cut_lineage(by_group(
        effects, ["doc_id", "sblock"], _chain(reach, "block", "sblock"),
        f"doc_id bigint, sblock bigint, block bigint, {steps}, {_TABLE}", "block",
    ))
    supers = (
        inner.groupBy("doc_id", "sblock")
        .agg(F.any_value("exit").alias("exit"), F.any_value("rows").alias("rows"))
        .withColumn("whole", F.lit(0).cast("bigint"))
    )
    outer = (
        by_group(
            supers, ["doc_id", "whole"], _chain(reach, "sblock", "whole"),
            f"doc_id bigint, whole bigint, sblock bigint, {steps}, {_TABLE}", "sblock",
        )
        .select(
            "doc_id", "sblock",
            (F.get("entry", F.lit(0)) + 1).cast("int").alias("state"),
            F.get("before", F.lit(0)).alias("super_base"),
        )
    )
    # What leaves block b enters block b + 1; block 0 is entered with 0.
    entries = (
        inner.join(by_key(outer), ["doc_id", "sblock"])
        .withColumn("at", F.element_at("entry", F.col("state")))
        .join(
            by_key(effects.select("doc_id", "block", F.col("exit").alias("own_exit"),
                                  F.col("rows").alias("own_rows"))),
            ["doc_id", "block"],
        )
        .select(
            "doc_id", (F.col("block") + 1).alias("block"),
            F.element_at("own_exit", (F.col("at") + 1).cast("int")).alias("entry"),
            (
                F.col("super_base") + F.element_at("before", F.col("state"))
                + F.element_at("own_rows", (F.col("at") + 1).cast("int"))
            ).alias("row_base"),
        )
    )
    entered = shown.join(by_key(entries), key, "left").fillna(0, ["entry", "row_base"])
    return by_group(entered, key, numbering, numbered, "seq")


class _Batch:
    """One batch still able to take rows of a document."""

    __slots__ = ("number", "height", "rows", "row", "row_w")

    def __init__(self, number: int, padding: int):
        self.number, self.height, self.rows = number, padding, 0
        self.row, self.row_w = [], padding


def _cascade(row_width: int, padding: int, max_height: int, strict: bool):
    """Stream sorted items through open batches.

    A batch packs what reaches it into rows, keeps the rows that fit and hands
    the items of every other row on, in order, to the next batch.  Only rows
    still being packed are held; a batch too full for the lowest item of the
    document is closed and forgotten.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_batches, made, lowest, out = None, [], 0, 0, []

        def closed(b):
            return b.rows > 0 and b.height + lowest + padding > max_height

        def feed(level: int, item):
            nonlocal made
            queue = [(level, item)]
            while queue:
                at, it = queue.pop(0)
                if at == len(open_batches):
                    open_batches.append(_Batch(made, padding))
                    made += 1
                b = open_batches[at]
                if b.row and b.row_w + it[1] + padding > row_width:
                    handed = settle(b)
                    if handed and strict:             # this batch is over
                        del open_batches[at]
                        queue.extend((at, h) for h in [*handed, it])
                        continue
                    queue.extend((at + 1, h) for h in handed)
                b.row.append(it)
                b.row_w += it[1] + padding

        def settle(b):
            """Close the open row: keep it, or return its items."""
            tall = max(i[2] for i in b.row) + padding
            row, b.row, b.row_w = b.row, [], padding
            if b.height + tall <= max_height or b.rows == 0:
                out.extend((doc, i[0], b.number, b.rows, k) for k, i in enumerate(row))
                b.height += tall
                b.rows += 1
                return []
            return row

        def retire():
            """Drop closed batches from the front of the chain of open ones."""
            for at in range(len(open_batches) - 1, -1, -1):
                b = open_batches[at]
                if closed(b):
                    held = b.row
                    del open_batches[at]
                    for it in held:
                        feed(at, it)

        def finish():
            while open_batches:
                b = open_batches[0]
                handed = settle(b) if b.row else []
                del open_batches[0]
                for it in handed:
                    feed(0, it)

        def flush():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * 5
            out = []
            names = ["doc_id", "seq", "batch_idx", "row_idx", "row_ord"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], names=names
            )

        for batch in batches:
            data = batch.to_pydict()
            for d, seq, w, h, low in zip(*(data[c] for c in ("doc_id", "seq", "w", "h", "low"))):
                if d != doc:
                    finish()
                    doc, made, lowest = d, 0, low
                before = len(out)
                feed(0, (seq, w, h))
                if len(out) > before:
                    retire()
                if len(out) >= 65536:
                    yield flush()
            yield flush()
        finish()
        yield flush()

    return place


def height_batches(
    items: DataFrame,
    row_width: int = C.GRID_WIDTH,
    padding: int = C.GRID_PADDING,
    max_height: int = C.GRID_MAX_HEIGHT,
    strict_order: bool = False,
) -> DataFrame:
    """(doc_id, seq, w, h) to (doc_id, seq, batch_idx, row_idx, row_ord).

    A row that does not fit is skipped, and a later, lower row may still join;
    what is left over is packed again for the next batch.  ``strict_order``
    closes a batch at the first row that does not fit.

    Each batch depends on all before it, so one document is one sequential
    stream; it is read from the sorted shuffle in Arrow batches and never held.
    """
    slim = items.select(*[F.col(c).cast("bigint") for c in ("doc_id", "seq", "w", "h")])
    lowest = slim.groupBy("doc_id").agg(F.min("h").alias("low"))
    return (
        slim.join(by_key(lowest), "doc_id")
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "seq")
        .mapInArrow(
            _cascade(row_width, padding, max_height, strict_order),
            "doc_id bigint, seq bigint, batch_idx bigint, row_idx bigint, row_ord bigint",
        )
    )


def grid_coordinates(
    placed: DataFrame, padding: int = C.GRID_PADDING, separators: bool = False
) -> DataFrame:
    """Add the grid box and row-major cell number of every placed item.

    ``placed`` has doc_id, batch_idx, row_idx, row_ord, w, h.  Rows and batches
    have a bounded width and height; a single endless grid is cut into blocks
    of rows for the vertical running sum.
    """
    line = C.SEPARATOR_WIDTH if separators else 0
    keys = ["doc_id", "batch_idx"]
    rows = placed.groupBy(*keys, "row_idx").agg(
        F.max("h").alias("row_h"), F.count(F.lit(1)).alias("cells")
    ).withColumns({"step": F.col("row_h") + padding + line, **radix_levels("row_idx", "__r", 1)})
    tops = preceding_totals(rows, keys, ["__r1", "row_idx"], ["step", "cells"])
    before = (
        Window.partitionBy(*keys, "row_idx").orderBy("row_ord")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    x = F.lit(padding) + F.coalesce(F.sum(F.col("w") + padding + line).over(before), F.lit(0))
    return (
        placed.withColumn("gx1", x)
        .join(by_key(tops.select(*keys, "row_idx", "row_h", "step_before", "cells_before")),
              [*keys, "row_idx"])
        .withColumns({
            "gy1": F.lit(padding) + F.col("step_before")
            + F.floor((F.col("row_h") - F.col("h")) / 2),
            "cell_idx": F.col("cells_before") + F.col("row_ord"),
        })
        .withColumns({"gx2": F.col("gx1") + F.col("w"), "gy2": F.col("gy1") + F.col("h")})
        .drop("row_h", "step_before", "cells_before")
    )


def grid_facts(cells: DataFrame) -> DataFrame:
    """Rows, widest row and cells of every grid."""
    keys = ["doc_id", "batch_idx"]
    return (
        cells.groupBy(*keys, "row_idx").agg(F.count(F.lit(1)).alias("in_row"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.max("in_row").alias("max_cols"),
            F.sum("in_row").alias("total_cells"),
        )
    )


def thumbnail_grid(
    pages: DataFrame, cols: int = 4, thumb_width: int = 400, keys: tuple = ("doc_id",)
) -> DataFrame:
    """Place of every page thumbnail, centred in a row of the tallest height.

    ``seq`` counts pages from 0 inside a document.
    """
    ratio = F.lit(float(thumb_width)) / F.col("width")
    sized = pages.withColumn("thumb_h", (F.col("height") * ratio).cast("bigint"))
    tallest = sized.groupBy(*keys).agg(F.max("thumb_h").alias("max_h"))
    return sized.join(tallest, list(keys)).withColumns({
        "grid_row": F.floor(F.col("seq") / cols), "grid_col": F.pmod(F.col("seq"), F.lit(cols)),
    }).withColumns({
        "gx": F.col("grid_col") * thumb_width,
        "gy": F.col("grid_row") * F.col("max_h")
        + F.floor((F.col("max_h") - F.col("thumb_h")) / 2),
    })
