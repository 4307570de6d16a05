"""Pictures as tile blocks: tests, colours, masks and fills on whole tiles.

A block is a 64 x 64 tile of a page, ``(doc_id, page_idx, ty, tx, h, w, n, px)``: ``px`` holds
red, green, blue and mask bytes row by row, ``n`` how many of its pixels exist (fewer than
h * w only where a page ends inside the block). Regions are joined to tiles, never to
pixels; inside a task numpy cuts each region's part out of the tile, the parts of a region
meet, and what is asked of the region is answered on its whole crop. A region is at most
a page, so a crop fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from regionflow import constants as C
from regionflow.functions import geometry as G
from regionflow.operators.masks import TILE_KEY, pack, unpack
from regionflow.operators.pixels import BOX, REGION, clip_to_page, plan_clearing
from regionflow.operators.runs import in_parts, whole_runs

BLOCK = "doc_id bigint, page_idx bigint, ty bigint, tx bigint, h bigint, w bigint, n bigint, px binary"
_LIGHT = np.array([299, 587, 114])


def picture(px: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(px, np.uint8).reshape(h, w, 4)


def there(h: int, w: int, n: int) -> np.ndarray:
    return (np.arange(h * w) < n).reshape(h, w)


def on_tiles(boxes: DataFrame) -> DataFrame:
    """Boxes once for every tile they touch."""
    solid = boxes.filter("x2 > x1 AND y2 > y1").withColumn(
        "t", F.explode(G.tiles("x1", "y1", F.col("x2") - 1, F.col("y2") - 1, C.TILE))
    )
    return solid.withColumns({"ty": F.col("t.ty"), "tx": F.col("t.tx")}).drop("t")


def over_regions(blocks: DataFrame, regions: DataFrame, call: Callable, schema: str) -> DataFrame:
    """``call(box, crop, known, todo)`` per region that has pixels; it returns a list of rows, as dicts.

    ``crop``: height x width x 4 of the region's box, ``known``: which pixels exist, ``todo``: the
    region's own list of numbers, where ``regions`` has such a column. ``schema`` lists the
    columns after the region key.
    """
    carried = ["todo"] if "todo" in regions.columns else []
    slim = regions.select(*REGION, *[F.col(c).cast("bigint").alias(c) for c in BOX], *carried)
    # A tile meets its regions as one list, so its pixels go to Python once.
    lists = on_tiles(slim).groupBy(*TILE_KEY).agg(F.collect_list(F.struct("region_id", *BOX, *carried)).alias("boxes"))
    met = blocks.join(lists, TILE_KEY).select(*TILE_KEY, "h", "w", "n", "px", "boxes")
    names = [*REGION, *BOX, "py", "px", "h", "w", "body", *carried]
    piece = ", ".join(f"{c} bigint" for c in names[: names.index("body")]) + ", body binary" + (", todo array<bigint>" if carried else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            boxes = batch.column("boxes").flatten()
            ends = np.cumsum(np.diff(batch.column("boxes").offsets.to_numpy()))
            ident, x1, y1, x2, y2 = (boxes.field(c).to_numpy() for c in ("region_id", *BOX))
            tiles = [batch.column(c).to_pylist() for c in (*TILE_KEY, "h", "w", "n", "px")]
            held, spots, bodies, start = [], [], [], 0
            for doc, page, ty, tx, h, w, n, body, end in zip(*tiles, ends.tolist()):
                tile = np.concatenate([picture(body, h, w), there(h, w, n)[:, :, None].astype(np.uint8)], axis=2)
                y0, x0 = ty * C.TILE, tx * C.TILE
                top, bottom = np.maximum(y1[start:end], y0), np.minimum(y2[start:end], y0 + h)
                left, right = np.maximum(x1[start:end], x0), np.minimum(x2[start:end], x0 + w)
                for k in np.flatnonzero((top < bottom) & (left < right)).tolist():
                    a, b, c, d = int(top[k]), int(bottom[k]), int(left[k]), int(right[k])
                    held.append(start + k)
                    spots.append((doc, page, a, c, b - a, d - c))
                    bodies.append(tile[a - y0 : b - y0, c - x0 : d - x0].tobytes())
                start = end
            held = np.array(held, np.int64)
            doc, page, py, px, h, w = np.array(spots, np.int64).reshape(-1, 6).T
            columns = [doc, page, ident[held], x1[held], y1[held], x2[held], y2[held], py, px, h, w]
            more = [boxes.field("todo").take(pa.array(held))] if carried else []
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary()), *more], names=names)

    head = ", ".join(f"{c} bigint" for c in REGION) + ", " + schema
    kinds = to_arrow_schema(blocks.sparkSession.createDataFrame([], head).schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(in_parts(batches), REGION):
            keys = list(zip(*(table.column(c).to_numpy()[starts].tolist() for c in REGION)))
            boxes = list(zip(*(table.column(c).to_numpy()[starts].tolist() for c in BOX)))
            spots = list(zip(*(table.column(c).to_pylist() for c in ("py", "px", "h", "w", "body"))))
            rows = []
            for key, (x1, y1, x2, y2), at, size in zip(keys, boxes, starts.tolist(), sizes.tolist()):
                crop = np.zeros((y2 - y1, x2 - x1, 5), np.uint8)
                for py, px, h, w, body in spots[at : at + size]:
                    crop[py - y1 : py - y1 + h, px - x1 : px - x1 + w] = np.frombuffer(body, np.uint8).reshape(h, w, 5)
                todo = np.array(table.column("todo")[at].as_py(), np.int64) if carried else None
                named = dict(zip(REGION, key))
                rows += [{**named, **found} for found in call((x1, y1, x2, y2), crop[:, :, :4], crop[:, :, 4] > 0, todo)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return met.mapInArrow(cut, piece).repartition(*REGION).sortWithinPartitions(*REGION, "py", "px").mapInArrow(answer, head)


def _median(values: np.ndarray) -> list:
    return np.floor(np.median(values, axis=0)).astype(int).tolist() if len(values) else [None] * 3


def _edges(known: np.ndarray) -> np.ndarray:
    """Along how many edges each pixel lies."""
    edge = np.zeros(known.shape, np.int64)
    edge[0] += 1
    edge[-1] += 1
    edge[:, 0] += 1
    edge[:, -1] += 1
    return edge * known


def _least(dark: np.ndarray, where: np.ndarray) -> int | None:
    return int(dark[where].min()) if where.any() else None


#: Columns of each kind of facts.
FACTS = {
    "edges": "edge_dark bigint, edge_n bigint, edge_light bigint, edge_colour array<bigint>",
    "background": "back_dark bigint, back_n bigint, back_light bigint, back_colour array<bigint>",
    "whole": "dark bigint",
    "mask": "above array<bigint>, max_m bigint",
}


def region_facts(blocks: DataFrame, regions: DataFrame, *wanted: str) -> DataFrame:
    """What is asked of a region's pixels, in one pass; ``wanted`` names kinds of ``FACTS``, none
    means all: darkest pixel, brightness and median colour along the edges and outside the text,
    darkest of all, mask counts. ``n`` counts pixels. Regions without a pixel have nulls."""
    kinds = wanted or tuple(FACTS)

    def facts(box, crop: np.ndarray, known: np.ndarray, todo) -> list[dict]:
        found: dict = {"n": int(known.sum())}
        if not found["n"]:
            return []
        rgb, mask = crop[:, :, :3], crop[:, :, 3]
        if "edges" in kinds:
            edge = _edges(known)
            strip, times = rgb[edge > 0].astype(np.int64), edge[edge > 0]
            wide = known.shape[0] > 2 and known.shape[1] > 2
            found |= {
                "edge_dark": int(strip.min()) if len(strip) else None, "edge_n": int(times.sum()),
                "edge_light": int((strip @ _LIGHT * times).sum()), "edge_colour": _median(strip) if wide else [None] * 3,
            }
        if "background" in kinds:
            back = rgb[known & (mask <= C.MASK_TEXT_LEVEL)].astype(np.int64)
            found |= {
                "back_dark": int(back.min()) if len(back) else None, "back_n": len(back),
                "back_light": int((back @ _LIGHT).sum()), "back_colour": _median(back),
            }
        if "whole" in kinds:
            found["dark"] = _least(rgb.min(axis=2), known)
        if "mask" in kinds:
            found |= {"above": [int((mask[known] > v).sum()) for v in (5, 10, 30, 127)], "max_m": int(mask[known].max(initial=0))}
        return [found]

    facts_of = over_regions(blocks, clip_to_page(regions), facts, ", ".join(["n bigint", *(FACTS[k] for k in kinds)]))
    return regions.join(facts_of, REGION, "left")


def judged(facts: DataFrame, white: int = C.WHITE_LEVEL, dark: int = C.DARK_LEVEL) -> DataFrame:
    """Facts read as the tests they are enough for: white edges and background, dark ground, text under the mask."""
    def darker(light: str, n: str):
        return F.coalesce(F.col(light) < F.col(n) * dark * 1000, F.lit(False))

    tests = {
        "edge_dark": {"edges_white": F.coalesce(F.col("edge_dark") >= white, F.lit(False)), "white_by_edge": darker("edge_light", "edge_n")},
        "back_dark": {"background_white": F.coalesce(F.col("back_dark") >= white, F.lit(True)), "white_by_mask": darker("back_light", "back_n")},
        "dark": {"all_white": F.coalesce(F.col("dark") >= white, F.lit(True))},
        "max_m": {"has_text": F.coalesce(F.col("max_m") > C.MASK_STRONG_LEVEL, F.lit(False))},
    }
    return facts.withColumns({name: test for column, some in tests.items() if column in facts.columns for name, test in some.items()})


def grown(text: np.ndarray, steps: int = 2) -> np.ndarray:
    """Spots grown by ``steps`` of the 4-neighbour cross."""
    for _ in range(steps):
        wider = text.copy()
        wider[1:] |= text[:-1]
        wider[:-1] |= text[1:]
        wider[:, 1:] |= text[:, :-1]
        wider[:, :-1] |= text[:, 1:]
        text = wider
    return text


def grown_text(blocks: DataFrame, regions: DataFrame, steps: int = 2) -> DataFrame:
    """Text pixels of each region grown by ``steps`` of the 4-neighbour cross, kept inside it:
    the box and its mask ``m`` of ones."""
    def grow(box, crop, known, todo):
        return [{**dict(zip(BOX, box)), "m": pack(grown((crop[:, :, 3] > C.MASK_TEXT_LEVEL) & known, steps).astype(np.uint8))}]

    return over_regions(blocks, clip_to_page(regions), grow, "x1 bigint, y1 bigint, x2 bigint, y2 bigint, m binary")


def region_crops(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region's pixels and mask (JN-18): box, size of what exists, RGB and mask bytes row by row."""
    def crop_of(box, crop, known, todo):
        rows, columns = known.any(axis=1).sum(), known.any(axis=0).sum()
        return [{**dict(zip(BOX, box)), "width": int(columns), "height": int(rows), "rgb": crop[known][:, :3].tobytes(), "mask": crop[known][:, 3].tobytes()}]

    return over_regions(blocks, clip_to_page(regions), crop_of, "x1 bigint, y1 bigint, x2 bigint, y2 bigint, width bigint, height bigint, rgb binary, mask binary")


def paint(blocks: DataFrame, fills: DataFrame) -> DataFrame:
    """Paint fills in ``fill_ord`` order, the last one on a pixel staying.

    ``fills``: page, region_id, fill_ord, box, fill_r/g/b and ``masked``; a masked fill paints
    the text pixels of the mask. A tile has few fills, so its list is small.
    """
    item = F.struct("fill_ord", *[F.col(c).cast("bigint").alias(c) for c in BOX], "masked", *[F.col(f"fill_{c}").cast("int").alias(f"fill_{c}") for c in "rgb"])
    lists = on_tiles(fills.withColumn("item", item)).groupBy(*TILE_KEY).agg(F.array_sort(F.collect_list("item")).alias("fills"))

    def change(tile, r, fills):
        y0, x0 = r["ty"] * C.TILE, r["tx"] * C.TILE
        text = tile[:, :, 3] > C.MASK_TEXT_LEVEL
        for f in fills or []:
            a, b = max(f["y1"] - y0, 0), min(f["y2"] - y0, r["h"])
            c, d = max(f["x1"] - x0, 0), min(f["x2"] - x0, r["w"])
            if a < b and c < d:
                spots = text[a:b, c:d] if f["masked"] else np.ones((b - a, d - c), bool)
                tile[a:b, c:d, :3][spots] = (f["fill_r"], f["fill_g"], f["fill_b"])
        return tile

    return _per_tile(blocks, [("fills", lists)], change)


_BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def whitened(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions painted white, for runs without inpainting."""
    white = {f"fill_{c}": F.lit(255) for c in "rgb"}
    return paint(blocks, clip_to_page(regions).withColumns({"fill_ord": F.lit(0), "masked": F.lit(False), **white}))


def _per_tile(blocks: DataFrame, others: list[tuple[str, DataFrame]], change: Callable) -> DataFrame:
    """``change(tile, other blocks' bytes)`` on each tile; others are joined tile by tile."""
    joined = blocks
    for name, other in others:
        joined = joined.join(other.select(*TILE_KEY, F.col(other.columns[-1]).alias(name)), TILE_KEY, "left")
    names = [n for n, _ in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            done = [change(picture(r["px"], r["h"], r["w"]).copy(), r, *(r[n] for n in names)).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BLOCK_NAMES[:-1]), pa.array(done, pa.binary())], names=_BLOCK_NAMES)

    return joined.select(*_BLOCK_NAMES, *names).mapInArrow(run, BLOCK)


def restored(blocks: DataFrame, original: DataFrame, regions: DataFrame) -> DataFrame:
    """Original pixels put back inside the given regions."""
    boxes = on_tiles(clip_to_page(regions)).groupBy(*TILE_KEY).agg(F.collect_list(F.array(*[F.col(c).cast("bigint") for c in BOX])).alias("boxes"))

    def change(tile, r, source, inside):
        y0, x0 = r["ty"] * C.TILE, r["tx"] * C.TILE
        for x1, y1, x2, y2 in inside or []:
            at = (slice(max(y1 - y0, 0), max(y2 - y0, 0)), slice(max(x1 - x0, 0), max(x2 - x0, 0)))
            tile[at][:, :, :3] = picture(source, r["h"], r["w"])[at][:, :, :3]
        return tile

    return _per_tile(blocks, [("source", original), ("inside", boxes)], change)


def blanked(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """Model input: pixels zero where the mask, over 256, is above one half."""
    def change(tile, r):
        tile[:, :, :3][tile[:, :, 3] / 256.0 > share] = 0
        return tile

    return _per_tile(blocks, [], change)


def composited(blocks: DataFrame, painted: DataFrame) -> DataFrame:
    """Blend model output over the picture by the mask over 256, truncated. ``painted`` ends
    with a column of float64 bytes, -1 to 1, three per pixel."""
    def change(tile, r, out):
        colour = np.clip((np.frombuffer(out, np.float64).reshape(*tile.shape[:2], 3) + 1) * 127.5, 0, 255)
        mask = tile[:, :, 3:] / 256.0
        tile[:, :, :3] = np.floor(tile[:, :, :3] * (1 - mask) + colour * mask)
        return tile

    return _per_tile(blocks, [("painted", painted)], change)


#: Clearing rules by number, as a region's list of boxes names them.
RULES = ("char", "line", "mask_line", "mask_region")


def _white_edges(rgb: np.ndarray, known: np.ndarray, white: int) -> bool:
    strip = rgb[_edges(known) > 0]
    return bool(len(strip)) and strip.min() >= white


def _edge_fill(rgb: np.ndarray, known: np.ndarray) -> list | None:
    """Median colour of the edges of a box of three pixels or more each way."""
    return _median(rgb[_edges(known) > 0]) if min(known.shape) > 2 else None


def clear_region(origin: tuple[int, int], crop: np.ndarray, known: np.ndarray, boxes: np.ndarray, white: int = C.WHITE_LEVEL):
    """A region's boxes filled one after the other, each on what the ones before it left.

    ``boxes``: (rule, line number, box, box of the character's line) in painting order. Returns
    the changed colours and where they were painted.
    """
    rgb, mask, painted = crop[:, :, :3].copy(), crop[:, :, 3], np.zeros(known.shape, bool)
    x0, y0 = origin
    line, line_white = None, False
    for rule, line_no, x1, y1, x2, y2, lx1, ly1, lx2, ly2 in boxes.tolist():
        at = (slice(y1 - y0, y2 - y0), slice(x1 - x0, x2 - x0))
        own, here = rgb[at], known[at]
        spots, colour = np.ones(here.shape, bool), [255] * 3
        if RULES[rule] == "char":
            # The line's edges are looked at before its first character is filled.
            if line != line_no:
                edge = (slice(ly1 - y0, ly2 - y0), slice(lx1 - x0, lx2 - x0))
                line, line_white = line_no, _white_edges(rgb[edge], known[edge], white)
            if not line_white:
                colour = _edge_fill(own, here) or colour
        elif RULES[rule] != "mask_region" and _white_edges(own, here, white):
            pass
        elif RULES[rule] == "line":
            colour = _edge_fill(own, here)
        else:
            text = (mask[at] > C.MASK_TEXT_LEVEL) & here
            back = own[here & ~text]
            spots = grown(text)
            colour = _median(back) if len(back) else colour
        if colour is not None:
            spots = spots & here
            own[spots] = colour
            painted[at] |= spots
    return rgb, painted


def clear_text(blocks: DataFrame, regions: DataFrame, texts: DataFrame, has_mask: bool = True, prefer_mask: bool = False) -> DataFrame:
    """The clearing step as one operator: every region's boxes as ``plan_clearing`` has them, by all
    four rules. Returns the changed blocks.

    A region is cut out once, with all its boxes, and painted in order, so a box that lies over
    another takes its colour from what that one left. Regions start from the original picture
    and are laid onto it in order.
    """
    plan = clip_to_page(plan_clearing(texts, regions, has_mask, prefer_mask)).filter("x2 > x1 AND y2 > y1")
    rule = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")) - 1
    line = [F.coalesce(f"line_{c}", c) for c in BOX]
    item = F.struct("line_no", "char_no", F.array(*[c.cast("bigint") for c in (rule, F.col("line_no"), *map(F.col, BOX), *line)]).alias("box"))
    # A region has as many boxes as it has characters; their hull is what is cut out.
    hulls = plan.groupBy(*REGION).agg(
        *[low(F.least(c, o)).alias(c) for low, c, o in ((F.min, "x1", line[0]), (F.min, "y1", line[1]))],
        *[high(F.greatest(c, o)).alias(c) for high, c, o in ((F.max, "x2", line[2]), (F.max, "y2", line[3]))],
        F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["box"])).alias("todo"),
    )

    def clear(box, crop, known, todo):
        x0, y0, x2, y2 = box
        rgb, painted = clear_region((x0, y0), crop, known, todo.reshape(-1, 10))
        for ty in range(y0 // C.TILE, (y2 - 1) // C.TILE + 1):
            for tx in range(x0 // C.TILE, (x2 - 1) // C.TILE + 1):
                a, c = max(ty * C.TILE, y0), max(tx * C.TILE, x0)
                part = (slice(a - y0, (ty + 1) * C.TILE - y0), slice(c - x0, (tx + 1) * C.TILE - x0))
                if painted[part].any():
                    h, w = painted[part].shape
                    yield {"ty": ty, "tx": tx, "y": a - ty * C.TILE, "x": c - tx * C.TILE, "h": h, "w": w, "cover": pack(painted[part].astype(np.uint8)), "rgb": rgb[part].tobytes()}

    parts = over_regions(blocks, hulls, clear, "ty bigint, tx bigint, y bigint, x bigint, h bigint, w bigint, cover binary, rgb binary")
    lists = parts.groupBy(*TILE_KEY).agg(F.array_sort(F.collect_list(F.struct("region_id", "y", "x", "h", "w", "cover", "rgb"))).alias("parts"))

    def lay(tile, r, parts):
        for p in parts or []:
            spots = unpack(p["cover"], p["h"], p["w"]) > 0
            colours = np.frombuffer(p["rgb"], np.uint8).reshape(p["h"], p["w"], 3)
            tile[p["y"] : p["y"] + p["h"], p["x"] : p["x"] + p["w"], :3][spots] = colours[spots]
        return tile

    return _per_tile(blocks, [("parts", lists)], lay)
