"""OCR lines to the grid cells they belong to.

A document of few cells is one list that its lines go through, so every line is dealt
once.  In others, as cells of one grid lie apart from each other, a tile of the grid meets
only a bounded number of cells: lines and cells are joined on (document, batch, tile)
and the exact rule is tested on those pairs; a batch never meets itself whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions import geometry as G
from regionflow.functions.text import has_map_script, is_noise, strip
from regionflow.session import by_key, cut_lineage, freed_shuffles

LINE_KEY = ("doc_id", "line_no")
GRID_BOX = ("gx1", "gy1", "gx2", "gy2")
CELL_FIELDS = [
    "batch_idx", "cell_idx", "page_idx", "bubble_idx", *GRID_BOX, "bx1", "by1", "pad_l", "pad_t",
]
BOX_FIELDS = ["page_idx", "bubble_idx", *GRID_BOX, "bx1", "by1", "pad_l", "pad_t"]
# Documents of at most so many cells are lists.
FEW_CELLS = 128
# Tile sizes; a box is probed at the first size it fits in, the rest in one tile.
TILE_SIZES = (256, 2048, 16384)
# Tiles that points are looked up in, and the longest side of the cells that lie in them.
POINT_TILES = ((32, 1024), (512, 16384), (8192, None))


def scale_to_image(lines: DataFrame, images: DataFrame, tolerance: float = C.DPI_TOLERANCE) -> DataFrame:
    """Undo display scaling: when an image's lines reach more than 1 % past its
    width or height, divide its boxes by that ratio (1.0 on an axis not exceeded).

    ``images`` has doc_id, batch_idx, img_w, img_h.
    """
    keys = ["doc_id", "batch_idx"]
    reach = lines.groupBy(*keys).agg(
        F.max(F.col("x") + F.col("width")).alias("max_x"),
        F.max(F.col("y") + F.col("height")).alias("max_y"),
    )

    def over(reached: str, limit: str) -> Column:
        return F.when(F.col(reached) > F.col(limit), F.col(reached) / F.col(limit)).otherwise(1.0)

    scale = (
        reach.join(images, keys)
        .withColumns({"sx": over("max_x", "img_w"), "sy": over("max_y", "img_h")})
        .filter((F.col("sx") > tolerance) | (F.col("sy") > tolerance))
        .select(*keys, "sx", "sy")
    )
    sx, sy = F.coalesce("sx", F.lit(1.0)), F.coalesce("sy", F.lit(1.0))
    return (
        lines.join(scale, keys, "left")
        .withColumns({
            "x": F.col("x") / sx, "y": F.col("y") / sy,
            "width": F.col("width") / sx, "height": F.col("height") / sy,
        })
        .drop("sx", "sy")
    )


def lines_outside_image(lines: DataFrame, images: DataFrame) -> DataFrame:
    return lines.join(images, ["doc_id", "batch_idx"]).filter(
        (F.col("x") + F.col("width") > F.col("img_w"))
        | (F.col("y") + F.col("height") > F.col("img_h"))
    )


def screen_lines(lines: DataFrame, translated: bool = False) -> DataFrame:
    """Trim texts and name the lines that are not mapped at all."""
    text = strip(F.coalesce("text", F.lit("")))
    skipped = F.when(is_noise(text), "skipped_empty")
    if not translated:
        skipped = skipped.when(~has_map_script(text), "skipped_no_script")
    return lines.withColumns({"text": text, "skipped": skipped})


def _line_points() -> dict[str, Column]:
    x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    return {
        "lx2": x2, "ly2": y2,
        "cx": (F.col("x") + x2) / 2, "cy": (F.col("y") + y2) / 2,
    }


def _probe(level: int, tiles: Column) -> Column:
    return F.transform(
        tiles,
        lambda t: F.struct(
            F.lit(level).alias("lv"), t.getField("ty").alias("ty"), t.getField("tx").alias("tx")
        ),
    )


def _whole() -> Column:
    """The one tile for boxes larger than every tile size."""
    zero = F.lit(0).cast("bigint")
    return F.struct(F.lit(len(TILE_SIZES)).alias("lv"), zero.alias("ty"), zero.alias("tx"))


def _line_probes(lines: DataFrame, points: bool = True) -> DataFrame:
    """Tiles of the box and, with ``points``, of the centre and of the top-left corner."""
    small = TILE_SIZES[0]
    box = ("x", "y", "lx2", "ly2")
    longest = F.greatest("width", "height")
    by_size = F.when(longest <= TILE_SIZES[0], _probe(0, G.tiles(*box, TILE_SIZES[0])))
    for level, size in enumerate(TILE_SIZES[1:], 1):
        by_size = by_size.when(longest <= size, _probe(level, G.tiles(*box, size)))
    by_size = by_size.otherwise(F.array(_whole()))
    if points:
        by_size = F.array_distinct(F.concat(
            _probe(0, G.tiles("cx", "cy", "cx", "cy", small)), _probe(0, G.tiles("x", "y", "x", "y", small)), by_size
        ))
    return lines.withColumn("p", F.explode(by_size))


def _cell_probes(cells: DataFrame, tolerance: float) -> DataFrame:
    grown = [F.col(c) + d for c, d in zip(GRID_BOX, (-tolerance, -tolerance, tolerance, tolerance))]
    probes = [_probe(level, G.tiles(*grown, size)) for level, size in enumerate(TILE_SIZES)]
    return cells.withColumn("p", F.explode(F.concat(*probes, F.array(_whole()))))


def _one_per_box(cells: DataFrame) -> DataFrame:
    """Earliest cell of every distinct grid box: without a batch to tell them
    apart, equal boxes always lose to the earliest."""
    rest = [c for c in CELL_FIELDS if c not in GRID_BOX]
    first = F.min_by(F.struct(*rest), F.col("cell_idx")).alias("c")
    return cells.groupBy("doc_id", *GRID_BOX).agg(first).select(
        "doc_id", *GRID_BOX, *[F.col(f"c.{c}").alias(c) for c in rest]
    )


def _point_cells(cells: DataFrame, tolerance: float) -> DataFrame:
    """Small tiles ``p`` with the cells a point in them may be in, of a document's cells in any batch.

    The earliest cell wins, so behind one that covers a whole tile none counts there. What is
    left of a tile depends on where boxes end in it, not on how many batches a document has.
    """
    grown = {c: F.col(c) + d for c, d in zip(GRID_BOX, (-tolerance, -tolerance, tolerance, tolerance))}
    longest = F.greatest(F.col("gx2") - F.col("gx1"), F.col("gy2") - F.col("gy1"))
    probes = F.lit(None)
    for level, (size, most) in reversed(list(enumerate(POINT_TILES))):
        there = _probe(level, G.tiles(*grown.values(), size))
        probes = there if most is None else F.when(longest <= most, there).otherwise(probes)
    touched = _one_per_box(cells).select("doc_id", "cell_idx", *GRID_BOX, F.explode(probes).alias("p"))
    size = F.element_at(F.array(*[F.lit(s) for s, _ in POINT_TILES]), F.col("p.lv") + 1)
    covers = F.lit(True)
    for axis in "xy":
        place = F.col(f"p.t{axis}")
        covers = covers & (grown[f"g{axis}1"] <= place * size) & (grown[f"g{axis}2"] >= (place + 1) * size)
    first = touched.groupBy("doc_id", "p").agg(F.min(F.when(covers, F.col("cell_idx"))).alias("first"))
    return touched.join(by_key(first), ["doc_id", "p"]).filter("first IS NULL OR cell_idx <= first").drop("first")


def _candidates(pairs: DataFrame, key: list[str], rule: Column, overlap: Column | float = 0.0) -> DataFrame:
    """The best of each line's cells: by rule, then by overlap in rule 3, then the earliest."""
    best = F.struct(rule.alias("rule"), F.when(rule == 3, -overlap).otherwise(0.0).alias("rank"), "cell_idx")
    return pairs.filter(rule.isNotNull()).groupBy(*key).agg(F.min(best).alias("m"))


def _best_cells(lines: DataFrame, cells: DataFrame, line_key: Sequence[str], tolerance: float, unknown_batches: bool) -> DataFrame:
    """(key, doc_id, rule, rank, cell_idx) of every line that lies in a cell."""
    key = list(dict.fromkeys([*line_key, "doc_id"]))
    placed = cells.select("doc_id", *CELL_FIELDS)
    points = lines.withColumns(_line_points()).select(*key, F.col("batch_idx").alias("l_batch"), "x", "y", "lx2", "ly2", "cx", "cy", "width", "height")
    overlap = G.overlap_area(("x", "y", "lx2", "ly2"), GRID_BOX)
    centre, corner = (F.when(G.inside(GRID_BOX, *at, tolerance), n) for n, at in ((1, ("cx", "cy")), (2, ("x", "y"))))
    known = _cell_probes(placed.filter("batch_idx IS NOT NULL"), tolerance)
    known = known.select("doc_id", F.col("batch_idx").alias("l_batch"), "p", "cell_idx", *GRID_BOX)
    met = _line_probes(points.filter("l_batch IS NOT NULL")).join(by_key(known), ["doc_id", "l_batch", "p"])
    found = _candidates(met, key, F.coalesce(centre, corner, F.when(overlap > 0, 3)), overlap)
    if not unknown_batches:
        return found.select(*key, "m.rule", "m.rank", "m.cell_idx")
    # A line without a batch may lie in any cell, one with a batch also in those without.
    # Joins for a kind that is not there at all are left out.
    without = placed.filter("batch_idx IS NULL")
    sides = [(some, others) for some, others, gone in (
        ("l_batch IS NULL", placed, lines.filter("batch_idx IS NULL").isEmpty()), ("l_batch IS NOT NULL", without, without.isEmpty()),
    ) if not gone]
    if not sides:
        return found.select(*key, "m.rule", "m.rank", "m.cell_idx")
    for some, others in sides:
        at = [
            F.struct(F.lit(n).alias("n"), F.struct(F.lit(level).alias("lv"), F.floor(F.col(y) / size).alias("ty"), F.floor(F.col(x) / size).alias("tx")).alias("p"))
            for n, x, y in ((1, "cx", "cy"), (2, "x", "y")) for level, (size, _) in enumerate(POINT_TILES)
        ]
        asked = points.filter(some).select(*key, "x", "y", "cx", "cy", F.inline(F.array(*at)))
        in_tile = asked.join(by_key(_point_cells(others, tolerance)), ["doc_id", "p"])
        found = found.unionByName(_candidates(in_tile, key, F.when(F.col("n") == 1, centre).otherwise(corner)))
    found = cut_lineage(found.groupBy(*key).agg(F.min("m").alias("m")))
    # The largest overlap only counts for lines whose points are in no cell.
    rest = points.join(by_key(found.filter("m.rule < 3").select(*key)), key, "left_anti")
    by_size = _line_probes(rest, points=False)
    for some, others in sides:
        boxes = _cell_probes(_one_per_box(others), tolerance).select("doc_id", "p", "cell_idx", *GRID_BOX)
        pairs = by_size.filter(some).join(by_key(boxes), ["doc_id", "p"])
        found = found.unionByName(_candidates(pairs, key, F.when(overlap > 0, 3), overlap))
    return found.groupBy(*key).agg(F.min("m").alias("m")).select(*key, "m.rule", "m.rank", "m.cell_idx")


def _by_length(cells: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells of documents of at most ``few`` cells, and of those with more, or None where there are none."""
    sizes = cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    with freed_shuffles(cells.sparkSession):
        most = sizes.agg(F.max("n")).first()[0]
    if most is None or most <= few:
        return cells, None
    cells = cut_lineage(cells)
    long = cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few)
    return cells.join(by_key(long), "doc_id", "left_anti"), cells.join(by_key(long), "doc_id", "left_semi")


def _placed_by_lists(lines: DataFrame, cells: DataFrame, tolerance: float, unknown_batches: bool, by_number: bool, fields: Sequence[str]) -> DataFrame:
    """Lines with ``m``, the best of their document's cells, which are few; null where none fits."""
    lists = cells.groupBy("doc_id").agg(
        F.collect_list(F.struct(*dict.fromkeys(["batch_idx", "cell_idx", *GRID_BOX, *fields]))).alias("__cells")
    )
    points = _line_points()
    x, y, cx, cy = F.col("x"), F.col("y"), points["cx"], points["cy"]
    has_box = x.isNotNull() & y.isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()

    def named(cell: Column) -> Column:
        return F.coalesce(cell.getField("cell_idx") == F.col("cell_idx"), F.lit(False))

    def may(cell: Column) -> Column:
        same = F.coalesce(cell.getField("batch_idx") == F.col("batch_idx"), F.lit(unknown_batches))
        return (same & has_box) | named(cell) if by_number else same & has_box

    def judged(cell: Column) -> Column:
        box = [cell.getField(c) for c in GRID_BOX]
        overlap = G.overlap_area((x, y, points["lx2"], points["ly2"]), box)
        centre, corner = G.inside(box, cx, cy, tolerance), G.inside(box, x, y, tolerance)
        rule = F.when(centre, 1).when(corner, 2).when(overlap > 0, 3)
        rank = F.when(centre | corner, 0.0).otherwise(-overlap)
        if by_number:
            rule, rank = F.when(named(cell), 0).otherwise(rule), F.when(named(cell), 0.0).otherwise(rank)
        return F.struct(rule.alias("rule"), rank.alias("rank"), *[cell.getField(c).alias(c) for c in ("cell_idx", *fields)])

    fits = F.filter(F.transform(F.filter("__cells", may), judged), lambda m: m.getField("rule").isNotNull())
    met = lines.join(by_key(lists), "doc_id", "left")
    # Made as a row of its own, so that it is made once however often it is asked for.
    return met.withColumn("m", F.explode(F.array(F.array_min(fits)))).drop("__cells")


def _placed_by_tiles(lines: DataFrame, cells: DataFrame, key: list[str], tolerance: float, unknown_batches: bool, by_number: bool, fields: Sequence[str]) -> DataFrame:
    """Lines with ``m`` like those of ``_placed_by_lists``, whatever the number of a document's cells."""
    direct = _directly(lines, cells, key, fields) if by_number else cut_lineage(lines)
    rest = direct.filter("m IS NULL") if by_number else direct
    boxed = rest.select(*dict.fromkeys([*key, "doc_id", "batch_idx", "x", "y", "width", "height"])).dropna(subset=["x", "y", "width", "height"])
    found = _best_cells(boxed, cells, key, tolerance, unknown_batches)
    if fields:
        found = found.join(by_key(cells.select("doc_id", "cell_idx", F.struct(*fields).alias("c"))), ["doc_id", "cell_idx"])
    found = found.select(*key, F.struct("rule", "rank", "cell_idx", *[f"c.{c}" for c in fields]).alias("by_place"))
    both = direct.join(by_key(found), key, "left")
    return both.withColumn("m", F.coalesce("m", "by_place") if by_number else F.col("by_place")).drop("by_place")


def _placed(
    lines: DataFrame, cells: DataFrame, line_key: Sequence[str], tolerance: float = C.MATCH_TOLERANCE,
    unknown_batches: bool = True, by_number: bool = True, fields: Sequence[str] = BOX_FIELDS,
) -> DataFrame:
    """Every line with ``m``: rule, rank, cell_idx and ``fields`` of its cell, or null. With ``by_number``
    a line's own cell number goes before all (rule 0); one that no cell has counts as none."""
    short, long = _by_length(cells, FEW_CELLS)
    if long is None:
        return _placed_by_lists(lines, short, tolerance, unknown_batches, by_number, fields)
    ids = by_key(long.select("doc_id").distinct())
    listed = _placed_by_lists(lines.join(ids, "doc_id", "left_anti"), short, tolerance, unknown_batches, by_number, fields)
    tiled = _placed_by_tiles(lines.join(ids, "doc_id", "left_semi"), long, list(line_key), tolerance, unknown_batches, by_number, fields)
    return listed.unionByName(tiled)


def spatial_matches(
    lines: DataFrame,
    cells: DataFrame,
    line_key: Sequence[str] = LINE_KEY,
    tolerance: float = C.MATCH_TOLERANCE,
    unknown_batches: bool = True,
    skip_named: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Best cell per line: (1) line centre in the cell, (2) top-left corner in the
    cell, both with tolerance and the earliest cell winning, (3) largest overlap.

    A line or cell without a batch may match any batch of its document; pass
    ``unknown_batches=False`` when every batch is known to save the joins for them.
    With ``skip_named`` lines whose own ``cell_idx`` is one of their document are left out.
    Columns to ``carry`` go along with the line's key.
    """
    named = ["cell_idx"] if skip_named else []
    asked = lines.select(*dict.fromkeys([*line_key, "doc_id", "batch_idx", "x", "y", "width", "height", *carry, *named]))
    placed = _placed(asked, cells, line_key, tolerance, unknown_batches, by_number=skip_named).filter("m.rule > 0")
    # Rows of one key are one line. Dealt by it, so that the join of a document with very many lines may be split.
    best = placed.repartition(*line_key).groupBy(*line_key).agg(F.min(F.struct("m", *carry)).alias("b"))
    return best.select(*line_key, *[f"b.{c}" for c in carry], *[f"b.m.{c}" for c in ("rule", "cell_idx", *BOX_FIELDS)])


def _page_box(exact: bool) -> Column:
    """Page coordinates of a match, truncated; a cell match takes the cell size."""
    if exact:
        return F.array(
            F.col("bx1"), F.col("by1"),
            F.col("bx1") + F.col("gx2") - F.col("gx1"), F.col("by1") + F.col("gy2") - F.col("gy1"),
        ).cast("array<int>")
    left = F.col("x") - F.col("gx1") + F.col("bx1") - F.col("pad_l")
    top = F.col("y") - F.col("gy1") + F.col("by1") - F.col("pad_t")
    return F.array(left, top, left + F.col("width"), top + F.col("height")).cast("array<int>")


def chars_to_page(chars: str = "chars") -> Column:
    """Character boxes from grid to page coordinates; only 4-long boxes stay."""
    dx = F.col("bx1") - F.col("gx1") - F.col("pad_l")
    dy = F.col("by1") - F.col("gy1") - F.col("pad_t")
    return F.transform(
        F.filter(F.col(chars), lambda c: F.size(c.getField("bbox")) == 4),
        lambda c: F.struct(
            c.getField("char").alias("char"),
            F.transform(
                c.getField("bbox"),
                lambda v, i: (v + F.when(i % 2 == 0, dx).otherwise(dy)).cast("int"),
            ).alias("bbox"),
        ),
    )


def _directly(lines: DataFrame, cells: DataFrame, key: list[str], fields: Sequence[str]) -> DataFrame:
    """Lines with ``m``, the cell of their own number (rule 0), or null. Written out."""
    # A line without a cell number gets one of many impossible numbers, so that
    # such lines spread over the join instead of meeting in one task.
    spread = F.coalesce("cell_idx", -1 - F.pmod(F.xxhash64(*key), F.lit(4096)))
    named = F.struct(F.lit(0).alias("rule"), F.lit(0.0).alias("rank"), "cell_idx", *fields).alias("m")
    known = cells.select("doc_id", F.col("cell_idx").alias("__cell"), named)
    return cut_lineage(lines.withColumn("__cell", spread).join(by_key(known), ["doc_id", "__cell"], "left").drop("__cell"))


def map_outcomes(
    lines: DataFrame, cells: DataFrame, line_key: Sequence[str] = LINE_KEY, translated: bool = False, unknown_batches: bool = True
) -> DataFrame:
    """The ``outcome`` of every line, as ``map_lines`` has it, without its cell: whether any cell fits is enough."""
    slim = lines.select(*dict.fromkeys([*line_key, "doc_id", "batch_idx", "cell_idx", "text", "x", "y", "width", "height"]))
    return _mapped(slim, cells, line_key, translated, unknown_batches, []).select(*line_key, "outcome")


def _mapped(lines: DataFrame, cells: DataFrame, line_key: Sequence[str], translated: bool, unknown_batches: bool, fields: Sequence[str]) -> DataFrame:
    """Screened lines with their ``outcome`` and ``m``."""
    screened = screen_lines(lines, translated)
    # Lines that are not mapped need no cell, so they are not dealt.
    placed = _placed(screened.filter("skipped IS NULL"), cells, line_key, unknown_batches=unknown_batches, fields=fields)
    aside = screened.filter("skipped IS NOT NULL").withColumn("m", F.lit(None).cast(placed.schema["m"].dataType))
    missing_box = F.col("x").isNull() | F.col("width").isNull()
    outcome = (
        F.when(F.col("m.rule") == 0, "matched_cell_idx").when(missing_box, "skipped_no_bbox")
        .when(F.col("m").isNotNull(), "matched_bbox").otherwise("unmatched")
    )
    return placed.unionByName(aside).withColumn("outcome", F.coalesce("skipped", outcome)).drop("skipped")


def map_by_number(lines: DataFrame, cells: DataFrame, line_key: Sequence[str] = LINE_KEY, translated: bool = False) -> DataFrame:
    """The lines that ``map_lines`` maps by their own cell number, with the cell and the page box."""
    named = screen_lines(lines, translated).filter("skipped IS NULL").select(*dict.fromkeys([*line_key, "doc_id", "cell_idx"]))
    found = named.join(by_key(cells.select("doc_id", "cell_idx", *BOX_FIELDS)), ["doc_id", "cell_idx"])
    return found.withColumn("bbox", _page_box(True))


def map_lines(
    lines: DataFrame,
    cells: DataFrame,
    line_key: Sequence[str] = LINE_KEY,
    translated: bool = False,
    unknown_batches: bool = True,
) -> DataFrame:
    """Every line with its ``outcome``, matched cell and page box.

    Lines: doc_id, batch_idx, text, x, y, width, height, cell_idx[, chars] and a key.
    Cells: doc_id, cell_idx (unique, in list order) and ``CELL_FIELDS``.
    """
    # A cell number nobody knows is dropped here and the position decides.
    both = _mapped(lines, cells, line_key, translated, unknown_batches, BOX_FIELDS)
    by_cell, placed = F.col("rule") == 0, F.col("rule") > 0
    mapped = both.withColumns({c: F.col(f"m.{c}") for c in ("cell_idx", *BOX_FIELDS, "rule")}).drop("m").withColumn(
        "bbox", F.when(placed, _page_box(False)).when(by_cell, _page_box(True))
    )
    if "chars" in lines.columns:
        kind = "array<struct<char:string,bbox:array<int>>>"
        mapped = mapped.withColumn("chars", F.when(placed, chars_to_page().cast(kind)))
    return mapped


def nearest_cells(
    points: DataFrame, cells: DataFrame, line_key: Sequence[str] = LINE_KEY,
    tiles: Sequence[tuple[str, int]] = (("1", 1 << 20), ("1", 1 << 14), ("1", 1 << 8), ("2", 32), ("2", 4)), few: int = 128,
) -> DataFrame:
    """Closest grid box (0 inside) to every point (cx, cy), over all batches.

    A document of at most ``few`` boxes is one list that its points go through. The boxes
    of others are grouped into ever smaller tiles with the hull of what they hold, first by
    their near corner (1), then by their far one (2), so that the last tiles hold boxes of
    nearly one place and size, and few of them however many boxes a document has.
    From the largest tiles down, a point keeps only tiles whose hull comes nearer
    than the distance some other tile guarantees; single boxes are compared last.
    """
    key = list(line_key)
    point = list(dict.fromkeys(["doc_id", *key, "cx", "cy"]))
    points = points.select(*point).dropna(subset=["cx", "cy"])
    boxes = cut_lineage(_one_per_box(cells.select("doc_id", *CELL_FIELDS)))
    sizes = boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    least, most = sizes.agg(F.min("n"), F.max("n")).first()
    found = []
    if least is None or least <= few:
        short = boxes.join(by_key(sizes.filter(F.col("n") <= few)), "doc_id", "left_semi")
        found.append(_nearest_of_list(points, short))
    if most is not None and most > few:
        long = boxes.join(by_key(sizes.filter(F.col("n") > few)), "doc_id", "left_semi")
        found.append(_nearest_by_tiles(points, long, key, tiles))
    return (
        reduce(DataFrame.unionByName, [df.select(*key, "m") for df in found]).groupBy(*key).agg(F.min("m").alias("m"))
        .select(*key, F.sqrt("m.d2").alias("distance"), "m.cell_idx", "m.page_idx", "m.bubble_idx")
    )


def _squared(x1, y1, x2, y2) -> Column:
    """Squared distance of the point to a box."""
    dx, dy = G.axis_distance(x1, x2, "cx"), G.axis_distance(y1, y2, "cy")
    return dx * dx + dy * dy


def _nearest_of_list(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with ``m``, the nearest of their document's boxes, which are few."""
    lists = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cell_idx", "page_idx", "bubble_idx", *GRID_BOX))).alias("boxes"))
    reached = F.transform("boxes", lambda b: _squared(*[b.getField(c) for c in GRID_BOX]))
    # The list is in the cells' order, so the first of the smallest distances is the earliest cell's.
    first = F.array_position("reached", F.array_min("reached")).cast("int")
    named = points.join(by_key(lists), "doc_id").withColumn("reached", reached).withColumn("at", first)
    nearest = F.get("boxes", F.col("at") - 1)
    return named.withColumn("m", F.struct(
        F.get("reached", F.col("at") - 1).alias("d2"), *[nearest.getField(c).alias(c) for c in ("cell_idx", "page_idx", "bubble_idx")]
    ))


def _nearest_by_tiles(points: DataFrame, boxes: DataFrame, key: list[str], tiles: Sequence[tuple[str, int]]) -> DataFrame:
    """Points with ``m`` for each of the boxes that may be the nearest."""
    own = ["doc_id"]
    for level, (corner, size) in enumerate(tiles):
        boxes = boxes.withColumn(
            f"t{level}",
            F.struct(F.floor(F.col(f"gy{corner}") / size).alias("ty"), F.floor(F.col(f"gx{corner}") / size).alias("tx")),
        )
        own = [*own, f"t{level}"]
    # The hulls of the smallest tiles are stored; those of larger ones are made of them.
    boxes = cut_lineage(boxes)
    hull = {"hx1": F.min, "hy1": F.min, "hx2": F.max, "hy2": F.max}
    smallest = cut_lineage(boxes.groupBy(*own).agg(*[low(f"g{name[1:]}").alias(name) for name, low in hull.items()]))

    def reach(low, high, p):
        return F.greatest(F.abs(F.col(p) - F.col(low)), F.abs(F.col(high) - F.col(p)))

    far_x, far_y = reach("hx1", "hx2", "cx"), reach("hy1", "hy2", "cy")
    # A level that parts nothing, as where all pages are smaller than its tiles, is left out.
    names = [f"t{i}" for i in range(len(tiles))]
    parts = smallest.agg(F.count_distinct("doc_id"), *[F.count_distinct("doc_id", *names[: i + 1]) for i in range(len(tiles))]).first()
    used = [t for t, before, now in zip(names, parts, parts[1:]) if now > before]
    kept, parents = points, ["doc_id"]
    for level in range(len(used)):
        own = ["doc_id", *used[: level + 1]]
        hulls = smallest.groupBy(*own).agg(*[low(name).alias(name) for name, low in hull.items()])
        near = kept.join(by_key(hulls), parents).withColumns({
            "low": _squared("hx1", "hy1", "hx2", "hy2"), "sure": far_x * far_x + far_y * far_y,
        })
        near = near.withColumn("limit", F.min("sure").over(Window.partitionBy(*key)))
        kept = near.filter("low <= limit").select(*dict.fromkeys([*points.columns, *own]))
        parents = own
    return kept.join(by_key(boxes), parents).withColumn("m", F.struct(_squared(*GRID_BOX).alias("d2"), "cell_idx", "page_idx", "bubble_idx"))


def unmapped_regions(regions: DataFrame, mapped: DataFrame) -> DataFrame:
    """Regions no line was mapped to."""
    keys = ["doc_id", "page_idx", "bubble_idx"]
    hits = mapped.filter("page_idx IS NOT NULL").select(*keys).distinct()
    return regions.join(by_key(hits), keys, "left_anti")


def near_misses(
    lines: DataFrame,
    cells: DataFrame,
    line_key: Sequence[str] = LINE_KEY,
    distance: float = C.NEAR_MISS_DISTANCE,
    tile: int = 256,
) -> DataFrame:
    """Lines whose centre comes within ``distance`` on both axes of a cell."""
    key = list(line_key)
    grown = [F.col(c) + d for c, d in zip(GRID_BOX, (-distance, -distance, distance, distance))]
    probes = cells.select(
        "doc_id", "batch_idx", "cell_idx", *GRID_BOX,
        F.explode(G.tiles(*grown, tile)).alias("p"),
    )
    centres = lines.withColumns(_line_points()).select(
        *dict.fromkeys([*key, "doc_id", "batch_idx", "cx", "cy"]),
        F.struct(
            F.floor(F.col("cy") / tile).alias("ty"), F.floor(F.col("cx") / tile).alias("tx")
        ).alias("p"),
    )
    return (
        centres.join(by_key(probes), ["doc_id", "batch_idx", "p"])
        .withColumns({
            "dx": G.axis_distance("gx1", "gx2", "cx"), "dy": G.axis_distance("gy1", "gy2", "cy"),
            "in_box": G.inside(GRID_BOX, "cx", "cy"),
        })
        .filter((F.col("dx") < distance) & (F.col("dy") < distance))
        .drop("p", *GRID_BOX)
    )


def mapping_counts(mapped: DataFrame) -> DataFrame:
    """One row of counters over the outcomes."""
    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome).alias(outcome)

    return mapped.agg(
        F.count(F.lit(1)).alias("total_lines"),
        *[
            count(o)
            for o in (
                "skipped_empty", "skipped_no_script", "skipped_no_bbox",
                "matched_cell_idx", "matched_bbox", "unmatched",
            )
        ],
    )


def mapped_share(regions: DataFrame, mapped: DataFrame) -> DataFrame:
    """Regions, regions with text and their percentage per document."""
    keys = ["doc_id", "page_idx", "bubble_idx"]
    hit = mapped.filter("page_idx IS NOT NULL").select(*keys).distinct().withColumn("hit", F.lit(1))
    return (
        regions.select(*keys).join(by_key(hit), keys, "left").groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("regions"), F.count("hit").alias("mapped"))
        .withColumn("percent", F.lit(100) * F.col("mapped") / F.greatest(F.lit(1), "regions"))
    )
