"""Queries over detections, regions and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import geometry as G
from regionflow.operators import batching, detect, layout, stats
from regionflow.operators.ordering import radix_levels, with_position
from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.session import by_key, cut_lineage

KEY = ["doc_id", "page_idx", "det_idx"]


@query("detect_filter", sql(
    "SELECT doc_id, page_idx, det_idx, label, score FROM det WHERE score > 0.5 AND label = 1", "det"))
def detect_filter(spark, sf):
    return detect.keep_detections(X.det(spark, sf), 1).select(*KEY, "label", "score")


@query("raw_boxes", sql("""SELECT doc_id, page_idx, det_idx, round(1 / (1 + exp(-lg)), 9) AS score,
    CAST(trunc((cx - w / 2) * width) AS BIGINT) AS x1, CAST(trunc((cy - h / 2) * height) AS BIGINT) AS y1,
    CAST(trunc((cx + w / 2) * width) AS BIGINT) AS x2, CAST(trunc((cy + h / 2) * height) AS BIGINT) AS y2 FROM (
    SELECT doc_id, page_idx, det_idx, (score - 0.4) * (label + 1) AS lg, x1 / 1024.0::DOUBLE AS cx, y1 / 1024.0::DOUBLE AS cy,
    (x2 - x1) / 1024.0::DOUBLE AS w, (y2 - y1) / 1024.0::DOUBLE AS h FROM det) JOIN page_dim USING (doc_id, page_idx)
    WHERE 1 / (1 + exp(-lg)) > 0.5""", "det", "page_dim"))
def raw_boxes(spark, sf):
    raw = X.det(spark, sf).selectExpr(
        *KEY, "array(0D, (score - 0.4D) * (label + 1), 1D) AS logits",
        "x1 / 1024D AS cx", "y1 / 1024D AS cy", "(x2 - x1) / 1024D AS w", "(y2 - y1) / 1024D AS h",
    )
    boxes = detect.boxes_from_logits(raw, X.page_dim(spark, sf), 1)
    return detect.keep_detections(boxes, 1).select(
        *KEY, F.round("score", 9).alias("score"), "x1", "y1", "x2", "y2"
    )


@query("reading_order", sql("""SELECT doc_id, page_idx, label, det_idx, x1, y1, row_number() OVER (
    PARTITION BY doc_id, page_idx, label ORDER BY floor(y1 / 100.0), x1 DESC, det_idx) - 1 AS bubble_idx
    FROM det WHERE score > 0.5 AND label = 1""", "det"))
def reading_order(spark, sf):
    kept = detect.keep_detections(X.det(spark, sf), 1)
    return detect.reading_order(kept).select(
        "doc_id", "page_idx", "label", "det_idx", "x1", "y1", "bubble_idx"
    )


@query("crop_window", sql("""SELECT doc_id, page_idx, level, bubble_idx, pad_l, pad_t, crop_w, crop_h FROM regions""", "regions"))
def crop_window(spark, sf):
    return X.regions(spark, sf).select(
        "doc_id", "page_idx", "level", "bubble_idx", "pad_l", "pad_t", "crop_w", "crop_h"
    )


def sized_det(spark, sf):
    return X.det(spark, sf).selectExpr(
        "*", "CAST(900 AS BIGINT) AS width", "CAST(1280 AS BIGINT) AS height"
    )


@query("context_window", sql("""SELECT doc_id, page_idx, det_idx, cx1, cy1, cx2, cy2, bx1 - cx1 AS mx1, by1 - cy1 AS my1,
    bx2 - cx1 AS mx2, by2 - cy1 AS my2, CAST(ceil((cx2 - cx1) / 8.0) AS BIGINT) * 8 AS model_w,
    CAST(ceil((cy2 - cy1) / 8.0) AS BIGINT) * 8 AS model_h FROM (
    SELECT *, greatest(0, bx1 - 64) AS cx1, greatest(0, by1 - 64) AS cy1, least(900, bx2 + 64) AS cx2,
    least(1280, by2 + 64) AS cy2 FROM (SELECT *, greatest(0, x1 - 5) AS bx1, greatest(0, y1 - 5) AS by1,
    least(900, x2 + 5) AS bx2, least(1280, y2 + 5) AS by2 FROM det WHERE label = 2))""", "det"))
def context_window(spark, sf):
    return detect.context_window(sized_det(spark, sf).filter("label = 2")).select(
        *KEY, "cx1", "cy1", "cx2", "cy2", "mx1", "my1", "mx2", "my2", "model_w", "model_h"
    )


@query("clamp_boxes", sql("""SELECT doc_id, page_idx, det_idx, greatest(0, x1) AS x1, greatest(0, y1) AS y1,
    least(900, x2) AS x2, least(1000, y2) AS y2 FROM det
    WHERE least(900, x2) > greatest(0, x1) AND least(1000, y2) > greatest(0, y1)""", "det"))
def clamp_boxes(spark, sf):
    short = sized_det(spark, sf).withColumn("height", F.lit(1000).cast("bigint"))
    return detect.clamp_boxes(short).select(*KEY, "x1", "y1", "x2", "y2")


@query("by_score", sql("""SELECT doc_id, page_idx, det_idx, score,
    row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY score DESC, det_idx) - 1 AS rank FROM det WHERE label = 1 AND score > 0.5""", "det"))
def by_score(spark, sf):
    return detect.by_score(detect.keep_detections(X.det(spark, sf), 1)).select(*KEY, "score", "rank")


@query("top_regions", sql("""SELECT doc_id, page_idx, level, bubble_idx, x1, y1 FROM regions WHERE bubble_idx < 2
    ORDER BY doc_id, page_idx, level, bubble_idx LIMIT 20""", "regions"))
def top_regions(spark, sf):
    keys = ["doc_id", "page_idx", "level", "bubble_idx"]
    return X.regions(spark, sf).filter("bubble_idx < 2").orderBy(*keys).limit(20).select(
        *keys, "x1", "y1"
    )


@query("regions_per_page", sql("""SELECT doc_id, page_idx, count(*) AS regions FROM regions GROUP BY ALL""", "regions"))
def regions_per_page(spark, sf):
    kept = detect.keep_detections(X.det(spark, sf)).filter("label IN (1, 2)")
    return stats.regions_per_page(kept)


@query("pages_to_segment", sql("""SELECT doc_id, page_idx FROM page_dim WHERE (doc_id, page_idx) IN (
    SELECT (doc_id, page_idx) FROM det WHERE score > 0.5 AND label IN (1, 2))""", "page_dim"))
def pages_to_segment(spark, sf):
    det = X.det(spark, sf)
    return detect.pages_with_regions(
        X.page_dim(spark, sf), detect.keep_detections(det, 1), detect.keep_detections(det, 2)
    ).select("doc_id", "page_idx")


@query("letterbox", sql("""SELECT *, CASE WHEN pad_right > 0 THEN 1024 - pad_right ELSE 1024 END AS mask_x2,
    CASE WHEN pad_bottom > 0 THEN 1024 - pad_bottom ELSE 1024 END AS mask_y2 FROM (
    SELECT doc_id, page_idx, det_idx, CAST(round_even(w * r, 0) AS BIGINT) AS new_w, CAST(round_even(h * r, 0) AS BIGINT) AS new_h,
    CAST(round_even((1024 - round_even(w * r, 0)) / 2 - 0.1::DOUBLE, 0) AS BIGINT) AS pad_left,
    CAST(round_even((1024 - round_even(w * r, 0)) / 2 + 0.1::DOUBLE, 0) AS BIGINT) AS pad_right,
    CAST(round_even((1024 - round_even(h * r, 0)) / 2 - 0.1::DOUBLE, 0) AS BIGINT) AS pad_top,
    CAST(round_even((1024 - round_even(h * r, 0)) / 2 + 0.1::DOUBLE, 0) AS BIGINT) AS pad_bottom FROM (
    SELECT *, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h,
    least(1024::DOUBLE / (y2 - y1), 1024::DOUBLE / (x2 - x1)) AS r FROM det))""", "det"))
def letterbox(spark, sf):
    boxes = X.det(spark, sf).selectExpr(*KEY, "x2 - x1 AS width", "y2 - y1 AS height")
    fitted = boxes.withColumns(G.letterbox("width", "height")).withColumns(G.letterbox_inverse())
    return fitted.select(
        *KEY, "new_w", "new_h", "pad_left", "pad_right", "pad_top", "pad_bottom", "mask_x2", "mask_y2"
    )


def page_items(spark, sf):
    """First-level regions of a document in order, as items to pack."""
    first = X.regions(spark, sf).filter("level = 1")
    return batching.region_order(first, "seq").selectExpr(
        "doc_id", "seq", "page_idx", "bubble_idx", "crop_w AS w", "crop_h AS h"
    )


def stored_items(spark, sf):
    return cut_lineage(page_items(spark, sf))


ITEMS = """items AS (SELECT doc_id, page_idx, bubble_idx, crop_w AS w, crop_h AS h, row_number() OVER (
    PARTITION BY doc_id ORDER BY page_idx, bubble_idx) - 1 AS seq FROM regions WHERE level = 1)"""


@query("region_numbers", sql(f"SELECT * FROM (WITH {ITEMS} SELECT doc_id, page_idx, bubble_idx, seq FROM items)", "regions"))
def region_numbers(spark, sf):
    return page_items(spark, sf).select("doc_id", "page_idx", "bubble_idx", "seq")


SHELF = f"""WITH RECURSIVE {{head}}, {ITEMS}, walk AS (
    SELECT doc_id, seq, 0::BIGINT AS row_idx, 0::BIGINT AS row_ord, 30 + w + 30 AS used FROM items WHERE seq = 0
    UNION ALL
    SELECT i.doc_id, i.seq, CASE WHEN used + w + 30 + {{extra}} > 600 THEN row_idx + 1 ELSE row_idx END,
    CASE WHEN used + w + 30 + {{extra}} > 600 THEN 0 ELSE row_ord + 1 END,
    CASE WHEN used + w + 30 + {{extra}} > 600 THEN 30 + w + 30 ELSE used + w + 30 END
    FROM walk JOIN items i ON i.doc_id = walk.doc_id AND i.seq = walk.seq + 1) """


def shelf_sql(body: str, extra: int = 0) -> str:
    head = sql("", "regions").strip()[len("WITH "):]
    return SHELF.format(head=head, extra=extra) + body


@query("shelf_pack", shelf_sql("SELECT doc_id, seq, row_idx, row_ord FROM walk"))
def shelf_pack(spark, sf):
    return layout.shelf_rows(stored_items(spark, sf))


@query("shelf_pack_separated", shelf_sql("SELECT doc_id, seq, row_idx, row_ord FROM walk", 6))
def shelf_pack_separated(spark, sf):
    return layout.shelf_rows(stored_items(spark, sf), separators=True)


# Blocks so short that the documents of the test tables need several of them.
@query("shelf_pack_chained", shelf_sql("SELECT doc_id, seq, row_idx, row_ord FROM walk"))
def shelf_pack_chained(spark, sf):
    return layout.shelf_rows(stored_items(spark, sf), block=1, super_block=2)


def one_grid(spark, sf, separators):
    items = stored_items(spark, sf)
    rows = cut_lineage(layout.shelf_rows(items, separators=separators))
    return items.join(by_key(rows), ["doc_id", "seq"]).withColumn("batch_idx", F.lit(0).cast("bigint"))


GRID = """, placed AS (SELECT * FROM walk JOIN items USING (doc_id, seq)),
    tall AS (SELECT doc_id, row_idx, max(h) AS row_h, count(*) AS n FROM placed GROUP BY ALL),
    tops AS (SELECT *, coalesce(sum(row_h + 30 + {line}) OVER o, 0) AS above, coalesce(sum(n) OVER o, 0) AS cells_before
    FROM tall WINDOW o AS (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, seq, CAST(cells_before + row_ord AS BIGINT) AS cell_idx, CAST(30 + coalesce(sum(w + 30 + {line}) OVER (
    PARTITION BY doc_id, row_idx ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gx1,
    CAST(30 + above + floor((row_h - h) / 2) AS BIGINT) AS gy1 FROM placed JOIN tops USING (doc_id, row_idx)"""


@query("grid_coords", shelf_sql("", 6).rstrip() + GRID.format(line=6))
def grid_coords(spark, sf):
    return layout.grid_coordinates(one_grid(spark, sf, True), separators=True).select(
        "doc_id", "seq", "cell_idx", "gx1", "gy1"
    )


@query("grid_facts", shelf_sql("""SELECT doc_id, 0::BIGINT AS batch_idx, max(row_idx) + 1 AS n_rows,
    max(row_ord) + 1 AS max_cols, count(*) AS total_cells FROM walk GROUP BY doc_id"""))
def grid_facts(spark, sf):
    return layout.grid_facts(one_grid(spark, sf, False))


# One step a batch: what is left is laid out in rows, each row joins if it fits, and the items
# of the others go on.
HEIGHT = """, walk_b AS (SELECT doc_id, 0::BIGINT AS batch_idx, list(struct_pack(seq := seq, w := w, h := h) ORDER BY seq) AS items FROM items GROUP BY doc_id), cascade AS (
    SELECT doc_id, batch_idx, items, NULL::STRUCT(seq BIGINT, w BIGINT, h BIGINT)[][] AS kept FROM walk_b
    UNION ALL
    SELECT doc_id, batch_idx + 1, flatten(split.over), split.fits FROM (SELECT doc_id, batch_idx, list_reduce(
        list_transform(packed.rows, lambda r: struct_pack(used := 0::BIGINT, fits := [r], over := [r][:0])),
        lambda a, x: CASE WHEN a.used + list_max(list_transform(x.fits[1], lambda i: i.h)) + 30 <= 1000 OR len(a.fits) = 0
        THEN struct_pack(used := a.used + list_max(list_transform(x.fits[1], lambda i: i.h)) + 30, fits := list_concat(a.fits, x.fits), over := a.over)
        ELSE struct_pack(used := a.used, fits := a.fits, over := list_concat(a.over, x.fits)) END,
        struct_pack(used := 30::BIGINT, fits := [packed.rows[1]][:0], over := [packed.rows[1]][:0])) AS split
    FROM (SELECT doc_id, batch_idx, list_reduce(
        list_transform(items, lambda i: struct_pack(used := 0::BIGINT, rows := [[i]])),
        lambda a, x: CASE WHEN len(a.rows) = 0 OR a.used + x.rows[1][1].w + 30 > 600
        THEN struct_pack(used := 60 + x.rows[1][1].w, rows := list_concat(a.rows, x.rows))
        ELSE struct_pack(used := a.used + x.rows[1][1].w + 30, rows := list_concat(a.rows[:-2], [list_concat(a.rows[-1], x.rows[1])])) END,
        struct_pack(used := 30::BIGINT, rows := [[items[1]]][:0])) AS packed FROM cascade WHERE len(items) > 0)))
    SELECT doc_id, seq, batch_idx - 1 AS batch_idx, row_idx - 1 AS row_idx, row_ord - 1 AS row_ord FROM (
    SELECT doc_id, batch_idx, row_idx, unnest(row).seq AS seq, unnest(range(1, len(row) + 1)) AS row_ord FROM (
    SELECT doc_id, batch_idx, unnest(kept) AS row, unnest(range(1, len(kept) + 1)) AS row_idx FROM cascade WHERE kept IS NOT NULL))"""


@query("height_batches", f"WITH RECURSIVE {sql('', 'regions').strip()[len('WITH '):]}, {ITEMS}" + HEIGHT)
def height_batches(spark, sf):
    return layout.height_batches(stored_items(spark, sf), max_height=1000)


@query("fixed_batches", sql(f"""SELECT * FROM (WITH {ITEMS} SELECT doc_id, seq, CAST(floor(seq / 9) AS BIGINT) AS batch_idx,
    seq % 9 AS batch_pos FROM items)""", "regions"))
def fixed_batches(spark, sf):
    return batching.fixed_batches(page_items(spark, sf), 9).select(
        "doc_id", "seq", "batch_idx", "batch_pos"
    )


@query("page_batches", sql("""SELECT doc_id, page_idx, bubble_idx,
    CASE WHEN total <= 40 THEN 0 ELSE b END AS batch_idx, CASE WHEN total <= 40 THEN 0 ELSE off END AS batch_offset,
    CASE WHEN total <= 40 THEN seq ELSE seq - off END AS batch_pos FROM (
    SELECT *, min(seq) OVER (PARTITION BY doc_id, page_idx, part) AS off,
    dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx, part) - 1 AS b FROM (
    SELECT doc_id, page_idx, bubble_idx, CAST(floor(bubble_idx / 2) AS BIGINT) AS part,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, bubble_idx) - 1 AS seq,
    count(*) OVER (PARTITION BY doc_id) AS total FROM regions WHERE level = 2))""", "regions").replace(
        "floor(bubble_idx / 2)", "floor(bubble_idx / 40)"))
def page_batches(spark, sf):
    second = X.regions(spark, sf).filter("level = 2").select("doc_id", "page_idx", "bubble_idx")
    return batching.page_batches(second, 40)


@query("page_batches_small", sql("""SELECT doc_id, page_idx, bubble_idx, b AS batch_idx, off AS batch_offset,
    seq - off AS batch_pos FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, page_idx, part) AS off,
    dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx, part) - 1 AS b FROM (
    SELECT doc_id, page_idx, bubble_idx, CAST(floor(bubble_idx / 2) AS BIGINT) AS part,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, bubble_idx) - 1 AS seq FROM regions WHERE level = 1))""", "regions"))
def page_batches_small(spark, sf):
    first = X.regions(spark, sf).filter("level = 1").select("doc_id", "page_idx", "bubble_idx")
    return batching.page_batches(first, 2)


@query("thumbnail_grid", sql("""SELECT doc_id, page_idx, seq % 4 AS grid_col, CAST(floor(seq / 4) AS BIGINT) AS grid_row,
    (seq % 4) * 400 AS gx, CAST(floor(seq / 4) AS BIGINT) * max_h + CAST(floor((max_h - thumb_h) / 2) AS BIGINT) AS gy FROM (
    SELECT *, max(thumb_h) OVER (PARTITION BY doc_id) AS max_h FROM (SELECT doc_id, page_idx,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS seq,
    CAST(floor((1280 + page_idx * 7) * (400::DOUBLE / (900 + doc_id % 5))) AS BIGINT) AS thumb_h FROM page_dim))""", "page_dim"))
def thumbnail_grid(spark, sf):
    pages = X.page_dim(spark, sf).selectExpr(
        "doc_id", "page_idx", "900 + doc_id % 5 AS width", "1280 + page_idx * 7 AS height"
    )
    numbered = with_position(
        pages, ["doc_id"], radix_levels("page_idx", "__p", 2), [F.col("page_idx")], "seq"
    )
    return layout.thumbnail_grid(numbered).select(
        "doc_id", "page_idx", "grid_col", "grid_row", "gx", "gy"
    )
