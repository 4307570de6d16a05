"""Queries over pixels and masks under regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.operators import assemble, infer
from regionflow.operators import blocks as B
from regionflow.operators import components as K
from regionflow.operators import masks as M
from regionflow.operators import pixels as P
from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.session import cut_lineage

REGION = ["doc_id", "page_idx", "region_id"]
KEYS = "doc_id, page_idx, region_id"
LIGHT = "r * 299 + g * 587 + b * 114"


def facts(spark, sf, *wanted):
    return B.judged(B.region_facts(X.blocks(spark, sf), X.px_regions(spark, sf), *wanted))


@query("edge_white", sql(f"""SELECT {KEYS}, coalesce(w, false) AS edges_white FROM px_regions LEFT JOIN (
    SELECT {KEYS}, min(least(r, g, b)) >= 240 AS w FROM inside WHERE edge > 0 GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def edge_white(spark, sf):
    return facts(spark, sf, "edges").select(*REGION, "edges_white")


@query("background_white", sql(f"""SELECT {KEYS}, coalesce(w, true) AS background_white FROM px_regions LEFT JOIN (
    SELECT {KEYS}, min(least(r, g, b)) >= 240 AS w FROM inside WHERE m <= 5 GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def background_white(spark, sf):
    return facts(spark, sf, "background").select(*REGION, "background_white")


@query("needing_inpaint", sql(f"""SELECT {KEYS} FROM inside GROUP BY ALL HAVING min(least(r, g, b)) < 240""", "inside"))
def needing_inpaint(spark, sf):
    return facts(spark, sf, "whole").filter("NOT all_white").select(*REGION)


@query("text_color", sql(f"""SELECT {KEYS}, coalesce(e.w, false) AS by_edge, coalesce(m.w, false) AS by_mask FROM px_regions
    LEFT JOIN (SELECT {KEYS}, sum(edge * ({LIGHT})) < 128000 * sum(edge) AS w FROM inside GROUP BY ALL) e USING ({KEYS})
    LEFT JOIN (SELECT {KEYS}, sum({LIGHT}) < 128000 * count(*) AS w FROM inside WHERE m <= 5 GROUP BY ALL) m USING ({KEYS})""", "inside", "px_regions"))
def text_color(spark, sf):
    return facts(spark, sf, "edges", "background").select(*REGION, F.col("white_by_edge").alias("by_edge"), F.col("white_by_mask").alias("by_mask"))


MEDIAN = ", ".join(f"CAST(floor(quantile_cont({c}, 0.5)) AS BIGINT) AS fill_{c}" for c in "rgb")


@query("fill_color", sql(f"""SELECT {KEYS}, fill_r, fill_g, fill_b FROM px_regions LEFT JOIN (
    SELECT {KEYS}, {MEDIAN} FROM inside WHERE edge > 0 AND x2 - x1 > 2 AND y2 - y1 > 2 GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def fill_color(spark, sf):
    return facts(spark, sf, "edges").select(*REGION, *[F.get("edge_colour", F.lit(k)).alias(f"fill_{c}") for k, c in enumerate("rgb")])


@query("mask_fill_color", sql(f"""SELECT {KEYS}, coalesce(fill_r, 255) AS fill_r, coalesce(fill_g, 255) AS fill_g, coalesce(fill_b, 255) AS fill_b
    FROM px_regions LEFT JOIN (SELECT {KEYS}, {MEDIAN} FROM inside WHERE m <= 5 GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def mask_fill_color(spark, sf):
    white = F.lit(255).cast("bigint")
    return facts(spark, sf, "background").select(
        *REGION, *[F.coalesce(F.get("back_colour", F.lit(k)), white).alias(f"fill_{c}") for k, c in enumerate("rgb")]
    )


DILATE = f"""SELECT DISTINCT {KEYS}, y + dy AS y, x + dx AS x FROM inside, (SELECT * FROM (SELECT unnest(range(-2, 3)) AS dy),
    (SELECT unnest(range(-2, 3)) AS dx) WHERE abs(dy) + abs(dx) <= 2) WHERE m > 5
    AND y + dy >= y1 AND y + dy < y2 AND x + dx >= x1 AND x + dx < x2"""


# Stretches of pixels next to each other in a row.
STRETCHES = """SELECT {keys}, y, min(x) AS x1, max(x) + 1 AS x2{more} FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y{by} ORDER BY x) AS stretch
    FROM ({pixels})) GROUP BY {keys}, y, stretch{by}"""


@query("dilate_mask", sql(STRETCHES.format(keys=KEYS, pixels=DILATE, more="", by=""), "inside"))
def dilate_mask(spark, sf):
    grown = B.grown_text(X.blocks(spark, sf), X.px_regions(spark, sf))
    runs = M.rows_of_runs(grown, REGION, "y1", "x1", "y2 - y1", "x2 - x1")
    return runs.select(*REGION, "y", "x1", "x2")


@query("mask_coverage", sql(f"""SELECT {KEYS}, {", ".join(f"round(count(*) FILTER (m > {v}) / greatest(1, count(*))::DOUBLE * 100, 9) AS over_{v}" for v in (5, 10, 30, 127))},
    max(m) AS max_m FROM inside GROUP BY ALL""", "inside"))
def mask_coverage(spark, sf):
    shares = [F.round(F.get("above", F.lit(k)) / F.col("n") * 100, 9).alias(f"over_{v}") for k, v in enumerate((5, 10, 30, 127))]
    return facts(spark, sf, "mask").filter("n > 0").select(*REGION, *shares, "max_m")


@query("strong_mask", sql(f"""SELECT {KEYS}, coalesce(t, false) AS has_text FROM px_regions LEFT JOIN (
    SELECT {KEYS}, max(m) > 127 AS t FROM inside GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def strong_mask(spark, sf):
    return facts(spark, sf, "mask").select(*REGION, "has_text")


CHARS = [
    "x1 + 1 AS cx1", "y1 + 1 AS cy1",
    "x1 + CASE WHEN region_id % 3 = 0 THEN -9 ELSE 4 END AS cx2", "y1 + 3 AS cy2",
]
#: A second character lies over the first.
MORE_CHARS = ["x1 + 3 AS cx1", "y1 AS cy1", "x1 + CASE WHEN region_id % 3 = 0 THEN -9 ELSE 7 END AS cx2", "y1 + 2 AS cy2"]


@query("mask_source", sql(f"""SELECT {KEYS}, CASE WHEN least(x1 + CASE WHEN region_id % 3 = 0 THEN -9 ELSE 4 END, x2) > x1 + 1
    AND least(y1 + 3, y2) > y1 + 1 THEN 'char_boxes' WHEN x2 <= x1 OR y2 <= y1 THEN 'skipped' WHEN t THEN 'text_mask' ELSE 'whole_box' END AS source
    FROM px_regions LEFT JOIN (SELECT {KEYS}, max(m) > 127 AS t FROM inside GROUP BY ALL) USING ({KEYS})""", "inside", "px_regions"))
def mask_source(spark, sf):
    regions = X.px_regions(spark, sf)
    chars = regions.selectExpr(*REGION, *CHARS)
    return P.mask_source(regions, chars, facts(spark, sf, "mask")).select(*REGION, "source")


@query("char_mask", sql(STRETCHES.format(keys=KEYS, more="", by="", pixels=f"""SELECT {KEYS}, unnest(range(greatest(y1, y1 + 1), least(y2, y1 + 3))) AS y, x FROM (
    SELECT *, unnest(range(greatest(x1, x1 + 1), least(x2, x1 + 4))) AS x FROM px_regions WHERE region_id % 3 <> 0)
    UNION SELECT {KEYS}, unnest(range(y1, least(y2, y1 + 2))) AS y, x FROM (
    SELECT *, unnest(range(greatest(x1, x1 + 3), least(x2, x1 + 7))) AS x FROM px_regions WHERE region_id % 3 <> 0)"""), "px_regions"))
def char_mask(spark, sf):
    regions = X.px_regions(spark, sf)
    chars = regions.selectExpr(*REGION, *CHARS).unionByName(regions.selectExpr(*REGION, *MORE_CHARS))
    runs = M.rows_of_runs(M.char_mask(chars, regions), REGION, "y1", "x1", "y2 - y1", "x2 - x1")
    return runs.select(*REGION, "y", "x1", "x2")


@query("crop_pixels", sql(f"""SELECT {KEYS}, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS rgb,
    string_agg(printf('%02X', m), '' ORDER BY y, x) AS mask FROM inside GROUP BY ALL""", "inside"))
def crop_pixels(spark, sf):
    crops = B.region_crops(X.blocks(spark, sf), X.px_regions(spark, sf)).filter("width > 0")
    return crops.select(*REGION, F.hex("rgb").alias("rgb"), F.hex("mask").alias("mask"))


@query("region_pictures", sql(f"""SELECT {KEYS}, to_base64(from_hex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x))) AS image_base64,
    count(DISTINCT x) AS width, count(DISTINCT y) AS height FROM inside GROUP BY ALL""", "inside"))
def region_pictures(spark, sf):
    crops = B.region_crops(X.blocks(spark, sf), X.px_regions(spark, sf)).filter("width > 0")
    return crops.select(*REGION, assemble.one_line_base64(F.col("rgb")).alias("image_base64"), "width", "height")


SAID = f"""said AS (SELECT {KEYS}, string_agg('r' || region_id || 'l' || n, '' ORDER BY n) AS original_text FROM (SELECT *, unnest(range(region_id % 3)) AS n FROM px_regions) GROUP BY ALL),
    pictures AS (SELECT {KEYS}, any_value(x1) || ',' || any_value(y1) || ',' || any_value(x2) || ',' || any_value(y2) AS box,
    to_base64(from_hex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x))) AS image_base64 FROM inside GROUP BY ALL)"""


def speech_rows(spark, sf):
    regions = X.px_regions(spark, sf)
    lines = F.sequence(F.lit(1).cast("bigint"), F.col("region_id") % 3)
    texts = regions.filter("region_id % 3 > 0").select(*REGION, F.explode(lines).alias("n")).selectExpr(*REGION, "n AS line_no", "concat('r', region_id, 'l', n - 1) AS text")
    done = regions.filter("region_id % 5 > 0").selectExpr(*REGION, "concat('T', region_id) AS translated")
    crops = B.region_crops(X.blocks(spark, sf), regions).filter("width > 0")
    return assemble.speech_images(crops, texts, done)


@query("speech_images", sql(f"""SELECT * FROM (WITH {SAID} SELECT doc_id, page_idx, region_id AS bubble_idx, box, image_base64, coalesce(original_text, '') AS original_text,
    CASE WHEN region_id % 5 > 0 THEN 'T' || region_id ELSE '[MISSING]' END AS translated_text, false AS inpainted_background
    FROM pictures LEFT JOIN said USING ({KEYS}))""", "inside", "px_regions"))
def speech_images(spark, sf):
    box = F.array_join(F.col("bubble_box").cast("array<string>"), ",").alias("box")
    return speech_rows(spark, sf).select("doc_id", "page_idx", "bubble_idx", box, "image_base64", "original_text", "translated_text", "inpainted_background")


@query("speech_envelope", sql("""SELECT doc_id, 'success' AS status, 'speech_image_only' AS output_type, count(DISTINCT page_idx) AS page_count, count(*) AS bubble_count,
    concat('{"text_chars":', CAST(sum(chars) AS BIGINT), '}') AS stats FROM (SELECT doc_id, page_idx, region_id,
    coalesce(list_sum(list_transform(range(region_id % 3), lambda n: length('r' || region_id || 'l' || n))), 0) AS chars FROM inside GROUP BY ALL) GROUP BY doc_id""", "inside"))
def speech_envelope(spark, sf):
    pages = cut_lineage(assemble.speech_pages(speech_rows(spark, sf)))
    chars = F.aggregate("regions", F.lit(0).cast("bigint"), lambda n, r: n + F.length(r["original_text"]))
    totals = pages.groupBy("doc_id").agg(F.sum(chars).alias("text_chars"))
    return assemble.response_envelope(pages, "speech_image_only", totals)


@query("page_envelope", """SELECT CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id, 'success' AS status, 'full_page' AS output_type, count(*) AS page_count,
    NULL::BIGINT AS bubble_count, concat('{"encoded_chars":', CAST(sum(length('data:image/jpeg;base64,' || to_base64(encode(html)))) AS BIGINT), '}') AS stats FROM pages GROUP BY ALL""")
def page_envelope(spark, sf):
    from regionflow.plans.outcome_queries import page_results

    pages = page_results(spark, sf)
    totals = pages.groupBy("doc_id").agg(F.sum(F.length("data_url")).alias("encoded_chars"))
    return assemble.response_envelope(pages, "full_page", totals)


@query("apply_fills", sql("""SELECT doc_id, page_idx, y, string_agg(CAST(coalesce(f * CASE 'r' WHEN 'r' THEN 1 WHEN 'g' THEN 2 ELSE 3 END % 256, r) AS BIGINT) || ',' || CAST(coalesce(f * CASE 'g' WHEN 'r' THEN 1 WHEN 'g' THEN 2 ELSE 3 END % 256, g) AS BIGINT) || ',' || CAST(coalesce(f * CASE 'b' WHEN 'r' THEN 1 WHEN 'g' THEN 2 ELSE 3 END % 256, b) AS BIGINT), ' ' ORDER BY x) AS line FROM raster LEFT JOIN (SELECT doc_id, page_idx, y, x, max_by(region_id % 251, region_id) AS f
    FROM inside WHERE region_id % 2 = 0 OR m > 5 GROUP BY ALL) USING (doc_id, page_idx, y, x) GROUP BY ALL""", "inside", "raster"))
def apply_fills(spark, sf):
    colour = {f"fill_{c}": F.col("region_id") % 251 * k % 256 for k, c in enumerate("rgb", 1)}
    fills = P.clip_to_page(X.px_regions(spark, sf)).withColumns({
        "fill_ord": F.col("region_id"), "masked": F.col("region_id") % 2 == 1, **colour,
    })
    return X.pixel_lines(B.paint(X.blocks(spark, sf), fills))


@query("white_fill", sql("""SELECT doc_id, page_idx, y, string_agg(CAST(CASE WHEN hit IS NULL THEN r ELSE 255 END AS BIGINT) || ',' || CAST(CASE WHEN hit IS NULL THEN g ELSE 255 END AS BIGINT) || ',' || CAST(CASE WHEN hit IS NULL THEN b ELSE 255 END AS BIGINT), ' ' ORDER BY x) AS line FROM raster LEFT JOIN (
    SELECT DISTINCT doc_id, page_idx, y, x, 1 AS hit FROM inside) USING (doc_id, page_idx, y, x) GROUP BY ALL""", "inside", "raster"))
def white_fill(spark, sf):
    return X.pixel_lines(B.whitened(X.blocks(spark, sf), X.px_regions(spark, sf)))


@query("restore_pixels", sql("""SELECT doc_id, page_idx, y, string_agg(CAST(CASE WHEN hit IS NULL THEN CASE WHEN m / 256.0::DOUBLE > 0.1 THEN 0 ELSE r END ELSE r END AS BIGINT) || ',' || CAST(CASE WHEN hit IS NULL THEN CASE WHEN m / 256.0::DOUBLE > 0.1 THEN 0 ELSE g END ELSE g END AS BIGINT) || ',' || CAST(CASE WHEN hit IS NULL THEN CASE WHEN m / 256.0::DOUBLE > 0.1 THEN 0 ELSE b END ELSE b END AS BIGINT), ' ' ORDER BY x) AS line FROM raster LEFT JOIN (
    SELECT DISTINCT doc_id, page_idx, y, x, 1 AS hit FROM inside WHERE region_id % 3 = 0) USING (doc_id, page_idx, y, x) GROUP BY ALL""", "inside", "raster"))
def restore_pixels(spark, sf):
    original = X.blocks(spark, sf)
    changed = B.blanked(original, 0.1)
    return X.pixel_lines(B.restored(changed, original, X.px_regions(spark, sf).filter("region_id % 3 = 0")))


@query("composite", sql("""SELECT doc_id, page_idx, y, string_agg(CAST(floor(r * (1 - m / 256.0::DOUBLE) + least(255, greatest(0, ((y % 5 - 2) / 2.0::DOUBLE + 1) * 127.5::DOUBLE)) * (m / 256.0::DOUBLE)) AS BIGINT) || ',' || CAST(floor(g * (1 - m / 256.0::DOUBLE) + least(255, greatest(0, ((y % 5 - 2) / 2.0::DOUBLE + 1) * 127.5::DOUBLE)) * (m / 256.0::DOUBLE)) AS BIGINT) || ',' || CAST(floor(b * (1 - m / 256.0::DOUBLE) + least(255, greatest(0, ((y % 5 - 2) / 2.0::DOUBLE + 1) * 127.5::DOUBLE)) * (m / 256.0::DOUBLE)) AS BIGINT), ' ' ORDER BY x) AS line FROM raster GROUP BY ALL""", "inside", "raster"))
def composite(spark, sf):
    blocks = X.blocks(spark, sf)
    return X.pixel_lines(B.composited(blocks, X.painted_rows(blocks)))


@query("blank_under_mask", sql("""SELECT doc_id, page_idx, y, string_agg(CAST(CASE WHEN m / 256.0::DOUBLE > 0.5 THEN 0 ELSE r END AS BIGINT) || ',' || CAST(CASE WHEN m / 256.0::DOUBLE > 0.5 THEN 0 ELSE g END AS BIGINT) || ',' || CAST(CASE WHEN m / 256.0::DOUBLE > 0.5 THEN 0 ELSE b END AS BIGINT), ' ' ORDER BY x) AS line FROM raster GROUP BY ALL""", "inside", "raster"))
def blank_under_mask(spark, sf):
    return X.pixel_lines(B.blanked(X.blocks(spark, sf)))


@query("normalise_mask", sql("""SELECT doc_id, page_idx, y, string_agg(CASE WHEN page_idx % 2 = 0 THEN CAST(trunc(m / 256.0::DOUBLE * 255) AS BIGINT)
    ELSE least(255, m * 2) END, ',' ORDER BY x) AS line FROM raster GROUP BY ALL""", "raster"))
def normalise_mask(spark, sf):
    return X.mask_lines(M.normalise_mask(X.model_masks(X.blocks(spark, sf))))


#: Two lines a region, or one that fills it, or none; characters on some. Lines below the page are
#: left out, so that no box lies over another of its region: the SQL knows the original picture alone.
LINE_BOXES = [
    "line_no", "x1",
    "y1 + CASE WHEN line_no = 1 THEN CAST(floor((y2 - y1) / 2.0) AS BIGINT) ELSE 0 END AS y1",
    "CASE WHEN region_id % 4 = 2 THEN x2 WHEN line_no = 0 THEN x2 - 1 ELSE x1 + CAST(floor((x2 - x1) / 3.0) AS BIGINT) END AS x2",
    "CASE WHEN region_id % 4 = 2 OR line_no = 1 THEN y2 ELSE y1 + CAST(floor((y2 - y1) / 2.0) AS BIGINT) END AS y2",
]
LINES = f"SELECT {KEYS}, {', '.join(LINE_BOXES)}, width, height FROM px_regions, (SELECT unnest(range(2)) AS line_no) WHERE region_id % 4 < 2 OR region_id % 4 = 2 AND line_no = 0"
#: The first line of every fourth region has its characters: a wide one and what is left.
CHAR_CUT = "lx1 + CAST(floor((lx2 - lx1) * 0.6) AS BIGINT)"
ON_PAGE = """greatest(0, least({p}x1, width - 1)) AS x1, greatest(0, least({p}y1, height - 1)) AS y1,
    greatest(0, least({p}x2, width)) AS x2, greatest(0, least({p}y2, height)) AS y2"""
CLEARING = f"""lines AS (SELECT {KEYS}, line_no, x1 AS lx1, y1 AS ly1, x2 AS lx2, y2 AS ly2, width, height FROM ({LINES}) WHERE x2 > x1 AND y2 > y1 AND y1 < height),
    area AS (SELECT {KEYS}, sum((lx2 - lx1) * (ly2 - ly1)) AS lines_area, bool_or(region_id % 4 = 0 AND line_no = 0) AS chars FROM lines GROUP BY ALL),
    ruled AS (SELECT r.*, lines_area IS NOT NULL AND (x2 - x1) * (y2 - y1) > 0 AND lines_area < (x2 - x1) * (y2 - y1) * 0.7 AS small, coalesce(chars, false) AS chars
    FROM px_regions r LEFT JOIN area USING ({KEYS}) WHERE region_id % 7 <> 0),
    plan AS (SELECT {KEYS}, 'mask_region' AS rule, 0 AS line_no, 0 AS char_no, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(width, x2) AS x2, least(height, y2) AS y2
    FROM ruled WHERE NOT small
    UNION ALL SELECT {KEYS}, CASE WHEN chars THEN 'line' ELSE 'mask_line' END, line_no, 0, {ON_PAGE.format(p='l')}
    FROM lines l JOIN (SELECT {KEYS}, chars FROM ruled WHERE small) USING ({KEYS}) WHERE NOT (chars AND line_no = 0)
    UNION ALL SELECT {KEYS}, 'of_char', line_no, -1, {ON_PAGE.format(p='l')} FROM lines l JOIN (SELECT {KEYS} FROM ruled WHERE small AND chars) USING ({KEYS}) WHERE line_no = 0
    UNION ALL SELECT {KEYS}, 'char', line_no, char_no, {ON_PAGE.format(p='c')} FROM (SELECT *, CASE WHEN char_no = 0 THEN lx1 ELSE {CHAR_CUT} END AS cx1, ly1 AS cy1,
    CASE WHEN char_no = 0 THEN {CHAR_CUT} ELSE lx2 END AS cx2, ly2 AS cy2 FROM lines, (SELECT unnest(range(2)) AS char_no))
    JOIN (SELECT {KEYS} FROM ruled WHERE small AND chars) USING ({KEYS}) WHERE line_no = 0),
    spots AS (SELECT p.*, q.y, q.x, q.r, q.g, q.b, q.m, q.y = p.y1 OR q.y = p.y2 - 1 OR q.x = p.x1 OR q.x = p.x2 - 1 AS edge
    FROM (SELECT * FROM plan WHERE x2 > x1 AND y2 > y1) p JOIN raster q ON q.doc_id = p.doc_id AND q.page_idx = p.page_idx AND q.x >= p.x1 AND q.x < p.x2 AND q.y >= p.y1 AND q.y < p.y2),
    seen AS (SELECT {KEYS}, rule, line_no, char_no, min(least(r, g, b)) FILTER (edge) >= 240 AS white, any_value(x2 - x1 > 2 AND y2 - y1 > 2) AS wide,
    [{', '.join(f"CAST(floor(quantile_cont({c}, 0.5) FILTER (edge)) AS BIGINT)" for c in "rgb")}] AS at_edge,
    [{', '.join(f"CAST(floor(quantile_cont({c}, 0.5) FILTER (m <= 5)) AS BIGINT)" for c in "rgb")}] AS behind, count(*) FILTER (m <= 5) AS n_behind FROM spots GROUP BY ALL),
    coloured AS (SELECT s.{', s.'.join(KEYS.split(', '))}, s.rule, s.line_no, s.char_no, CASE WHEN s.rule = 'char' THEN CASE WHEN l.white OR NOT s.wide THEN [255, 255, 255] ELSE s.at_edge END
    WHEN s.rule <> 'mask_region' AND s.white THEN [255, 255, 255] WHEN s.rule = 'line' THEN CASE WHEN s.wide THEN s.at_edge END
    WHEN s.n_behind > 0 THEN s.behind ELSE [255, 255, 255] END AS colour, s.rule = 'mask_region' OR s.rule = 'mask_line' AND NOT s.white AS masked
    FROM seen s LEFT JOIN seen l ON l.rule = 'of_char' AND l.doc_id = s.doc_id AND l.page_idx = s.page_idx AND l.region_id = s.region_id AND l.line_no = s.line_no WHERE s.rule <> 'of_char'),
    fills AS (SELECT * FROM coloured WHERE colour IS NOT NULL),
    filled AS (SELECT f.doc_id, f.page_idx, y, x, f.region_id, f.line_no, f.char_no, colour FROM fills f JOIN spots USING ({KEYS}, rule, line_no, char_no) WHERE NOT masked
    UNION ALL SELECT DISTINCT f.doc_id, f.page_idx, y + dy, x + dx, f.region_id, f.line_no, f.char_no, colour FROM fills f JOIN spots USING ({KEYS}, rule, line_no, char_no),
    (SELECT * FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE abs(dy) + abs(dx) <= 2)
    WHERE masked AND m > 5 AND y + dy >= y1 AND y + dy < y2 AND x + dx >= x1 AND x + dx < x2),
    last AS (SELECT doc_id, page_idx, y, x, arg_max(colour, [region_id, line_no, char_no]) AS c FROM filled GROUP BY ALL)"""


# All four rules of clearing: characters, lines, lines and whole regions by the mask.
@query("clear_text", sql(f"""SELECT * FROM (WITH {CLEARING} SELECT doc_id, page_idx, y, string_agg(coalesce(c[1], r) || ',' || coalesce(c[2], g) || ',' || coalesce(c[3], b), ' ' ORDER BY x) AS line
    FROM raster LEFT JOIN last USING (doc_id, page_idx, y, x) GROUP BY doc_id, page_idx, y)""", "px_regions", "raster"))
def clear_text(spark, sf):
    regions = X.px_regions(spark, sf)
    two = regions.withColumn("line_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    lines = two.filter("region_id % 4 < 2 OR region_id % 4 = 2 AND line_no = 0").selectExpr(*REGION, *LINE_BOXES, "height").filter("y1 < height")
    cut = CHAR_CUT.replace("lx", "x")
    chars = f"CASE WHEN region_id % 4 = 0 AND line_no = 0 THEN array(array(x1, y1, {cut}, y2), array({cut}, y1, x2, y2)) ELSE array() END AS chars"
    return X.pixel_lines(B.clear_text(X.blocks(spark, sf), regions.selectExpr("*", PLAN_REGIONS), lines.selectExpr("*", chars)))


GRID_CELLS = [
    "doc_id", "page_idx AS batch_idx", "page_idx", "x1 AS gx1", "y1 AS gy1", "x2 AS gx2", "y2 AS gy2",
    "x1 + 1 AS bx1", "y1 + 2 AS by1",
    "x1 + 1 + (x2 - x1) * (CASE WHEN region_id % 3 = 0 THEN 2 ELSE 1 END) AS bx2",
    "y1 + 2 + (y2 - y1) * (CASE WHEN region_id % 3 = 0 THEN 2 ELSE 1 END) AS by2",
]


GRID_MERGED = f"""SELECT doc_id, page_idx, y, x, max(m) AS m FROM (SELECT c.doc_id, c.page_idx, py AS y, px AS x, q.m FROM (
    SELECT *, unnest(range(by1, by2)) AS py FROM (SELECT *, unnest(range(bx1, bx2)) AS px FROM (SELECT {', '.join(GRID_CELLS)} FROM clipped
    WHERE x2 > x1 AND y2 > y1))) c JOIN raster q ON q.doc_id = c.doc_id AND q.page_idx = c.batch_idx
    AND q.x = gx1 + CAST(floor((px - bx1 + 0.5::DOUBLE) * (gx2 - gx1) / (bx2 - bx1)) AS BIGINT)
    AND q.y = gy1 + CAST(floor((py - by1 + 0.5::DOUBLE) * (gy2 - gy1) / (by2 - by1)) AS BIGINT)) GROUP BY ALL HAVING max(m) > 0"""


# Stretches of one value end at a tile's border, as blocks do.
@query("grid_mask_merge", sql(STRETCHES.format(keys="doc_id, page_idx, tx", more=", m", by=", m", pixels=f"SELECT *, CAST(floor(x / 64.0) AS BIGINT) AS tx FROM ({GRID_MERGED})"), "clipped", "raster"))
def grid_mask_merge(spark, sf):
    cells = P.clip_to_page(X.px_regions(spark, sf)).filter("x2 > x1 AND y2 > y1").selectExpr(*GRID_CELLS)
    grid = M.mask_of(X.blocks(spark, sf)).withColumnRenamed("page_idx", "batch_idx")
    merged = M.grid_mask_to_pages(grid, cells)
    return M.rows_of_runs(merged, ["doc_id", "page_idx", "tx"], "ty * 64", "tx * 64", "h", "w")


PLAN_REGIONS = "CASE WHEN region_id % 7 = 0 THEN '[NO TEXT]' ELSE 'done' END AS translated"
PLAN_TEXTS = [
    "0L AS line_no", "x1", "y1",
    "CASE WHEN region_id % 2 = 0 THEN x1 + 1 ELSE x2 END AS x2", "y2",
    "CASE WHEN region_id % 5 = 0 THEN array() ELSE array(array(x1, y1, x1 + 1, y1 + 2)) END AS chars",
]


@query("clear_plan", sql(f"""SELECT {KEYS}, CASE WHEN small AND region_id % 5 <> 0 THEN 'char' WHEN small THEN 'mask_line' ELSE 'mask_region' END AS rule,
    count(*) AS boxes FROM (SELECT *, (x2 - x1) * (y2 - y1) AS ra, CASE WHEN region_id % 2 = 0 THEN (y2 - y1) ELSE (x2 - x1) * (y2 - y1) END AS ta,
    ra > 0 AND ta < ra * 0.7 AS small, CASE WHEN region_id % 2 = 0 THEN x1 + 1 ELSE x2 END AS lx2 FROM px_regions
    WHERE region_id % 7 <> 0 AND x2 > x1 AND y2 > y1)
    WHERE CASE WHEN small AND region_id % 5 <> 0 THEN least(lx2, width) > greatest(0, least(x1, width - 1)) AND least(x1 + 1, width) > greatest(0, least(x1, width - 1))
    AND least(y1 + 2, height) > least(y1, height - 1) AND least(y2, height) > least(y1, height - 1)
    WHEN small THEN least(lx2, width) > greatest(0, least(x1, width - 1)) AND least(y2, height) > least(y1, height - 1) ELSE true END GROUP BY ALL""", "px_regions"))
def clear_plan(spark, sf):
    regions = X.px_regions(spark, sf)
    texts = regions.selectExpr(*REGION, *PLAN_TEXTS)
    plan = P.plan_clearing(texts, regions.selectExpr("*", PLAN_REGIONS), has_mask=True)
    return plan.groupBy(*REGION, "rule").agg(F.count(F.lit(1)).alias("boxes"))


# Runs of strong pixels spread to the runs they touch above and below; the least one reached
# names the area.
@query("mask_components", sql("""SELECT doc_id, page_idx, x1, y1, x2, y2, pixels FROM (WITH RECURSIVE s AS (
    SELECT doc_id, page_idx, y, min(x) AS a, max(x) AS b, ((doc_id * 16 + page_idx) * 65536 + y) * 64 + min(x) AS p FROM (
    SELECT *, x - row_number() OVER (PARTITION BY doc_id, page_idx, y ORDER BY x) AS run FROM raster WHERE m > 100) GROUP BY doc_id, page_idx, y, run), d AS (
    SELECT u.p AS p, v.p AS q FROM s u JOIN s v ON u.doc_id = v.doc_id AND u.page_idx = v.page_idx AND v.y = u.y + 1 AND v.a <= u.b AND v.b >= u.a), e AS (
    SELECT p, q FROM d UNION ALL SELECT q, p FROM d), reach AS (SELECT p, p AS q FROM s UNION SELECT r.p, e.q FROM reach r JOIN e ON e.p = r.q)
    SELECT doc_id, page_idx, min(a) AS x1, min(y) AS y1, max(b) + 1 AS x2, max(y) + 1 AS y2, CAST(sum(b - a + 1) AS BIGINT) AS pixels
    FROM s JOIN (SELECT p, min(q) AS root FROM reach GROUP BY p) USING (p) GROUP BY doc_id, page_idx, root HAVING sum(b - a + 1) > 1)""", "raster"))
def mask_components(spark, sf):
    return K.components(M.mask_of(X.blocks(spark, sf)), level=100, min_size=1)


def dark_pixels():
    """Stand-in for a mask model: 255 where a block's picture is dark."""
    def model(frame):
        masks = []
        for body in frame["px"]:
            rgb = np.frombuffer(body, np.uint8).reshape(-1, 4)[:, :3].astype(np.int64)
            masks.append(M.pack(np.where(rgb @ np.array([299, 587, 114]) < 128000, 255, 0).astype(np.uint8)))
        return frame.drop(columns="px").assign(m=masks)

    return model


# What lies beyond a page's last pixel is dark in a block, and cut off again.
@query("mask_model", sql(STRETCHES.format(keys="doc_id, page_idx", more="", by="", pixels=f"SELECT doc_id, page_idx, y, x FROM raster WHERE {LIGHT} < 128000"), "raster"))
def mask_model(spark, sf):
    asked = X.blocks(spark, sf)
    found = infer.run_model(asked, "dark", dark_pixels, M.MASK_BLOCK, parallel_calls=4)
    runs = M.rows_of_runs(found.withColumn("rows", F.ceil(F.col("n") / F.col("w"))), ["doc_id", "page_idx", "ty", "tx", "n"], "0", "0", "h", "w")
    last = F.least(F.col("x2"), F.col("n") - F.col("y") * C.TILE)
    return runs.withColumn("x2", last).filter("x2 > x1").select("doc_id", "page_idx", (F.col("ty") * C.TILE + F.col("y")).alias("y"), "x1", "x2")


def negatives():
    """Stand-in for an inpainting model: the negative under the mask, the picture elsewhere."""
    def model(frame):
        out = []
        for rgb, mask in zip(frame["rgb"], frame["mask"]):
            colours, spots = np.frombuffer(rgb, np.uint8).reshape(-1, 3).copy(), np.frombuffer(mask, np.uint8) > 127
            colours[spots] = 255 - colours[spots]
            out.append(colours.tobytes())
        return frame[["doc_id", "page_idx", "region_id"]].assign(painted=out)

    return model


# Windows of a region with two pixels of its surroundings.
@query("inpaint_model", sql(f"""SELECT {KEYS}, string_agg(CASE WHEN m > 127 THEN printf('%02X%02X%02X', 255 - r, 255 - g, 255 - b) ELSE printf('%02X%02X%02X', r, g, b) END, '' ORDER BY y, x) AS painted
    FROM (SELECT {KEYS}, greatest(0, x1 - 2) AS x1, greatest(0, y1 - 2) AS y1, least(width, x2 + 2) AS x2, least(height, y2 + 2) AS y2 FROM px_regions) c
    JOIN raster p USING (doc_id, page_idx) WHERE p.x >= c.x1 AND p.x < c.x2 AND p.y >= c.y1 AND p.y < c.y2 GROUP BY ALL""", "px_regions", "raster"))
def inpaint_model(spark, sf):
    around = X.px_regions(spark, sf).withColumns({"x1": F.col("x1") - 2, "y1": F.col("y1") - 2, "x2": F.col("x2") + 2, "y2": F.col("y2") + 2})
    crops = B.region_crops(X.blocks(spark, sf), around).filter("width > 0").select(*REGION, "rgb", "mask")
    painted = infer.run_model(crops, "negative", negatives, "doc_id bigint, page_idx bigint, region_id bigint, painted binary", parallel_calls=4)
    return painted.select(*REGION, F.hex("painted").alias("painted"))
