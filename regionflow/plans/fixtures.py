"""Page, line, reply and pixel tables derived from the driver's tables.

The row expressions are plain SQL that Spark and the checking engine read alike.
Each derivation is row-wise or a partial-aggregate, and grows with its table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.operators import detect
from regionflow.operators.blocks import BLOCK
from regionflow.operators.runs import in_parts

WIDTH, HEIGHT = 900, 1280
BIG = 4294967296          # cell numbers: page * BIG + region

DET = [
    "CAST(floor(l_orderkey / 50.0) AS BIGINT) AS doc_id",
    "l_orderkey % 50 AS page_idx",
    "concat(CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',"
    " CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)) AS det_idx",
    "CAST(l_linenumber % 3 AS BIGINT) AS label",
    "l_discount * 10 AS score",
    "l_partkey % 700 - 5 AS x1",
    "(l_suppkey * 13 + l_linenumber * 97) % 1100 - 5 AS y1",
    "l_partkey % 700 + 15 + CAST(floor(l_quantity) AS BIGINT) * 2 AS x2",
    "(l_suppkey * 13 + l_linenumber * 97) % 1100 + 15"
    " + CAST(floor(l_extendedprice) AS BIGINT) % 180 AS y2",
]

_KANA = "translate(CAST(l_partkey AS STRING), '0123456789', 'アイウエオカキクケコ')"
LINE_TEXT = (
    "CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS STRING)"
    f" WHEN l_partkey % 5 = 2 THEN concat('　', {_KANA}, ' ')"
    " WHEN l_partkey % 5 = 4 AND l_suppkey % 4 = 0 THEN 'ノ'"
    " WHEN l_partkey % 5 = 4 AND l_suppkey % 4 = 1 THEN '  '"
    f" WHEN l_partkey % 5 = 4 THEN concat({_KANA}, ' ', CAST(l_suppkey AS STRING), ' LV')"
    f" ELSE {_KANA} END"
)
_K = "(l_partkey % 4)"
_AWAY = "(CASE WHEN l_partkey % 13 = 0 THEN 5000 ELSE 0 END)"
_NO_BOX = "l_partkey % 97 = 0"


def _nullable(expr: str) -> str:
    return f"CASE WHEN {_NO_BOX} THEN NULL ELSE CAST({expr} AS DOUBLE) END"


LINES = [
    DET[0], "l_orderkey % 50 AS src_page", DET[2].replace("AS det_idx", "AS line_no"),
    "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_orderkey % 50 END AS batch_idx",
    f"{LINE_TEXT} AS text",
    _nullable(f"({_K} % 3) * 260 + l_partkey % 61 + {_AWAY}") + " AS x",
    _nullable(f"CAST(floor({_K} / 3.0) AS BIGINT) * 260 + l_suppkey % 61") + " AS y",
    _nullable("20 + floor(l_quantity) * 2") + " AS width",
    _nullable("15 + CAST(floor(l_extendedprice) AS BIGINT) % 180") + " AS height",
    f"CASE WHEN l_suppkey % 3 = 0 THEN (l_orderkey % 50) * {BIG} + {_K} END AS cell_idx",
]

TEXTS = [
    DET[0], DET[1], "1 + l_suppkey % 2 AS level", "l_partkey % 4 AS bubble_idx",
    LINES[2], f"{LINE_TEXT} AS text",
    "l_partkey % 700 AS x1", "(l_suppkey * 13) % 1100 AS y1",
    "l_partkey % 700 + CAST(floor(l_quantity) AS BIGINT) * 3 - 9 AS x2",
    "(l_suppkey * 13) % 1100 + CAST(floor(l_extendedprice) AS BIGINT) % 120 AS y2",
]

JOBS = [
    "CAST(floor(conv_id / 20.0) AS BIGINT) AS doc_id", "conv_id % 20 AS page_idx",
    "turn AS bubble_idx", "role = 'system' AS is_l2",
    "text",
]

REGION_INFOS = [
    "user_id AS doc_id", "event_id",
    "CASE WHEN event_type = 'error' THEN ''"
    " ELSE concat(event_type, ':', CAST(event_id AS STRING)) END AS text",
]

PIXEL = [
    "CAST(CASE WHEN code >= 97 THEN 240 + code % 16 ELSE (code * 37) % 256 END AS BIGINT) AS r",
    "CAST(CASE WHEN code >= 97 THEN 255 ELSE (code * 53) % 256 END AS BIGINT) AS g",
    "CAST(CASE WHEN code >= 97 THEN 250 ELSE (code * 71) % 256 END AS BIGINT) AS b",
    "CAST(CASE WHEN code % 4 = 0 THEN (code * 29) % 256 ELSE 0 END AS BIGINT) AS m",
]
PIXEL_REGION = [
    "(page_id * 7 + k * 13) % 60 - 2 AS x1", "(page_id * 5 + k * 8) % height AS y1",
    "(page_id * 7 + k * 13) % 60 + (page_id + k) % 9 AS x2",
    "(page_id * 5 + k * 8) % height + 2 + (page_id * 3 + k) % 7 AS y2",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*DET)


def page_dim(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*DET[:2]).distinct().selectExpr(
        "*", f"CAST({WIDTH} AS BIGINT) AS width", f"CAST({HEIGHT} AS BIGINT) AS height"
    )


def regions(spark, sf_dir) -> DataFrame:
    """Kept detections of labels 1 and 2, numbered, with crop windows."""
    kept = detect.keep_detections(det(spark, sf_dir)).filter("label IN (1, 2)")
    sized = detect.reading_order(kept).selectExpr(
        "*", f"CAST({WIDTH} AS BIGINT) AS width", f"CAST({HEIGHT} AS BIGINT) AS height"
    )
    return detect.crop_window(sized).withColumnRenamed("label", "level")


def cells(spark, sf_dir) -> DataFrame:
    """First-level regions on a wide-spaced grid per page, three to a row."""
    return regions(spark, sf_dir).filter("level = 1").selectExpr(
        "doc_id", "page_idx AS batch_idx", f"page_idx * {BIG} + bubble_idx AS cell_idx",
        "page_idx", "bubble_idx",
        "30 + (bubble_idx % 3) * 260 AS gx1",
        "30 + CAST(floor(bubble_idx / 3) AS BIGINT) * 260 AS gy1",
        "crop_w", "crop_h", "x1 AS bx1", "y1 AS by1", "pad_l", "pad_t",
    ).selectExpr("*", "gx1 + crop_w AS gx2", "gy1 + crop_h AS gy2")


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*LINES)


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*TEXTS)


def jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").repartition("conv_id", "turn").selectExpr(*JOBS)


def turns(spark, sf_dir) -> DataFrame:
    """Every row of a conversation in order, in blocks of four, so that a reply made
    from a block is small however many rows a conversation has."""
    from regionflow.operators.ordering import radix_levels, with_position

    base = table(spark, sf_dir, "conversations")
    placed = with_position(
        base, ["conv_id"], radix_levels("turn", "__t", 2), [F.col("turn"), F.col("role"), F.col("text")], "place"
    )
    return placed.selectExpr(
        "conv_id", "CAST(floor(place / 4) AS BIGINT) AS block", "place % 4 AS idx", "turn", "text",
        "(conv_id + place) % 5 <> 0 AS told",
    )


def _reply_parts(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id", "block").agg(
        (F.max("idx") + 1).alias("expected"),
        F.array_sort(
            F.collect_list(F.when(F.col("told"), F.struct("idx", "text")))
        ).alias("told"),
    )


def replies(spark, sf_dir) -> DataFrame:
    """``[N]: text`` replies with some cells left out."""
    return _reply_parts(spark, sf_dir).selectExpr(
        "conv_id", "block", "expected",
        "array_join(transform(told, t -> concat('[', t.idx, ']: ', t.text)), '\n') AS output",
    )


def json_replies(spark, sf_dir) -> DataFrame:
    """The same as JSON; every 4th fenced, every 9th cut before its last brackets."""
    body = "to_json(named_struct('bubbles', transform(told, t -> named_struct('id', t.idx, 'text', t.text))))"
    return _reply_parts(spark, sf_dir).selectExpr("conv_id", "block", "expected", f"{body} AS body").selectExpr(
        "conv_id", "block", "expected",
        "CASE WHEN conv_id % 9 = 0 THEN substring(body, 1, length(body) - 3)"
        " WHEN conv_id % 4 = 0 THEN concat('```json\n', body, '\n```') ELSE body END AS output",
    )


def region_infos(spark, sf_dir) -> DataFrame:
    """Regions of the stream, numbered per document by event."""
    from regionflow.operators.ordering import radix_levels, with_position

    base = table(spark, sf_dir, "events").selectExpr(*REGION_INFOS)
    return with_position(
        base, ["doc_id"], radix_levels("event_id", "__e", 2), [F.col("event_id")], "global_idx"
    )


def raster(spark, sf_dir) -> DataFrame:
    """Every page's text as a 64-pixel-wide picture, one pixel per character."""
    chars = table(spark, sf_dir, "pages").repartition("page_id").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)."), F.lit(0))).alias("i", "ch")
    )
    return chars.selectExpr("page_id", "CAST(i AS BIGINT) AS i", "CAST(ascii(ch) AS BIGINT) AS code").selectExpr(
        "CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id", "page_id % 10 AS page_idx",
        "CAST(floor(i / 64.0) AS BIGINT) AS y", "i % 64 AS x", *PIXEL,
    )


def px(spark, sf_dir) -> DataFrame:
    return raster(spark, sf_dir).drop("m")


def mask_px(spark, sf_dir) -> DataFrame:
    return raster(spark, sf_dir).drop("r", "g", "b")


def px_regions(spark, sf_dir) -> DataFrame:
    """Boxes spread over every raster page, more on longer ones."""
    return table(spark, sf_dir, "pages").repartition("page_id").selectExpr(
        "page_id", "CAST(ceil(length(html) / 64.0) AS BIGINT) AS height",
        "explode(sequence(0L, CAST(floor(length(html) / 512.0) AS BIGINT))) AS k",
    ).selectExpr(
        "CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id", "page_id % 10 AS page_idx",
        "k AS region_id", *PIXEL_REGION, "CAST(64 AS BIGINT) AS width", "height",
    )


def doc_lines(spark, sf_dir) -> DataFrame:
    """Lines of every document; a third in kana vowels, a third half so."""
    kana = "translate({}, 'aeiou', 'アエイオウ')"
    half = "CAST(floor(length(line) / 2) AS INT)"
    return table(spark, sf_dir, "documents").repartition("doc_id").selectExpr(
        "doc_id", "posexplode(split(text, '\n')) AS (line_no, line)"
    ).selectExpr(
        "doc_id", "CAST(line_no AS BIGINT) AS line_no",
        f"CASE WHEN doc_id % 3 = 0 THEN {kana.format('line')}"
        f" WHEN doc_id % 3 = 1 THEN concat({kana.format(f'substring(line, 1, {half})')},"
        f" substring(line, {half} + 1)) ELSE line END AS text",
    )


def blocks(spark, sf_dir) -> DataFrame:
    """The raster as tile blocks; the last tile of a page may end inside a row."""
    def run(batches):
        for batch in in_parts(batches):
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                code = np.frombuffer((html or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                letter = code >= 97
                planes = np.stack([
                    np.where(letter, 240 + code % 16, code * 37 % 256), np.where(letter, 255, code * 53 % 256),
                    np.where(letter, 250, code * 71 % 256), np.where(code % 4 == 0, code * 29 % 256, 0),
                ], axis=1).astype(np.uint8)
                for ty in range(-(-len(code) // 4096)):
                    part = planes[ty * 4096 : (ty + 1) * 4096]
                    h = -(-len(part) // 64)
                    body = np.zeros((h * 64, 4), np.uint8)
                    body[: len(part)] = part
                    rows.append({"doc_id": page // 10, "page_idx": page % 10, "ty": ty, "tx": 0, "h": h, "w": 64, "n": len(part), "px": body.tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    pages = table(spark, sf_dir, "pages").select("page_id", "html").repartition("page_id")
    return pages.mapInArrow(run, BLOCK)


def pixel_lines(df: DataFrame, channels: str = "rgb") -> DataFrame:
    """Blocks as one text per row of pixels, all values of the channels, for comparison."""
    at = ["rgbm".index(c) for c in channels]

    def run(batches):
        for batch in in_parts(batches):
            rows = []
            for r in batch.to_pylist():
                tile = np.frombuffer(r["px"], np.uint8).reshape(r["h"], r["w"], 4)[:, :, at]
                for y in range(r["h"]):
                    shown = tile[y, : max(0, min(r["w"], r["n"] - y * r["w"]))]
                    rows.append({"doc_id": r["doc_id"], "page_idx": r["page_idx"], "y": r["ty"] * 64 + y, "line": " ".join(",".join(map(str, v)) for v in shown.tolist())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return df.mapInArrow(run, "doc_id bigint, page_idx bigint, y bigint, line string")


def model_masks(blocks_of: DataFrame) -> DataFrame:
    """Mask blocks as a model gives them: doubles, on every other page from 0 to 1."""
    names = ["doc_id", "page_idx", "ty", "tx", "h", "w", "n", "m"]

    def run(batches):
        for batch in in_parts(batches):
            even = np.array(batch.column("page_idx").to_pylist()) % 2 == 0
            bodies = [np.frombuffer(b, np.uint8)[3::4] for b in batch.column("px").to_pylist()]
            values = [(m / 256.0 if e else m * 2.0).tobytes() for m, e in zip(bodies, even)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(values, pa.binary())], names=names)

    return blocks_of.select(*names[:-1], "px").mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:-1]) + ", m binary")


def mask_lines(masks: DataFrame) -> DataFrame:
    """Mask blocks as one text per row of pixels, for comparison."""
    from regionflow.operators.masks import unpack

    def run(batches):
        for batch in in_parts(batches):
            rows = []
            for r in batch.to_pylist():
                mask = unpack(r["m"], r["h"], r["w"])
                for y in range(r["h"]):
                    shown = mask[y, : max(0, min(r["w"], r["n"] - y * r["w"]))]
                    rows.append({"doc_id": r["doc_id"], "page_idx": r["page_idx"], "y": r["ty"] * 64 + y, "line": ",".join(map(str, shown.tolist()))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return masks.mapInArrow(run, "doc_id bigint, page_idx bigint, y bigint, line string")


def painted_rows(blocks_of: DataFrame) -> DataFrame:
    """Stand-in for a model's output: one value per row of pixels, -1 to 1."""
    def run(batches):
        for batch in in_parts(batches):
            rows = []
            for r in batch.to_pylist():
                y = r["ty"] * 64 + np.arange(r["h"])
                value = np.repeat((y % 5 - 2) / 2.0, r["w"] * 3)
                rows.append({**{k: r[k] for k in ("doc_id", "page_idx", "ty", "tx")}, "out": value.astype(np.float64).tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return blocks_of.mapInArrow(run, "doc_id bigint, page_idx bigint, ty bigint, tx bigint, out binary")
