"""Model replies and OCR responses as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions.parse import parse_cells

OCR_BODY = (
    "success boolean, error string, results array<struct<text:string, bbox:array<double>, "
    "confidence:double, chars:array<struct<char:string, bbox:array<double>>>>>"
)


def explode_cells(replies: DataFrame, cells: Column, keys: list[str]) -> DataFrame:
    """One row per cell of every reply."""
    return replies.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.idx", "c.text")


def ocr_lines(bodies: DataFrame, body: str) -> DataFrame:
    """Lines of OCR service responses, numbered in order: corner box to x, y, width
    and height, confidence 1.0 unless given, characters only with a box."""
    keys = [c for c in bodies.columns if c != body]
    read = bodies.withColumn("b", F.from_json(body, OCR_BODY)).filter("b.success")
    item = read.select(*keys, F.posexplode("b.results").alias("line_no", "r"))
    none = F.array(*[F.lit(0.0)] * 4)
    box = F.coalesce("r.bbox", none)
    return item.withColumn("box", box).select(
        *keys, F.col("line_no").cast("bigint").alias("line_no"),
        F.coalesce("r.text", F.lit("")).alias("text"),
        F.get("box", F.lit(0)).alias("x"), F.get("box", F.lit(1)).alias("y"),
        (F.get("box", F.lit(2)) - F.get("box", F.lit(0))).alias("width"),
        (F.get("box", F.lit(3)) - F.get("box", F.lit(1))).alias("height"),
        F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"),
        F.filter("r.chars", lambda c: F.size(c.getField("bbox")) > 0).alias("chars"),
    )


def quad_to_box(quads: DataFrame, width: Column, height: Column) -> DataFrame:
    """Four corners (qx1..qy4) to the box around them, cut to the picture."""
    def cut(pick, axis: str, limit: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(pick(*[f"q{axis}{i}" for i in range(1, 5)]), limit))

    return quads.withColumns({
        "x1": cut(F.least, "x", width), "y1": cut(F.least, "y", height),
        "x2": cut(F.greatest, "x", width), "y2": cut(F.greatest, "y", height),
    })


def batch_items(bodies: DataFrame, body: str) -> DataFrame:
    """One row per item of a batch response: its result, or its error."""
    keys = [c for c in bodies.columns if c != body]
    shape = "array<struct<success:boolean, error:string, results:string>>"
    read = bodies.withColumn("b", F.from_json(body, f"struct<results:{shape}>"))
    broken = F.col("b.results").isNull()
    items = F.when(
        broken,
        F.array(F.struct(F.lit(False).alias("success"), F.lit("bad JSON").alias("error"),
                         F.lit(None).cast("string").alias("results"))),
    ).otherwise(F.col("b.results"))
    return read.select(*keys, F.posexplode(items).alias("index", "r")).select(
        *keys, F.col("index").cast("bigint").alias("index"),
        F.coalesce("r.success", F.lit(False)).alias("success"), "r.error", "r.results",
    )


def cells_view(replies: DataFrame, name: str, output: str = "output", expected: str = "expected") -> None:
    """SQL face of the cell parser: a view ``name`` with the other columns, idx and text."""
    keys = [c for c in replies.columns if c not in (output, expected)]
    explode_cells(replies, parse_cells(output, expected), keys).createOrReplaceTempView(name)


#: Numbered cells, as ``functions.parse`` reads them, for Python's own patterns.
_NUMBERED = re.compile(r"\[(\d+)\]:\s*(.+?)(?=\[\d+\]:|\Z)", re.DOTALL)


@F.udtf(returnType="idx bigint, text string")
class ReplyCells:
    """Table function: the cells of one reply, by number; the last text of a number counts, and a
    lone cell may carry none."""

    def eval(self, output: str, expected: int):
        text = (output or "").strip()
        if expected == 1:
            text = text[4:].strip() if text.startswith("[0]:") else text
            if text:
                yield 0, text
            return
        found = {int(n): body.strip() for n, body in _NUMBERED.findall(text) if body.strip()}
        yield from ((n, body) for n, body in found.items() if 0 <= n < (expected or 0))


def register_cells(spark: SparkSession, name: str = "reply_cells") -> None:
    """The table function for SQL: ``FROM replies, LATERAL reply_cells(output, expected)``."""
    spark.udtf.register(name, ReplyCells)
