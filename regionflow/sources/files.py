"""Picture files and saved result files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.operators.blocks import BLOCK
from regionflow.operators.ordering import number_sorted
from regionflow.session import cut_lineage

# --- fixed values: names of debug pictures that are not input -----------------
EXCLUDED = ["viz", "debug", "detected", "fixed", "compare", "test"]
SAVED = (
    "map<string,array<struct<idx:bigint, bubble_box:array<bigint>, "
    "texts:array<struct<text:string, bbox:array<bigint>>>>>>"
)


#: Endings of the pictures that Spark's image reader decodes.
PICTURE = r"(?i)\.(png|jpe?g|gif|w?bmp)\z"


def input_names(files: DataFrame) -> DataFrame:
    """Paths once each, without debug pictures, with ``name`` and the ``number`` of all digits in it (or 0)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    digits = F.regexp_replace("name", r"\D", "")
    return (
        files.withColumn("name", name).withColumn("number", F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))
        .filter(~F.col("name").rlike("|".join(EXCLUDED)))
        .dropDuplicates(["path"])
    )


def list_pictures(spark: SparkSession, folder: str, pattern: str = "*.{jpg,png}") -> DataFrame:
    """Input pictures once each, in order of the digits in their names, then path.
    Only names are read here, not the pictures."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .load(folder).select("path", "length")
    )
    return input_names(files).orderBy("number", "path")


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures as pages, decoded by Spark; broken files are dropped.

    Every folder that holds pictures is a document (``doc_id``, by the folders' order), its
    pictures are numbered by the digits in their names, then by path. Names come from a
    listing that opens no file and keeps those with a picture's ending, so a picture is
    decoded once; a broken one leaves a gap in the numbers. Only names are sorted, and a
    document's pages are few beside the corpus.
    """
    def place(c: str) -> Column:
        # The two readers write the scheme of local paths differently.
        return F.regexp_replace(c, "^file:/+", "file:///")

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = listed.filter(F.col("path").rlike(PICTURE)).select(place("path").alias("origin"))
    name = F.element_at(F.split("origin", "/"), -1)
    names = listed.select(
        "origin", F.regexp_replace("origin", r"/[^/]*\z", "").alias("folder"),
        F.coalesce(F.regexp_replace(name, r"\D", "").try_cast("bigint"), F.lit(0)).alias("number"),
    )
    docs = number_sorted(names.select("folder").distinct(), [F.col("folder")], "doc_id")
    in_folder = Window.partitionBy("folder").orderBy("number", "origin")
    order = names.withColumn("page_idx", (F.row_number().over(in_folder) - 1).cast("bigint")).join(docs.select("folder", "doc_id"), "folder")
    pictures = (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
        .select(place("image.origin").alias("origin"), "image.width", "image.height", "image.nChannels", "image.data")
    )
    # Names are stored, so that Spark knows their size and lets them travel, not the pictures, where they are few.
    return pictures.join(cut_lineage(order.select("origin", "doc_id", "page_idx")), "origin")


def page_blocks(pages: DataFrame) -> DataFrame:
    """Decoded pages (bytes are blue, green, red, or one grey) as tile blocks without a mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                whole = np.zeros((r["height"], r["width"], 4), np.uint8)
                whole[:, :, :3] = raw[:, :, 2::-1] if r["nChannels"] >= 3 else raw[:, :, :1]
                rows = []
                for ty in range(-(-r["height"] // C.TILE)):
                    for tx in range(-(-r["width"] // C.TILE)):
                        part = whole[ty * C.TILE : (ty + 1) * C.TILE, tx * C.TILE : (tx + 1) * C.TILE]
                        h, w = part.shape[:2]
                        rows.append({"doc_id": r["doc_id"], "page_idx": r["page_idx"], "ty": ty, "tx": tx, "h": h, "w": w, "n": h * w, "px": part.tobytes()})
                yield pa.RecordBatch.from_pylist(rows)

    return pages.select("doc_id", "page_idx", "width", "height", "nChannels", "data").mapInArrow(run, BLOCK)


def saved_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Regions of saved result files (page path to regions), one row per region.

    A file is one object, or with ``lines`` one object per line, read in parts.
    """
    page = F.explode(F.from_json("value", SAVED)).alias("page_path", "regions")
    return (
        spark.read.text(path, wholetext=not lines).select(page)
        .withColumn("page_no", F.regexp_extract("page_path", r"(\d+)", 1).try_cast("bigint"))
        .select("page_path", "page_no", F.explode("regions").alias("r"))
        .select("page_path", "page_no", "r.idx", "r.bubble_box", "r.texts")
    )


def saved_counts(saved: DataFrame) -> DataFrame:
    """Regions and texts per saved page, in page order."""
    return (
        saved.groupBy("page_path", "page_no")
        .agg(F.count(F.lit(1)).alias("regions"), F.sum(F.size("texts")).alias("texts"))
        .orderBy("page_no", "page_path")
    )
