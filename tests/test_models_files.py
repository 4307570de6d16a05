"""Model stages with plain stubs, picture files and saved results."""

import json
import struct
import sys
import time
import uuid
import zlib

from pyspark import cloudpickle
from pyspark.sql import functions as F

from regionflow.operators import infer
from regionflow.plans import fixtures, outcome_queries
from regionflow.sources import files, languages

# The stubs live in this file, which workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_double():
    return lambda frame: frame.assign(y=frame.x * 2, error=None)[["x", "y", "error"]]


def load_picky():
    def run(frame):
        out = frame.assign(y=frame.x, error=None)[["x", "y", "error"]]
        out.loc[out.x % 2 == 1, "error"] = "odd"
        return out
    return run


def test_models_and_fallbacks(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    schema = "x bigint, y bigint, error string"
    done = infer.with_fallbacks(
        df, [("picky", load_picky, False), ("double", load_double, False)], schema
    ).collect()
    assert {r.x: r.y for r in done} == {x: x * 2 if x % 2 else x for x in range(10)}
    stuck = infer.with_fallbacks(df, [("picky", load_picky, True), ("double", load_double, False)], schema)
    assert stuck.filter("error IS NOT NULL").count() == 5
    assert infer.run_model(df, "double", load_double, schema, parallel_calls=2).agg(F.sum("y")).first()[0] == 90


def test_calls_at_one_time_are_bounded_without_a_shuffle(spark, tmp_path):
    def load():
        def model(frame):
            name = tmp_path / uuid.uuid4().hex
            name.touch()
            time.sleep(0.2)
            frame = frame.assign(running=len(list(tmp_path.iterdir())))
            name.unlink()
            return frame[["x", "running"]]

        return model

    rows = spark.range(0, 16, 1, 16).withColumnRenamed("id", "x")
    for most in (2, 5):
        asked = infer.run_model(rows, f"counted{most}", load, "x bigint, running bigint", parallel_calls=most)
        assert "Exchange" not in asked._jdf.queryExecution().executedPlan().toString()
        got = asked.collect()
        assert len(got) == 16 and 1 <= max(r.running for r in got) <= most


def test_ask_until_good_asks_only_bad_batches(spark):
    batches = spark.range(6).withColumnRenamed("id", "batch_idx")

    def ask(df):
        good = F.col("attempt") >= F.col("batch_idx") % 3
        return df.withColumn("reply", F.when(good, F.concat(F.lit("r"), "attempt")).otherwise(""))

    problem = F.when(F.col("reply") == "", "empty")
    got = infer.ask_until_good(batches, ask, problem, max_attempts=5).collect()
    assert {r.batch_idx: r.reply for r in got} == {b: f"r{b % 3}" for b in range(6)}
    last = infer.ask_until_good(batches, ask, problem, max_attempts=2).filter("problem IS NOT NULL")
    assert {r.batch_idx for r in last.collect()} == {2, 5}


def png(width, height, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * width for _ in range(height))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_picture_files(spark, tmp_path):
    for name, rgb in (("page_10.png", (1, 2, 3)), ("page_9.png", (9, 8, 7)), ("cover.png", (0, 0, 0)), ("page_3_debug.png", (5, 5, 5))):
        (tmp_path / name).write_bytes(png(3, 2, rgb))
    (tmp_path / "page_1.txt").write_text("no picture")
    got = [r.name for r in files.list_pictures(spark, str(tmp_path)).collect()]
    assert got == ["cover.png", "page_9.png", "page_10.png"]
    other = tmp_path / "second"
    other.mkdir()
    (other / "page_1.png").write_bytes(png(70, 65, (4, 5, 6)))
    pages = files.load_pages(spark, str(tmp_path))
    order = [(r.doc_id, r.page_idx, r.origin.rsplit("/", 1)[1]) for r in pages.orderBy("doc_id", "page_idx").collect()]
    assert order == [(0, 0, "cover.png"), (0, 1, "page_3_debug.png"), (0, 2, "page_9.png"), (0, 3, "page_10.png"), (1, 0, "page_1.png")]
    blocks = files.page_blocks(pages)
    (small,) = blocks.filter("page_idx = 3").collect()
    assert (small.h, small.w, small.n) == (2, 3, 6) and bytes(small.px) == bytes((1, 2, 3, 0)) * 6
    tiles = {(r.ty, r.tx): (r.h, r.w, bytes(r.px)) for r in blocks.filter("doc_id = 1").collect()}
    assert {k: v[:2] for k, v in tiles.items()} == {(0, 0): (64, 64), (0, 1): (64, 6), (1, 0): (1, 64), (1, 1): (1, 6)}
    assert {v[2][:4] for v in tiles.values()} == {bytes((4, 5, 6, 0))}


def test_saved_results_and_languages(spark, tmp_path):
    region = {"idx": 0, "bubble_box": [1, 2, 3, 4], "texts": [{"text": "a", "bbox": [1, 2, 3, 4]}] * 2}
    (tmp_path / "r.json").write_text(json.dumps({"page_10.jpg": [region], "page_2.jpg": [region, region]}))
    counts = files.saved_counts(files.saved_results(spark, str(tmp_path / "r.json"))).collect()
    assert [(r.page_path, r.regions, r.texts) for r in counts] == [("page_2.jpg", 2, 4), ("page_10.jpg", 1, 2)]
    codes = spark.createDataFrame([("yue",), ("sv",)], "code string")
    got = {r.code: (r.language, r.chinese_name, r.chinese_prompt) for r in languages.with_mt_names(codes, "code").collect()}
    assert got == {"yue": ("Cantonese", "粤语", True), "sv": ("Sv", "Sv", False)}
    assert languages.languages(spark).count() == 13 and languages.mt_languages(spark).count() == 38


def test_saves_hold_a_line_per_page(spark):
    sf = "/root/testdata/sf0.001"
    written = outcome_queries.stored_saves(spark, sf).inputFiles()
    lines = [r["value"] for r in spark.read.text(written).collect()]
    texts = fixtures.texts(spark, sf)
    assert all(len(json.loads(x)) == 1 for x in lines)
    assert len(lines) == texts.select("doc_id", "page_idx").distinct().count()
    assert len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < texts.select("doc_id").distinct().count()
