"""Python stages hold a part of an Arrow batch at a time, however large the batch."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from regionflow.operators import blocks as B
from regionflow.operators import components as K
from regionflow.operators import infer
from regionflow.operators import masks as M
from regionflow.operators.runs import PART_BYTES, PART_ROWS, by_group, in_parts, whole_runs
from regionflow.plans import fixtures as X

TILES = 2500


class Frame:
    """Stands for a DataFrame and gives the function that Spark would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

    mapInPandas = mapInArrow


def tiles(n: int = TILES) -> pa.RecordBatch:
    random = np.random.default_rng(3)
    rows = [{"doc_id": k // 10, "page_idx": k % 10, "ty": 0, "tx": 0, "h": 64, "w": 64, "n": 4096} for k in range(n)]
    body = [np.where(random.random(64 * 64 * 4) < 0.02, 255, 0).astype(np.uint8).tobytes() for _ in range(16)]
    return pa.RecordBatch.from_pylist([{**r, "px": body[k % 16]} for k, r in enumerate(rows)])


def packed() -> pa.RecordBatch:
    masks = M.mask_of(Frame())(iter([tiles()]))
    return pa.Table.from_batches(list(masks)).combine_chunks().to_batches()[0]


def test_parts_are_small_and_whole():
    batch = tiles()
    parts = list(in_parts([batch]))
    assert all(p.nbytes <= PART_BYTES and p.num_rows <= PART_ROWS for p in parts) and len(parts) > 30
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    few = list(in_parts([batch.select(["doc_id"])], rows=100))
    assert max(p.num_rows for p in few) <= 100 and sum(p.num_rows for p in few) == TILES
    # One row may be larger than a part; what lies beside it is cut off.
    uneven = pa.RecordBatch.from_pydict({"b": [b"x"] * 50 + [b"y" * 3 * PART_BYTES] + [b"z"] * 50})
    assert max(p.num_rows for p in in_parts([uneven]) if p.nbytes > PART_BYTES) == 1


@pytest.mark.parametrize("stage, rows", [
    (lambda: (B.blanked(Frame()), tiles()), 64),
    (lambda: (X.pixel_lines(Frame()), tiles()), 64 * 64),
    (lambda: (M.mask_of(Frame()), tiles()), PART_ROWS),
    (lambda: (X.model_masks(Frame()), tiles()), 64),
    (lambda: (X.painted_rows(Frame()), tiles()), 64),
    (lambda: (X.mask_lines(Frame()), packed()), 64 * PART_ROWS),
    (lambda: (K.label_tiles(Frame()), packed()), 200 * PART_ROWS),
], ids=["blanked", "pixel_lines", "mask_of", "model_masks", "painted_rows", "mask_lines", "label_tiles"])
def test_large_batches_leave_in_parts(stage, rows):
    run, batch = stage()
    made = list(run(iter([batch])))
    assert max(b.num_rows for b in made) <= rows and len(made) > 1
    # The same rows as from many small batches.
    small = list(run(batch.slice(k, 50) for k in range(0, batch.num_rows, 50)))
    assert pa.Table.from_batches(made).equals(pa.Table.from_batches(small))


def test_a_model_gets_parts():
    seen = []

    def load():
        def model(frame):
            seen.append(frame.memory_usage(deep=True).sum())
            return frame[["k"]]
        return model

    run = infer.run_model(Frame(), "parts", load, "k bigint")
    frame = pd.DataFrame({"k": range(600), "px": [b"\0" * 65536] * 600})
    made = pd.concat(run(iter([frame])), ignore_index=True)
    assert made["k"].tolist() == list(range(600))
    assert len(seen) > 1 and max(seen) <= infer.CALL_BYTES


def test_runs_over_parts():
    keys = np.repeat(np.arange(900), np.random.default_rng(1).integers(1, 9, 900))
    batch = pa.RecordBatch.from_pydict({"k": keys, "v": np.arange(len(keys))})
    rows = []
    for table, starts, sizes in whole_runs(in_parts([batch], rows=7), ["k"]):
        for at, size in zip(starts.tolist(), sizes.tolist()):
            assert len(set(table.column("k")[at : at + size].to_pylist())) == 1
            rows.append((table.column("k")[at].as_py(), size))
    assert rows == list(zip(*(c.tolist() for c in np.unique(keys, return_counts=True))))


def test_small_groups_stay_dealt_over_all_tasks(spark):
    """Groups of few bytes are work in Python all the same, so they are not put together in one task."""
    def where(key, part):
        from pyspark import TaskContext

        return part.assign(task=TaskContext.get().partitionId())

    groups = by_group(spark.range(400).selectExpr("id AS k", "id % 7 AS v"), ["k"], where, "k bigint, v bigint, task bigint", "v")
    assert groups.count() == 400 and groups.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_saved_tabs_share_files(spark, tmp_path):
    from regionflow.operators import assemble

    pages = spark.range(400).selectExpr("id AS page_id", "concat('https://a.b/', id % 300) AS tab_title", "if(id % 2 = 0, 'before', 'after') AS stage")
    assemble.save_pages(pages, str(tmp_path / "tabs"))
    saved = spark.read.parquet(str(tmp_path / "tabs"))
    assert saved.count() == 400 and saved.select("stage", "tab_title").distinct().count() == 300
    assert len(list((tmp_path / "tabs").rglob("*.parquet"))) <= 40
