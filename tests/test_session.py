"""Stored tables: removed with their block, and never by another thread's."""

import os
import threading

from pyspark.sql import functions as F

from regionflow.plans import catalog
from regionflow.session import cut_lineage, shared_dir, temporary_tables


def folder_of(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_nested_blocks(spark):
    with temporary_tables(spark) as keep:
        first = cut_lineage(spark.range(3))
        with temporary_tables(spark) as keep_inner:
            inner = cut_lineage(spark.range(4))
            kept_inner = keep_inner(inner.withColumn("x", F.lit(1)))
            gone = folder_of(inner)
        assert not os.path.exists(gone) and kept_inner.count() == 4 and first.count() == 3
        kept, middle = keep(kept_inner), folder_of(kept_inner)
    assert not os.path.exists(middle) and not os.path.exists(folder_of(kept) + "/none") and kept.count() == 4


def test_two_threads(spark):
    """One thread's block opens after and ends before what the other stored is read."""
    stored, ended, found = threading.Event(), threading.Event(), {}

    def longer():
        with temporary_tables(spark):
            opened.wait(60)
            table = cut_lineage(spark.range(100))
            stored.set()
            ended.wait(60)
            found["rows"] = table.count()
            found["folder"] = folder_of(table)

    def shorter():
        with temporary_tables(spark):
            opened.set()
            stored.wait(60)
            found["other"] = folder_of(cut_lineage(spark.range(5)))
        ended.set()

    opened = threading.Event()
    threads = [threading.Thread(target=t) for t in (longer, shorter)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found["rows"] == 100 and not os.path.exists(found["folder"]) and not os.path.exists(found["other"])


def test_empty_blocks_are_told_apart(spark):
    with temporary_tables(spark):
        with temporary_tables(spark):
            pass
        table = cut_lineage(spark.range(2))
        assert table.count() == 2
        path = folder_of(table)
    assert not os.path.exists(path)


def test_two_stages_store_side_by_side(spark, tmp_path):
    """Two live streams whose micro-batches store and read tables at one time."""
    (tmp_path / "in").mkdir()
    seen = {"a": [], "b": []}

    def writer(name):
        def store(frame, epoch):
            with temporary_tables(frame.sparkSession):
                table = cut_lineage(frame.withColumn("stage", F.lit(name)))
                seen[name].append((cut_lineage(table.filter("id % 2 = 0")).count(), table.count(), folder_of(table)))
        return store

    for k in range(4):
        spark.range(10).repartition(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    running = [source.writeStream.foreachBatch(writer(n)).option("checkpointLocation", str(tmp_path / n)).start() for n in seen]
    for q in running:
        q.processAllAvailable()
        q.stop()
    assert all(len(v) == 4 and all(r[:2] == (5, 10) and not os.path.exists(r[2]) for r in v) for v in seen.values())


def test_a_query_leaves_its_result_alone(spark):
    base = os.path.dirname(shared_dir(spark, "look")).removeprefix("file:")
    before = set(os.listdir(base))
    df = catalog.QUERIES["map_spatial"](spark, "/root/testdata/sf0.001")
    assert set(os.listdir(base)) - before == {os.path.basename(folder_of(df))} and df.count() > 0
