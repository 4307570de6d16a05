"""Session defaults and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "regionflow") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@contextmanager
def stream_settings(spark: SparkSession, partitions: int = 64):
    """Settings for starting a stateful stream, put back afterwards: state in RocksDB,
    which spills to disk, and ``partitions`` of it. The number stays for a stream's
    whole life, so choose it for the cluster at its largest, not as it is at start.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local
    master, whose executors share the machine's disk, may do without.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class _Block:
    """Paths stored while one ``temporary_tables`` block is the innermost of its thread."""

    def __init__(self, outer: _Block | None):
        self.outer = outer
        self.paths: list[str] = []


#: The innermost open block. Threads, and streams' micro-batches among them, have their own.
_open_block: ContextVar[_Block | None] = ContextVar("open_block", default=None)


def _place(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What queries inside the block shuffled is removed as each ends, not when the driver's collector comes to it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df, compression: str | None = None):
    """Write out and read back in the shared folder.

    Survives executor loss like a checkpoint, and the reader knows its size and
    columns: later joins broadcast it only when it is truly small, and read only
    what they need. What was shuffled for it is gone when it is stored. The table goes with the open ``temporary_tables`` block, or, outside
    of any, when the driver ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "table")
    block = _open_block.get()
    if block is not None:
        block.paths.append(path)
    with freed_shuffles(spark):
        df.write.parquet(path, compression=compression)
    if block is None:
        files, place = _place(spark, path)
        files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df):
    """The side of a join that is dealt by its key however small it looks.

    Spark's estimate knows a stored table by its compressed bytes alone, and takes rows that are
    exploded for as many as went in, so it may broadcast what fits neither driver nor executors.
    """
    return df.hint("merge")


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables stored inside the block, by the same thread, are removed when it ends.

    Yields ``keep``, which stores a result beyond the block (within an outer block,
    until that one ends).
    """
    block = _Block(_open_block.get())
    token = _open_block.set(block)

    def keep(df):
        inner = _open_block.set(block.outer)
        try:
            return cut_lineage(df)
        finally:
            _open_block.reset(inner)

    try:
        yield keep
    finally:
        _open_block.reset(token)
        for path in block.paths:
            files, place = _place(spark, path)
            files.delete(place, True)


def without_leftovers(spark: SparkSession, build):
    """``build()`` with what it stores in between removed; stored itself only where it was built on such tables."""
    with temporary_tables(spark) as keep:
        result = build()
        return keep(result) if _open_block.get().paths else result
