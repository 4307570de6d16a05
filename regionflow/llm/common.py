"""What the operators of this subpackage share: batches of whole texts inside tasks,
per-worker memory, stored tables and reachability over links."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.session import cut_lineage

#: Text handled at once inside a task, in characters. Longer single texts go alone.
SLICE_CHARS = 2_000_000


def worker_state(key: str, build: Callable[[], object]):
    """``build()`` once per Python worker and key; later tasks of the worker reuse it.

    Functions of this package travel by value, so a module-level variable would be
    new in every task. Only the latest key is held, so one operator's memory does not
    stay while the next one runs.
    """
    held = sys.modules.setdefault("_regionflow_worker", types.ModuleType("_regionflow_worker"))
    if getattr(held, "key", None) != key:
        held.key, held.value = None, None
        held.key, held.value = key, build()
    return held.value


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with at most ``most`` characters (or one row), with their texts; null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = size = 0
        for k, t in enumerate(texts):
            if k > start and size + len(t) > most:
                yield batch.slice(start, k - start), texts[start:k]
                start, size = k, 0
            size += len(t)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def lists_of(flat, counts) -> pa.ListArray:
    """An Arrow list column from flat values and the number of values per row."""
    import numpy as np

    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: Labels that a sample may tell apart; more are an error.
LABELS = 10_000


def fewest(rows: DataFrame, label: str, draw: str | Column, n: int, *ties: str) -> DataFrame:
    """``n`` rows of each label (all, where there are fewer), those with the smallest ``draw`` (a hash).

    Rows are counted per label and power of two of the hash; that table, bounded by
    ``LABELS``, tells each label the power below which at least ``n`` rows lie. It is broadcast, so
    rows above are cut off before anything is shuffled: about two to four times ``n`` rows move
    for a label of any size. Rows with equal draw and ``ties`` move as one with their number
    and are drawn as so many copies of one of them, so ``draw`` should hash whatever tells
    rows apart. Rows without a label take no part.
    """
    spark, columns = rows.sparkSession, rows.columns
    share = F.pmod(draw, F.lit(1 << 32)).cast("double") / (1 << 32)
    held = rows.filter(F.col(label).isNotNull()).withColumn("share", share)
    held = held.withColumn("level", F.when(F.col("share") == 0, 33).otherwise(F.floor(-F.log2("share"))).cast("int"))
    counts = held.groupBy(label, "level").agg(F.count("*").alias("of_level")).limit(LABELS * 34 + 1).collect()
    per_label: dict = {}
    for r in counts:
        per_label.setdefault(r[label], {})[r["level"]] = r["of_level"]
    if len(per_label) > LABELS:
        raise ValueError(f"more than {LABELS} labels in column {label}")
    cuts = []
    for name, levels in per_label.items():
        reached = 0
        for level in sorted(levels, reverse=True):
            reached += levels[level]
            if reached >= n:
                break
        cuts.append((name, level))
    cut = spark.createDataFrame(cuts, T.StructType([T.StructField(label, rows.schema[label].dataType), T.StructField("from_level", T.IntegerType())]))
    near = held.join(F.broadcast(cut), label).filter(F.col("level") >= F.col("from_level"))
    keys = list(dict.fromkeys([label, "share", *ties]))
    alike = near.groupBy(*keys).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in columns if c not in keys])
    order = Window.partitionBy(label).orderBy("share", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = alike.withColumn("before", F.sum("copies").over(order) - F.col("copies")).filter(F.col("before") < n)
    copies = F.least(F.col("copies"), n - F.col("before")).cast("int")
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*columns)


#: A key counts as hot from this share of all rows on.
HOT_SHARE = 1 / 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row per key, of ``size`` rows) where some keys may be hot.

    Keys of ``HOT_SHARE`` of all rows or more, a thousand at most, are looked up in a broadcast
    table, so their rows stay where they are; only all others are shuffled. Rows with a null
    key meet nothing and stay, too. ``facts`` and ``rows`` should be stored tables, as both are read twice.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    added = [c for c in facts.columns if c not in keys and c != size]
    usual = F.col(size) < total * HOT_SHARE
    # At most 1 / HOT_SHARE keys hold so many rows each: the bound makes the broadcast safe.
    hot = F.broadcast(facts.filter(~usual).select(*keys, *added))
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    held = rows.filter(there)
    met = held.join(hot, keys)
    others = held.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.filter(usual).select(*keys, *added), keys, "left")
    nothing = rows.filter(~there).select("*", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in added])
    columns = [*rows.columns, *added]
    return met.select(columns).unionByName(others.select(columns)).unionByName(nothing.select(columns))


def reachable(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` (a, b).

    Each round hands the smallest neighbour to all neighbours and to the node itself
    (large star, then small star), which at least halves long chains; rounds are
    written to the shared folder, so a lost executor costs one round. A hot node's
    neighbours are folded by a partial minimum before the shuffle; no neighbour
    list is ever collected.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours above a node link to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        after = cut_lineage(small.filter("a <> b").distinct())
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(before) == tuple(now):
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def tiled(members: DataFrame, keys: list[str], ident: str, most: int, size: str | None = None) -> DataFrame:
    """Members of every group of two or more, dealt into tiles of at most about twice ``most``.

    A group is split into parts by a hash of ``ident``; each part meets itself and each
    other part in one tile (``low``, ``high``), so all pairs of a group come together
    somewhere and no task holds a whole hot group. ``side`` tells the two parts of a tile
    apart. Rows come sorted by tile. ``size`` names a column that has the group's size already.
    """
    if size is None:
        sizes = cut_lineage(members.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1"))
        held = members.join(sizes, keys)
    else:
        held = members.filter(F.col(size) > 1)
    held = held.withColumn("parts", F.ceil(F.col(size or "size") / most).cast("long"))
    held = held.withColumn("part", F.pmod(F.xxhash64(ident, *keys), F.col("parts")))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, 0).otherwise((F.col("part") == high).cast("int"))
    tiles = met.select(*members.columns, low.alias("low"), high.alias("high"), side.alias("side"))
    # A hash of the whole tile's key deals tiles out; sorting keeps each together.
    tile = [*keys, "low", "high"]
    return tiles.withColumn("deal", F.xxhash64(*tile)).repartition("deal").sortWithinPartitions(*tile, ident).drop("deal")


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list, list]]:
    """Sorted batches as tables of whole runs of equal ``keys``, with each run's start and size."""
    import numpy as np

    def starts(table: pa.Table):
        columns = np.stack([table.column(c).to_numpy() for c in keys])
        return np.concatenate(([0], np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1))

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        at = starts(table)
        if at[-1]:
            yield table.slice(0, at[-1]), at[:-1], np.diff(at)
        rest = table.slice(at[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64), np.array([rest.num_rows])
