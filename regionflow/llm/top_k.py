"""Operator 6: exact top-k search by tiled matrix products.

Queries and candidates are laid out as blocks of rows. A grid join lets every query block
meet every shard; each tile is one matrix product with a partial selection, and the
partial lists are merged up a tree of shard groups until one list per query is left.

Components are floor(256 x), so scores are whole numbers. Products are exact: in double
precision where the sum stays below 2**53, else in whole numbers of any size (a score
beyond the long range is set to its end).

Defined cases: vectors that are null, or hold null or non-finite components, and rows
without an id take no part. Only vectors of equal length are compared. Rows that share a
query's id count as its own. Repeated candidate rows are candidates each. Ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.session import cut_lineage

QUERY_ROWS = 1024
SHARD_ROWS = 4096
#: Lists merged into one at each level of the tree.
FAN = 16
SMALL = 1 << 15


def usable(key: str, vector: str) -> Column:
    """A row with an id and a vector of finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def blocks(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(dim, block, ids, kind, matrix): up to ``most`` rows each, by rising id within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            out: list[list] = [[], [], [], [], []]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                at = at[np.argsort(ids[at], kind="stable")]
                whole = np.floor(256 * flat[starts[at][:, None] + np.arange(dim)])
                for k in range(0, len(at), most):
                    part = whole[k : k + most]
                    kind = "<i2" if np.abs(part).max(initial=0) < SMALL else "<f8"
                    for column_out, value in zip(out, (int(dim), block, ids[at[k : k + most]].astype("<i8").tobytes(), kind, part.astype(kind).tobytes())):
                        column_out.append(value)
                    block += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["dim", "block", "ids", "kind", "matrix"])

    chosen = rows.filter(usable(key, vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return cut_lineage(chosen.mapInArrow(run, "dim long, block long, ids binary, kind string, matrix binary"))


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each query within a tile: query id, candidate id, score."""
    bound = q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0))
    n = len(c_ids)
    if bound * (n + 1) < 2**52:
        # Score and place in one exact number: equal scores prefer the smaller id.
        ranked = (q @ c.T) * n + (n - 1 - np.arange(n))
        ranked[q_ids[:, None] == c_ids[None, :]] = -np.inf
        best = np.argpartition(-ranked, min(k, n) - 1, axis=1)[:, :k]
        got = np.take_along_axis(ranked, best, axis=1)
        scores = np.floor(np.where(np.isfinite(got), got, 0) / n).astype(np.int64)
        rows, kept = np.repeat(q_ids, best.shape[1]), np.isfinite(got).reshape(-1)
        return rows[kept], c_ids[best].reshape(-1)[kept], scores.reshape(-1)[kept]
    ends = np.iinfo(np.int64)
    whole = [[int(x) for x in row] for row in c]
    found = []
    for own, row in zip(q_ids.tolist(), q):
        values = [int(x) for x in row]
        scored = sorted((-sum(a * b for a, b in zip(values, other)), ident) for ident, other in zip(c_ids.tolist(), whole) if ident != own)[:k]
        found += [(own, ident, min(max(-s, ends.min), ends.max)) for s, ident in scored]
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products."""
    spark = queries.sparkSession
    columns = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = blocks(queries, key, vector, QUERY_ROWS)
    c = blocks(candidates, key, vector, SHARD_ROWS).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(columns)))
    spread = q.select("dim", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("group"))
    # Matrices are binary, so no side is small by mistake; the grid key deals the tiles out.
    tiles = spread.hint("merge").join(c.select("dim", "group", "ids", "kind", "matrix"), ["dim", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                got = tile(
                    np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_matrix"], r["q_kind"]).reshape(-1, dim).astype(np.float64),
                    np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["matrix"], r["kind"]).reshape(-1, dim).astype(np.float64), k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), r["group"])), *map(pa.array, got)], names=["node", "query_id", "vec_id", "score"])

    lists = tiles.mapInArrow(run, "node long, query_id long, vec_id long, score long")
    nodes = columns
    while True:
        nodes = -(-nodes // FAN)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN))
        best = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if nodes == 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        lists = lists.drop("rank")
