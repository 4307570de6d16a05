"""Bounded groups handed to Python in one sorted pass over a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes and rows of Arrow data that are turned into Python values at a time.
PART_BYTES, PART_ROWS = 1 << 20, 1024


def in_parts(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of at most ``most`` bytes and ``rows`` rows, or of a single row.

    Spark's batches end by rows and bytes that suit plain columns; pictures, packed masks and texts
    take many times their bytes as Python values, so these are made, and given back, a part at a time.
    """
    for batch in batches:
        parts = [batch]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > most):
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted batches as tables of whole runs of equal numeric ``keys``, with each run's start and size."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in keys])
        new = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        if rest and any(rest[-1].column(k)[-1].as_py() != m for k, m in zip(keys, marks[:, 0].tolist())):
            new = np.concatenate(([0], new))
        if len(new):
            # What was held ends before this batch's last run begins.
            table = pa.Table.from_batches([*rest, batch.slice(0, int(new[-1]))]).combine_chunks()
            if table.num_rows:
                held = table.num_rows - int(new[-1])
                starts = np.concatenate(([0], held + new[:-1])) if held or len(new) > 1 else np.zeros(1, np.int64)
                starts = np.unique(starts)
                yield table, starts, np.diff(starts, append=table.num_rows)
            rest = [batch.slice(int(new[-1]))]
        else:
            rest.append(batch)
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, np.zeros(1, np.int64), np.array([table.num_rows])


def by_group(
    rows: DataFrame, keys: list[str], call: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str,
    order: str,
) -> DataFrame:
    """``call(key values, group)`` for every group of ``keys``, its rows by ``order``.

    Like a grouped map, but groups are cut out of the sorted partition, so many small
    groups cost one Python call frame, not one each. Groups are bounded by their keys.
    """
    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(batches, keys):
            frame = table.to_pandas()
            made = []
            for at, size in zip(starts.tolist(), sizes.tolist()):
                part = frame.iloc[at : at + size]
                made.append(call(tuple(part[k].iloc[0] for k in keys), part))
            done = pd.concat(made, ignore_index=True)
            if len(done):
                yield from pa.Table.from_pandas(done, schema=kinds, preserve_index=False).to_batches()

    # With their number named partitions stay as many as the session has: small groups are few bytes
    # but much work, and would otherwise be put together in one task.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
