"""Positions and running totals that stay parallel inside one huge key.

A plain ``row_number() OVER (PARTITION BY doc ORDER BY ...)`` sends a whole
document to one task.  Here the order is described by a few coarse *levels*
(columns, ascending) followed by a fine order.  Rows are ranked inside the
finest group only; group totals are turned into offsets level by level, so no
window ever holds more than one group of one level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.session import by_key, cut_lineage

RADIX = 1024


def radix_levels(position: str, prefix: str, depth: int = 2) -> dict[str, Column]:
    """Coarse-to-fine block numbers of a non-negative integer position.

    ``depth=2`` gives blocks of 1024 and super-blocks of 1024 * 1024.
    """
    return {
        f"{prefix}{level}": F.floor(F.col(position) / F.lit(RADIX ** level)).cast("bigint")
        for level in range(depth, 0, -1)
    }


def preceding_totals(
    cells: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Add ``<value>_before``: the total of all earlier cells under ``keys``.

    ``cells`` has one row per (keys, levels).  Order is lexicographic by levels.
    """
    head, last = list(levels[:-1]), levels[-1]
    parents = [*keys, *head]
    earlier = (
        Window.partitionBy(*parents)
        .orderBy(last)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cells.withColumns(
        {f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    )
    if not head:
        return local
    totals = cells.groupBy(*parents).agg(*[F.sum(v).alias(v) for v in values])
    above = preceding_totals(totals, keys, head, values).select(
        *parents, *[F.col(f"{v}_before").alias(f"__{v}_above") for v in values]
    )
    return (
        local.join(by_key(above), parents)
        .withColumns(
            {f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}_above") for v in values}
        )
        .drop(*[f"__{v}_above" for v in values])
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    levels: dict[str, Column],
    order: Sequence[Column],
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``name``: 0-based position, or the exclusive running sum of ``weight``.

    Key and level columns must not be null.
    """
    marked = df.withColumns(levels) if levels else df
    fine = [*keys, *levels]
    window = Window.partitionBy(*fine).orderBy(*order)
    if weight is None:
        local = F.row_number().over(window) - 1
        size = F.count(F.lit(1))
    else:
        local = F.coalesce(
            F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
        size = F.sum(weight)
    ranked = marked.withColumn(name, local.cast("bigint"))
    if not levels:
        return ranked
    offsets = preceding_totals(
        marked.groupBy(*fine).agg(size.alias("__size")), keys, list(levels), ["__size"]
    ).select(*fine, "__size_before")
    return (
        ranked.join(by_key(offsets), fine)
        .withColumn(name, (F.col(name) + F.col("__size_before")).cast("bigint"))
        .drop("__size_before", *levels)
    )


def number_sorted(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: 0-based position of every row in one global order.

    For orders that have no coarse levels (file paths, say): a range sort, the
    size of every sorted partition, and an offset per partition.  The sorted rows
    are written out first, so partitions stay what they were counted as.
    """
    sorted_rows = cut_lineage(
        df.orderBy(*order).withColumns({
            "__part": F.spark_partition_id().cast("bigint"),
            "__row": F.monotonically_increasing_id(),
        })
    )
    sizes = sorted_rows.groupBy("__part").agg(
        F.count(F.lit(1)).alias("n"), F.min("__row").alias("__first")
    ).withColumn("__all", F.lit(0))
    before = preceding_totals(sizes, ["__all"], ["__part"], ["n"])
    return (
        sorted_rows.join(before.select("__part", "__first", "n_before"), "__part")
        .withColumn(name, F.col("n_before") + F.col("__row") - F.col("__first"))
        .drop("__part", "__row", "__first", "n_before")
    )
