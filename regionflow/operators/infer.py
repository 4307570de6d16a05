"""Model calls as Spark stages.

A model is a callable the user hands in: it gets a pandas frame and returns one.
It is loaded once per Python worker and only sees a part of an Arrow batch, or one
batch of jobs, at a time.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import is_limited, is_overload
from regionflow.session import cut_lineage

#: Bytes of rows that a row model gets at a time.
CALL_BYTES = 8 << 20

Model = Callable[[pd.DataFrame], pd.DataFrame]


def _model(name: str, load: Callable[[], Model]) -> Model:
    """The worker's copy of a model; kept in its module table, as the functions
    shipped to a worker are made anew for every task."""
    kept = sys.modules.setdefault("regionflow_models", types.ModuleType("regionflow_models"))
    if not hasattr(kept, name):
        setattr(kept, name, load())
    return getattr(kept, name)


def _parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A frame in parts of at most ``CALL_BYTES`` bytes, or of a single row."""
    waiting = [frame]
    while waiting:
        part = waiting.pop()
        if len(part) > 1 and part.memory_usage(deep=True).sum() > CALL_BYTES:
            half = len(part) // 2
            waiting += [part.iloc[half:], part.iloc[:half]]
        else:
            yield part.reset_index(drop=True)


def run_model(
    rows: DataFrame, name: str, load: Callable[[], Model], schema: str,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Run a row model (detector, mask, inpainter) over partitions.

    ``parallel_calls`` bounds how many calls run at once: the rows are stored, so that the work
    before the model keeps its own parallelism, and read by so many tasks without a shuffle.
    """
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for frame in frames:
            for part in _parts(frame):
                yield model(part)

    limited = cut_lineage(rows).coalesce(parallel_calls) if parallel_calls else rows
    return limited.mapInPandas(call, schema)


def run_batches(
    rows: DataFrame, keys: Sequence[str], name: str, load: Callable[[], Model], schema: str,
) -> DataFrame:
    """Run a batch model once per batch of jobs (batches have a fixed size)."""
    def call(batch: pd.DataFrame) -> pd.DataFrame:
        return _model(name, load)(batch)

    return rows.groupBy(*keys).applyInPandas(call, schema)


def with_fallbacks(
    rows: DataFrame, backends: Sequence[tuple[str, Callable[[], Model], bool]], schema: str
) -> DataFrame:
    """Ordered backends (name, loader, required); a row whose backend reports an
    ``error`` goes to the next one, except that a required backend's error stands.

    Every backend's rows are written out: a model is not asked twice.
    """
    done, waiting = None, rows
    for at, (name, load, required) in enumerate(backends):
        answered = cut_lineage(run_model(waiting, name, load, schema))
        last = required or at == len(backends) - 1
        final = answered if last else answered.filter("error IS NULL")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        failed = answered.filter("error IS NOT NULL")
        waiting = failed.select(*rows.columns)
    return done


def route(already_translated: Column, local: Column, local_ready: bool, mode: Column) -> Column:
    """Where a job's text is translated."""
    return (
        F.when(already_translated, "none")
        .when(local & F.lit(local_ready), "local")
        .when(local, "unavailable")
        .when(mode == "gemini", "gemini")
        .otherwise("api")
    )


def apply_route(jobs: DataFrame, translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send jobs on by their ``route``; kept and unavailable ones need no model."""
    kept = jobs.filter("route = 'none'").withColumn("translated", F.col("text"))
    down = jobs.filter("route = 'unavailable'").withColumn("translated", F.lit(C.LOCAL_UNAVAILABLE))
    asked = translate(jobs.filter("route NOT IN ('none', 'unavailable')"))
    return kept.unionByName(down).unionByName(asked.select(*kept.columns))


def ask_until_good(
    batches: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    problem: Column,
    max_attempts: int = 5,
) -> DataFrame:
    """Ask, check, and ask again only the batches whose reply is bad.

    ``ask`` gets the batches with an ``attempt`` column and returns them with
    their reply; ``problem`` is null for a good reply.  The last reply is kept
    in the end.  Each round is written out, so nothing is asked twice; the only
    thing read by the driver is whether a bad batch is left.
    """
    columns = batches.columns
    done, waiting = None, batches
    for attempt in range(max_attempts):
        asked = ask(waiting.withColumn("attempt", F.lit(attempt)))
        checked = cut_lineage(asked.withColumn("problem", problem))
        bad = checked.filter("problem IS NOT NULL")
        last = attempt == max_attempts - 1 or bad.isEmpty()
        final = checked if last else checked.filter("problem IS NULL")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        waiting = bad.select(*columns)
    return done


def attempt_schedule(
    calls: DataFrame, base_temperature: float = 0.7, fallback: str = "fallback",
    step: float = 0.05, ceiling: float = 0.85,
) -> DataFrame:
    """Wait, temperature and model of every attempt.

    ``calls``: request, attempt (from 0), error of that attempt.  The second
    overload, or the first rate limit, moves the following attempts to the
    fallback model.  A request has a handful of attempts.
    """
    earlier = (
        Window.partitionBy("request").orderBy("attempt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    overloads = F.coalesce(F.sum(is_overload("error").cast("int")).over(earlier), F.lit(0))
    limits = F.coalesce(
        F.sum((is_limited("error") & ~is_overload("error")).cast("int")).over(earlier), F.lit(0)
    )
    return calls.withColumns({
        "wait_s": F.when(F.col("attempt") > 0, F.pow(F.lit(2.0), "attempt")).otherwise(0.0),
        "temperature": F.least(F.lit(ceiling), F.lit(base_temperature) + F.col("attempt") * step),
        "model_used": F.when((overloads >= 2) | (limits >= 1), F.lit(fallback)).otherwise(
            F.col("model")
        ),
    })
