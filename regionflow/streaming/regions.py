"""The streaming form: regions in, translated regions out in order.

Stage 1 cuts a document's regions, which may arrive in any order, into
translation batches and emits a batch as soon as it is complete.  Stage 2
translates batches and writes results.  Stage 3 releases results in region
order.  Before them an OCR stage may read the regions' texts, nine at a time, whole nines
filled over micro-batches.  Stages meet in shared Parquet folders, so each restarts on its own from
its checkpoint.  There is no event time: state goes when a document is complete
or its stall timer fires.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from regionflow import constants as C
from regionflow.functions.text import event_text
from regionflow.operators.batching import zip_texts
from regionflow.operators.ordering import radix_levels, with_position
from regionflow.session import cut_lineage, stream_settings, temporary_tables

REGION_INPUT = (
    "doc_id bigint, global_idx bigint, page_idx bigint, bubble_idx bigint, text string, "
    "ocr_error boolean, is_end boolean"
)
BATCHED = (
    "doc_id bigint, kind string, batch_idx bigint, global_idx bigint, text_idx bigint, "
    "page_idx bigint, bubble_idx bigint, text string"
)
RESULT = (
    "doc_id bigint, kind string, global_idx bigint, page_idx bigint, bubble_idx bigint, "
    "original_text string, translated_text string"
)
RELEASED = (
    "doc_id bigint, kind string, global_idx bigint, page_idx bigint, bubble_idx bigint, "
    "original_text string, translated_text string"
)
OCR_INPUT = REGION_INPUT + ", ocr_batch bigint"
STALL_MS = 300_000
#: How long a worker may take for what is missing once a document's end is known.
WORKER_MS = 120_000
#: Rows of a key held in memory before they go to its state.
NEAR_ROWS = 65_536
#: Rows of a key handed on at once.
FRAME_ROWS = 4096
BROKEN_SOURCE = "source failed"


def values_of(frame: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """Rows of a key as plain tuples; most keys bring few, and named ones cost a class each time."""
    return zip(*(frame[n].tolist() for n in names))


def framed(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size, so a key's output is never held whole."""
    names = [part.split()[0] for part in schema.split(",")]
    while part := list(itertools.islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(part, columns=names)


class _Held:
    """Rows of a key by index: what this call brought is in memory, the rest in a map state.

    State is asked only for what is known to lie there, and written once at the end of a
    call, or when many rows wait for an earlier one.
    """

    def __init__(self, state, stored: int):
        self.state, self.stored = state, stored
        self.near: dict[int, tuple] = {}

    def put(self, idx: int, row: tuple) -> None:
        self.near[idx] = row
        if len(self.near) > NEAR_ROWS:
            self.flush()

    def get(self, idx: int) -> tuple | None:
        if idx in self.near:
            return self.near[idx]
        return tuple(self.state.getValue((idx,))) if self.stored and self.state.containsKey((idx,)) else None

    def drop(self, idx: int) -> None:
        self.near.pop(idx, None)
        if self.stored and self.state.containsKey((idx,)):
            self.state.removeKey((idx,))
            self.stored -= 1

    def flush(self) -> None:
        for idx, row in self.near.items():
            self.stored += not (self.stored and self.state.containsKey((idx,)))
            self.state.updateValue((idx,), row)
        self.near = {}

    def clear(self) -> None:
        self.near = {}
        if self.stored:
            self.state.clear()
        self.stored = 0


class NineBatcher(StatefulProcessor):
    """Regions for the OCR stage: so many of a document in order at a time, however its regions
    come in and over however many micro-batches; the rest goes with the end marker."""

    def __init__(self, size: int = C.STREAM_REGION_BATCH, stall_ms: int | None = STALL_MS):
        self.size, self.stall_ms = size, stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, sent bigint, total bigint, broken boolean, timer bigint, stored bigint")
        self.rows = handle.getMapState("rows", "idx bigint", "page bigint, bubble bigint, text string, bad boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        yield from framed(self.step(key, rows, timerValues), OCR_INPUT)

    def emit(self, doc: int, held: _Held, start: int, end: int) -> Iterator[tuple]:
        for idx in range(start, end):
            yield doc, idx, *held.get(idx), False, start // self.size
            held.drop(idx)

    def step(self, key, rows, timerValues) -> Iterator[tuple]:
        (doc,) = key
        at, sent, total, broken, timer, stored = self.place.get() if self.place.exists() else (0, 0, -1, False, -1, 0)
        held = _Held(self.rows, stored)
        if self.stall_ms and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stall_ms
            self.handle.registerTimer(timer)
        for frame in rows:
            for idx, page, bubble, text, bad, is_end in values_of(frame, "global_idx", "page_idx", "bubble_idx", "text", "ocr_error", "is_end"):
                if is_end:
                    total, broken = int(idx), bool(bad)
                elif idx >= at:
                    held.put(int(idx), (int(page), int(bubble), text or "", bool(bad)))
            while held.get(at) is not None:
                at += 1
                if at - sent == self.size:
                    yield from self.emit(doc, held, sent, at)
                    sent = at
        if at == total:
            yield from self.emit(doc, held, sent, at)
            yield doc, total, -1, -1, "", broken, True, -1
            self.place.clear()
            held.clear()
            if timer >= 0:
                self.handle.deleteTimer(timer)
        else:
            held.flush()
            self.place.update((at, sent, total, broken, timer, held.stored))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, sent, _, _, _, stored = self.place.get() if self.place.exists() else (0, 0, -1, False, -1, 0)
        held = _Held(self.rows, stored)

        def rest() -> Iterator[tuple]:
            yield from self.emit(key[0], held, sent, at)
            yield key[0], at, -1, -1, "", True, True, -1

        yield from framed(rest(), OCR_INPUT)
        self.place.clear()
        held.clear()

    def close(self) -> None:
        pass


class RegionBatcher(StatefulProcessor):
    """Accumulate regions in order; emit a batch at every ``size``-th text and the
    rest at the end marker (whose ``global_idx`` is the number of regions).

    An end marker with ``ocr_error`` says that the source broke off there: the regions
    so far are emitted, then an error instead of the end. A stall does the same."""

    def __init__(self, size: int = C.STREAM_TEXT_BATCH, stall_ms: int | None = STALL_MS):
        self.size, self.stall_ms = size, stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState(
            "place", "next bigint, first bigint, texts bigint, batch bigint, total bigint, timer bigint, broken boolean, stored bigint"
        )
        self.rows = handle.getMapState(
            "rows", "idx bigint", "page bigint, bubble bigint, text string, bad boolean"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        yield from framed(self.step(key, rows, timerValues), BATCHED)

    def emit(self, doc: int, held: _Held, first: int, until: int, batch: int) -> Iterator[tuple]:
        seen = 0
        for idx in range(first, until):
            row = held.get(idx)
            if row is None:
                continue                      # an error row, released before
            page, bubble, text, _ = row
            yield doc, "region", batch, idx, seen, page, bubble, text
            seen += text != ""
            held.drop(idx)

    def step(self, key, rows, timerValues) -> Iterator[tuple]:
        (doc,) = key
        at, first, texts, batch, total, timer, broken, stored = (
            self.place.get() if self.place.exists() else (0, 0, 0, 0, -1, -1, False, 0)
        )
        held = _Held(self.rows, stored)
        if self.stall_ms and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stall_ms
            self.handle.registerTimer(timer)
        waiting = first < at
        for frame in rows:
            for idx, page, bubble, text, bad, is_end in values_of(frame, "global_idx", "page_idx", "bubble_idx", "text", "ocr_error", "is_end"):
                if is_end:
                    total, broken = int(idx), bool(bad)
                elif idx >= at:
                    held.put(int(idx), (int(page), int(bubble), text or "", bool(bad)))
            while (row := held.get(at)) is not None:
                page, bubble, text, bad = row
                if bad:
                    yield doc, "ocr_error", -1, at, -1, page, bubble, C.OCR_ERROR
                    held.drop(at)
                else:
                    texts, waiting = texts + (text != ""), True
                at += 1
                if texts == self.size:
                    yield from self.emit(doc, held, first, at, batch)
                    first, texts, batch, waiting = at, 0, batch + 1, False
        if at == total:
            if waiting:
                yield from self.emit(doc, held, first, at, batch)
            yield (doc, "error" if broken else "end", -1, total, -1, -1, -1, BROKEN_SOURCE if broken else "")
            self.place.clear()
            held.clear()
            if timer >= 0:
                self.handle.deleteTimer(timer)
        else:
            held.flush()
            self.place.update((at, first, texts, batch, total, timer, broken, held.stored))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, first, _, batch, *_, stored = self.place.get() if self.place.exists() else (0, 0, 0, 0, 0)
        held = _Held(self.rows, stored)

        def rest() -> Iterator[tuple]:
            # What came in order before the gap is still worth translating.
            yield from self.emit(key[0], held, first, at, batch)
            yield key[0], "error", -1, at, -1, -1, -1, f"Timeout waiting for result {at}"

        yield from framed(rest(), BATCHED)
        self.place.clear()
        held.clear()

    def close(self) -> None:
        pass


class OrderedRelease(StatefulProcessor):
    """Hold results by index and let them go while the next index is there; the end or
    an error closes the document and drops what is held of it.

    A result that never comes ends the document in an error: ``stall_ms`` after its first
    row, but not before a worker had ``worker_ms`` for it since the document's end was known.
    """

    def __init__(self, stall_ms: int | None = None, worker_ms: int = WORKER_MS):
        self.stall_ms, self.worker_ms = stall_ms, worker_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, total bigint, error string, due bigint, timer bigint, stored bigint")
        self.rows = handle.getMapState(
            "held", "idx bigint", "page bigint, bubble bigint, source string, target string"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        yield from framed(self.step(key, rows, timerValues), RELEASED)

    def step(self, key, rows, timerValues) -> Iterator[tuple]:
        (doc,) = key
        at, total, error, due, timer, stored = self.place.get() if self.place.exists() else (0, -1, None, -1, -1, 0)
        held = _Held(self.rows, stored)
        now = timerValues.getCurrentProcessingTimeInMs() if self.stall_ms else 0
        if self.stall_ms and timer < 0:
            due = timer = now + self.stall_ms
            self.handle.registerTimer(timer)
        for frame in rows:
            for kind, idx, page, bubble, source, target in values_of(frame, "kind", "global_idx", "page_idx", "bubble_idx", "original_text", "translated_text"):
                if kind in ("end", "error"):
                    total = int(idx)
                    error = source if kind == "error" else None
                    due = max(due, now + self.worker_ms)
                elif idx >= at:
                    held.put(int(idx), (int(page), int(bubble), source, target))
            while (row := held.get(at)) is not None:
                yield doc, "result", at, *row
                held.drop(at)
                at += 1
        if at == total:
            if error is None:
                yield doc, "complete", total, -1, -1, "", ""
            else:
                yield doc, "error", total, -1, -1, error, error
            self.place.clear()
            held.clear()
            if timer >= 0:
                self.handle.deleteTimer(timer)
        else:
            held.flush()
            self.place.update((at, total, error, due, timer, held.stored))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.place.exists():
            return
        at, total, error, due, _, stored = self.place.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        # Without its end a document is still read, and the stage before has a limit for that.
        later = due if now < due else now + self.stall_ms if total < 0 else -1
        if later >= 0:
            self.handle.registerTimer(later)
            self.place.update((at, total, error, due, later, stored))
            return
        message = f"Timeout waiting for result {at}"
        yield from framed(iter([(key[0], "error", at, -1, -1, message, message)]), RELEASED)
        self.place.clear()
        _Held(self.rows, stored).clear()

    def close(self) -> None:
        pass


def batch_nines(stream: DataFrame, size: int = C.STREAM_REGION_BATCH, stall_ms: int | None = STALL_MS) -> DataFrame:
    """Regions with their ``ocr_batch``, let go when a batch is whole or its document ends."""
    return stream.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=NineBatcher(size, stall_ms), outputStructType=OCR_INPUT,
        outputMode="Append", timeMode="ProcessingTime" if stall_ms else "None",
    )


def batch_regions(
    stream: DataFrame, size: int = C.STREAM_TEXT_BATCH, stall_ms: int | None = STALL_MS
) -> DataFrame:
    return stream.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=RegionBatcher(size, stall_ms), outputStructType=BATCHED,
        outputMode="Append", timeMode="ProcessingTime" if stall_ms else "None",
    )


def release_in_order(stream: DataFrame, stall_ms: int | None = None, worker_ms: int = WORKER_MS) -> DataFrame:
    return stream.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=OrderedRelease(stall_ms, worker_ms), outputStructType=RELEASED,
        outputMode="Append", timeMode="ProcessingTime" if stall_ms else "None",
    )


def translate_batched(
    batched: DataFrame, translate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Results of one micro-batch of complete batches.

    ``translate`` turns (doc_id, batch_idx, texts array) into the same keys with
    ``translations`` and ``error``; an error marks the whole batch, never the query.
    """
    regions = batched.filter("kind = 'region'")
    texts = regions.filter("text <> ''").groupBy("doc_id", "batch_idx").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("text_idx", "text"))),
            lambda s: s.getField("text"),
        ).alias("texts")
    )
    # Written once: errors and texts below must come from the same answers.
    replies = cut_lineage(translate(texts))
    errors = replies.filter("error IS NOT NULL").select(
        "doc_id", "batch_idx", F.lit(True).alias("broken")
    )
    answered = replies.filter("error IS NULL").select("doc_id", "batch_idx", "translations")
    results = zip_texts(regions, answered).join(errors, ["doc_id", "batch_idx"], "left").select(
        "doc_id", F.lit("result").alias("kind"), "global_idx", "page_idx", "bubble_idx",
        F.col("text").alias("original_text"),
        F.when(F.col("broken"), C.TRANSLATE_ERROR).otherwise(F.col("translated"))
        .alias("translated_text"),
    )
    passed_on = batched.filter("kind IN ('ocr_error', 'end', 'error')").select(
        "doc_id", F.when(F.col("kind") == "ocr_error", "result").otherwise(F.col("kind")).alias("kind"),
        "global_idx", "page_idx", "bubble_idx", F.col("text").alias("original_text"),
        F.col("text").alias("translated_text"),
    )
    return results.unionByName(passed_on)


def stream_plan(regions: DataFrame) -> DataFrame:
    """First-level regions as stream input: their lines run together, numbered per document
    by page and region, and an end marker per document.

    ``regions``: doc_id, page_idx, level, bubble_idx, original_text.
    """
    first = regions.filter("level = 1").select("doc_id", "page_idx", "bubble_idx", F.col("original_text").alias("text"))
    numbered = with_position(
        first, ["doc_id"], radix_levels("page_idx", "__p", 1), [F.col("page_idx"), F.col("bubble_idx")], "global_idx"
    )
    names = [part.split()[0] for part in REGION_INPUT.split(",")]
    rows = numbered.withColumns({"ocr_error": F.lit(False), "is_end": F.lit(False)}).select(*names)
    none = F.lit(-1).cast("bigint")
    ends = numbered.groupBy("doc_id").agg((F.max("global_idx") + 1).alias("global_idx")).withColumns({
        "page_idx": none, "bubble_idx": none, "text": F.lit(""), "ocr_error": F.lit(False), "is_end": F.lit(True),
    })
    return rows.unionByName(ends)


def read_crops(frame: DataFrame, ocr: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The OCR stage on rows of ``batch_nines``: ``ocr`` gets region rows with their ``ocr_batch`` and
    gives them back with ``text`` and ``ocr_error``; end markers pass."""
    names = [part.split()[0] for part in REGION_INPUT.split(",")]
    return ocr(frame.filter("NOT is_end")).select(*names).unionByName(frame.filter("is_end").select(*names))


def start_region_stream(
    spark: SparkSession,
    source: str,
    work: str,
    translate: Callable[[DataFrame], DataFrame],
    size: int = C.STREAM_TEXT_BATCH,
    files_per_trigger: int | None = None,
    stall_ms: int | None = STALL_MS,
    worker_ms: int = WORKER_MS,
    state_partitions: int = 8,
    ocr: Callable[[DataFrame], DataFrame] | None = None,
    finite: bool = False,
    every: str = "1 second",
) -> list[StreamingQuery]:
    """Start all stages over what comes to ``source`` (Parquet, ``REGION_INPUT``).

    The stages run side by side, so rows are released while regions still arrive; folders
    under ``work`` make each stage restartable. A ``finite`` run goes through the stages one
    after the other to the end of the input, and then they are over.
    """
    trigger = {"availableNow": True} if finite else {"processingTime": every}

    def read(path: str, schema: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(path)

    def stage(name: str, schema: str, change: Callable[[DataFrame], DataFrame], rows: DataFrame) -> StreamingQuery:
        # A folder that is watched must hold something.
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{work}/{name}/epoch=-1")

        def write(frame: DataFrame, epoch: int) -> None:
            # One folder per epoch: a repeated epoch replaces its own output only.
            with temporary_tables(frame.sparkSession):
                # Stored first: each use of the frame itself would run the stateful step again.
                change(cut_lineage(frame)).write.mode("overwrite").parquet(f"{work}/{name}/epoch={epoch}")

        started = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/check-{name}").trigger(**trigger).start()
        if finite:
            started.awaitTermination()
        return started

    queries = []
    with stream_settings(spark, state_partitions):
        regions = source
        if ocr:
            nines = batch_nines(read(source, REGION_INPUT), stall_ms=stall_ms)
            queries.append(stage("regions", REGION_INPUT, lambda frame: read_crops(frame, ocr), nines))
            regions = f"{work}/regions/*"
        batched = batch_regions(read(regions, REGION_INPUT), size, stall_ms)
        queries.append(stage("results", RESULT, lambda frame: translate_batched(frame, translate), batched))
        released = (
            release_in_order(read(f"{work}/results/*", RESULT), stall_ms, worker_ms)
            .writeStream.format("parquet").option("path", f"{work}/released")
            .option("checkpointLocation", f"{work}/check-released").trigger(**trigger).start()
        )
        if finite:
            released.awaitTermination()
        queries.append(released)
    return queries


def run_region_stream(
    spark: SparkSession, source: str, work: str, translate: Callable[[DataFrame], DataFrame],
    stall_ms: int | None = None, **options,
) -> DataFrame:
    """Run all stages over what is in ``source`` and return the released rows.

    A finite source has no stalls to wait for, so timers are off.
    """
    start_region_stream(spark, source, work, translate, stall_ms=stall_ms, finite=True, **options)
    return spark.read.schema(RELEASED).parquet(f"{work}/released")


def start_events(regions: DataFrame, batch: int = C.STREAM_REGION_BATCH) -> DataFrame:
    """The opening event of every document."""
    return regions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_bubbles"), F.countDistinct("page_idx").alias("pages")
    ).select(
        "doc_id", F.lit("start").alias("kind"), F.lit(-1).cast("bigint").alias("global_idx"),
        event_text(
            F.lit("start"),
            F.struct(
                F.ceil(F.col("total_bubbles") / batch).alias("total_batches"),
                "total_bubbles", "pages",
            ),
        ).alias("event"),
    )


def released_events(released: DataFrame) -> DataFrame:
    """Released rows with their event text."""
    result = F.struct("global_idx", "page_idx", "bubble_idx", "original_text", "translated_text")
    end = F.struct(F.struct(F.col("global_idx").alias("bubbles")).alias("stats"))
    error = F.struct(F.col("original_text").alias("error"))
    return released.withColumn(
        "event",
        F.when(F.col("kind") == "result", event_text(F.lit("result"), result))
        .when(F.col("kind") == "complete", event_text(F.lit("complete"), end))
        .otherwise(event_text(F.lit("error"), error)),
    )
