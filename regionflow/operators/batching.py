"""Numbering and batching of jobs, and joining replies back by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.parse import reply_status
from regionflow.operators.ordering import RADIX, preceding_totals, radix_levels, with_position
from regionflow.session import by_key


def _page_levels(first: Column) -> dict[str, Column]:
    """Blocks of 1024 pages, then pages, a very full page in parts."""
    block = F.floor(F.col("page_idx") / RADIX)
    part = F.floor(F.col("bubble_idx") / RADIX)
    return {
        "__block": F.struct(first.alias("a"), block.alias("b")),
        "__page": F.struct(F.col("page_idx").alias("a"), part.alias("b")),
    }


def job_order(jobs: DataFrame, name: str = "seq") -> DataFrame:
    """First-level jobs by (page, region), then second-level ones; from 0 per document."""
    return with_position(
        jobs, ["doc_id"], _page_levels(F.col("is_l2").cast("int")), [F.col("bubble_idx")], name
    )


def region_order(regions: DataFrame, name: str = "global_idx") -> DataFrame:
    """Running number of regions by (page, region) inside a document."""
    return with_position(
        regions, ["doc_id"], _page_levels(F.lit(0)), [F.col("bubble_idx")], name
    )


def fixed_batches(jobs: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Batches of ``size`` by position, and the place inside the batch."""
    return jobs.withColumns({
        "batch_idx": F.floor(F.col(seq) / size).cast("bigint"),
        "batch_pos": F.pmod(F.col(seq), F.lit(size)).cast("bigint"),
    })


def page_batches(regions: DataFrame, size: int) -> DataFrame:
    """Batches that never mix pages; one single batch when all regions fit in it.

    ``bubble_idx`` counts from 0 inside a page.  Adds batch_idx, the running
    offset of the batch and the place inside it.
    """
    full = F.ceil(F.col("n") / size)
    pages = (
        regions.groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"parts": full, **radix_levels("page_idx", "__p", 1)})
    )
    before = preceding_totals(pages, ["doc_id"], ["__p1", "page_idx"], ["n", "parts"])
    totals = pages.groupBy("doc_id").agg(F.sum("n").alias("total"))
    table = before.join(totals, "doc_id").select(
        "doc_id", "page_idx", "n_before", "parts_before", "total"
    )
    part = F.floor(F.col("bubble_idx") / size)
    whole = F.col("total") <= size
    at = F.col("n_before") + F.col("bubble_idx")
    return (
        regions.join(table, ["doc_id", "page_idx"])
        .withColumns({
            "batch_idx": F.when(whole, 0).otherwise(F.col("parts_before") + part).cast("bigint"),
            "batch_offset": F.when(whole, 0)
            .otherwise(F.col("n_before") + part * size).cast("bigint"),
        })
        .withColumn("batch_pos", (at - F.col("batch_offset")).cast("bigint"))
        .drop("n_before", "parts_before", "total")
    )


def text_cut_batches(infos: DataFrame, size: int = C.STREAM_TEXT_BATCH) -> DataFrame:
    """Cut after every ``size``-th non-empty text; an empty one rides along with
    the batch open at its place.  ``global_idx`` gives the order; adds also
    ``text_idx``, the number of texts before it in its batch."""
    has_text = (F.col("text") != "").cast("bigint")
    counted = with_position(
        infos, ["doc_id"], radix_levels("global_idx", "__g", 2),
        [F.col("global_idx")], "texts_before", weight=has_text,
    )
    return counted.withColumns({
        "batch_idx": F.floor(F.col("texts_before") / size).cast("bigint"),
        "text_idx": F.pmod(F.col("texts_before"), F.lit(size)).cast("bigint"),
    }).drop("texts_before")


def batch_ranges(batched: DataFrame, position: str = "global_idx") -> DataFrame:
    return batched.groupBy("doc_id", "batch_idx").agg(
        F.min(position).alias("first_idx"), F.max(position).alias("last_idx"),
        F.count(F.lit(1)).alias("n"),
    )


def numbered_prompt(batched: DataFrame, style: str = "list") -> DataFrame:
    """One row per batch: ``list`` gives a JSON array of ``1. text``, ``lines``
    gives ``[1]: text`` lines.  A batch has a fixed size, so its array is small."""
    number = (F.col("batch_pos") + 1).cast("string")
    if style == "list":
        entry = F.concat(number, F.lit(". "), F.col("text"))
    else:
        entry = F.concat(F.lit("["), number, F.lit("]: "), F.col("text"))
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("batch_pos", entry.alias("e")))),
        lambda s: s.getField("e"),
    )
    body = F.to_json(entries) if style == "list" else F.array_join(entries, "\n")
    return batched.groupBy("doc_id", "batch_idx").agg(
        F.count(F.lit(1)).alias("n"), body.alias("prompt_body")
    )


def join_by_position(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """Translation i of a batch belongs to job i; past the end it is missing.

    ``replies``: doc_id, batch_idx, translations array.
    """
    entries = replies.select(
        "doc_id", "batch_idx", F.posexplode("translations").alias("batch_pos", "translated")
    ).withColumn("batch_pos", F.col("batch_pos").cast("bigint"))
    return jobs.join(by_key(entries), ["doc_id", "batch_idx", "batch_pos"], "left").withColumn(
        "translated", F.coalesce("translated", F.lit(C.MISSING))
    )


def zip_texts(infos: DataFrame, replies: DataFrame) -> DataFrame:
    """Translation k of a batch belongs to its k-th non-empty text; empty texts
    give ``''``.  ``infos`` come from :func:`text_cut_batches`."""
    entries = replies.select(
        "doc_id", "batch_idx", F.posexplode("translations").alias("text_idx", "translated")
    ).withColumn("text_idx", F.col("text_idx").cast("bigint"))
    texts = infos.filter("text != ''").join(
        by_key(entries), ["doc_id", "batch_idx", "text_idx"], "left"
    ).withColumn("translated", F.coalesce("translated", F.lit(C.MISSING)))
    empty = infos.filter("text = ''").withColumn("translated", F.lit(""))
    return texts.unionByName(empty)


def missing_cells(expected: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Cell numbers 0 .. expected-1 that no reply line carried."""
    slots = expected.filter("expected > 0").select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("expected") - 1)).alias("idx")
    )
    return slots.join(parsed.select(*keys, "idx"), [*keys, "idx"], "left_anti")


def retry_slots(missing: DataFrame, keys: list[str]) -> DataFrame:
    """Renumber the missing cells of every batch 0..k-1 for a smaller retry grid."""
    order = Window.partitionBy(*keys).orderBy("idx")
    return missing.withColumn("retry_idx", (F.row_number().over(order) - 1).cast("bigint"))


def retry_overlay(
    parsed: DataFrame, slots: DataFrame, retried: DataFrame, keys: list[str]
) -> DataFrame:
    """First-round cells plus retry cells under their original numbers."""
    back = retried.select(*keys, F.col("idx").alias("retry_idx"), "text")
    recovered = slots.join(back, [*keys, "retry_idx"]).select(*keys, "idx", "text")
    return parsed.select(*keys, "idx", "text").withColumn("retried", F.lit(False)).unionByName(
        recovered.withColumn("retried", F.lit(True))
    )


def global_cells(parsed: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Batch-local cell numbers to document numbers by adding the batch offset."""
    return parsed.join(offsets.select(*keys, "batch_offset"), keys).withColumn(
        "cell_idx", F.coalesce("idx", F.lit(0)) + F.col("batch_offset")
    )


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines of all batches of a document, run together: by batch, then by cell (a missing
    number counts as 0), then by ``line_no``. Adds ``place`` and the batch counted from 1.

    ``lines``: doc_id, batch_idx, cell_idx, line_no.
    """
    cell = F.coalesce("cell_idx", F.lit(0)).cast("bigint")
    keyed = lines.withColumn("__cell", cell)
    placed = with_position(
        keyed, ["doc_id"], radix_levels("batch_idx", "__b", 2), [F.col("batch_idx"), F.col("__cell"), F.col("line_no")], "place"
    )
    return placed.withColumn("batch_no", F.col("batch_idx") + 1).drop("__cell")


def failed_batches(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Batches with an error or fewer cells than asked for.

    ``expected``: one row per region (keys, page_idx); ``actual``: one row per
    reply (keys, actual, error).
    """
    asked = expected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected"),
        F.sort_array(F.collect_set("page_idx")).alias("pages"),
    )
    joined = asked.join(actual, keys, "left").fillna(0, ["actual"])
    short = F.col("actual") < F.col("expected")
    return joined.filter(F.col("error").isNotNull() | short).withColumn(
        "missing", F.when(F.col("error").isNull(), F.col("expected") - F.col("actual"))
    )


def batch_status(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per translation batch: texts sent and received, status, retries and time.

    ``replies``: doc_id, batch_idx, translations, error, time_ms, attempts.
    """
    keys = ["doc_id", "batch_idx"]
    sent = batched.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"))
    failed = F.concat(F.lit("error: "), F.col("error"))
    return sent.join(replies, keys, "left").select(
        *keys, "texts", F.coalesce(failed, reply_status("translations", "texts")).alias("status"),
        F.when(F.col("error").isNull(), F.coalesce(F.size("translations"), F.lit(0))).otherwise(0).alias("received"),
        F.greatest(F.coalesce(F.col("attempts"), F.lit(1)) - 1, F.lit(0)).alias("retries"), "time_ms",
    )


def outcome_counts(translations: DataFrame, definition: str, keys: list[str]) -> DataFrame:
    """Success and failure by one of the three definitions in use.

    a: success unless failed or no-text; b: success when usable; c: when not blank.
    """
    t = F.coalesce("translated", F.lit(""))
    failed, no_text = t == C.FAILED, t == C.NO_TEXT
    n = F.count(F.lit(1))

    def count(name: str, test: Column) -> Column:
        return F.count_if(test).alias(name)

    usable = (t != "") & ~t.startswith("[")
    aggregates = {
        "a": [count("success", ~failed & ~no_text), count("failed", failed | no_text)],
        "b": [
            count("success", usable), (n - F.count_if(usable)).alias("failed"),
            count("no_text", no_text), count("marked_failed", failed), count("empty", t == ""),
        ],
        "c": [
            count("success", t.rlike(r"(?U)[^\s\x1c-\x1f]")),
            (n - F.count_if(t.rlike(r"(?U)[^\s\x1c-\x1f]"))).alias("failed"),
        ],
    }[definition]
    return translations.groupBy(*keys).agg(*aggregates) if keys else translations.agg(*aggregates)


def retry_plan(
    translated: DataFrame,
    batch: int = C.RETRY_BATCH,
    max_share: float = C.RETRY_MAX_FAILED_SHARE,
) -> DataFrame:
    """Failed texts of documents with at most ``max_share`` failures, batched anew."""
    failed = F.col("translated") == C.FAILED
    docs = (
        translated.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
        .filter((F.col("bad") > 0) & (F.col("bad") <= F.col("n") * max_share))
        .select("doc_id")
    )
    again = translated.filter(failed).select("doc_id", "seq", "text").join(docs, "doc_id", "left_semi")
    numbered = with_position(
        again, ["doc_id"], radix_levels("seq", "__s", 2), [F.col("seq")], "retry_seq"
    )
    return fixed_batches(numbered, batch, "retry_seq")


def overlay_retries(translated: DataFrame, retried: DataFrame) -> DataFrame:
    """Replace a failed text only where the retry succeeded."""
    good = retried.filter(F.col("retried") != C.FAILED).select("doc_id", "seq", "retried")
    return (
        translated.join(good, ["doc_id", "seq"], "left")
        .withColumn(
            "translated",
            F.when(F.col("translated") == C.FAILED, F.coalesce("retried", "translated"))
            .otherwise(F.col("translated")),
        )
        .drop("retried")
    )
