"""Queries over saved files, model stages, and the failure branches of replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import parse as P
from regionflow.functions import quality as Q
from regionflow.operators import assemble, batching, infer, mapping
from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.session import by_key, shared_dir
from regionflow.sources import files
from regionflow.sources import replies as R

BATCH = ["conv_id", "block"]


def stored_saves(spark, sf):
    """Saved result files, one line per page: page path to regions with their texts."""
    region = F.struct(
        F.col("bubble_idx").alias("idx"), F.array("x1", "y1", "x2", "y2").alias("bubble_box"),
        F.array(F.struct("text", F.array("x1", "y1", "x2", "y2").alias("bbox"))).alias("texts"),
    )
    pages = X.texts(spark, sf).groupBy("doc_id", "page_idx").agg(
        F.array_sort(F.collect_list(F.struct("line_no", region.alias("r")))).alias("all")
    ).select(
        F.concat(F.lit("in/page_"), F.col("page_idx").cast("string"), F.lit(".jpg")).alias("path"),
        F.transform("all", lambda x: x["r"]).alias("regions"),
    )
    folder = shared_dir(spark, "saved")
    # Pages are dealt out by the hash of document and page, so a file holds many of them.
    pages.select(F.to_json(F.create_map("path", "regions")).alias("value")).write.text(folder)
    return files.saved_results(spark, folder, lines=True)


@query("saved_regions", sql("""SELECT 'in/page_' || page_idx || '.jpg' AS page_path, page_idx AS page_no, bubble_idx AS idx,
    x1 || ',' || y1 || ',' || x2 || ',' || y2 AS box, text FROM texts""", "texts"))
def saved_regions(spark, sf):
    return stored_saves(spark, sf).select(
        "page_path", "page_no", "idx", F.array_join(F.col("bubble_box").cast("array<string>"), ",").alias("box"),
        F.element_at("texts", 1)["text"].alias("text"),
    )


@query("saved_counts", sql("""SELECT 'in/page_' || page_idx || '.jpg' AS page_path, page_idx AS page_no, count(*) AS regions,
    count(*) AS texts FROM texts GROUP BY page_idx""", "texts"))
def saved_counts(spark, sf):
    return files.saved_counts(stored_saves(spark, sf))


@query("batch_items", sql("""SELECT conv_id, block, idx AS index, CASE WHEN told THEN NULL ELSE 'gap ' || turn END AS error, told AS success,
    CASE WHEN told THEN text END AS results FROM turns WHERE conv_id % 13 > 0
    UNION ALL SELECT conv_id, block, 0, 'bad JSON', false, NULL FROM blocks WHERE conv_id % 13 = 0""", "turns", "blocks"))
def batch_items(spark, sf):
    return R.batch_items(batch_bodies(spark, sf), "body").select(*BATCH, "index", "success", "error", "results")


def batch_bodies(spark, sf):
    """Reply bodies of an OCR service: an item per turn, some failed; every thirteenth body is broken."""
    item = F.struct(
        F.col("told").alias("success"), F.when(~F.col("told"), F.concat(F.lit("gap "), F.col("turn").cast("string"))).alias("error"),
        F.when(F.col("told"), F.col("text")).alias("results"),
    )
    bodies = X.turns(spark, sf).groupBy(*BATCH).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("i")))), lambda x: x["i"]).alias("results")
    ).withColumn("body", F.when(F.col("conv_id") % 13 == 0, "{bad").otherwise(F.to_json(F.struct("results"))))
    return bodies.drop("results")


# A body that cannot be read is the batch's error; an item that failed is a missing cell.
@query("failed_batches", sql("""SELECT conv_id, block, count(*) AS expected, CASE WHEN conv_id % 13 = 0 THEN 0 ELSE count(*) FILTER (told) END AS actual,
    string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages, CASE WHEN conv_id % 13 = 0 THEN 'bad JSON' END AS error,
    CASE WHEN conv_id % 13 > 0 THEN count(*) FILTER (NOT told) END AS missing FROM turns
    GROUP BY conv_id, block HAVING count(*) FILTER (NOT told) > 0 OR conv_id % 13 = 0""", "turns"))
def failed_batches(spark, sf):
    regions = X.turns(spark, sf).selectExpr(*BATCH, "turn AS page_idx")
    items = R.batch_items(batch_bodies(spark, sf), "body")
    actual = items.groupBy(*BATCH).agg(F.count_if("success").alias("actual"), F.max(F.when(F.col("error") == "bad JSON", F.col("error"))).alias("error"))
    bad = batching.failed_batches(regions, actual, BATCH)
    return bad.select(*BATCH, "expected", "actual", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "error", "missing")


@query("batch_status", sql("""SELECT doc_id, batch_idx, n AS texts, CASE WHEN batch_idx % 5 = 3 THEN 'error: 503' WHEN batch_idx % 5 = 4 THEN 'empty_response'
    WHEN batch_idx % 5 = 2 AND n > 1 THEN concat('partial (', n - 1, '/', n, ')') ELSE 'success' END AS status,
    CASE WHEN batch_idx % 5 = 3 THEN 0 WHEN batch_idx % 5 = 4 THEN 0 WHEN batch_idx % 5 = 2 AND n > 1 THEN n - 1 ELSE n END AS received,
    batch_idx % 5 AS retries, 100 * n AS time_ms FROM (SELECT doc_id, CAST(floor(seq / 20) AS BIGINT) AS batch_idx, count(*) AS n FROM ordered_jobs GROUP BY ALL)""", "ordered_jobs"))
def batch_status(spark, sf):
    from regionflow.plans.text_queries import ordered_jobs

    batched = batching.fixed_batches(ordered_jobs(spark, sf), 20)
    texts = batched.groupBy("doc_id", "batch_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "text"))), lambda s: s["text"]).alias("all")
    )
    kind = F.col("batch_idx") % 5
    short = F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(1)))
    replies = texts.select(
        "doc_id", "batch_idx", F.when(kind < 2, F.col("all")).when(kind == 2, short).alias("translations"),
        F.when(kind == 3, "503").alias("error"), (F.size("all") * 100).alias("time_ms"), (kind + 1).alias("attempts"),
    )
    return batching.batch_status(batched, replies)


# One reply per conversation for each reason, in the order of the rules, then a good one.
@query("reply_reasons", sql("""SELECT conv_id, block, CASE k WHEN 0 THEN 'empty_output' WHEN 1 THEN 'no_cells_parsed' WHEN 2 THEN 'index_overflow:4_vs_3'
    WHEN 3 THEN 'missing_indices:[1]_of_3' WHEN 4 THEN 'word_repetition:go' WHEN 5 THEN 'alternating_repetition:ping_pong'
    WHEN 6 THEN 'phrase_repetition:tra la lo' WHEN 7 THEN 'low_uniqueness' WHEN 8 THEN concat('duplicate_cells:3x''', left(t, 10), '''') ELSE 'good' END AS reason
    FROM (SELECT conv_id, block, conv_id % 10 AS k, 'n' || conv_id || ' of b' || block AS t FROM blocks)""", "blocks"))
def reply_reasons(spark, sf):
    kind = F.col("conv_id") % 10
    t = F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit(" of b"), F.col("block").cast("string"))
    said = {
        0: F.lit(" \n "), 1: t, 3: F.concat(F.lit("[0]: "), t, F.lit(" [2]: z")),
        4: F.concat(F.lit("[0]: go go go "), t, F.lit(" [1]: b [2]: c")),
        5: F.concat(F.lit("[0]: ping pong ping pong ping pong [1]: b [2]: "), t),
        6: F.concat(F.lit("[0]: tra la lo, tra la lo, tra la lo, tra la lo, [1]: b [2]: "), t),
        7: F.concat(F.lit("[0]: "), F.repeat(F.lit("ab"), 400), F.lit(" [1]: b [2]: a")),
        8: F.concat(F.lit("[0]: "), t, F.lit(" [1]: "), t, F.lit(" [2]: "), t),
    }
    output = F.concat(F.lit("[0]: "), t, F.lit(" [1]: b [2]: c"))
    for k, form in said.items():
        output = F.when(kind == k, form).otherwise(output)
    replies = X.replies(spark, sf).select(*BATCH, output.alias("output"))
    parsed = replies.withColumn("cells", F.when(kind == 2, F.array(F.struct(F.lit(3).cast("bigint").alias("idx"), t.alias("text")))).otherwise(P.parse_cells("output", F.lit(3))))
    return parsed.select(*BATCH, F.coalesce(Q.reply_problem("output", "cells", F.lit(3)), F.lit("good")).alias("reason"))


@query("full_pages", """SELECT CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id, page_id % 10 AS page_idx, true AS success,
    'data:image/jpeg;base64,' || to_base64(encode(html)) AS data_url FROM pages""")
def full_pages(spark, sf):
    return page_results(spark, sf)


def page_results(spark, sf):
    pages = X.table(spark, sf, "pages").selectExpr(
        "CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id", "page_id % 10 AS page_idx", "CAST(html AS BINARY) AS content"
    )
    return assemble.full_page_results(pages)


@query("saved_tabs", """SELECT CASE WHEN page_id % 2 = 0 THEN 'before' ELSE 'after' END AS stage,
    coalesce(nullif(left(trim(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_'), 50), ''), 'untitled') AS tab_title,
    page_id, length(html) AS size FROM pages""")
def saved_tabs(spark, sf):
    pages = X.table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 2 == 0, "before").otherwise("after").alias("stage"), F.col("url").alias("tab_title"),
        "page_id", F.length("html").cast("bigint").alias("size"),
    )
    folder = shared_dir(spark, "tabs")
    assemble.save_pages(pages, folder)
    return spark.read.schema("page_id bigint, size bigint, stage string, tab_title string").parquet(folder)


@query("char_boxes", sql("""SELECT doc_id, src_page, line_no, char_no, CAST(trunc(x - gx1 + bx1 - pad_l + 3 + 7 * char_no) AS BIGINT) AS left,
    CAST(trunc(y - gy1 + by1 - pad_t + 5) AS BIGINT) AS top, CAST(trunc(x - gx1 + bx1 - pad_l + 9 + 7 * char_no) AS BIGINT) AS right, CAST(trunc(y - gy1 + by1 - pad_t + 16) AS BIGINT) AS bottom,
    substr(text, CAST(char_no + 1 AS BIGINT), 1) AS char FROM (SELECT *, unnest(range(length(text))) AS char_no FROM spatial)""", "spatial"))
def char_boxes(spark, sf):
    """Every character of every line that was mapped by place, in page coordinates."""
    from regionflow.plans.mapping_queries import spatial_matches

    def boxed(k):
        left = F.col("x") + 3 + 7 * k
        return F.struct(F.substring("text", k + 1, F.lit(1)).alias("char"), F.array(left, F.col("y") + 5, left + 6, F.col("y") + 16).alias("bbox"))

    # A box of another length than four is dropped.
    bad = F.array(F.struct(F.lit("?").alias("char"), F.array(F.col("x"), F.col("y")).alias("bbox")))
    chars = F.concat(F.transform(F.sequence(F.lit(0), F.length("text") - 1), boxed), bad)
    matched = spatial_matches(spark, sf, carry=["text", "x", "y"])
    moved = matched.withColumn("chars", chars).withColumn("moved", mapping.chars_to_page())
    sides = [F.col("c.bbox")[k].cast("bigint").alias(side) for k, side in enumerate(("left", "top", "right", "bottom"))]
    return moved.select("doc_id", "src_page", "line_no", F.posexplode("moved").alias("char_no", "c")).select("doc_id", "src_page", "line_no", "char_no", *sides, "c.char")


def counting_model():
    """Stand-in for a loaded model."""
    return lambda frame: frame.assign(answer=frame["text"] + "/" + frame["text"].str.len().astype(str))


@query("model_batches", sql("SELECT doc_id, seq, text || '/' || length(text) AS answer FROM ordered_jobs", "ordered_jobs"))
def model_batches(spark, sf):
    from regionflow.plans.text_queries import ordered_jobs

    jobs = batching.fixed_batches(ordered_jobs(spark, sf), 20).select("doc_id", "batch_idx", "seq", "text")
    answered = infer.run_batches(jobs, ["doc_id", "batch_idx"], "counting", counting_model, "doc_id bigint, batch_idx bigint, seq bigint, text string, answer string")
    return answered.select("doc_id", "seq", "answer")


def picky(word):
    """A backend that refuses texts with ``word`` in them."""
    def load():
        def model(frame):
            bad = frame["text"].str.contains(word, regex=False)
            return frame.assign(backend=word, error=bad.map({True: "no", False: None}).astype(object))

        return model

    return load


@query("model_fallbacks", sql("""SELECT doc_id, seq, CASE WHEN contains(text, 'the') THEN 'q' ELSE 'the' END AS backend,
    CASE WHEN contains(text, 'the') AND contains(text, 'q') THEN 'no' END AS error FROM ordered_jobs""", "ordered_jobs"))
def model_fallbacks(spark, sf):
    from regionflow.plans.text_queries import ordered_jobs

    jobs = ordered_jobs(spark, sf).select("doc_id", "seq", "text")
    backends = [("first", picky("the"), False), ("second", picky("q"), False)]
    answered = infer.with_fallbacks(jobs, backends, "doc_id bigint, seq bigint, text string, backend string, error string")
    return answered.select("doc_id", "seq", "backend", "error")


@query("ask_again", sql("""SELECT conv_id, block, least(conv_id % 6, 3) AS attempt, CASE WHEN conv_id % 6 > 3 THEN 'bad' END AS problem FROM blocks""", "blocks"))
def ask_again(spark, sf):
    """A stub that answers well at attempt ``conv_id % 6``; four attempts in all."""
    batches = X.replies(spark, sf).select(*BATCH)

    def ask(waiting):
        return waiting.withColumn("reply", F.when(F.col("attempt") >= F.col("conv_id") % 6, "good"))

    asked = infer.ask_until_good(batches, ask, F.when(F.col("reply").isNull(), "bad"), max_attempts=4)
    return asked.select(*BATCH, F.col("attempt").cast("bigint").alias("attempt"), "problem")
