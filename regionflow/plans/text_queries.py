"""Queries over texts, jobs, batches and translations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions import text as T
from regionflow.operators import assemble, batching, infer, merge, stats
from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.session import cut_lineage

JOB = ["doc_id", "page_idx", "bubble_idx"]


def stub_translation(text="text"):
    """Deterministic stand-in for a translator."""
    spot = F.pmod(F.col("page_idx") * 7 + F.col("bubble_idx"), F.lit(10))
    return (
        F.when(spot == 0, C.FAILED).when(spot == 1, C.NO_TEXT).when(spot == 2, "")
        .otherwise(F.concat(F.lit("T:"), F.col(text)))
    )


def ordered_jobs(spark, sf):
    return batching.job_order(X.jobs(spark, sf).filter("text <> ''"))


def translated_jobs(spark, sf):
    return ordered_jobs(spark, sf).withColumn("translated", stub_translation())


@query("script_filter", sql("""SELECT doc_id, line_no, meaning > 0 AND cjk::DOUBLE / meaning >= 0.2 AS keep, cjk > 0 AS any_cjk FROM (
    SELECT doc_id, line_no, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{ff66}-\\x{ff9f}]', '', 'g')) AS cjk,
    length(regexp_replace(text, '[^A-Za-z0-9\\x{80}-\\x{10ffff}]', '', 'g')) AS meaning FROM doc_lines)""", "doc_lines"))
def script_filter(spark, sf):
    return X.doc_lines(spark, sf).select(
        "doc_id", "line_no", T.should_translate("text").alias("keep"),
        T.contains_cjk("text").alias("any_cjk"),
    )


@query("slug", """SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_'), 50), ''), 'untitled') AS slug FROM pages""")
def slug(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.slug("url").alias("slug"))


@query("request_modes", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN dflt
    WHEN o_orderkey % 4 <> 0 AND lower(CASE o_orderkey % 4 WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' ELSE '1' END) IN ('true', '1', 'yes') THEN 'vlm'
    WHEN o_orderkey % 3 <> 0 AND (CASE o_orderkey % 3 WHEN 1 THEN 'Yes' ELSE '0' END) = 'Yes' THEN 'local'
    WHEN dflt = 'gemini' THEN 'gemini' ELSE 'api' END AS mode,
    CASE WHEN kind NOT IN ('full_page', 'speech_image_only', 'text_only') THEN concat('Invalid output_type: ', kind,
    '. Must be one of: full_page, speech_image_only, text_only') END AS error FROM (SELECT *,
    CASE o_custkey % 4 WHEN 0 THEN 'vlm' WHEN 1 THEN 'local' WHEN 2 THEN 'gemini' ELSE 'api' END AS dflt,
    CASE o_custkey % 5 WHEN 0 THEN 'text_only' WHEN 1 THEN 'pdf' ELSE 'full_page' END AS kind FROM orders)""")
def request_modes(spark, sf):
    requests = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 4 WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' WHEN 3 THEN '1' END AS ocr_translate",
        "CASE o_orderkey % 3 WHEN 1 THEN 'Yes' WHEN 2 THEN '0' END AS translate_local",
        "CASE o_custkey % 4 WHEN 0 THEN 'vlm' WHEN 1 THEN 'local' WHEN 2 THEN 'gemini' ELSE 'api' END AS dflt",
        "CASE o_custkey % 5 WHEN 0 THEN 'text_only' WHEN 1 THEN 'pdf' ELSE 'full_page' END AS kind",
    )
    return requests.select(
        "o_orderkey", T.translate_mode("ocr_translate", "translate_local", "dflt").alias("mode"),
        T.output_type_error("kind").alias("error"),
    )


@query("error_classes", """SELECT event_id, CASE WHEN p IN ('429', '502', '503') OR event_type = 'error' AND p = '408' THEN true ELSE false END AS retryable,
    p = '503' AS overload, p = '429' OR event_type = 'purchase' AS limited,
    concat('key', CAST(event_id % 3 AS STRING)) AS key_name FROM (
    SELECT *, CAST(400 + user_id % 4 * 34 + CAST(floor(event_id / 7) AS BIGINT) % 2 AS STRING) AS p0,
    CASE event_id % 5 WHEN 0 THEN '429' WHEN 1 THEN '502' WHEN 2 THEN '503' WHEN 3 THEN '408' ELSE '400' END AS p FROM events)""")
def error_classes(spark, sf):
    calls = X.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat('code ', CASE event_id % 5 WHEN 0 THEN '429' WHEN 1 THEN '502' WHEN 2 THEN '503' WHEN 3 THEN '408' ELSE '400' END,"
        " CASE event_type WHEN 'error' THEN CASE WHEN event_id % 5 = 3 THEN ' Timeout' ELSE '' END"
        " WHEN 'purchase' THEN ' Quota used' ELSE '' END) AS message",
    )
    return calls.select(
        "event_id", T.is_retryable("message").alias("retryable"),
        T.is_overload("message").alias("overload"), T.is_limited("message").alias("limited"),
        T.rotate_key(F.lit(" key0, key1,, key2 "), "event_id").alias("key_name"),
    )


# A request is what a user does within 500 events; its attempts are these events, in order.
@query("attempt_schedule", """SELECT event_id, attempt, CASE WHEN attempt > 0 THEN power(2, attempt)::DOUBLE ELSE 0 END AS wait_s,
    round(least(0.85::DOUBLE, 0.7::DOUBLE + attempt * 0.05::DOUBLE), 6) AS temperature,
    CASE WHEN coalesce(sum((event_type = 'error')::INT) OVER w, 0) >= 2 OR coalesce(sum((event_type = 'click')::INT) OVER w, 0) >= 1 THEN 'fallback' ELSE 'main' END AS model_used
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) - 1 AS attempt FROM (SELECT *, floor(event_id / 500) AS part FROM events))
    WINDOW w AS (PARTITION BY user_id, part ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def attempt_schedule(spark, sf):
    calls = X.table(spark, sf, "events").selectExpr(
        "event_id", "struct(user_id, floor(event_id / 500) AS part) AS request", "'main' AS model",
        "CASE event_type WHEN 'error' THEN '503 overloaded' WHEN 'click' THEN '429' ELSE 'bad' END AS error",
    )
    order = Window.partitionBy("request").orderBy("event_id")
    calls = calls.withColumn("attempt", (F.row_number().over(order) - 1).cast("bigint"))
    return infer.attempt_schedule(calls).select(
        "event_id", "attempt", "wait_s", F.round("temperature", 6).alias("temperature"), "model_used"
    )


@query("language_names", """SELECT custkey, coalesce(name, concat(upper(left(code, 1)), lower(substr(code, 2)))) AS language FROM (
    SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-TW' WHEN 2 THEN 'sWe' WHEN 3 THEN 'id' ELSE 'kk' END AS code FROM customer)
    LEFT JOIN (VALUES ('en', 'English'), ('zh-TW', 'Chinese (Traditional)'), ('id', 'Indonesian')) v(c, name) ON code = c""")
def language_names(spark, sf):
    from regionflow.sources.languages import with_language_name

    codes = X.table(spark, sf, "customer").selectExpr(
        "c_custkey AS custkey",
        "CASE c_custkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-TW' WHEN 2 THEN 'sWe' WHEN 3 THEN 'id' ELSE 'kk' END AS code",
    )
    return with_language_name(codes, "code").select("custkey", "language")


def merged(spark, sf):
    return merge.merge_regions(X.texts(spark, sf), X.regions(spark, sf))


@query("merge_texts", sql("""SELECT doc_id, page_idx, level, bubble_idx, n, original_text, merged FROM merged""", "merged"))
def merge_texts(spark, sf):
    return merged(spark, sf).select(
        "doc_id", "page_idx", "level", "bubble_idx", F.size("items").alias("n"), "original_text", "merged"
    )


@query("restore_regions", sql("""SELECT doc_id, page_idx, bubble_idx FROM regions WHERE level = 2
    EXCEPT SELECT doc_id, page_idx, bubble_idx FROM merged WHERE level = 2""", "merged", "regions"))
def restore_regions(spark, sf):
    return merge.regions_to_restore(X.regions(spark, sf), merged(spark, sf)).select(*JOB)


@query("region_jobs", sql("""SELECT doc_id, page_idx, bubble_idx, is_l2, text, row_number() OVER (PARTITION BY doc_id
    ORDER BY is_l2, page_idx, bubble_idx) - 1 AS seq FROM (SELECT *, level = 2 AS is_l2,
    trim(merged, ' 　' || chr(10)) AS text FROM merged) WHERE text <> ''""", "merged"))
def region_jobs(spark, sf):
    return batching.job_order(merge.jobs_of(merged(spark, sf))).select(*JOB, "is_l2", "text", "seq")


@query("job_order", sql("SELECT doc_id, page_idx, bubble_idx, is_l2, seq FROM ordered_jobs", "ordered_jobs"))
def job_order(spark, sf):
    return ordered_jobs(spark, sf).select(*JOB, "is_l2", "seq")


@query("translation_batches", sql("""SELECT doc_id, CAST(floor(seq / 20) AS BIGINT) AS batch_idx, count(*) AS n,
    string_agg('[' || (seq % 20 + 1) || ']: ' || text, chr(10) ORDER BY seq) AS prompt_body FROM ordered_jobs GROUP BY ALL""", "ordered_jobs"))
def translation_batches(spark, sf):
    return batching.numbered_prompt(batching.fixed_batches(ordered_jobs(spark, sf), 20), "lines")


@query("prompt_json", sql("""SELECT doc_id, CAST(floor(seq / 33) AS BIGINT) AS batch_idx, count(*) AS n,
    CAST(to_json(list((seq % 33 + 1) || '. ' || text ORDER BY seq)) AS VARCHAR) AS prompt_body FROM ordered_jobs GROUP BY ALL""", "ordered_jobs"))
def prompt_json(spark, sf):
    return batching.numbered_prompt(batching.fixed_batches(ordered_jobs(spark, sf), 33), "list")


@query("prompt_text", sql("""SELECT conv_id, block, CASE WHEN expected = 1 THEN 'Read the text of the picture. Answer with the text only.'
    ELSE concat('The grid holds ', expected, ' cells. Read every cell. Answer with ', expected, ' entries, [0] to [', expected - 1, '].') END AS prompt FROM blocks""", "blocks"))
def prompt_text(spark, sf):
    from regionflow.functions.prompts import grid_prompt

    return X.replies(spark, sf).select(
        "conv_id", "block", grid_prompt("expected", F.lit(False), F.lit("English")).alias("prompt")
    )


@query("prompt_grid_json", sql("""SELECT conv_id, block, 'Read every cell' || CASE WHEN conv_id % 2 = 1 THEN ' and translate it to French' ELSE '' END || '. Answer with JSON only: '
    || CASE WHEN expected = 1 THEN '{"text": "..."}' ELSE '{"bubbles": [{"id": 0, "text": "..."}, ...]} with ids 0 to ' || (expected - 1) END AS prompt FROM blocks""", "blocks"))
def prompt_grid_json(spark, sf):
    from regionflow.functions.prompts import json_grid_prompt

    return X.replies(spark, sf).select("conv_id", "block", json_grid_prompt("expected", F.col("conv_id") % 2 == 1, F.lit("French")).alias("prompt"))


@query("prompt_translation", sql("""SELECT conv_id, block, CASE WHEN conv_id % 3 = 0 THEN '翻译成' || CASE WHEN conv_id % 2 = 0 THEN '法语' ELSE '德语' END || '，保留[N]:编号：'
    ELSE 'Translate to ' || CASE WHEN conv_id % 2 = 0 THEN 'French' ELSE 'German' END || ', keep the [N]: numbers:' END || chr(10) || chr(10)
    || string_agg('[' || (idx + 1) || ']: ' || text, chr(10) ORDER BY idx) AS prompt FROM turns GROUP BY conv_id, block""", "turns"))
def prompt_translation(spark, sf):
    from regionflow.functions.prompts import translation_prompt

    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: F.concat(F.lit("["), (t["idx"] + 1).cast("string"), F.lit("]: "), t["text"]))
    bodies = X.turns(spark, sf).groupBy("conv_id", "block").agg(F.array_join(lines, "\n").alias("body"))
    french = F.col("conv_id") % 2 == 0
    prompt = translation_prompt("body", F.when(french, "French").otherwise("German"), F.when(french, "法语").otherwise("德语"), F.col("conv_id") % 3 == 0)
    return bodies.select("conv_id", "block", prompt.alias("prompt"))


# Every third text has lost its cell number, which counts as 0.
@query("ordered_lines", sql("""SELECT conv_id AS doc_id, block + 1 AS batch_no, line_no, row_number() OVER (PARTITION BY conv_id
    ORDER BY block, coalesce(cell_idx, 0), line_no) - 1 AS place FROM (SELECT *, idx AS line_no, CASE WHEN (conv_id + turn) % 3 > 0 THEN 3 - idx END AS cell_idx FROM turns)""", "turns"))
def ordered_lines(spark, sf):
    lines = X.turns(spark, sf).selectExpr("conv_id AS doc_id", "block AS batch_idx", "idx AS line_no", "CASE WHEN (conv_id + turn) % 3 > 0 THEN 3 - idx END AS cell_idx")
    return batching.ordered_lines(lines).select("doc_id", "batch_no", "line_no", "place")


# Names as a folder of pictures may hold them: some twice, some left over from debugging.
@query("input_files", """SELECT path, number, row_number() OVER (ORDER BY number, path) - 1 AS place FROM (
    SELECT DISTINCT path, coalesce(try_cast(regexp_replace(name, '[^0-9]', '', 'g') AS BIGINT), 0) AS number FROM (
    SELECT path, lower(string_split(path, '/')[-1]) AS name FROM (SELECT 'in/' || CASE page_id % 7 WHEN 0 THEN 'Debug_' WHEN 1 THEN 'x_compare' WHEN 2 THEN 'cover' ELSE 'page_' END
    || CASE WHEN page_id % 7 = 2 THEN chr(CAST(97 + page_id % 26 AS INTEGER)) ELSE CAST(page_id // 2 AS VARCHAR) END || '.jpg' AS path FROM pages)) WHERE NOT regexp_matches(name, 'viz|debug|detected|fixed|compare|test'))""")
def input_files(spark, sf):
    from regionflow.operators.ordering import number_sorted
    from regionflow.sources.files import input_names

    paths = X.table(spark, sf, "pages").selectExpr(
        "concat('in/', CASE page_id % 7 WHEN 0 THEN 'Debug_' WHEN 1 THEN 'x_compare' WHEN 2 THEN 'cover' ELSE 'page_' END,"
        " CASE WHEN page_id % 7 = 2 THEN chr(97 + page_id % 26) ELSE CAST(floor(page_id / 2) AS STRING) END, '.jpg') AS path"
    )
    return number_sorted(input_names(paths), [F.col("number"), F.col("path")], "place").select("path", "number", "place")


def cut_reply(spark, sf, size):
    """Batches answered by the stub, each reply losing its last three texts."""
    batched = batching.fixed_batches(ordered_jobs(spark, sf), size)
    entry = F.struct("batch_pos", stub_translation().alias("t"))
    all_of = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.getField("t"))
    replies = batched.groupBy("doc_id", "batch_idx").agg(all_of.alias("all")).select(
        "doc_id", "batch_idx",
        F.slice("all", F.lit(1), F.greatest(F.lit(0), F.size("all") - 3)).alias("translations"),
    )
    return batched, replies


@query("positional_join", sql("""SELECT doc_id, page_idx, bubble_idx, CASE WHEN row_number() OVER (PARTITION BY doc_id, b ORDER BY seq DESC) <= 3
    THEN '[MISSING]' ELSE translated END AS translated FROM (SELECT *, floor(seq / 20) AS b FROM stubbed)""", "stubbed"))
def positional_join(spark, sf):
    batched, replies = cut_reply(spark, sf, 20)
    return batching.join_by_position(batched, replies).select(*JOB, "translated")


@query("zip_nonempty", sql("""SELECT doc_id, global_idx, batch_idx, CASE WHEN text = '' THEN '' WHEN n - text_idx <= 2 THEN '[MISSING]'
    ELSE 'T:' || text END AS translated FROM (SELECT *, count(*) FILTER (text <> '') OVER (PARTITION BY doc_id, batch_idx) AS n FROM cut)""", "cut"))
def zip_nonempty(spark, sf):
    infos = cut_lineage(batching.text_cut_batches(X.region_infos(spark, sf)))
    texts = infos.filter("text <> ''").groupBy("doc_id", "batch_idx").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("text_idx", "text"))),
            lambda s: F.concat(F.lit("T:"), s.getField("text")),
        ).alias("all")
    )
    replies = texts.select(
        "doc_id", "batch_idx",
        F.slice("all", F.lit(1), F.greatest(F.lit(0), F.size("all") - 2)).alias("translations"),
    )
    return batching.zip_texts(infos, replies).select("doc_id", "global_idx", "batch_idx", "translated")


@query("text_cut_batches", sql("SELECT doc_id, global_idx, batch_idx, text_idx FROM cut", "cut"))
def text_cut_batches(spark, sf):
    return batching.text_cut_batches(X.region_infos(spark, sf)).select(
        "doc_id", "global_idx", "batch_idx", "text_idx"
    )


@query("batch_ranges", sql("""SELECT doc_id, batch_idx, min(global_idx) AS first_idx, max(global_idx) AS last_idx, count(*) AS n
    FROM cut GROUP BY ALL""", "cut"))
def batch_ranges(spark, sf):
    return batching.batch_ranges(batching.text_cut_batches(X.region_infos(spark, sf)))


OUTCOME = {
    "a": "count(*) FILTER (translated NOT IN ('[TRANSLATION FAILED]', '[NO TEXT]')) AS success, "
         "count(*) FILTER (translated IN ('[TRANSLATION FAILED]', '[NO TEXT]')) AS failed",
    "b": "count(*) FILTER (translated <> '' AND translated NOT LIKE '[%') AS success, "
         "count(*) FILTER (translated = '' OR translated LIKE '[%') AS failed, "
         "count(*) FILTER (translated = '[NO TEXT]') AS no_text, "
         "count(*) FILTER (translated = '[TRANSLATION FAILED]') AS marked_failed, count(*) FILTER (translated = '') AS empty",
    "c": "count(*) FILTER (trim(translated) <> '') AS success, count(*) FILTER (trim(translated) = '') AS failed",
}


def _outcome(kind):
    def build(spark, sf):
        return batching.outcome_counts(translated_jobs(spark, sf), kind, ["doc_id"])

    query(f"outcome_{kind}", sql(f"SELECT doc_id, {OUTCOME[kind]} FROM stubbed GROUP BY doc_id", "stubbed"))(build)


for _kind in OUTCOME:
    _outcome(_kind)


@query("failed_retry", sql("""SELECT doc_id, seq, CASE WHEN translated = '[TRANSLATION FAILED]' AND share <= 0.1 AND again % 20 < 15
    THEN 'R:' || text ELSE translated END AS translated, CASE WHEN translated = '[TRANSLATION FAILED]' AND share <= 0.1
    THEN CAST(floor(again / 20) AS BIGINT) END AS retry_batch FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, translated ORDER BY seq) - 1 AS again,
    count(*) FILTER (translated = '[TRANSLATION FAILED]') OVER (PARTITION BY doc_id) / count(*) OVER (PARTITION BY doc_id)::DOUBLE AS share FROM stubbed)""", "stubbed"))
def failed_retry(spark, sf):
    done = cut_lineage(translated_jobs(spark, sf))
    plan = cut_lineage(batching.retry_plan(done, max_share=0.1))
    answers = plan.withColumn(
        "retried", F.when(F.col("batch_pos") < 15, F.concat(F.lit("R:"), "text")).otherwise(C.FAILED)
    )
    batch = plan.select("doc_id", "seq", F.col("batch_idx").alias("retry_batch"))
    return batching.overlay_retries(done, answers).join(batch, ["doc_id", "seq"], "left").select(
        "doc_id", "seq", "translated", "retry_batch"
    )


@query("translate_routes", sql("""SELECT doc_id, page_idx, bubble_idx, CASE page_idx % 4 WHEN 0 THEN text WHEN 1 THEN '[LOCAL_TRANSLATE_UNAVAILABLE]'
    WHEN 2 THEN 'gemini:' || text ELSE 'api:' || text END AS translated FROM ordered_jobs""", "ordered_jobs"))
def translate_routes(spark, sf):
    routed = ordered_jobs(spark, sf).withColumn(
        "route",
        infer.route(
            F.col("page_idx") % 4 == 0, F.col("page_idx") % 4 == 1, False,
            F.when(F.col("page_idx") % 4 == 2, "gemini").otherwise("api"),
        ),
    )

    def ask(jobs):
        return jobs.withColumn("translated", F.concat("route", F.lit(":"), "text"))

    return infer.apply_route(routed, ask).select(*JOB, "translated")


@query("text_only_output", sql("""SELECT doc_id, page_idx, count(*) AS regions, string_agg(bubble_idx || '|' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|' || parts || '|' ||
    original_text || '|' || CASE WHEN bubble_idx = 2 THEN '[MISSING]' ELSE 'T:' || merged END, chr(10) ORDER BY bubble_idx) AS body
    FROM merged WHERE level = 1 GROUP BY ALL""", "merged"))
def text_only_output(spark, sf):
    nested = assemble.nest_pages(_text_rows(spark, sf))
    return nested.select("doc_id", "page_idx", F.size("regions").alias("regions"), flat_regions(nested).alias("body"))


def _text_rows(spark, sf):
    regions = cut_lineage(merged(spark, sf))
    answers = regions.filter("bubble_idx <> 2").select(
        "doc_id", "page_idx", "level", "bubble_idx", F.concat(F.lit("T:"), "merged").alias("translated")
    )
    return assemble.text_only_regions(assemble.with_translations(regions, answers))


def flat_regions(nested):
    """Regions of a page as lines of text, for comparison."""
    fields = nested.schema["regions"].dataType.elementType.names

    def items(r):
        return F.array_join(F.transform(
            r.getField("original_texts"),
            lambda i: F.concat(i.getField("text"), F.lit("@"), F.array_join(i.getField("bbox").cast("array<string>"), ",")),
        ), ";")

    def line(r):
        flags = [r.getField(f).cast("string") for f in ("is_text_free", "inpainted") if f in fields]
        return F.concat_ws(
            "|", r.getField("bubble_idx").cast("string"),
            F.array_join(r.getField("bubble_box").cast("array<string>"), ","),
            items(r), r.getField("original_text"), r.getField("translated_text"), *flags,
        )

    return F.array_join(F.transform("regions", line), "\n")


@query("text_only_legacy", sql("""SELECT doc_id, page_idx, count(*) AS regions,
    string_agg(body, chr(10) ORDER BY lv, bubble_idx) AS body FROM (
    SELECT doc_id, page_idx, bubble_idx, 1 AS lv, bubble_idx || '|' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|' || parts || '|' || original_text || '|' ||
    CASE WHEN bubble_idx = 2 THEN '[MISSING]' ELSE 'T:' || merged END AS body FROM merged WHERE level = 1
    UNION ALL SELECT doc_id, page_idx, bubble_idx, 2, bubble_idx || '|' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|true|false' FROM regions WHERE level = 2)
    GROUP BY ALL""", "merged", "regions"))
def text_only_legacy(spark, sf):
    free = assemble.text_free_regions(X.regions(spark, sf))
    nested = assemble.nest_pages(assemble.legacy_rows(_text_rows(spark, sf), free))
    return nested.select("doc_id", "page_idx", F.size("regions").alias("regions"), flat_regions(nested).alias("body"))


@query("run_stats", sql("""SELECT p.doc_id, pages, coalesce(bubbles_detected, 0) AS bubbles_detected, coalesce(text_free_regions, 0) AS text_free_regions,
    coalesce(ocr_lines, 0) AS ocr_lines, coalesce(texts_to_translate, 0) AS texts_to_translate, coalesce(texts_l1, 0) AS texts_l1,
    coalesce(texts_l2, 0) AS texts_l2, coalesce(CAST(ceil(texts_to_translate / 100.0) AS BIGINT), 0) AS translation_batches FROM (
    SELECT doc_id, count(*) AS pages FROM page_dim GROUP BY 1) p LEFT JOIN (SELECT doc_id, count(*) FILTER (level = 1) AS bubbles_detected,
    count(*) FILTER (level = 2) AS text_free_regions FROM regions GROUP BY 1) r USING (doc_id) LEFT JOIN (
    SELECT doc_id, count(*) AS ocr_lines FROM lines GROUP BY 1) l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS texts_to_translate,
    count(*) FILTER (NOT is_l2) AS texts_l1, count(*) FILTER (is_l2) AS texts_l2 FROM jobs WHERE text <> '' GROUP BY 1) j USING (doc_id)""",
    "page_dim", "regions", "lines", "jobs"))
def run_stats(spark, sf):
    from regionflow.operators.detect import keep_detections

    kept = keep_detections(X.det(spark, sf)).filter("label IN (1, 2)").withColumnRenamed("label", "level")
    return stats.run_stats(
        X.page_dim(spark, sf), kept, X.lines(spark, sf), X.jobs(spark, sf).filter("text <> ''"),
        C.TRANSLATION_BATCH,
    )


@query("response_envelope", sql("""SELECT doc_id, 'success' AS status, 'text_only' AS output_type, count(DISTINCT page_idx) AS page_count, count(*) AS bubble_count,
    concat('{"ocr_lines":', CAST(sum(n) AS BIGINT), ',"text_chars":', CAST(sum(length(original_text)) AS BIGINT), '}') AS stats
    FROM merged WHERE level = 1 GROUP BY doc_id""", "merged"))
def response_envelope(spark, sf):
    rows = cut_lineage(_text_rows(spark, sf))
    totals = rows.groupBy("doc_id").agg(
        F.sum(F.size("original_texts")).alias("ocr_lines"), F.sum(F.length("original_text")).alias("text_chars")
    )
    return assemble.response_envelope(assemble.nest_pages(rows), "text_only", totals)


@query("stage_timings", """SELECT CASE WHEN grouping(event_type) = 1 THEN 'total' ELSE event_type END AS stage, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms
    FROM events GROUP BY ROLLUP (event_type)""")
def stage_timings(spark, sf):
    return stats.stage_timings(
        X.table(spark, sf, "events").selectExpr("event_type AS stage", "floor(value) AS time_ms")
    )


@query("call_stats", """SELECT user_id, count(v) AS calls, coalesce(CAST(sum(v) AS BIGINT), 0) AS total_ms,
    coalesce(sum(v) / nullif(count(v), 0)::DOUBLE, 0) AS avg_ms FROM (SELECT user_id, CASE WHEN event_type = 'view'
    THEN CAST(floor(value) AS BIGINT) END AS v FROM events) GROUP BY user_id""")
def call_stats(spark, sf):
    calls = X.table(spark, sf, "events").selectExpr(
        "user_id", "CASE WHEN event_type = 'view' THEN floor(value) END AS time_ms"
    )
    return stats.call_stats(calls, ["user_id"])


@query("backend_comparison", """SELECT event_type AS model, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS time_ms,
    CAST(sum(user_id % 7) AS BIGINT) AS line_count, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status FROM events GROUP BY event_type""")
def backend_comparison(spark, sf):
    runs = X.table(spark, sf, "events").selectExpr(
        "event_type AS model", "floor(value) AS time_ms", "user_id % 7 AS line_count",
        "CASE WHEN event_type = 'error' THEN 'down' END AS error",
    )
    return stats.backend_comparison(runs)
