"""Queries that run the streaming form to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.session import cut_lineage, shared_dir
from regionflow.streaming import chunks, regions


def cores(spark) -> int:
    """Tasks at one time, for the files and the state partitions of a finite stream."""
    return max(8, spark.sparkContext.defaultParallelism)


def source_files(spark, sf):
    """Stream input: every region with its number, and an end marker per document; the
    source of every eleventh document breaks off there."""
    infos = cut_lineage(X.region_infos(spark, sf))
    rows = infos.selectExpr(
        "doc_id", "global_idx", "CAST(floor(global_idx / 10) AS BIGINT) AS page_idx",
        "global_idx % 10 AS bubble_idx", "text", "event_id % 97 = 5 AS ocr_error", "false AS is_end",
    )
    ends = infos.groupBy("doc_id").agg((F.max("global_idx") + 1).alias("global_idx")).selectExpr(
        "doc_id", "global_idx", "-1L AS page_idx", "-1L AS bubble_idx", "'' AS text",
        "doc_id % 11 = 3 AS ocr_error", "true AS is_end",
    )
    path = shared_dir(spark, "regions")
    rows.unionByName(ends).repartition(cores(spark)).write.parquet(path)
    return path


def stub_replies(batches):
    """Answers every text; the batch that holds a text ending in 333 is down, one with a
    text ending in 7 loses its last answer."""
    answers = F.transform("texts", lambda t: F.concat(F.lit("T:"), t))
    short = F.exists("texts", lambda t: t.endswith("7"))
    return batches.select(
        "doc_id", "batch_idx",
        F.when(short, F.slice(answers, F.lit(1), F.size("texts") - 1)).otherwise(answers).alias("translations"),
        F.when(F.exists("texts", lambda t: t.endswith("333")), F.lit("503")).alias("error"),
    )


@query("stream_regions", sql("""SELECT doc_id, global_idx, kind, original_text, translated_text, 'event: ' || kind || chr(10) || 'data: ' || CASE kind
    WHEN 'result' THEN to_json(struct_pack(global_idx := global_idx, page_idx := CAST(floor(global_idx / 10) AS BIGINT), bubble_idx := global_idx % 10,
    original_text := original_text, translated_text := translated_text))::VARCHAR WHEN 'error' THEN '{"error":"source failed"}'
    ELSE '{"stats":{"bubbles":' || global_idx || '}}' END || chr(10) || chr(10) AS event FROM (
    SELECT doc_id, global_idx, 'result' AS kind, text AS original_text, CASE WHEN bool_or(text LIKE '%333') OVER w
    THEN '[TRANSLATE_ERROR]' WHEN text = '' THEN '' WHEN bool_or(text LIKE '%7') OVER w AND global_idx = max(CASE WHEN text <> '' THEN global_idx END) OVER w
    THEN '[MISSING]' ELSE 'T:' || text END AS translated_text FROM (
    SELECT *, floor(coalesce(sum((text <> '')::INT) OVER (PARTITION BY doc_id ORDER BY global_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 25) AS b
    FROM infos WHERE event_id % 97 <> 5) WINDOW w AS (PARTITION BY doc_id, b)
    UNION ALL SELECT doc_id, global_idx, 'result', '[OCR_ERROR]', '[OCR_ERROR]' FROM infos WHERE event_id % 97 = 5
    UNION ALL SELECT doc_id, max(global_idx) + 1, CASE WHEN doc_id % 11 = 3 THEN 'error' ELSE 'complete' END,
    CASE WHEN doc_id % 11 = 3 THEN 'source failed' ELSE '' END, CASE WHEN doc_id % 11 = 3 THEN 'source failed' ELSE '' END
    FROM infos GROUP BY doc_id)""", "infos"))
def stream_regions(spark, sf):
    released = regions.run_region_stream(
        spark, source_files(spark, sf), shared_dir(spark, "stream"), stub_replies, state_partitions=cores(spark)
    )
    return regions.released_events(released).select("doc_id", "global_idx", "kind", "original_text", "translated_text", "event")


@query("stream_events", sql("""SELECT doc_id, 'start' AS kind, concat('event: start', chr(10), 'data: {"total_batches":', CAST(ceil(count(*) / 9.0) AS BIGINT),
    ',"total_bubbles":', count(*), ',"pages":', count(DISTINCT CAST(floor(global_idx / 10) AS BIGINT)), '}', chr(10), chr(10)) AS event FROM infos GROUP BY doc_id""", "infos"))
def stream_events(spark, sf):
    rows = X.region_infos(spark, sf).selectExpr("doc_id", "CAST(floor(global_idx / 10) AS BIGINT) AS page_idx")
    return regions.start_events(rows).select("doc_id", "kind", "event")


@query("stream_plan", sql("""SELECT doc_id, global_idx, page_idx, bubble_idx, text, false AS is_end FROM (
    SELECT doc_id, page_idx, bubble_idx, original_text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, bubble_idx) - 1 AS global_idx
    FROM merged WHERE level = 1) UNION ALL SELECT doc_id, count(*), -1, -1, '', true FROM merged WHERE level = 1 GROUP BY doc_id""", "merged"))
def stream_plan(spark, sf):
    from regionflow.plans.text_queries import merged

    return regions.stream_plan(cut_lineage(merged(spark, sf))).select("doc_id", "global_idx", "page_idx", "bubble_idx", "text", "is_end")


# Translations of whole conversations, numbered by line; some loop, some are left in kana.
@query("early_translation", sql("""SELECT reply_id, chunk_no, reason FROM (SELECT reply_id, chunk_no, coalesce(
    CASE WHEN numbered > 2 * expected THEN 'too_many_lines:' || numbered END,
    CASE WHEN length(p) > 200 AND n_lines >= 4 AND looped IS NOT NULL THEN 'repetition:' || len(list_filter(lines, lambda x: x = looped)) || 'x' END,
    CASE WHEN length(p) > 150 AND cjk > length(p) * 0.5 THEN 'still_cjk:' || cjk || '/' || length(p) END) AS reason FROM (
    SELECT *, list_filter(lines, lambda x: length(x) > 5 AND len(list_filter(lines, lambda y: y = x)) >= 3)[1] AS looped FROM (
    SELECT *, every[-8:] AS lines, len(every) AS n_lines FROM (
    SELECT *, len(regexp_extract_all(p, '(?m)^[0-9]+[.)]')) AS numbered, len(regexp_extract_all(p, '[\\x{3040}-\\x{30ff}]')) AS cjk,
    list_filter(list_transform(string_split(p, chr(10)), lambda t: trim(t)), lambda t: t <> '') AS every FROM (
    SELECT *, substr(output, 1, CAST((chunk_no + 1) * 40 AS BIGINT)) AS p FROM (
    SELECT *, unnest(range(CAST(ceil(length(output) / 40.0) AS BIGINT))) AS chunk_no FROM (
    SELECT conv_id * 1000 + block AS reply_id, CASE WHEN conv_id % 5 = 3 THEN translate(said, 'aeioust', 'アエイオウスト') ELSE said END
    || CASE conv_id % 5 WHEN 1 THEN repeat(chr(10) || '1. again', 9) WHEN 2 THEN repeat(chr(10) || 'the same line over and over', 4) ELSE '' END AS output, expected
    FROM (SELECT conv_id, block, string_agg((idx + 1) || '. ' || text, chr(10) ORDER BY idx) AS said, max(idx) + 1 AS expected FROM turns GROUP BY ALL))))))))
    WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY chunk_no) = 1""", "turns"))
def early_translation(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: F.concat((t["idx"] + 1).cast("string"), F.lit(". "), t["text"]))
    said = X.turns(spark, sf).groupBy("conv_id", "block").agg(F.array_join(lines, "\n").alias("said"), (F.max("idx") + 1).alias("expected"))
    replies = said.selectExpr(
        "conv_id * 1000 + block AS reply_id",
        "concat(CASE WHEN conv_id % 5 = 3 THEN translate(said, 'aeioust', 'アエイオウスト') ELSE said END, CASE conv_id % 5"
        " WHEN 1 THEN repeat('\n1. again', 9) WHEN 2 THEN repeat('\nthe same line over and over', 4) ELSE '' END) AS output", "expected",
    )
    return chunks.first_abort(replies, 40, chunks.translations("English"))


# Each prefix is judged anew here; the operator reads each reply once.
@query("early_abort", sql("""SELECT reply_id, chunk_no, reason FROM (SELECT *, coalesce(
    'index_overflow:' || list_filter(seen, lambda i: i >= expected)[1] || '_vs_' || expected,
    CASE WHEN len(list_distinct(seen)) > 2 * expected THEN 'too_many_indices:' || len(list_distinct(seen)) END,
    CASE WHEN n_bodies >= 4 THEN 'repetition:' || len(list_filter(bodies, lambda x: x = looped)) || 'x' || chr(39) || left(looped, 20) || chr(39) END,
    CASE WHEN length(p) > 100 AND len(tail) >= 10 AND len(list_filter(tail, lambda w: length(w) = 1)) >= 8 THEN 'single_char_spam' END) AS reason FROM (
    SELECT *, list_filter(bodies, lambda x: length(x) > 2 AND len(list_filter(bodies, lambda y: y = x)) >= 3)[1] AS looped FROM (
    SELECT *, every[-6:] AS bodies, len(every) AS n_bodies FROM (
    SELECT *, list_transform(regexp_extract_all(p, '\\[([0-9]+)\\]:', 1), lambda i: CAST(i AS BIGINT)) AS seen,
    list_transform(regexp_extract_all(p, '\\[[0-9]+\\]:\\s*([^\\[]+)', 1), lambda x: left(trim(x, ' ' || chr(10)), 50)) AS every,
    list_filter(regexp_split_to_array(right(p, 100), '\\s+'), lambda w: w <> '') AS tail FROM (
    SELECT *, substr(output, 1, CAST((chunk_no + 1) * 200 AS BIGINT)) AS p FROM (
    SELECT *, unnest(range(CAST(ceil(length(output) / 200.0) AS BIGINT))) AS chunk_no FROM (
    SELECT conv_id * 1000 + block AS reply_id, string_agg('[' || idx || ']: ' || text, chr(10) ORDER BY idx) FILTER (told)
    || CASE WHEN conv_id % 5 = 1 THEN repeat(' [1]: again', 5) WHEN conv_id % 5 = 2 THEN repeat(' x', 60) WHEN conv_id % 5 = 4 THEN ' [9]:' ELSE '' END AS output,
    greatest(1, max(idx) + 1 + CASE WHEN conv_id % 5 = 1 THEN 9 ELSE 0 END) AS expected FROM turns GROUP BY conv_id, block)))))))
    WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY chunk_no) = 1""", "turns"))
def early_abort(spark, sf):
    replies = X.replies(spark, sf).filter("output <> ''").selectExpr(
        "conv_id * 1000 + block AS reply_id",
        "concat(output, CASE conv_id % 5 WHEN 1 THEN repeat(' [1]: again', 5) WHEN 2 THEN repeat(' x', 60) WHEN 4 THEN ' [9]:' ELSE '' END) AS output",
        "greatest(1L, expected + CASE WHEN conv_id % 5 = 1 THEN 9 ELSE 0 END) AS expected",
    )
    return chunks.first_abort(replies, 200)
