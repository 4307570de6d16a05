"""The whole way from detections to nested, translated pages, with a stub for the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import parse as P
from regionflow.operators import assemble, batching, merge
from regionflow.plans import fixtures as X
from regionflow.plans.mapping_queries import mapped
from regionflow.plans.reference_sql import CTES, sql
from regionflow.plans.registry import query
from regionflow.plans.text_queries import flat_regions
from regionflow.session import by_key, cut_lineage

BATCH_SIZE = 20

# The tables of merged texts over again, made from mapped lines.
CTES["line_texts"] = """SELECT doc_id, page_idx, 1::BIGINT AS level, bubble_idx, line_no, text, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2
    FROM mapped WHERE outcome LIKE 'matched%'"""
CTES["line_collected"] = CTES["collected"].replace("FROM texts", "FROM line_texts")
CTES["line_ratio"] = CTES["ratio"].replace("FROM collected", "FROM line_collected")
CTES["line_merged"] = CTES["merged"].replace("FROM ratio", "FROM line_ratio")


@query("full_chain", sql(f"""SELECT doc_id, page_idx, count(*) AS regions, string_agg(bubble_idx || '|' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|' ||
    parts || '|' || original_text || '|' || coalesce(translated, '[MISSING]'), chr(10) ORDER BY bubble_idx) AS body
    FROM line_merged LEFT JOIN (SELECT doc_id, page_idx, bubble_idx, CASE WHEN seq % 7 = 3 THEN '' ELSE 'T:' || text END AS translated FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, bubble_idx) - 1 AS seq FROM (
    SELECT *, trim(merged, ' 　' || chr(10)) AS text FROM line_merged) WHERE text <> '')) USING (doc_id, page_idx, bubble_idx)
    GROUP BY doc_id, page_idx""", "mapped", "regions", "line_texts", "line_collected", "line_ratio", "line_merged"))
def full_chain(spark, sf):
    """Detections, numbered regions, grid cells, mapped lines, merged texts, jobs, batches,
    replies, parsed translations, pages. The stub answers ``[k]: T:text`` and leaves out
    every seventh text."""
    lines = mapped(spark, sf).filter("outcome LIKE 'matched%'")
    texts = cut_lineage(lines.select(
        "doc_id", "page_idx", F.lit(1).cast("bigint").alias("level"), "bubble_idx", "line_no", "text",
        *[F.get("bbox", F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    ))
    regions = cut_lineage(merge.merge_regions(texts, X.regions(spark, sf)))
    jobs = batching.job_order(merge.jobs_of(regions))
    batched = cut_lineage(batching.fixed_batches(jobs, BATCH_SIZE))
    answered = batched.filter("seq % 7 <> 3").withColumn("text", F.concat(F.lit("T:"), "text"))
    # The stub model: the prompt's own numbers with the translated texts.
    replies = batched.groupBy("doc_id", "batch_idx").agg(F.count(F.lit(1)).alias("expected")).join(
        by_key(batching.numbered_prompt(answered, "lines").withColumnRenamed("prompt_body", "output")), ["doc_id", "batch_idx"], "left"
    ).select("doc_id", "batch_idx", P.parse_translation("output", "expected").alias("translations"))
    translated = batching.join_by_position(batched, replies).withColumn(
        "level", F.when(F.col("is_l2"), 2).otherwise(1).cast("bigint")
    )
    nested = assemble.nest_pages(assemble.text_only_regions(assemble.with_translations(regions, translated)))
    return nested.select("doc_id", "page_idx", F.size("regions").alias("regions"), flat_regions(nested).alias("body"))
