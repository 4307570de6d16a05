"""Queries that parse and check model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionflow.functions import parse as P
from regionflow.functions import quality as Q
from regionflow.operators import batching
from regionflow.plans import fixtures as X
from regionflow.plans.reference_sql import sql
from regionflow.plans.registry import query
from regionflow.sources import replies as R
from regionflow.session import cut_lineage

BATCH = ["conv_id", "block"]


def parsed(spark, sf):
    return R.explode_cells(X.replies(spark, sf), P.parse_cells("output", "expected"), BATCH)


@query("parse_cells", sql("SELECT conv_id, block, idx, text FROM turns WHERE told", "turns"))
def parse_cells(spark, sf):
    return parsed(spark, sf)


@query("cells_in_sql", sql("SELECT conv_id, block, idx, text FROM turns WHERE told", "turns"))
def cells_in_sql(spark, sf):
    """The same by the table function, asked in SQL."""
    R.register_cells(spark)
    replies = X.replies(spark, sf).select(*BATCH, "expected", "output")
    return spark.sql("SELECT conv_id, block, c.idx, c.text FROM {replies}, LATERAL reply_cells(output, expected) c", replies=replies)


# A reply of one cell that cannot be read as JSON bubbles is kept raw.
@query("parse_json_reply", sql("""SELECT conv_id, block, idx, CASE WHEN conv_id % 9 = 0
    THEN replace(text, chr(10), '\\n') ELSE text END AS text FROM turns JOIN blocks USING (conv_id, block)
    WHERE told AND (conv_id % 9 <> 0 OR expected > 1) UNION ALL
    SELECT conv_id, block, 0, CASE WHEN conv_id % 9 <> 0 THEN '{"bubbles":[]}' WHEN NOT told THEN '{"bubbles":'
    ELSE concat('{"bubbles":[{"id":0,"text":"', replace(text, chr(10), '\\n'), '"') END
    FROM turns JOIN blocks USING (conv_id, block) WHERE expected = 1 AND (conv_id % 9 = 0 OR NOT told)""", "turns", "blocks"))
def parse_json_reply(spark, sf):
    return R.explode_cells(X.json_replies(spark, sf), P.parse_json_reply("output", "expected"), BATCH)


# One reply per turn, in each form the ladder knows: JSON text, the same cut short or
# behind a preamble in a fence, an empty text, numbered, and plain.
@query("single_reply", sql("""SELECT conv_id, block, idx AS cell, CASE idx WHEN 1 THEN replace(text, chr(10), '\\n') ELSE trim(text) END AS text
    FROM turns WHERE NOT (idx = 3 AND conv_id % 2 = 0)""", "turns"))
def single_reply(spark, sf):
    body = "to_json(named_struct('text', text))"
    replies = X.turns(spark, sf).selectExpr(
        "conv_id", "block", "idx AS cell",
        f"CASE idx WHEN 0 THEN {body} WHEN 1 THEN concat(substring({body}, 1, length({body}) - 1), ', \"x')"
        " WHEN 2 THEN concat(CASE conv_id % 4 WHEN 0 THEN 'Here\\'s the OCR result: ' WHEN 1 THEN 'OCR OUTPUT for you: ' WHEN 2 THEN 'Following your format, as asked: ' ELSE '' END,"
        f" '```json\n', {body}, '\n```')"
        " WHEN 3 THEN CASE conv_id % 2 WHEN 0 THEN '{\"text\": \"\"}' ELSE concat('[0]: ', text) END END AS output",
    )
    return R.explode_cells(replies, P.parse_json_reply("output", F.lit(1)), ["conv_id", "block", "cell"]).drop("idx")


@query("missing_cells", sql("""SELECT conv_id, block, idx FROM (SELECT conv_id, block, unnest(range(expected)) AS idx FROM blocks)
    EXCEPT SELECT conv_id, block, idx FROM turns WHERE told""", "turns", "blocks"))
def missing_cells(spark, sf):
    replies = X.replies(spark, sf)
    return batching.missing_cells(replies.select(*BATCH, "expected"), parsed(spark, sf), BATCH)


@query("retry_overlay", sql("""SELECT conv_id, block, idx, text, false AS retried FROM turns WHERE told UNION ALL
    SELECT conv_id, block, idx, 'R:' || idx AS text, true FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY idx) - 1 AS k
    FROM turns WHERE NOT told) WHERE k <> 1""", "turns"))
def retry_overlay(spark, sf):
    first = cut_lineage(parsed(spark, sf))
    asked = X.replies(spark, sf).select(*BATCH, "expected")
    slots = cut_lineage(batching.retry_slots(batching.missing_cells(asked, first, BATCH), BATCH))
    # The stub answers every retry slot but number 1, under the slot's own number.
    answers = slots.filter("retry_idx <> 1").select(
        *BATCH, F.col("retry_idx"), F.concat(F.lit("R:"), F.col("idx").cast("string")).alias("text")
    ).withColumnRenamed("retry_idx", "idx")
    return batching.retry_overlay(first, slots, answers, BATCH)


@query("global_cells", sql("""SELECT conv_id, block, idx, idx + off AS cell_idx FROM turns JOIN (SELECT conv_id, block,
    CAST(coalesce(sum(expected) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
    FROM blocks) USING (conv_id, block) WHERE told""", "turns", "blocks"))
def global_cells(spark, sf):
    from regionflow.operators.ordering import preceding_totals, radix_levels

    sizes = X.replies(spark, sf).select(*BATCH, "expected").withColumns(radix_levels("block", "__b", 1))
    offsets = preceding_totals(sizes, ["conv_id"], ["__b1", "block"], ["expected"]).select(
        *BATCH, F.col("expected_before").alias("batch_offset")
    )
    return batching.global_cells(parsed(spark, sf), offsets, BATCH).select(*BATCH, "idx", "cell_idx")


# Every third conversation answers in bare lines, which are read by place.
@query("parse_translation", sql("""SELECT conv_id, block, idx AS pos, CASE WHEN told THEN text ELSE '' END AS text FROM turns WHERE conv_id % 3 > 0
    UNION ALL SELECT conv_id, block, row_number() OVER (PARTITION BY conv_id, block ORDER BY NOT told, idx) - 1,
    CASE WHEN told THEN replace(text, chr(10), ' ') ELSE '' END FROM turns WHERE conv_id % 3 = 0""", "turns"))
def parse_translation(spark, sf):
    told = X.turns(spark, sf).groupBy(*BATCH).agg(
        (F.max("idx") + 1).alias("expected"),
        F.array_sort(F.collect_list(F.when(F.col("told"), F.struct("idx", "text")))).alias("told"),
    )
    replies = told.selectExpr(
        *BATCH, "expected",
        "CASE WHEN conv_id % 3 > 0 THEN array_join(transform(told, t -> concat('[', t.idx + 1, ']: ', t.text)), '\n')"
        " ELSE array_join(transform(told, t -> concat(t.idx + 1, '. ', replace(t.text, '\n', ' '))), '\n') END AS output",
    )
    return replies.select(*BATCH, F.posexplode(P.parse_translation("output", "expected")).alias("pos", "text"))


@query("pad_translations", sql("""SELECT conv_id, block, pos, CASE WHEN pos < len(l) THEN l[pos + 1] ELSE '[TRANSLATION FAILED]' END AS text,
    CASE WHEN len(l) < n THEN concat('partial (', len(l), '/', n, ')') ELSE 'success' END AS status FROM (
    SELECT *, unnest(range(n)) AS pos FROM (SELECT conv_id, block, 3 + conv_id % 3 AS n,
    list(text ORDER BY idx) FILTER (told) AS l FROM turns GROUP BY ALL HAVING count(*) FILTER (told) > 0))""", "turns"))
def pad_translations(spark, sf):
    told = X.turns(spark, sf).filter("told").groupBy(*BATCH).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s.getField("text")
        ).alias("l")
    ).selectExpr(
        *BATCH, "3 + conv_id % 3 AS n",
        "concat('Sure: ', to_json(named_struct('translated', l)), ' done') AS output",
    )
    read = told.withColumn("got", P.parse_translated_json("output"))
    return read.select(
        *BATCH, F.posexplode(P.pad_translations("got", "n")).alias("pos", "text"),
        P.reply_status("got", "n").alias("status"),
    )


TOLD = """told_text AS (SELECT conv_id, block, coalesce(string_agg('[' || idx || ']: ' || text, chr(10) ORDER BY idx)
    FILTER (told), '') AS out, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (NOT told) AS gaps FROM turns GROUP BY ALL)"""


# Words, parts and cells as lists; the first place of each kind of repetition names it.
REASONS = r"""CASE WHEN n_told = 0 THEN 'empty_output'
    WHEN expected > 1 AND n_told < expected THEN 'missing_indices:[' || gaps || ']_of_' || expected
    WHEN len(w) >= 6 AND len(thrice) > 0 THEN 'word_repetition:' || w[thrice[1]]
    WHEN len(w) >= 6 AND len(turns_taken) > 0 THEN 'alternating_repetition:' || w[turns_taken[1]] || '_' || w[turns_taken[1] + 1]
    WHEN phrase IS NOT NULL THEN 'phrase_repetition:' || substr(phrase, 1, 20)
    WHEN length(out) > 500 AND len(list_distinct(regexp_extract_all(out, '(?s).'))) / length(out)::DOUBLE < 0.08 THEN 'low_uniqueness'
    WHEN often >= 3 THEN 'duplicate_cells:' || often || 'x''' || substr(often_text, 1, 10) || '''' END"""
PHRASES = ", ".join(
    f"""list_filter(list_transform(range(1, len(string_split(out, '{sep}')) - 1),
    lambda i: CASE WHEN length(trim(string_split(out, '{sep}')[i])) > 1 AND trim(string_split(out, '{sep}')[i]) = trim(string_split(out, '{sep}')[i + 1])
    AND trim(string_split(out, '{sep}')[i]) = trim(string_split(out, '{sep}')[i + 2]) THEN trim(string_split(out, '{sep}')[i]) END), lambda p: p IS NOT NULL)[1]"""
    for sep in ("、", ",", "。", " ")
)


@query("reply_quality", sql(f"""SELECT * FROM (WITH {TOLD}, noisy AS (SELECT conv_id, block, gaps, CASE WHEN out = '' THEN out
    WHEN conv_id % 6 = 0 THEN out || ' so again again again and on' WHEN conv_id % 6 = 1 THEN out || ' on off on off on off'
    WHEN conv_id % 6 = 2 THEN out || ', one more, one more, one more, end' WHEN conv_id % 6 = 3 THEN same_out ELSE out END AS out
    FROM told_text LEFT JOIN (SELECT conv_id, block, string_agg('[' || idx || ']: all the same text', chr(10) ORDER BY idx) AS same_out
    FROM turns WHERE told GROUP BY ALL) USING (conv_id, block)),
    cell AS (SELECT conv_id, block, CASE WHEN conv_id % 6 = 3 THEN 'all the same text' ELSE text END AS text, count(*) AS n, min(idx) AS first
    FROM turns WHERE told GROUP BY ALL),
    cells AS (SELECT conv_id, block, max(n) AS often, arg_min(text, [-n, first]) AS often_text FROM cell GROUP BY conv_id, block),
    split AS (SELECT *, list_filter(string_split_regex(out, '\\s+'), lambda x: x <> '') AS w FROM noisy),
    placed AS (SELECT *, list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND length(w[i]) > 1) AS thrice,
    list_filter(range(1, len(w) - 4), lambda i: w[i] = w[i + 2] AND w[i] = w[i + 4] AND w[i + 1] = w[i + 3] AND w[i + 1] = w[i + 5]) AS turns_taken,
    coalesce({PHRASES}) AS phrase FROM split)
    SELECT conv_id, block, coalesce({REASONS}, 'good') AS reason
    FROM blocks JOIN placed USING (conv_id, block) LEFT JOIN cells USING (conv_id, block))""", "turns", "blocks"))
def reply_quality(spark, sf):
    """Four ways of looping are planted beside what the conversations say by themselves."""
    kind, said = F.col("conv_id") % 6, F.col("output") != ""
    same = F.transform(F.regexp_extract_all("output", F.lit(r"(?m)^\[\d+\]: "), F.lit(0)), lambda t: F.concat(t, F.lit("all the same text")))
    noisy = X.replies(spark, sf).withColumn(
        "output",
        F.when(said & (kind == 0), F.concat("output", F.lit(" so again again again and on")))
        .when(said & (kind == 1), F.concat("output", F.lit(" on off on off on off")))
        .when(said & (kind == 2), F.concat("output", F.lit(", one more, one more, one more, end")))
        .when(said & (kind == 3), F.array_join(same, "\n"))
        .otherwise(F.col("output")),
    )
    cells = P.parse_cells("output", "expected")
    return noisy.select(
        *BATCH, F.coalesce(Q.reply_problem("output", cells, "expected"), F.lit("good")).alias("reason")
    )


@query("repetition_loop", sql(f"""SELECT * FROM (WITH {TOLD}, noisy AS (SELECT conv_id, block, CASE WHEN out = '' THEN out
    WHEN conv_id % 6 = 0 THEN repeat('go on, ', 12) || out
    WHEN conv_id % 6 IN (1, 3) THEN out || array_to_string(list_transform(range(24), lambda k: chr(10) || CASE WHEN k % (conv_id % 6 + 3) = 0
    THEN ' one and the same line comes back here every now and then ' ELSE 'line ' || k || ' of a list that is long enough to be looked at' END), '')
    ELSE out END AS out FROM told_text),
    pieces AS (SELECT *, substr(out, s + 1, w) AS p FROM (SELECT *, unnest(range(2, 31)) AS w FROM (SELECT *, unnest(range(100)) AS s
    FROM noisy WHERE length(out) >= 50)) WHERE s < least(100, length(out) - w)),
    lines AS (SELECT conv_id, block, trim(line) AS line FROM (SELECT conv_id, block, unnest(string_split(out, chr(10))) AS line
    FROM noisy WHERE length(out) > 1000 AND len(string_split(out, chr(10))) > 20)),
    hits AS (SELECT conv_id, block FROM pieces WHERE len(list_distinct(regexp_extract_all(replace(replace(p, ' ', ''), chr(10), ''), '(?s).'))) > 1
    AND (length(out) - length(replace(out, p, ''))) / length(p) >= 5 AND (length(out) - length(replace(out, p || p, ''))) / length(p || p) >= 4
    UNION SELECT conv_id, block FROM lines WHERE line <> '' GROUP BY conv_id, block, line HAVING count(*) >= 5)
    SELECT n.conv_id, n.block, h.conv_id IS NOT NULL AS loops FROM noisy n LEFT JOIN hits h USING (conv_id, block))""", "turns"))
def repetition_loop(spark, sf):
    """A doubled piece starts some replies, as a stuck model's does; some end in lines of which one
    comes back six times, and some four."""
    every = F.col("conv_id") % 6 + 3
    lines = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.when(
        k % every == 0, F.lit("\n one and the same line comes back here every now and then ")
    ).otherwise(F.concat(F.lit("\nline "), k.cast("string"), F.lit(" of a list that is long enough to be looked at"))))
    noisy = X.replies(spark, sf).withColumn(
        "output",
        F.when(F.col("output") == "", "")
        .when(F.col("conv_id") % 6 == 0, F.concat(F.repeat(F.lit("go on, "), F.lit(12)), "output"))
        .when((F.col("conv_id") % 6).isin(1, 3), F.concat("output", F.array_join(lines, "")))
        .otherwise(F.col("output")),
    )
    return noisy.select(*BATCH, Q.repetition_loop("output").alias("loops"))


@query("translation_quality", sql("""SELECT conv_id, block, coalesce(CASE WHEN blank > n * 0.5 THEN concat('too_many_empty:', blank, '/', n) END,
    CASE WHEN left_over > n * 0.3 THEN concat('untranslated:', left_over, '/', n) END, 'good') AS reason FROM (
    SELECT conv_id, block, count(*) AS n, count(*) FILTER (t = '') AS blank, count(*) FILTER (regexp_matches(t, '[\\x{3040}-\\x{30ff}]')) AS left_over
    FROM (SELECT *, CASE WHEN NOT told OR conv_id % 7 = 0 AND idx % 3 > 0 THEN '' WHEN conv_id % 5 = 0 THEN translate(text, 'aeiou', 'アエイオウ')
    ELSE text END AS t FROM turns) GROUP BY ALL)""", "turns"))
def translation_quality(spark, sf):
    shown = X.turns(spark, sf).selectExpr(
        *BATCH, "idx",
        "CASE WHEN NOT told OR conv_id % 7 = 0 AND idx % 3 > 0 THEN ' ' WHEN conv_id % 5 = 0"
        " THEN translate(text, 'aeiou', 'アエイオウ') ELSE text END AS t",
    )
    batches = shown.groupBy(*BATCH).agg(F.collect_list("t").alias("texts"))
    return batches.select(
        *BATCH, F.coalesce(Q.translation_problem("texts"), F.lit("good")).alias("reason")
    )


@query("ocr_responses", """SELECT l_orderkey, l_linenumber, l_partkey, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height,
    CASE WHEN l_suppkey % 2 = 0 THEN l_discount ELSE 1 END AS confidence FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_discount,
    CAST(least(900, l_partkey % 950) AS DOUBLE) AS x1, CAST(least(1280, l_suppkey % 1300) AS DOUBLE) AS y1,
    CAST(least(900, l_partkey % 950 + 40) AS DOUBLE) AS x2, CAST(least(1280, l_suppkey % 1300 + 20) AS DOUBLE) AS y2 FROM lineitem)""")
def ocr_responses(spark, sf):
    quads = X.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CAST(l_partkey % 950 AS DOUBLE) AS qx1", "CAST(l_suppkey % 1300 + 20 AS DOUBLE) AS qy1",
        "CAST(l_partkey % 950 + 40 AS DOUBLE) AS qx2", "CAST(l_suppkey % 1300 AS DOUBLE) AS qy2",
        "CAST(l_partkey % 950 + 3 AS DOUBLE) AS qx3", "CAST(l_suppkey % 1300 + 7 AS DOUBLE) AS qy3",
        "CAST(l_partkey % 950 + 9 AS DOUBLE) AS qx4", "CAST(l_suppkey % 1300 + 5 AS DOUBLE) AS qy4",
        "CASE WHEN l_suppkey % 2 = 0 THEN l_discount END AS confidence",
    )
    boxed = R.quad_to_box(quads, F.lit(900.0), F.lit(1280.0))
    bodies = boxed.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.to_json(F.struct(
            F.lit(True).alias("success"),
            F.array(F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence")).alias("results"),
        )).alias("body"),
    )
    lines = R.ocr_lines(bodies, "body")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "x", "y", "width", "height", "confidence")
