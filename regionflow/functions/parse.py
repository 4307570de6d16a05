"""Model replies to cells or translations, as column expressions.

Replies stay one row each: a reply is parsed into an array of
``struct<idx bigint, text string>`` inside the JVM, and the caller explodes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import col, let, strip

CELLS = "array<struct<idx:bigint,text:string>>"

# --- fixed values: reply patterns --------------------------------------------
NUMBERED = r"(?sU)\[(\d+)\]:\s*(.+?)(?=\[\d+\]:|$)"
NUMBERED_SPACED = r"(?sU)\[(\d+)\]:\s*(.+?)(?=\s*\[\d+\]:|$)"
BROKEN_BUBBLE = r'"id"\s*:\s*(\d+)\s*,\s*"text"\s*:\s*"([^"]*)"'
BROKEN_TEXT = r'"text"\s*:\s*"([^"]*)"'
LINE_NUMBER = r"^(\d+[\.\)]|\[\d+\]:?)\s*"
LIST_NUMBER = r"^\d+\.\s*"

_WIDE_DIGITS = "０１２３４５６７８９"


def _index(digits: Column) -> Column:
    return F.translate(digits, _WIDE_DIGITS, "0123456789").try_cast("bigint")


def _pairs(text: Column, pattern: str) -> Column:
    """Every (number, body) match in order; bodies trimmed."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("t"),
    )
    return F.transform(
        found,
        lambda m: F.struct(
            _index(m.getField("n")).alias("idx"), strip(m.getField("t")).alias("text")
        ),
    )


def last_per_index(pairs: Column) -> Column:
    """Keep the last text of every index; replies number each cell once, so the
    quadratic look-ahead only runs when an index really repeats."""
    def keep(found: Column) -> Column:
        plain = F.size(F.array_distinct(F.transform(found, lambda p: p.getField("idx"))))
        later = F.filter(
            found,
            lambda p, i: ~F.exists(
                F.slice(found, i + 2, F.size(found)),
                lambda q: q.getField("idx") == p.getField("idx"),
            ),
        )
        return F.when(plain == F.size(found), found).otherwise(later)

    return let(pairs, keep)


def _in_range(pairs: Column, expected: Column) -> Column:
    return F.filter(
        pairs,
        lambda p: (p.getField("text") != "")
        & (p.getField("idx") >= 0)
        & (p.getField("idx") < expected),
    )


def _single(text: Column) -> Column:
    """One-cell array, or an empty one when the text is empty."""
    none = F.array().cast(CELLS)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("idx"), text.alias("text")))
    return F.when(text != "", one).otherwise(none)


def _unlabel(text: Column) -> Column:
    return F.when(text.startswith("[0]:"), strip(F.substring(text, 5, 2**31 - 1))).otherwise(text)


def parse_cells(output, expected) -> Column:
    """``[N]: text`` reply, numbered from 0; a lone cell may carry no number."""
    out, n = F.coalesce(col(output), F.lit("")), col(expected)
    many = last_per_index(_in_range(_pairs(out, NUMBERED), n))
    return F.when(n == 1, _single(_unlabel(strip(out)))).otherwise(many)


def swallowed(text) -> Column:
    """An empty cell takes the next cell's label into its own text."""
    return col(text).rlike(r"^\[\d+\]:")


def strip_preamble(output) -> Column:
    text = strip(F.coalesce(col(output), F.lit("")))
    for pattern in C.PREAMBLES:
        # An anchored pattern occurs once, so replacing "all" removes just that one.
        text = F.regexp_replace(text, "(?iU)" + pattern.replace("$", r"\z"), "")
    return strip(text)


def parse_json_reply(output, expected) -> Column:
    """First rung that yields cells: JSON text, JSON bubbles, a lone raw or
    partial reply, ``[N]:`` lines, then bubbles picked from broken JSON."""
    n = col(expected)
    out = strip_preamble(output)
    doc = F.try_parse_json(out)
    json_text = F.try_variant_get(doc, "$.text", "string")
    bubbles = F.try_variant_get(
        doc, "$.bubbles", "array<struct<id:string,text:string>>"
    )
    json_cells = last_per_index(
        _in_range(
            F.transform(
                F.coalesce(bubbles, F.array().cast("array<struct<id:string,text:string>>")),
                lambda b: F.struct(
                    b.getField("id").try_cast("double").cast("bigint").alias("idx"),
                    strip(b.getField("text")).alias("text"),
                ),
            ),
            n,
        )
    )
    lone = _unlabel(out)
    partial = F.regexp_extract(lone, BROKEN_TEXT, 1)
    lone = F.when(
        lone.startswith('{"text":') & lone.rlike(BROKEN_TEXT), partial
    ).otherwise(lone)
    numbered = last_per_index(_in_range(_pairs(out, NUMBERED_SPACED), n))
    broken = last_per_index(_in_range(_pairs(out, BROKEN_BUBBLE), n))
    return (
        F.when((n == 1) & json_text.isNotNull(), _single(strip(json_text)))
        .when(F.size(json_cells) > 0, json_cells)
        .when(n == 1, _single(lone))
        .when(F.size(numbered) > 0, numbered)
        .otherwise(broken)
    )


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda t: t != "")


def _empty_strings(n: Column) -> Column:
    return F.array_repeat(F.lit(""), n.cast("int"))


def parse_translation(output, expected) -> Column:
    """Array of ``expected`` texts from ``[N]:`` numbered from 1, or from bare
    lines when no number was found; a missing text is ``''``."""
    out, n = F.coalesce(col(output), F.lit("")), col(expected)
    pairs = _pairs(out, NUMBERED)
    positions = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    by_index = F.map_from_entries(
        last_per_index(
            F.filter(pairs, lambda p: (p.getField("idx") > 0) & (p.getField("idx") <= n))
        )
    )
    numbered = let(
        by_index,
        lambda m: F.transform(positions, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(""))),
    )
    plain = F.slice(
        F.concat(
            F.transform(_lines(out), lambda t: F.regexp_replace(t, "(?U)" + LINE_NUMBER, "")),
            _empty_strings(n),
        ),
        F.lit(1), n.cast("int"),
    )
    return F.when(F.size(pairs) > 0, numbered).otherwise(plain)


def parse_translated_json(output) -> Column:
    """``translated`` array of a JSON reply, or its unnumbered lines when the
    JSON cannot be read.  Null when the reply is empty."""
    out = F.coalesce(col(output), F.lit(""))
    braced = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    doc = F.try_parse_json(F.when(braced != "", braced).otherwise(out))
    from_json = F.coalesce(
        F.try_variant_get(doc, "$.translated", "array<string>"),
        F.array().cast("array<string>"),
    )
    kept = F.filter(
        _lines(out), lambda t: ~(t.startswith("{") | t.startswith("}"))
    )
    from_lines = F.filter(
        F.transform(kept, lambda t: F.regexp_replace(t, "(?U)" + LIST_NUMBER, "")),
        lambda t: t != "",
    )
    return F.when(out != "", F.when(doc.isNotNull(), from_json).otherwise(from_lines))


def pad_translations(translations, expected) -> Column:
    """Exactly ``expected`` entries; the missing tail is marked as failed."""
    n = col(expected).cast("int")
    got = F.coalesce(col(translations), F.array().cast("array<string>"))
    return F.slice(
        F.concat(got, F.array_repeat(F.lit(C.FAILED), n)), F.lit(1), n
    )


def reply_status(translations, expected) -> Column:
    got, n = col(translations), col(expected)
    return (
        F.when(got.isNull(), "empty_response")
        .when(
            F.size(got) < n,
            F.concat(
                F.lit("partial ("), F.size(got).cast("string"), F.lit("/"),
                n.cast("string"), F.lit(")"),
            ),
        )
        .otherwise("success")
    )
