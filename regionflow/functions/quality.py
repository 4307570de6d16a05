"""Checks of model replies.  Each returns the first reason found, or null."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow import constants as C
from regionflow.functions.text import col, let, strip


def words(text) -> Column:
    return F.filter(F.split(col(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _positions(count: Column) -> Column:
    """0 .. count-1, empty when count <= 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def repeated_word(output) -> Column:
    """First word said three times in a row, once there are six words."""
    def find(w: Column) -> Column:
        hit = F.filter(
            _positions(F.size(w) - 2),
            lambda i: (F.get(w, i) == F.get(w, i + 1))
            & (F.get(w, i) == F.get(w, i + 2))
            & (F.length(F.get(w, i)) > 1),
        )
        return F.when(F.size(w) >= 6, F.get(w, _first(hit)))

    return let(words(output), find)


def alternating_words(output) -> Column:
    """First ``a b a b a b``, as ``a_b``."""
    def find(w: Column) -> Column:
        hit = F.filter(
            _positions(F.size(w) - 5),
            lambda i: (F.get(w, i) == F.get(w, i + 2)) & (F.get(w, i) == F.get(w, i + 4))
            & (F.get(w, i + 1) == F.get(w, i + 3)) & (F.get(w, i + 1) == F.get(w, i + 5)),
        )
        return let(_first(hit), lambda at: F.concat(F.get(w, at), F.lit("_"), F.get(w, at + 1)))

    return let(words(output), find)


def repeated_phrase(output) -> Column:
    """First part said three times in a row, over four separators in turn."""
    def by(separator: str) -> Column:
        def find(parts: Column) -> Column:
            hit = F.filter(
                _positions(F.size(parts) - 2),
                lambda i: (F.length(F.get(parts, i)) > 1)
                & (F.get(parts, i) == F.get(parts, i + 1))
                & (F.get(parts, i) == F.get(parts, i + 2)),
            )
            return F.get(parts, _first(hit))

        return let(F.transform(F.split(col(output), separator), strip), find)

    return F.coalesce(*[by(s) for s in ("、", ",", "。", " ")])


def characters(text) -> Column:
    """Code points of a text (``split`` on '' would break surrogate pairs)."""
    return F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))


def low_uniqueness(output, limit: float = 0.08, longer_than: int = 500) -> Column:
    length = F.length(col(output))
    distinct = F.size(F.array_distinct(characters(output)))
    return (length > longer_than) & (distinct / length < limit)


def _counted(texts: Column) -> Column:
    """Every distinct text with how often it occurs, in order of first sight."""
    return F.transform(
        F.array_distinct(texts),
        lambda t: F.struct(F.size(F.filter(texts, lambda u: u == t)).alias("n"), t.alias("text")),
    )


def duplicate_cells(cells) -> Column:
    """``3x'text'`` for the most frequent cell text, when it occurs three times."""
    def name(counted: Column) -> Column:
        best = F.array_max(F.transform(counted, lambda c: c.getField("n")))
        return let(best, lambda n: F.when(
            n >= 3,
            F.concat(
                n.cast("string"), F.lit("x'"),
                F.substring(
                    _first(F.filter(counted, lambda c: c.getField("n") == n)).getField("text"), 1, 10
                ),
                F.lit("'"),
            ),
        ))

    return let(
        F.transform(col(cells), lambda c: c.getField("text")), lambda t: let(_counted(t), name)
    )


def missing_indices(cells, expected) -> Column:
    have = F.transform(col(cells), lambda c: c.getField("idx").cast("int"))
    return F.array_except(_positions(col(expected).cast("int")), have)


def reply_problem(output, cells, expected) -> Column:
    """Why a grid reply must be asked again; null when it is good."""
    return let(col(cells), lambda found: _problem(output, found, expected))


def _problem(output, found: Column, expected) -> Column:
    out, n = F.coalesce(col(output), F.lit("")), col(expected).cast("int")
    top = F.array_max(F.transform(found, lambda c: c.getField("idx")))
    gaps = missing_indices(found, n)
    listed = F.concat(
        F.array_join(F.slice(gaps, 1, 5).cast("array<string>"), ","),
        F.when(
            F.size(gaps) > 5,
            F.concat(F.lit("...+"), (F.size(gaps) - 5).cast("string"), F.lit("more")),
        ).otherwise(""),
    )

    def tagged(tag: str, detail: Column) -> Column:
        return F.concat(F.lit(tag + ":"), detail)

    return F.coalesce(
        F.when(strip(out) == "", F.lit("empty_output")),
        F.when((n > 1) & (F.size(found) == 0), F.lit("no_cells_parsed")),
        F.when(
            (n > 1) & (top >= n),
            tagged("index_overflow", F.concat((top + 1).cast("string"), F.lit("_vs_"), n.cast("string"))),
        ),
        F.when(
            (n > 1) & (F.size(gaps) > 0),
            tagged("missing_indices", F.concat(F.lit("["), listed, F.lit("]_of_"), n.cast("string"))),
        ),
        tagged("word_repetition", repeated_word(out)),
        F.when(F.size(words(out)) >= 6, tagged("alternating_repetition", alternating_words(out))),
        tagged("phrase_repetition", F.substring(repeated_phrase(out), 1, 20)),
        F.when(low_uniqueness(out), F.lit("low_uniqueness")),
        tagged("duplicate_cells", duplicate_cells(found)),
    )


def _squares(code: np.ndarray, width: int) -> np.ndarray:
    """Where a piece of ``width`` characters is followed by itself: ``width`` equal steps in a row."""
    steps = np.concatenate(([0], np.cumsum(code[:-width] == code[width:])))
    alike = np.concatenate(([0], np.cumsum(code[:-1] == code[1:])))
    start = np.flatnonzero(steps[width:] - steps[:-width] == width)
    # A piece of one character alone is no loop.
    return start[alike[start + width - 1] - alike[start] < width - 1]


def loops(text: str, threshold: int = 5) -> bool:
    """Whether a reply loops, in time linear in its length. ``threshold`` is two or more.

    A piece that follows itself ``threshold - 1`` times, apart from each other, also occurs
    ``threshold`` times, so only such doubled pieces are looked for: per width, from runs of
    equal characters at that distance.
    """
    if len(text) < 50:
        return False
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for width in range(2, min(30, len(text) // 2) + 1):
        starts = _squares(code, width)
        if len(starts) < threshold - 1:
            continue
        early = {text[k : k + width] for k in range(min(100, len(text) - width))}
        early = {piece for piece in early if len(set(piece) - set("\n ")) > 1}
        if not early:
            continue
        ends: dict[str, int] = {}
        doubled: Counter[str] = Counter()
        for k in starts.tolist():
            piece = text[k : k + width]
            if piece not in early or k < ends.get(piece, 0):
                continue
            ends[piece] = k + 2 * width
            doubled[piece] += 1
            if doubled[piece] >= threshold - 1:
                return True
    lines = text.split("\n")
    if len(text) <= 1000 or len(lines) <= 20:
        return False
    often = Counter(t for line in lines if (t := line.strip()))
    return max(often.values(), default=0) >= threshold


def repetition_loop(output, threshold: int = 5) -> Column:
    """A short piece that starts early and keeps following itself, or a very
    long reply in which one line keeps coming back; a missing reply does not loop.
    """
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: loops(t, threshold))

    return found(F.coalesce(col(output), F.lit("")))


def translation_problem(translations, target_language: str = "English") -> Column:
    """Why a translated batch (array of texts) must be asked again."""
    texts = col(translations)
    n = F.size(texts)
    blank = F.size(F.filter(texts, lambda t: F.coalesce(strip(t), F.lit("")) == ""))
    reasons = [
        F.when(texts.isNull() | (n == 0), F.lit("empty_translations")),
        F.when(
            blank > n * 0.5,
            F.concat(F.lit("too_many_empty:"), blank.cast("string"), F.lit("/"), n.cast("string")),
        ),
    ]
    if target_language.lower() in C.NON_CJK_TARGETS:
        left = F.size(
            F.filter(
                texts,
                lambda t: F.coalesce(t.rlike(f"[{C.CJK_UNTRANSLATED}]"), F.lit(False)),
            )
        )
        reasons.append(
            F.when(
                left > n * 0.3,
                F.concat(F.lit("untranslated:"), left.cast("string"), F.lit("/"), n.cast("string")),
            )
        )
    return F.coalesce(*reasons)
