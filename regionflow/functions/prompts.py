"""Prompt texts, in our own words, by cell count and target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow.functions.text import col


def grid_prompt(cells, translate, language) -> Column:
    """One cell asks for bare text, several for one numbered entry per cell."""
    n, lang = col(cells), col(language)
    goal = F.when(col(translate), F.concat(F.lit(" and translate it to "), lang)).otherwise("")
    what = F.when(col(translate), F.lit("translation")).otherwise("text")
    one = F.concat(
        F.lit("Read the text of the picture"), goal, F.lit(". Answer with the "), what, F.lit(" only.")
    )
    many = F.format_string(
        "The grid holds %d cells. Read every cell%s. Answer with %d entries, [0] to [%d].",
        n, goal, n, n - 1,
    )
    return F.when(n == 1, one).otherwise(many)


def json_grid_prompt(cells, translate, language) -> Column:
    """The same with a JSON reply."""
    n, lang = col(cells), col(language)
    goal = F.when(col(translate), F.concat(F.lit(" and translate it to "), lang)).otherwise("")
    shape = F.when(n == 1, F.lit('{"text": "..."}')).otherwise(
        F.format_string('{"bubbles": [{"id": 0, "text": "..."}, ...]} with ids 0 to %d', n - 1)
    )
    return F.concat(F.lit("Read every cell"), goal, F.lit(". Answer with JSON only: "), shape)


def translation_prompt(body, language, chinese_name, use_chinese) -> Column:
    """Numbered source texts with the instruction in English or Chinese."""
    english = F.concat(F.lit("Translate to "), col(language), F.lit(", keep the [N]: numbers:\n\n"))
    chinese = F.concat(F.lit("翻译成"), col(chinese_name), F.lit("，保留[N]:编号：\n\n"))
    return F.concat(F.when(col(use_chinese), chinese).otherwise(english), col(body))
