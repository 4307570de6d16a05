"""String expressions: trimming, script tests, slugs, flags, event text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow import constants as C

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda that mentions an
    outer expression would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value) -> Column:
    """Trim every Unicode space, U+3000 included (``trim`` would leave it)."""
    return F.regexp_replace(col(value), _EDGE_SPACE, "")


def is_noise(value) -> Column:
    """Empty after trimming, or one of the lone noise characters."""
    text = strip(value)
    return F.coalesce((text == "") | text.isin(C.SKIP_CHARS), F.lit(True))


def has_map_script(value) -> Column:
    return F.coalesce(col(value).rlike(f"[{C.CJK_MAP}]"), F.lit(False))


def contains_cjk(value) -> Column:
    return F.coalesce(col(value).rlike(f"[{C.CJK_RATIO}]"), F.lit(False))


def cjk_ratio(value) -> Column:
    """CJK characters over meaningful ones (ASCII alphanumerics, or beyond ASCII)."""
    text = F.coalesce(col(value), F.lit(""))
    cjk = F.regexp_count(text, F.lit(f"[{C.CJK_RATIO}]"))
    meaningful = F.regexp_count(text, F.lit(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    return F.when(meaningful > 0, cjk / meaningful).otherwise(F.lit(0.0))


def should_translate(value, min_ratio: float = C.MIN_CJK_RATIO) -> Column:
    text = F.coalesce(col(value), F.lit(""))
    has_meaning = text.rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    return has_meaning & (cjk_ratio(text) >= min_ratio)


def is_usable_translation(value) -> Column:
    """Not empty and not a bracketed marker."""
    text = F.coalesce(col(value), F.lit(""))
    return (text != "") & ~text.startswith("[")


def slug(value) -> Column:
    """Folder-safe title: at most 50 characters, ``untitled`` when empty."""
    safe = F.regexp_replace(
        F.coalesce(col(value), F.lit("untitled")), r"[^\p{L}\p{N}_-]", "_"
    )
    trimmed = F.regexp_replace(safe, r"^_+|_+\z", "")
    return F.coalesce(F.nullif(F.substring(trimmed, 1, 50), F.lit("")), F.lit("untitled"))


def truthy(value) -> Column:
    return F.lower(F.coalesce(col(value), F.lit(""))).isin("true", "1", "yes")


def translate_mode(ocr_translate, translate_local, default_mode, gemini_ready=True) -> Column:
    """Which translator serves a request: vlm, local, gemini or api."""
    ocr, local, mode = col(ocr_translate), col(translate_local), col(default_mode)
    unset = ocr.isNull() & local.isNull()
    use_vlm = F.when(unset, mode == "vlm").otherwise(truthy(ocr))
    use_local = F.when(unset, mode == "local").otherwise(truthy(local))
    return (
        F.when(use_vlm, "vlm")
        .when(use_local, "local")
        .when((mode == "gemini") & F.lit(gemini_ready), "gemini")
        .otherwise("api")
    )


def output_type_error(value) -> Column:
    """Null for a known output type, else the error text."""
    kind = F.coalesce(col(value), F.lit("full_page"))
    return F.when(
        ~kind.isin(C.OUTPUT_TYPES),
        F.concat(
            F.lit("Invalid output_type: "), kind,
            F.lit(". Must be one of: " + ", ".join(C.OUTPUT_TYPES)),
        ),
    )


def event_text(kind, payload) -> Column:
    """One server-sent event: name line, JSON line, blank line."""
    return F.concat(
        F.lit("event: "), col(kind), F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n")
    )


def error_class(message) -> Column:
    """retryable / overload / limited / other, as an array of classes."""
    text = F.coalesce(col(message), F.lit(""))
    low = F.lower(text)
    return F.array_compact(
        F.array(
            F.when(
                text.rlike("RateLimitError|429|503|502") | low.contains("timeout"),
                F.lit("retryable"),
            ),
            F.when(low.rlike("503|unavailable|overloaded"), F.lit("overload")),
            F.when(low.rlike("429|resource_exhausted|quota"), F.lit("limited")),
        )
    )


def is_retryable(message) -> Column:
    return F.array_contains(error_class(message), "retryable")


def is_overload(message) -> Column:
    return F.array_contains(error_class(message), "overload")


def is_limited(message) -> Column:
    return F.array_contains(error_class(message), "limited")


def rotate_key(names, batch_idx) -> Column:
    """Name of the credential a batch uses: comma list, round robin by batch."""
    keys = F.filter(
        F.transform(F.split(F.coalesce(col(names), F.lit("")), ","), strip),
        lambda k: k != "",
    )
    return F.when(
        F.size(keys) > 0,
        F.element_at(keys, (F.pmod(col(batch_idx), F.size(keys)) + 1).cast("int")),
    ).otherwise(F.lit(""))


def code_as_name(code) -> Column:
    """Fallback language name: first letter upper, the rest lower."""
    c = col(code)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
