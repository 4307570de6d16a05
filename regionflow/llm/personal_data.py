"""Operator 10: personal data by weak supervision.

Base spans follow fixed patterns and always stay. Further candidates come from wider
patterns; labelers built on patterns, word lists and context vote on each (for, against,
no opinion). The votes of all candidates of all texts are counted, expectation-maximisation
estimates from the counts how reliable each labeler is, and a final classifier on the
span's own shape is trained on the resulting probabilities. Candidates that it accepts
are added. Counts are kept per kind, votes and shape, all of few values, so what reaches
the driver is bounded although it covers every candidate.

Positions are code points, end exclusive. Defined cases: null and empty texts have no
spans; repeated rows count each and have equal spans; without candidates nothing is
added; further columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name", "address")
KINDS = BASE + ADDED
ACCEPT = 0.5
SPAN = "struct<kind:string,start:long,end:long>"

# The part of an address before the sign is found by walking back, so a long run of its
# letters without the sign costs nothing. Digit runs are read once, from their start.
AFTER_SIGN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Fixed values of the labelers: words that announce personal data, openings of issued
# keys, forms of address, common given names, and signs of ordinary numbers.
CUES = ("mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "account", "iban", "passport", "ssn", "ssh", "login", "user", "contact", "password", "passwd", "token", "secret", "key", "server", "host")
KEY_OPENINGS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "xox", "AIza", "eyJ")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
NAMES = frozenset("James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Anna Maria Peter Paul Thomas Hans Klaus Jean Pierre Marie Sophie Carlos José Juan Luis Carmen Ana".split())
ORDINARY = ("version", "chapter", "page", "figure", "table", "section", "isbn", "issn", "price", "$", "€", "£", "%", "#", " v")

SECRET = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.\-]{8,})")
SECRET_SIGNS = ("=", ":")
WORD_RUN = re.compile(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*")
GROUPED = re.compile(r"(?<![0-9])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")
TITLED = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + r")\.? ((?:[A-ZÀ-Ý][\w'-]+)(?: [A-ZÀ-Ý][\w'-]+)?)")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]? ?at ?[\])]? ?[A-Za-z0-9-]+ ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,6}(?!\w)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = []
    if "@" in text:
        last = 0
        for m in AFTER_SIGN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def wider(text: str) -> Iterator[tuple[int, str, int]]:
    """Candidates (start, kind, end) by wide patterns; they may overlap base spans."""
    low = None
    if any(s in text for s in SECRET_SIGNS):
        low = text.lower()
        if any(w in low for w in ("passw", "pwd", "secret", "token", "key")):
            for m in SECRET.finditer(text):
                yield m.start(1), "secret", m.end(1)
    if DIGIT.search(text):
        for m in WORD_RUN.finditer(text):
            if m.end() - m.start() >= 16 and not m.group().replace("-", "").isdigit():
                yield m.start(), "secret", m.end()
        for m in GROUPED.finditer(text):
            yield m.start(), "number", m.end()
    if any(t in text for t in TITLES):
        for m in TITLED.finditer(text):
            yield m.start(1), "name", m.end(1)
    if "dot" in text:
        for m in SPELLED.finditer(text):
            yield m.start(), "address", m.end()


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """Labelers' opinions on one candidate: 1 for, -1 against, 0 none."""
    span, left = text[start:end], text[max(0, start - 24) : start]
    near = left.lower()
    digits = len(DIGIT.findall(span))
    letters = sum(c.isalpha() for c in span)
    pattern = {
        "secret": 1 if re.search(r"(?i)(?:password|passwd|pwd|secret|token|key)[\"' ]{0,3}[=:]", left) or re.fullmatch(r"[A-Z0-9]{20}|[0-9a-f]{32,}", span) else 0,
        "number": 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) else (1 if 9 <= digits <= 15 else -1),
        "name": 1, "address": 1 if re.search(r"[\[(]|\bat\b.*\bdot\b", span) else 0,
    }[kind]
    listed = 0
    if kind == "secret":
        listed = 1 if span.startswith(KEY_OPENINGS) else 0
    elif kind == "name":
        listed = 1 if span.split()[0] in NAMES else 0
    elif kind == "address":
        listed = 1 if re.search(r"(?i)(?:com|org|net|edu|de|fr|es|uk|io)$", span) else -1
    context = 1 if any(c in near for c in CUES) else 0
    ordinary = -1 if any(c in near[-12:] for c in ORDINARY) else 0
    variety = len(set(span))
    shape = {
        "secret": 1 if digits >= 3 and letters >= 3 and variety >= 8 else -1,
        "number": 1 if digits in (9, 10, 11) and variety >= 5 else -1,
        "name": 0 if " " in span else -1, "address": 1 if len(span) <= 60 else -1,
    }[kind]
    return pattern, listed, context, ordinary, shape


def shape_of(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """The final classifier's inputs, each of few values."""
    span = text[start:end]
    digits = len(DIGIT.findall(span))
    return (
        min(3, len(span) // 12), min(3, 4 * digits // max(1, len(span))), int(span.upper() == span), int(span.lower() == span),
        int(len(set(span)) >= 8), int(start > 0 and text[start - 1] in "=:\"' "), int(any(c in text[max(0, start - 24) : start].lower() for c in CUES)),
    )


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, code) of candidates clear of base spans; the code tells kind, votes and shape."""
    out, taken = [], [(s, e) for s, _, e in base]
    for start, kind, end in sorted(wider(text), key=lambda c: (c[0], -c[2])):
        if any(start < e and s < end for s, e in taken):
            continue
        taken.append((start, end))
        code = "|".join((kind, ",".join(map(str, votes(text, start, kind, end))), ",".join(map(str, shape_of(text, start, kind, end)))))
        out.append((start, kind, end, code))
    return out


@dataclass
class SpanModel:
    """Reliabilities by labeler, probabilities by code, and the codes that are accepted."""

    reliability: dict[str, float]
    probability: dict[str, float]
    accepted: frozenset[str]


def fit(counts: dict[str, int], rounds: int = 60) -> SpanModel:
    """Expectation-maximisation over vote counts, then a logistic classifier on shapes."""
    if not counts:
        return SpanModel({}, {}, frozenset())
    codes = sorted(counts)
    parts = [c.split("|") for c in codes]
    weight = np.array([counts[c] for c in codes], np.float64)
    cast = np.array([[int(v) for v in p[1].split(",")] for p in parts])
    kinds = np.array([ADDED.index(p[0]) for p in parts])
    positive = np.clip(0.5 + 0.15 * cast.sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([(weight[kinds == k] @ positive[kinds == k] + 1) / (weight[kinds == k].sum() + 2) for k in range(len(ADDED))])
        log_odds = np.log(prior / (1 - prior))[kinds]
        reliability = []
        for j in range(cast.shape[1]):
            # One reliability per labeler over the votes it gave; no opinion is no evidence.
            # Starting counts and the range hold that a labeler is right more often than not.
            voted = cast[:, j] != 0
            right = np.where(cast[:, j] == 1, positive, 1 - positive)
            share = (weight[voted] @ right[voted] + 8) / (weight[voted].sum() + 10)
            reliability.append(float(np.clip(share, 0.55, 0.98)))
            log_odds = log_odds + cast[:, j] * np.log(reliability[-1] / (1 - reliability[-1]))
        positive = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    shapes = np.array([[int(v) for v in p[2].split(",")] for p in parts])
    columns = [kinds == k for k in range(len(ADDED))]
    for j in range(shapes.shape[1]):
        columns += [(kinds == k) & (shapes[:, j] == v) for k in range(len(ADDED)) for v in range(4)]
    x = np.stack(columns, axis=1).astype(np.float64)
    w, scale = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (scale * (p - positive)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    names = ("pattern", "list", "context", "ordinary", "shape")
    accepted = frozenset(c for c, v in zip(codes, p) if v >= ACCEPT)
    return SpanModel(dict(zip(names, reliability)), dict(zip(codes, p.tolist())), accepted)


def learn(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count the candidates' codes over all texts and fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, int] = {}
        for _, texts in slices(batches, text):
            for t in texts:
                for *_, code in candidates(t, base_spans(t)):
                    counted[code] = counted.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["code", "n"])

    counts = docs.select(text).mapInArrow(run, "code string, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return fit({r["code"]: r["n"] for r in counts.collect()})


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Spans replaced by their kind in angle brackets; overlapping ones by one, of the kind listed first."""
    out, at = [], 0
    merged: list[list] = []
    for start, kind, end in sorted(spans, key=lambda s: (s[0], s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
            merged[-1][1] = min(merged[-1][1], kind, key=KINDS.index)
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: SpanModel, text: str = "text", redacted: str | None = None) -> DataFrame:
    """``docs`` with ``found`` (array of kind, start, end, by start and kind) and, if named, the redacted text.

    A null text stays null when redacted; ``redacted`` may name the text column itself.
    """
    added = ["found", *([redacted] if redacted else [])]
    keep = [f for f in docs.schema if f.name not in added or f.name == text and redacted != text]
    names = [f.name for f in keep]
    out = [*keep, T.StructField("found", T.ArrayType(T._parse_datatype_string(SPAN)))]
    if redacted:
        out.append(T.StructField(redacted, T.StringType()))
    accepted, schema = model.accepted, T.StructType(out)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            found, clean = [], []
            there = batch.column(text).is_valid().to_pylist()
            for t, known in zip(texts, there):
                base = base_spans(t)
                spans = [(s, KINDS[k], e) for s, k, e in base]
                spans += [(s, k, e) for s, k, e, code in candidates(t, base) if code in accepted]
                spans.sort(key=lambda x: (x[0], KINDS.index(x[1])))
                found.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
                if redacted:
                    clean.append((redact(t, spans) if spans else t) if known else None)
            columns = [*(batch.column(c) for c in names), pa.array(found, kind_type)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if redacted else []), names=schema.names)

    return docs.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
