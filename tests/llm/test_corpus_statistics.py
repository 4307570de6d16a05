"""Operators 12 and 13 against plain code, on odd rows, ties, long runs and forced collisions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from regionflow.llm import divergence, importance

DOCS = "doc_id long, text string, lang string, source string, rank string, digest long"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "É", "don't", "a1b2", "ÆØ", "中文", "x_y"]
    rows = []
    for k in range(300):
        size = int(rng.integers(0, 60))
        text = " ".join(rng.choice(words, size, p=None)) + rng.choice(["", ".", "!\n"])
        rows.append((k, text, ["en", "de", None][k % 3], ["s1", "s2", "s3", None, "s4"][k % 5], "own", k))
    rows += [(1000, None, "en", "s1", "r", 1), (1001, "", "fr", "empty", "r", 1), (1002, "ABC " * 30_000, "en", "s2", "r", 1), (None, "w1 " * 30, "en", "s9", "r", 1)]
    return rows + [(2000, "w1 w2 w3 w4 w5 " * 6, "en", "s1", "r", 1)] * 7


def plain_features(text, longest):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS)) if w]
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_equals_plain_code(spark, longest):
    rows, target = documents(), [("w1 w2 w3 Äpfel w1",), (None,), ("",), ("x_y 中文 é",)]
    buckets = 500
    counts = [Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, longest)[1]) for texts in ([r[1] for r in rows], [t for t, in target])]
    total = [sum(c.values()) for c in counts]
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (total[0] + buckets) / ((counts[0][b] + 1) * (total[1] + buckets)))) for b in range(buckets)]
    expected = []
    for ident, text, *_ in rows:
        n_words, found = plain_features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        expected.append((ident, len(found), n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in expected if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * 10 // 100
    assert drawn > 5
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = importance.resample(df, spark.createDataFrame(target, "text string"), longest=longest, buckets=buckets).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, drawn + 1)) and [tuple(r)[:5] for r in ranked] == able[:drawn]


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(5, "w1 w2 w3 w4 w5 " * 5)] * 400 + [(6, "w1 w2 w3 w4 w5 " * 5)] * 20 + [(7, "w1")]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1",)], "text string")).collect()
    assert len(got) == 421 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 43))


def test_importance_of_empty_tables(spark):
    docs, target = spark.createDataFrame(documents(), DOCS), spark.createDataFrame([("w1",)], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(documents())


def plain_divergence(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))) for _, text, lang, source, *_ in rows]
    in_docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in terms:
        in_docs[lang].update(set(found))
        groups[lang, source].update(found)
    out = []
    for lang, own in in_docs.items():
        kept = sorted(t for t, n in own.items() if n >= least)
        of_lang = Counter()
        for (name, _), c in groups.items():
            of_lang.update(c if name == lang else {})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(of_lang)
        p = {source: shares(c) for (name, source), c in groups.items() if name == lang}
        for source in p:
            pairs = [(-sum(abs(p[source][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != source]
            over = [(q[t] - p[source][t], t.encode()) for t in kept if groups[lang, source][t] and p[source][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "terms", "sources"), [(64, 2048, 64), (4, 16, 2)])
def test_divergence_equals_plain_code(spark, monkeypatch, bits, terms, sources):
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "TILE_SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = documents()
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(4), least_docs=20, top=7, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows, 20, 7)


def test_divergence_without_kept_terms_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x", "", 0), (2, "c", "en", "y", "", 0), (3, None, None, None, "", 0)], DOCS)
    assert sorted(map(tuple, divergence.divergence(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.divergence(df.limit(0)).count() == 0
