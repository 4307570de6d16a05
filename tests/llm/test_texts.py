"""Operators 4, 5, 9 and 10 against brute force and held-out rows, and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regionflow.llm import dart_minhash, language, personal_data, quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def weighted(text):
    words = text.split()
    counts = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    return {s: 1 + np.log(c) for s, c in counts.items()}


def groups(texts):
    sets = [weighted(t or "") for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and top(a) != top(b):
                least = sum(min(w, sets[b].get(s, 0)) for s, w in sets[a].items())
                if least / (sum(sets[a].values()) + sum(sets[b].values()) - least) >= 0.8 - 1e-12:
                    root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(texts))]


def near_copies(seed=1):
    rnd = random.Random(seed)
    texts = [None, "", " ", "one two", "one two", "two one", "a b c d e", "a b c d e f", "la " * 400, "la " * 402, "la " * 30]
    for _ in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(40, 300))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = f"z{rnd.randint(0, 10**6)}"
            texts.append(" ".join(words))
    return texts + ["long text " + " ".join(f"v{k}" for k in range(20_000))] * 2


@pytest.mark.parametrize("tile", [512, 4])
def test_near_texts_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(dart_minhash, "TILE", tile)
    texts = near_copies()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, sig string").repartition(5)
    got = {r["doc_id"]: (r["cluster_id"], r["kept"]) for r in dart_minhash.near_texts(df).collect()}
    assert got == {k: (g, k == g) for k, g in enumerate(groups(texts))}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "t", 2), (3, "other", None, None, None), (None, "a b c d e f", "de", "u", 3), (None, None, None, None, None), (9, None, "x", "y", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = dart_minhash.without_copies(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept) == [(False, 3, "a b c d e f"), (False, 3, "other"), (False, 9, ""), (True, 0, "")]
    assert dart_minhash.without_copies(df.limit(0)).count() == 0


def test_signatures_agree_as_often_as_similar():
    words = [f"w{k}" for k in range(300)]
    other = [*words[:200], *(f"z{k}" for k in range(100)), *words[:50] * 2]
    owner, shingle, weight = dart_minhash.weighted_shingles([" ".join(words), " ".join(other)], {})
    made = dart_minhash.signatures(owner, shingle, weight, 2, 4000)
    true = dart_minhash.similarity((shingle[owner == 0], weight[owner == 0]), (shingle[owner == 1], weight[owner == 1]))
    assert abs((made[0] == made[1]).mean() - true) < 0.03


def remainder(ident, of):
    return zlib.crc32(str(ident).encode()) % of


def test_languages_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_language"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_of_odd_rows(spark):
    labelled = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "fr"), ("", "fr"), ("words", None))], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "x", "a"), (5, "the cat and " * 20_000, "a"), (5, "der hund und die " * 20, "a")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(labelled, odd).collect())
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[4:] == [(5, "de"), (5, "en")] and got[3][1] in ("de", "en")
    assert {r["lang_pred"] for r in language.identify(labelled.limit(0), odd).collect()} == {"und"}
    assert language.identify(labelled, odd.limit(0)).count() == 0


def test_signs_that_are_no_letters_have_no_language(spark):
    labelled = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"))], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "² ³"), (2, "½"), (3, "① ②"), (4, "é²"), (5, "中")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(labelled, odd).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(got[k][0] in ("de", "en") for k in (4, 5))


def test_quality_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_quality"](spark, SF).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_quality_of_odd_rows(spark):
    learn = spark.createDataFrame([(k, ("plain words in a row %d " % k) * 5 if k % 2 else "$$$ @@@ " * 30, 100) for k in range(60)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(1, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "x"), (3, "$$$ @@@ " * 5000, 7, "x"), (4, "plain words in a row", None, "x"), (4, "plain words in a row", None, "x")], "doc_id long, text string, n_chars long, buckets string")
    got = quality.classify(odd, learn, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 3)["predicted"] == 0
    assert {r["predicted"] for r in got if r["doc_id"] == 4} == {1}
    assert {r["score"] for r in quality.classify(odd, learn, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd.limit(0), learn, labels).count() == 0


def test_factor_sums_equal_pairs():
    rng = np.random.default_rng(2)
    model = quality.FactorisationMachine(np.zeros((len(quality.STATISTICS), quality.BINS - 2)), 0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    index, value = rng.choice(quality.SIZE, 9, replace=False), rng.normal(size=9)
    plain = 0.3 + model.linear[index] @ value + sum(model.factors[index[a]] @ model.factors[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert np.isclose(model.logits(index, value, np.zeros(9, int), 1)[0][0], plain)


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] if all(int(p) <= 255 for p in m.group().split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        checked = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        found += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and checked % 10 == 0 else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] if 9 <= sum(c.isdigit() for c in m.group()) <= 15 else []
    return sorted(found)


def test_base_spans_equal_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choices("aZ0129..@@+ -()é%5", k=rnd.randint(1, 45)))
        assert personal_data.base_spans(text) == plain_spans(text)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000):
        personal_data.base_spans(text)


def test_personal_data_is_found_and_replaced(spark):
    key = "AKIA" + "Q7RT2ZX4" * 2
    rows = [(k, f'call me at +1 (555) 555-{1000 + k} or a.b@mail.example.com, token = "{k:040x}deadbeef" and {key} end', "x") for k in range(50)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "nothing here at all", "x"), (102, "nothing here at all", "x"), (103, "plain " * 50_000 + "10.0.0.1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    model = personal_data.learn(df)
    got = personal_data.find(df, model, redacted="text").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] < 100:
            assert r["text"] == "call me at <PHONE> or <EMAIL>, token = \"<SECRET>\" and <SECRET> end"
        elif r["doc_id"] == 103:
            assert [tuple(s) for s in r["found"]] == [("ip", 300_000, 300_008)]
        else:
            assert r["found"] == [] and r["text"] == dict((a, b) for a, b, _ in rows)[r["doc_id"]]
    none = df.limit(0)
    assert personal_data.find(none, personal_data.learn(none)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("own"), "found": F.col("doc_id")})
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        assert 0 < len(rows) <= before and all(r["score"] == "own" and r["found"] == r["doc_id"] for r in rows)
        before = len(rows)
    texts = [r["text"] for r in rows]
    assert groups(random.Random(1).sample(texts, 150)) == list(range(150))
    assert not any(plain_spans(t) for t in texts)
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in rows}
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
