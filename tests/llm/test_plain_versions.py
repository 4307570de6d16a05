"""Models and plans against plain recomputation: operator 9's network, operator 4's score,
operator 10's aggregation and what its added spans catch, operator 6's tree, an empty pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from regionflow.llm import language, personal_data, quality, top_k

SF = "/root/testdata/sf0.001"


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(1)
    samples = [("a", "aba cab " * 9), ("b", "zyz xyz " * 9), ("c", "mno nom é" * 9)] * 12
    net = language.train(samples, epochs=2)
    windows = rng.integers(0, 256, (3, language.LENGTH)).astype(np.uint8)
    windows[1, 40:] = 0
    found = net.probabilities(windows)
    for window, row in zip(windows, found):
        answers = []
        for k, width in enumerate(language.WIDTHS):
            for f in range(language.FILTERS):
                weights = net.filters[:, k * language.FILTERS + f].reshape(-1, language.EMBEDDING)
                best = max(
                    sum(float(weights[j] @ net.embedding[window[at + j]]) for j in range(width))
                    for at in range(language.LENGTH - max(language.WIDTHS) + 1)
                )
                answers.append(max(0.0, best + float(net.bias[k * language.FILTERS + f])))
        logits = [sum(a * float(w) for a, w in zip(answers, net.out[:, c])) + float(net.out_bias[c]) for c in range(len(net.languages))]
        total = sum(math.exp(x - max(logits)) for x in logits)
        assert np.allclose(row, [math.exp(x - max(logits)) / total for x in logits], atol=1e-4)
        # Narrow filters' tails are zero, so a filter reads no more than its width.
    for k, width in enumerate(language.WIDTHS):
        assert not net.filters.reshape(max(language.WIDTHS), language.EMBEDDING, -1)[width:, :, k * language.FILTERS : (k + 1) * language.FILTERS].any()


def plain_quality(text, length, model):
    """A score from the definition: every input by hand, all pairs."""
    words = text.split()
    counts = Counter(words)
    buckets = Counter()
    for w, n in counts.items():
        buckets[zlib.crc32(w.encode()) % quality.WORDS] += n
    values = {b: math.log1p(n) for b, n in buckets.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    raw, lines, some = text.encode(), text.split("\n"), max(len(words), 1)
    kinds = Counter(quality.KINDS[b] for b in raw)
    share = [kinds[k] / max(len(raw), 1) for k in range(7)]
    statistics = [
        math.log1p(len(words)), len(counts) / some, max(counts.values(), default=0) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
        len(raw) / some, share[1], share[2], share[3], share[5], share[4], share[6], math.log1p(len(lines)), len(set(lines)) / len(lines),
        None if length is None else math.log1p(max(length, 0)),
    ]
    inputs = [(b, v / norm) for b, v in values.items()]
    for k, s in enumerate(statistics):
        place = quality.BINS - 1 if s is None else sum(edge <= s for edge in model.edges[k])
        inputs.append((quality.WORDS + quality.BINS * k + place, 0.3))
    logit = model.bias + sum(model.linear[i] * v for i, v in inputs)
    for a in range(len(inputs)):
        for b in range(a):
            logit += float(model.factors[inputs[a][0]] @ model.factors[inputs[b][0]]) * inputs[a][1] * inputs[b][1]
    return 1 / (1 + math.exp(-logit))


def test_quality_equals_plain_score(spark):
    learn = spark.createDataFrame([(k, ("plain words in a row %d " % k) * 5 if k % 2 else "$$$ @@@ " * 30, 100 + k) for k in range(60)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.train(quality.sample(learn, labels))
    texts = [("", 0), ("one", None), ("A b b b. C|d\nA b\nA b 123", 30), ("é ü ß\n\n", 3), ("plain words in a row 7 " * 4, 92)]
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(texts)], "doc_id long, text string, n_chars long")
    for r in quality.score(df, model).collect():
        assert math.isclose(r["score"], plain_quality(*texts[r["doc_id"]], model), abs_tol=1e-9)


def test_sample_of_quality_is_bounded_and_repeatable(spark):
    rows = [(k % 40, f"words of text {k} " * (1 + k % 9), 10 * k) for k in range(400)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    whole = quality.sample(learn, labels)
    assert Counter(s[0] for s in whole) == {0: 200, 1: 200}
    again = quality.sample(learn.repartition(7), labels)
    assert all(a[0] == b[0] and all(np.array_equal(x, y) for x, y in zip(a[1:], b[1:])) for a, b in zip(whole, again))
    few = quality.sample(learn, labels, sample_rows=30)
    assert Counter(s[0] for s in few) == {0: 30, 1: 30}
    tight = quality.sample(learn, labels, most_inputs=50)
    assert all(sum(len(s[1]) for s in tight if s[0] == mark) <= 50 for mark in (0, 1)) and len(tight) > 10


def test_reliabilities_equal_plain_expectation_maximisation():
    rnd = random.Random(4)
    counts = {}
    for _ in range(60):
        code = "|".join((rnd.choice(personal_data.ADDED), ",".join(str(rnd.choice((-1, 0, 1))) for _ in range(5)), ",".join(str(rnd.randint(0, 1)) for _ in range(7))))
        counts[code] = rnd.randint(1, 6)
    model = personal_data.fit(counts, rounds=20)
    items = [(c.split("|")[0], [int(v) for v in c.split("|")[1].split(",")]) for c, n in counts.items() for _ in range(n)]
    belief = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v in items]
    for _ in range(20):
        prior = {}
        for kind in personal_data.ADDED:
            mine = [b for (k, _), b in zip(items, belief) if k == kind]
            prior[kind] = (sum(mine) + 1) / (len(mine) + 2)
        right = []
        for j in range(5):
            given = [b if v[j] == 1 else 1 - b for (_, v), b in zip(items, belief) if v[j]]
            right.append(min(0.98, max(0.55, (sum(given) + 8) / (len(given) + 10))))
        belief = []
        for kind, v in items:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v[j] * math.log(right[j] / (1 - right[j])) for j in range(5))
            belief.append(1 / (1 + math.exp(-odds)))
    assert np.allclose(list(model.reliability.values()), right)


def test_added_spans_catch_planted_ones(spark):
    """Keys, passwords and identity numbers in half of the texts, look-alikes in the others."""
    rnd = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, planted = [], {}
    for k in range(400):
        filler = " ".join(rnd.choices(("the", "order", "was", "sent", "on", "time", "again", "to", "us"), k=rnd.randint(5, 30)))
        hidden = None
        if k % 2:
            hidden = ["AKIA" + "".join(rnd.choices(letters, k=16)), f"{rnd.randint(100, 899)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", "".join(rnd.choices("abcdefghjkmnpqrstuvwxyz23456789", k=14))][k % 3]
            lead = ["key is ", "ssn: ", "password = "][k % 3]
            text = f"{filler} {lead}{hidden} {filler}"
            planted[k] = (text.index(hidden), text.index(hidden) + len(hidden))
        else:
            text = f"{filler} {['page 12 of 300', 'version 1.2.3-beta', 'in 2019-2020'][k % 3]} {filler}"
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    caught = false = 0
    for r in personal_data.find(df, personal_data.learn(df)).collect():
        added = [s for s in r["found"] if s["kind"] in personal_data.ADDED]
        if r["doc_id"] in planted:
            start, end = planted[r["doc_id"]]
            caught += any(s["start"] < end and start < s["end"] for s in added)
            false += sum(not (s["start"] < end and start < s["end"]) for s in added)
        else:
            false += len(added)
    recall, precision = caught / len(planted), caught / max(1, caught + false)
    assert recall > 0.9 and precision > 0.9, (recall, precision)


def test_top_k_over_more_than_one_level_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 5)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 4)
    rng = np.random.default_rng(6)
    vectors = (rng.integers(-20, 21, (500, 5)) / 256).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = [tuple(r) for r in top_k.search(df.filter("vec_id % 50 = 0"), df, k=5).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    expected = []
    for q in range(0, 500, 50):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(500) if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("labels", [True, False])
def test_pipeline_of_an_empty_table(spark, tmp_path, labels):
    for name in ("documents", "labels"):
        table = pq.read_table(f"{SF}/{name}.parquet")
        pq.write_table(table if name == "labels" and labels else table.slice(0, 0), tmp_path / f"{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "sequence_id" in got.columns
