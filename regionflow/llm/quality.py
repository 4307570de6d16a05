"""Operator 4: a factorisation machine for text quality.

Hashed words (dampened, scaled counts), structure statistics and the stored length, both
in bins, are the inputs; every pair of inputs interacts through low-rank factors. The
pair sum is taken in linear time as half of (sum of v x) squared minus the sum of their
squares, per factor. Training is numpy on a bounded sample of labelled rows; scoring
covers every whole text, inside tasks.

Defined cases: null and empty texts are scored like any other, by their bins alone. A
null length has a bin of its own. Rows of ``labels`` without a quality are no labels; of
several labels of one id the mean counts; unlike texts of one id are samples each. A missing
``length`` column is an error. Without labels every score is 0.5. Repeated
rows get equal scores; further columns are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import fewest, lists_of, slices, worker_state

#: Bound of the training sample: rows per label.
SAMPLE = 4000
#: Bound of the training sample: word buckets of all its texts, per label (32 MB).
SAMPLE_INPUTS = 2_000_000
WORDS = 1 << 13
FACTORS = 8
BINS = 16
STATISTICS = (
    "words", "distinct words", "top word", "repeats next to each other", "bytes per word", "capitals",
    "digits", "punctuation", "other signs", "bars", "beyond ASCII", "lines", "distinct lines", "length",
)
SIZE = WORDS + BINS * len(STATISTICS)
#: Word hashes kept per worker; with more, the memory starts anew.
MEMORY = 500_000
#: Kinds of bytes: 1 capital, 2 digit, 3 punctuation of prose, 4 bar, 5 other ASCII sign, 6 beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[65:91] = 1
KINDS[48:58] = 2
KINDS[[ord(c) for c in ".,;:'\"()-?"]] = 3
KINDS[ord("|")] = 4
KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 5
KINDS[128:] = 6


def inputs(texts: list[str], stored: list, memory: dict[str, int]):
    """Per text its word buckets with values (flat, with counts per text) and its statistics."""
    split = [t.split() for t in texts]
    new = set().union(*split).difference(memory)
    if len(memory) + len(new) > MEMORY and memory:
        memory.clear()
        new = set().union(*split)
    memory.update((w, zlib.crc32(w.encode())) for w in new)
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    hashes = np.fromiter((memory[w] for s in split for w in s), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    keys, counts = np.unique(owner << 32 | hashes, return_counts=True)
    word_owner = keys >> 32
    distinct = np.bincount(word_owner, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, word_owner, counts)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][same], minlength=len(texts))
    # Buckets: words that share one are added up.
    bucket_keys, where = np.unique(word_owner * WORDS + (keys & 0xFFFFFFFF) % WORDS, return_inverse=True)
    values = np.log1p(np.bincount(where, counts, len(bucket_keys))) if len(keys) else np.zeros(0)
    bucket_owner, bucket = bucket_keys // WORDS, bucket_keys % WORDS
    norm = np.sqrt(np.bincount(bucket_owner, values**2, len(texts)))
    values = values / np.maximum(norm, 1e-12)[bucket_owner]
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum(sizes)
    share = np.zeros((7, len(texts)))
    for kind in range(1, 7):
        total = np.concatenate(([0], np.cumsum(kinds == kind, dtype=np.int64)))
        share[kind] = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
    lines = [t.split("\n") for t in texts]
    n_lines = np.fromiter(map(len, lines), np.float64, len(lines))
    unlike = np.fromiter((len(set(x)) for x in lines), np.float64, len(lines)) / n_lines
    some = np.maximum(n_words, 1)
    length = np.array([np.nan if s is None else np.log1p(max(s, 0)) for s in stored], np.float64)
    statistics = np.stack([np.log1p(n_words), distinct / some, top / some, repeats / some, sizes / some, share[1], share[2], share[3], share[5], share[4], share[6], np.log1p(n_lines), unlike, length], axis=1)
    return bucket, values, np.bincount(bucket_owner, minlength=len(texts)), statistics


@dataclass
class FactorisationMachine:
    edges: np.ndarray  # statistics x (BINS - 2)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, bucket, values, counts, statistics):
        """All inputs of all texts: index, value, owner; the owners in order."""
        n = len(counts)
        index = np.empty((n, len(STATISTICS)), np.int64)
        for k in range(len(STATISTICS)):
            column = statistics[:, k]
            found = np.searchsorted(self.edges[k], column, side="right")
            index[:, k] = WORDS + BINS * k + np.where(np.isnan(column), BINS - 1, found)
        owner = np.concatenate([np.repeat(np.arange(n), counts), np.repeat(np.arange(n), len(STATISTICS))])
        order = np.argsort(owner, kind="stable")
        every = np.concatenate([bucket, index.reshape(-1)])
        value = np.concatenate([values, np.full(n * len(STATISTICS), 0.3)])
        return every[order], value[order], owner[order]

    def logits(self, index, value, owner, n):
        """Scores before the logistic curve, and each text's factor sums."""
        starts = np.searchsorted(owner, np.arange(n))
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(samples: list, epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 5) -> FactorisationMachine:
    """Fit on rows (label, word buckets, values, statistics), both labels weighing the same."""
    rng = np.random.default_rng(seed)
    labels = np.array([s[0] for s in samples], np.float64)
    statistics = np.array([s[3] for s in samples], np.float64)
    quantiles = np.linspace(0, 1, BINS)[1:-1]
    edges = np.stack([np.quantile(c[~np.isnan(c)], quantiles) if (~np.isnan(c)).any() else np.zeros(BINS - 2) for c in statistics.T])
    model = FactorisationMachine(edges, 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))
    share = np.clip(labels.mean(), 0.01, 0.99)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    seen = {"linear": np.full(SIZE, 1e-6), "factors": np.full((SIZE, FACTORS), 1e-6)}
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), batch):
            rows = [samples[j] for j in order[k : k + batch]]
            n = len(rows)
            index, value, owner = model.rows(
                np.concatenate([np.asarray(r[1], np.int64) for r in rows]), np.concatenate([np.asarray(r[2], np.float64) for r in rows]),
                np.array([len(r[1]) for r in rows]), np.array([r[3] for r in rows], np.float64),
            )
            logit, sums = model.logits(index, value, owner, n)
            wrong = (logistic(logit) - labels[order[k : k + batch]]) * weight[order[k : k + batch]] / n
            each = wrong[owner] * value
            used, where = np.unique(index, return_inverse=True)
            linear = np.bincount(where, each, len(used)) + 1e-5 * model.linear[used]
            slope = each[:, None] * (sums[owner] - model.factors[index] * value[:, None])
            factors = np.stack([np.bincount(where, slope[:, f], len(used)) for f in range(FACTORS)], axis=1) + 1e-5 * model.factors[used]
            model.bias -= rate * wrong.sum()
            for name, gradient in (("linear", linear), ("factors", factors)):
                seen[name][used] += gradient**2
                getattr(model, name)[used] -= 4 * rate * gradient / np.sqrt(seen[name][used])
    return model


def features(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` without its text, with word buckets, values and statistics."""
    keep = [f for f in docs.schema if f.name not in (text, length)]
    names = [f.name for f in keep]
    schema = T.StructType([
        *keep, T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("statistics", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_state("quality_words", dict)
        for batch, texts in slices(batches, text):
            bucket, values, counts, statistics = inputs(texts, batch.column(length).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), lists_of(bucket, counts), lists_of(values, counts), lists_of(statistics.reshape(-1), [statistics.shape[1]] * len(texts))],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, most_inputs: int = SAMPLE_INPUTS, key: str = "doc_id", text: str = "text", length: str = "n_chars", label: str = "quality") -> list:
    """Inputs of labelled texts, chosen by a hash of id, text and length: of each label at most
    ``sample_rows`` texts, and of these as many as have ``most_inputs`` word buckets together."""
    marks = labels.filter(F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("mark"))
    # Only ids and hashes are shuffled to meet the labels; repeated rows are one.
    there = docs.select(key, F.xxhash64(text, length).alias("version")).distinct().join(marks, key)
    there = there.withColumn("draw", F.xxhash64(F.col(key).cast("string"), "version", F.lit(13)))
    chosen = fewest(there, "mark", "draw", sample_rows, key, "version")
    # At most two times sample_rows ids: the bound makes the broadcast safe.
    rows = docs.select(key, text, length).withColumn("version", F.xxhash64(text, length)).join(F.broadcast(chosen), [key, "version"])
    made = features(rows.dropDuplicates([key, "version"]), text, length)
    upto = F.sum(F.size("buckets")).over(Window.partitionBy("mark").orderBy("draw", key, "version").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = made.withColumn("upto", upto).filter(F.col("upto") <= most_inputs).orderBy("mark", "draw", "upto").select("mark", "buckets", "values", "statistics").toArrow()
    lists = [[part.as_py() if name == "mark" else part.values.to_numpy() for part in found.column(name)] for name in ("mark", "buckets", "values", "statistics")]
    return list(zip(*lists))


def score(docs: DataFrame, model: FactorisationMachine | None, text: str = "text", length: str = "n_chars", cut: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``cut`` on)."""
    keep = [f for f in docs.schema if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_state("quality_words", dict)
        for batch, texts in slices(batches, text):
            if model is None:
                found = np.full(len(texts), 0.5)
            else:
                bucket, values, counts, statistics = inputs(texts, batch.column(length).to_pylist(), memory)
                logit, _ = model.logits(*model.rows(bucket, values, counts, statistics), len(texts))
                found = logistic(logit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, learnable: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on a sample of ``learnable`` rows with ``labels`` and score ``docs``."""
    samples = sample(learnable, labels)
    return score(docs, train(samples) if len({s[0] for s in samples}) == 2 else None)
