"""Operator 9: language ID by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over windows of fixed length, each
filter's largest answer goes into a softmax. Training is numpy on a bounded sample of
labelled windows; scoring reads every window of every text, in batches inside tasks, and
averages the windows' probabilities by their bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0. The sample is
drawn per language by a hash of id and text, so row order does not matter; a repeated row
counts as often as it is there.
Without any labelled row every text is ``und``. Further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import fewest, slices

#: Bytes in a window.
LENGTH = 256
#: Bound of the training sample: windows per language.
SAMPLE = 2000
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCnn:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # widest * EMBEDDING x all filters; a narrow filter's tail is zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Each place's embedded bytes, as many as the widest filter reads."""
        embedded = self.embedding[windows]
        n, length, size = embedded.shape
        wide = max(WIDTHS)
        s = embedded.strides
        view = np.lib.stride_tricks.as_strided(embedded, (n, length - wide + 1, wide * size), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self.patches(windows)
        answers = patches.reshape(-1, patches.shape[2]) @ self.filters
        answers = answers.reshape(patches.shape[0], patches.shape[1], -1)
        best = answers.argmax(axis=1)
        top = np.take_along_axis(answers, best[:, None, :], axis=1)[:, 0] + self.bias
        return np.maximum(top, 0), best, patches

    def probabilities(self, windows: np.ndarray, block: int = 32) -> np.ndarray:
        found = np.empty((len(windows), len(self.bias)), np.float32)
        for k in range(0, len(windows), block):
            patches = self.patches(windows[k : k + block])
            answers = patches.reshape(-1, patches.shape[2]) @ self.filters
            found[k : k + block] = answers.reshape(patches.shape[0], patches.shape[1], -1).max(axis=1)
        return softmax(np.maximum(found + self.bias, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], epochs: int = 10, batch: int = 64, rate: float = 0.003, seed: int = 7) -> ByteCnn:
    """Fit on (language, text window) pairs. Windows are cut at random lengths, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    languages = sorted({s[0] for s in samples})
    index = {name: k for k, name in enumerate(languages)}
    data = np.zeros((len(samples), LENGTH), np.uint8)
    for k, (_, text) in enumerate(samples):
        raw = text.encode()[:LENGTH]
        data[k, : len(raw)] = np.frombuffer(raw, np.uint8)
    target = np.array([index[s[0]] for s in samples])
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide, EMBEDDING, n_filters), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(wide * EMBEDDING, n_filters)
    f32 = np.float32
    net = ByteCnn(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32), (rng.normal(0, 0.25, mask.shape) * mask).astype(f32),
        np.zeros(n_filters, f32), rng.normal(0, 0.1, (n_filters, len(languages))).astype(f32), np.zeros(len(languages), f32),
    )
    net.embedding[0] = 0
    parts = ["embedding", "filters", "bias", "out", "out_bias"]
    moments = {p: (np.zeros_like(getattr(net, p)), np.zeros_like(getattr(net, p))) for p in parts}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            windows = data[rows].copy()
            short = rng.random(len(rows)) < 0.4
            for r in np.flatnonzero(short):
                windows[r, rng.integers(12, LENGTH) :] = 0
            top, best, patches = net.features(windows)
            wrong = softmax(top @ net.out + net.out_bias)
            wrong[np.arange(len(rows)), target[rows]] -= 1
            wrong /= len(rows)
            back = (wrong @ net.out.T) * (top > 0)
            # Only the place of each filter's largest answer takes part.
            chosen = patches[np.arange(len(rows))[:, None], best]
            grads = {"out": top.T @ wrong, "out_bias": wrong.sum(0), "bias": back.sum(0), "filters": np.einsum("nf,nfp->pf", back, chosen) * mask}
            into = (back[:, :, None] * net.filters.T[None]).reshape(len(rows), n_filters, wide, EMBEDDING)
            bytes_at = windows[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(wide)]
            gradient = np.zeros_like(net.embedding)
            np.add.at(gradient, bytes_at.reshape(-1), into.reshape(-1, EMBEDDING))
            gradient[0] = 0
            grads["embedding"] = gradient
            step += 1
            for p in parts:
                m, v = moments[p]
                m += 0.1 * (grads[p] - m)
                v += 0.001 * (grads[p] ** 2 - v)
                getattr(net, p)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def sample(docs: DataFrame, sample_rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "lang") -> list[tuple[str, str]]:
    """At most ``sample_rows`` windows of labelled texts per language, chosen by a hash of id and text."""
    draw = F.xxhash64(F.col(key).cast("string"), text, F.lit(11))
    start = 1 + F.pmod(draw, F.greatest(F.length(text) - LENGTH, F.lit(1)))
    windows = (
        docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
        .select(F.col(label).alias("label"), draw.alias("draw"), F.substring(text, start, F.lit(LENGTH)).alias("window"))
        .filter(F.col("window").rlike(r"\p{L}"))
    )
    chosen = fewest(windows, "label", "draw", sample_rows, "window")
    return sorted((r["label"], r["window"]) for r in chosen.select("label", "window").collect())


def predict(docs: DataFrame, net: ByteCnn | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from every window of every whole text."""
    keep = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            predicted, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [k for k, t in enumerate(texts) if LETTER.search(t)] if net else []
            if rows:
                raw = [texts[k].encode() for k in rows]
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                counts = -(-sizes // LENGTH)
                first = np.cumsum(counts) - counts
                windows = np.zeros(int(counts.sum()) * LENGTH, np.uint8)
                for a, r in zip((first * LENGTH).tolist(), raw):
                    windows[a : a + len(r)] = np.frombuffer(r, np.uint8)
                weight = np.full(len(windows) // LENGTH, float(LENGTH))
                weight[first + counts - 1] = sizes - (counts - 1) * LENGTH
                found = net.probabilities(windows.reshape(-1, LENGTH)) * weight[:, None]
                mean = np.add.reduceat(found, first, axis=0) / sizes[:, None]
                top = mean.argmax(axis=1)
                for k, j, p in zip(rows, top.tolist(), mean.max(axis=1).tolist()):
                    predicted[k], scores[k] = net.languages[j], min(1.0, max(0.0, p))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(predicted, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def identify(labelled: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Train on a sample of ``labelled`` and predict ``docs``."""
    samples = sample(labelled, key=key)
    return predict(docs, train(samples) if samples else None)
