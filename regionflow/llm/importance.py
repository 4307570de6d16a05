"""Operator 12: resampling of documents by importance towards a target corpus.

Words come from Arrow's kernels over whole batches: ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode``. Runs of n words are built from shifted
dictionary indices; the hash of a run is worked out once per distinct run of a batch, and
goes on from the hash of its first n - 1 words. Counts per bucket of all documents and of
all target texts give a whole-numbered gain per bucket; a document's weight is the floored
mean of its features' gains, taken by index and summed by segments.

A key drawn by a hash of the id (Gumbel noise, in thousandths) turns weights into a draw
without replacement of the highest scores. A score lies within about 60,000 of zero, so
ranks come from the number of rows per score: these counts are bounded, and rows are
ordered only within their score.

Defined cases: a null or empty text has no word, no feature and weight 0. Null ids are
hashed as an empty text. Rows that share an id share the noise, are drawn one by one, and
rank next to each other in any order. An empty table gives no rows; an empty target counts
nothing. Further columns of the documents are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import slices
from regionflow.session import cut_lineage

BUCKETS = 10_000
#: Everything in ASCII but digits and letters parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Dictionary indices of all words in order, the dictionary, and the number of words per text."""
    # A fresh array: ascii_lower misreads the offsets of a slice that was cast.
    split = pc.split_pattern_regex(pc.ascii_lower(pa.array(texts, pa.large_string())), pattern=BETWEEN)
    flat = pc.list_flatten(split)
    owner = pc.list_parent_indices(split).to_numpy()
    # A separator at either end of a text leaves an empty piece there.
    there = pc.greater(pc.binary_length(flat), 0)
    coded = pc.dictionary_encode(flat.filter(there))
    counts = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return coded.indices.to_numpy().astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()], counts


def features(texts: list[str], longest: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words, text by text, with the runs and the words per text."""
    index, dictionary, counts = words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    run = index
    crcs = np.fromiter(map(zlib.crc32, dictionary), np.int64, len(dictionary))
    owners, found = [owner], [crcs[run] % buckets]
    size = max(len(dictionary), 1)
    for shift in range(1, longest):
        # The run before and the word after it; only those within one text are kept.
        pairs = run[:-1] * size + index[shift:]
        inside = owner[: len(pairs)] == owner[shift:]
        distinct, run = np.unique(pairs, return_inverse=True)
        crcs = np.fromiter((zlib.crc32(b" " + dictionary[p % size], int(crcs[p // size])) for p in distinct.tolist()), np.int64, len(distinct))
        owners.append(owner[: len(run)][inside])
        found.append((crcs[run] % buckets)[inside])
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(counts)), counts


def bucket_counts(rows: DataFrame, longest: int = 1, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket; a task sends one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in slices(batches, text):
            total += np.bincount(features(texts, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    # One row per bucket at most.
    for r in rows.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source."""
    size = len(source)
    t, s = target.astype(np.float64), source.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def noise(ids: list[str], seed: int) -> np.ndarray:
    """Thousandths of Gumbel noise from each id's hash."""
    import hashlib

    h = np.fromiter((int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in ids), np.float64, len(ids))
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, n_words, weight, score) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            bucket, n_features, n_words = features(texts, longest, len(gain))
            taken = np.concatenate(([0], np.cumsum(gain.take(bucket))))
            ends = np.cumsum(n_features)
            weight = (taken[ends] - taken[ends - n_features]) // np.maximum(n_features, 1)
            score = weight + noise(["" if i is None else str(i) for i in batch.column(key).to_pylist()], seed)
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, (n_features, n_words, weight, score))], names=[key, "n_features", "n_words", "weight", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_features long, n_words long, weight long, score long")


def draw(scored: DataFrame, key: str, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank`` among the drawn share of rows with ``least_words``; null elsewhere."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    # One row per score: bounded by the range of scores, whatever the number of rows.
    per_score = sorted(((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in per_score) // 100
    reached, before = [], 0
    for score, n in per_score:
        if before >= wanted:
            break
        reached.append((score, before))
        before += n
    undrawn = F.lit(None).cast("long")
    if not reached:
        return scored.withColumn("rank", undrawn)
    offsets = spark.createDataFrame(reached, "score long, before long")
    lowest = reached[-1][0]
    columns = scored.columns
    # Repeated rows are one row with a number until they are ranked.
    rows = scored.filter(able & (F.col("score") >= lowest)).groupBy(*columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), *[c for c in columns if c not in (key, "score")])
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("upto", upto).join(F.broadcast(offsets), "score")
    ranks = F.explode(F.sequence(F.col("before") + F.col("upto") - F.col("copies") + 1, F.col("before") + F.col("upto")))
    ranked = placed.withColumn("rank", ranks).select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    others = scored.filter(~(able & (F.col("score") >= lowest))).withColumn("rank", undrawn)
    return others.unionByName(ranked)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024,
    key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, n_words, weight, score, rank) of every document; ``percent`` of the able ones have a rank."""
    gain = gains(bucket_counts(docs, longest, text, buckets), bucket_counts(target, longest, text, buckets))
    return draw(cut_lineage(weigh(docs, gain, longest, seed, key, text)), key, percent, least_words)
