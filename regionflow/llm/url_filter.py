"""Operator 11: allow or block URLs by rules, and by gradient-boosted trees beyond them.

A rule names a host and a path; it fits the host with its subdomains where the URL's path
starts with the rule's, and the longest one decides. URLs that a rule decides are the
labelled ones: trees over lexical features learn from them and judge all others.

Features are lengths, depth, digit ratio, entropy, parameter counts, other counts of signs,
and statistics of suffixes: how often URLs with the same last host labels, the same first
path segment or the same file ending were blocked. Suffixes are hashed to ``BUCKETS``, so
the statistics stay bounded while they count every labelled URL. Half of the labelled URLs
(by a hash of the URL) gives these statistics and the other half a bounded sample for the
trees, so no URL meets its own label among its inputs.

Defined cases: a null URL or one without ``://`` has an empty host and path; no rule with a
host fits it and the trees judge what text there is. Copies of a URL fall on the same side
and get equal scores. Where the sample holds one label alone, every other URL gets that
verdict; without any labelled URL, ``allow``. Very long URLs are read whole. Further
columns are carried along; ones that clash with an added column give way to it.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import fewest, slices

#: Bound of the training sample: URLs per label.
SAMPLE = 5000
#: Hash buckets of each kind of suffix.
BUCKETS = 1 << 12
SUFFIXES = ("last label", "last two labels", "first segment", "ending")
#: A suffix's share is drawn to the overall share by so many imagined URLs.
PRIOR = 10.0
COUNTS = (
    "length", "host length", "path length", "query length", "depth", "host labels", "longest segment", "digit ratio",
    "host digit ratio", "entropy", "host entropy", "parameters", "hyphens", "underscores", "percent signs", "capitals",
    "dots in path", "signs", "fragment", "secure",
)
BINS = 32
ADDED = ("host", "path", "rule", "verdict", "score")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A to Z are lower-cased."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. For lists of up to some hundred rules."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    ]
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, nothing)


def entropy(texts: list[str]) -> np.ndarray:
    """Bits per byte of each text, by its own byte frequencies."""
    raw = [t.encode(errors="replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    keys, counts = np.unique(np.repeat(np.arange(len(raw)), sizes) << 8 | np.frombuffer(b"".join(raw), np.uint8), return_counts=True)
    owner = keys >> 8
    share = counts / sizes[owner]
    return np.bincount(owner, -share * np.log2(share), len(raw))


def lexical(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per URL its counts, and the hashed place of each of its suffixes."""
    rows, places, hosts = [], [], []
    for url in urls:
        head, _, rest = url.partition("://")
        before, mark, fragment = (rest or head).partition("#")
        before, _, query = before.partition("?")
        host, _, tail = before.partition("/")
        host = host.lower()
        segments = [s for s in tail.split("/") if s]
        labels = host.split(".")
        last = segments[-1] if segments and not tail.endswith("/") else ""
        ending = last.rpartition(".")[2] if "." in last else ("/" if tail.endswith("/") else "")
        digits = sum(map(url.count, string.digits))
        host_digits = sum(map(host.count, string.digits))
        rows.append((
            len(url), len(host), len(tail), len(query), len(segments), len(labels), max(map(len, segments), default=0), digits / max(len(url), 1),
            host_digits / max(len(host), 1), 0.0, 0.0, query.count("&") + bool(query), url.count("-"), url.count("_"), url.count("%"),
            sum(map(url.count, string.ascii_uppercase)), tail.count("."), sum(map(url.count, "=@~!$+,;:")), len(mark), head == "https",
        ))
        suffixes = (labels[-1], ".".join(labels[-2:]), segments[0] if segments else "", ending)
        places.append([k * BUCKETS + zlib.crc32(s.encode(errors="replace")) % BUCKETS for k, s in enumerate(suffixes)])
        hosts.append(host)
    counts = np.array(rows, np.float64).reshape(len(urls), len(COUNTS))
    counts[:, COUNTS.index("entropy")] = entropy(urls)
    counts[:, COUNTS.index("host entropy")] = entropy(hosts)
    return counts, np.array(places, np.int64).reshape(len(urls), len(SUFFIXES))


@dataclass
class SuffixStatistics:
    """Blocked and all labelled URLs of each hashed suffix."""

    blocked: np.ndarray
    total: np.ndarray

    def inputs(self, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
        n = max(self.total[:BUCKETS].sum(), 1)
        overall = self.blocked[:BUCKETS].sum() / n
        share = (self.blocked[places] + PRIOR * overall) / (self.total[places] + PRIOR)
        return np.concatenate([counts, share, np.log1p(self.total[places])], axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth: node ``k`` has children ``2k+1`` and ``2k+2``."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: larger values go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1."""
        logit = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            logit += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms of binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    logit = np.full(len(y), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        gradient, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            here = node - first
            sums = np.empty((2, width, nodes, BINS))
            for f in range(width):
                key = here * BINS + binned[:, f]
                sums[0, f] = np.bincount(key, gradient, nodes * BINS).reshape(nodes, BINS)
                sums[1, f] = np.bincount(key, curve, nodes * BINS).reshape(nodes, BINS)
            left = np.cumsum(sums, axis=3)
            whole = left[:, :, :, -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            for k in range(nodes):
                f, b = np.unravel_index(gain[:, k].argmax(), (width, BINS))
                if gain[f, k, b] > 1e-9 and b < len(edges[f]):
                    model.feature[t, first + k], model.above[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.above[t, node])
        at = node - inner
        model.leaf[t] = -rate * np.bincount(at, gradient, leaves) / (np.bincount(at, curve, leaves) + ridge)
        logit += model.leaf[t][at]
    return model


@dataclass
class Judge:
    statistics: SuffixStatistics
    trees: Trees | None
    #: The verdict's probability where there are no trees.
    constant: float

    def score(self, urls: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.constant)
        return self.trees.score(self.statistics.inputs(*lexical(urls)))


def suffix_statistics(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> SuffixStatistics:
    """Counts over all of ``labelled``, added up per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(SUFFIXES) * BUCKETS
        bad, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch, urls in slices(batches, url):
            _, places = lexical(urls)
            marks = np.repeat(batch.column(blocked).to_numpy(zero_copy_only=False).astype(np.float64), len(SUFFIXES))
            total += np.bincount(places.reshape(-1), minlength=size)
            bad += np.bincount(places.reshape(-1), marks, size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bad[used]), pa.array(total[used])], names=["place", "bad", "total"])

    found = labelled.select(url, blocked).mapInArrow(run, "place long, bad long, total long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    statistics = SuffixStatistics(np.zeros(len(SUFFIXES) * BUCKETS), np.zeros(len(SUFFIXES) * BUCKETS))
    # At most BUCKETS rows of each kind of suffix.
    for r in found.collect():
        statistics.blocked[r["place"]], statistics.total[r["place"]] = r["bad"], r["total"]
    return statistics


def learn(labelled: DataFrame, sample_rows: int = SAMPLE, url: str = "url", blocked: str = "blocked") -> Judge:
    """Fit on rows (url, blocked 0 or 1); rows where either is null are no labels."""
    rows = labelled.filter(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("blocked"))
    half = F.pmod(F.xxhash64("url", F.lit(23)), F.lit(2))
    statistics = suffix_statistics(rows.filter(half == 0))
    chosen = fewest(rows.filter(half == 1), "blocked", F.xxhash64("url", F.lit(29)), sample_rows, "url").select("url", "blocked").collect()
    chosen = sorted((r["url"], r["blocked"]) for r in chosen)
    y = np.array([b for _, b in chosen], np.float64)
    if len(np.unique(y)) < 2:
        return Judge(statistics, None, float(y[0]) if len(y) else 0.0)
    return Judge(statistics, train(statistics.inputs(*lexical([u for u, _ in chosen])), y), 0.0)


def score(pages: DataFrame, judge: Judge, url: str = "url") -> DataFrame:
    """``pages`` with ``score``, the probability that a URL is to be blocked."""
    keep = [f for f in pages.schema if f.name != "score"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, urls in slices(batches, url):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(judge.score(urls))], names=[*names, "score"])

    return pages.select(*names).mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def ruled(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; the last two null where no rule fits."""
    keep = [c for c in pages.columns if c not in ADDED]
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return parts.withColumn("by_rule", decided(F.col("host"), F.col("path"), rules)).select(*keep, "host", "path", "by_rule.*")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", cut: float = 0.5) -> DataFrame:
    """Every page with host, path, rule, verdict and the trees' score; the rules label what the trees learn from."""
    found = ruled(pages, rules, url)
    labelled = found.filter("verdict is not null").select(F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("blocked"))
    own = F.when(F.col("score") >= cut, "block").otherwise("allow")
    return score(found, learn(labelled), url).withColumn("verdict", F.coalesce("verdict", own))
