"""Operator 13: how far the sources of a language diverge in their terms.

Terms are counted per (language, source) by 64-bit digests: counts travel with digests
alone. Text comes back late. A second pass over the documents keeps, per digest, the
smallest and the largest of its terms; where the two differ, several terms share the
digest, and a third pass counts the terms of these digests apart, by their text.
So results are exact for digests of any width.

Each language keeps the terms of at least ``least_docs`` of its documents. A share is
p = 1 + floor(scale * (count + add) / (N + add * V)) for V kept terms with N occurrences. Two
sources are compared over all kept terms, in tiles of terms and of sources: a tile adds up
what its terms change against two sources that hold none of them, so absent terms cost
nothing. A source's most over-used terms are cut by value before their text is joined.

Defined cases: null text, language or source is the empty one. A group without terms takes
part with zero counts. Without kept terms all pair values are 0. Repeated rows are
documents each. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import slices
from regionflow.session import cut_lineage

#: Letters of ASCII, and everything beyond it; on UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Distinct terms a task holds before it hands them on.
HELD = 300_000
#: Terms and sources of a tile.
TILE_TERMS = 2048
TILE_SOURCES = 64


def digest(term: Column, bits: int = 64) -> Column:
    """A term's digest; fewer bits than 64 only make collisions."""
    whole = F.xxhash64(term)
    return whole if bits == 64 else F.pmod(whole, F.lit(1 << bits))


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per task, added up where memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                        pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                        pa.array([in_docs[t] for t in n], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch, texts in slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms = TERM.findall(text.encode().lower())
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from hand_on()
        yield from hand_on()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def distinct_terms(docs: DataFrame) -> DataFrame:
    """(term): each term at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string())], names=["term"])
            held.clear()
            return out

        for _, texts in slices(batches):
            for text in texts:
                held.update(TERM.findall(text.encode().lower()))
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    return docs.select("text").mapInArrow(run, "term string")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, digest, part, of_lang): terms of at least ``least_docs`` documents of a language."""
    sums = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs"))
    return sums.filter(F.col("docs") >= least_docs).drop("docs")


def group_counts(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, part, n, docs) and the dictionary (digest, term).

    ``part`` is empty but for digests of several terms, where it is the term.
    """
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    merged = cut_lineage(
        counted_terms(docs).select("lang", "source", digest(F.col("term"), bits).alias("digest"), "n", "docs")
        .groupBy("lang", "source", "digest").agg(*sums).select("lang", "source", "digest", F.lit("").alias("part"), "n", "docs")
    )
    # Dealt out by digest first, so that each term travels once and not as both ends.
    terms = distinct_terms(docs).withColumn("digest", digest(F.col("term"), bits)).repartition("digest")
    ends = cut_lineage(terms.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    shared = cut_lineage(ends.filter("term <> last").select("digest"))
    dictionary = ends.select("digest", "term")
    if shared.isEmpty():
        return merged, dictionary
    apart = (
        counted_terms(docs).withColumn("digest", digest(F.col("term"), bits)).join(shared, "digest", "left_semi")
        .groupBy("lang", "source", "digest", F.col("term").alias("part")).agg(*sums)
    )
    return cut_lineage(merged.join(shared, "digest", "left_anti").select(apart.columns).unionByName(apart)), dictionary


def share(count: Column, total: Column, kept: Column, add: int, scale: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * kept)) in whole numbers."""
    part = F.lit(scale).cast("decimal(19,0)") * (count + add).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, (total + add * kept).cast("decimal(19,0)"))


def source_distances(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of every two sources of a language.

    ``rows`` are the shares of terms that a source holds, ``facts`` has every source with
    its share of absent terms (``absent``) and the number of kept terms (``kept``).
    """
    sources = facts.groupBy("lang").agg(F.count("*").alias("sources"))
    sized = facts.join(cut_lineage(sources), "lang").withColumn("blocks", F.ceil(F.col("sources") / TILE_SOURCES).cast("long"))
    sized = cut_lineage(sized.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("tiles", F.ceil(F.col("kept") / TILE_TERMS).cast("long")))
    held = rows.select("lang", "source", "digest", "part", "p").join(sized.select("lang", "source", "absent", "block", "blocks", "tiles"), ["lang", "source"])
    held = held.withColumn("tile", F.pmod(F.xxhash64("digest", "part"), F.col("tiles"))).drop("tiles")
    # Every source is told to every tile of terms, as its absent terms differ from others' held ones.
    told = sized.filter("tiles > 0").select(
        "lang", "source", F.lit(None).cast("long").alias("digest"), F.lit("").alias("part"), F.col("absent").alias("p"), "absent", "block", "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"),
    )
    laid = held.unionByName(told).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    laid = laid.select("lang", "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "source", "digest", "part", "p", "absent")

    def run(table: pa.Table) -> pa.Table:
        names, row = np.unique(np.array(table.column("source").to_pylist(), object), return_inverse=True)
        # A term's column is by digest and part, so that terms of one digest stay apart.
        terms = list(zip(table.column("digest").to_pylist(), table.column("part").to_pylist()))
        column = {t: k for k, t in enumerate(dict.fromkeys(t for t in terms if t[0] is not None))}
        own = np.array([k for k, t in enumerate(terms) if t[0] is not None], np.int64)
        at = np.fromiter((column[terms[k]] for k in own), np.int64, len(own))
        absent = np.zeros(len(names), np.int64)
        absent[row] = table.column("absent").to_numpy()
        block = np.zeros(len(names), np.int64)
        block[row] = table.column("block").to_numpy()
        p = np.repeat(absent[:, None], len(column), axis=1)
        p[row[own], at] = table.column("p").to_numpy()[own]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first, second, value = [], [], []
        for a in np.flatnonzero(block == low):
            b = np.flatnonzero(block == high) if low != high else np.arange(a + 1, len(names))
            first += [names[a]] * len(b)
            second += names[b].tolist()
            value += (np.abs(p[a] - p[b]).sum(axis=1) - len(column) * np.abs(absent[a] - absent[b])).tolist()
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

    met = laid.groupBy("lang", "tile", "low", "high").applyInArrow(run, "lang string, a string, b string, value long")
    met = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # Pairs of sources are the result; a salt deals those of a large language out.
    parts = 64
    one = sized.select("lang", F.col("source").alias("a"), F.col("absent").alias("of_a"), "kept", F.pmod(F.xxhash64("source"), F.lit(parts)).alias("deal"))
    other = sized.select("lang", F.col("source").alias("b"), F.col("absent").alias("of_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("deal"))
    pairs = one.join(other, ["lang", "deal"]).filter("a <> b")
    value = F.coalesce("value", F.lit(0)) + F.col("kept") * F.abs(F.col("of_a") - F.col("of_b"))
    return pairs.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, add: int = 5, scale: int = 1_000_000_000, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and the terms a source over-uses most."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, dictionary = group_counts(docs, bits)
    kept = cut_lineage(kept_terms(counts, least_docs))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("in_lang"))
    held = cut_lineage(counts.drop("docs").join(kept, ["lang", "digest", "part"]))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    facts = docs.select("lang", "source").distinct().join(cut_lineage(of_group), ["lang", "source"], "left").join(cut_lineage(of_lang), "lang", "left")
    facts = facts.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_group", "kept", "in_lang")])
    absent = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("in_group"), F.col("kept"), add, scale)).otherwise(0)
    facts = cut_lineage(facts.withColumn("absent", absent))
    rows = held.join(facts, ["lang", "source"]).select(
        "lang", "source", "digest", "part", "absent", "kept",
        share(F.col("n"), F.col("in_group"), F.col("kept"), add, scale).alias("p"),
        share(F.col("of_lang"), F.col("in_lang"), F.col("kept"), add, scale).alias("q"),
    )
    rows = cut_lineage(rows)
    distances = source_distances(rows.drop("q"), facts)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    over = rows.filter("p > q").select("lang", "source", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("place", F.rank().over(by_value)).filter(F.col("place") <= top)
    named = over.join(dictionary, "digest").withColumn("item", F.when(F.col("part") == "", F.col("term")).otherwise(F.col("part")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def part(found: DataFrame, name: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(distances, "pair").unionByName(part(named, "term").filter(F.col("rank") <= top))
