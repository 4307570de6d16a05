"""Operator 2: near-duplicate embeddings by spherical-cap filters.

A filter is a direction made of one code word from each of two random codebooks, after a
random rotation; a vector passes all filters whose direction it exceeds a cap height
with. The height lets ``MEAN_PASSED`` filters through on average; as the number varies much between
vectors, a vector with fewer than ``PASSED`` lowers its cap until so many pass. List decoding
finds all of them from the two halves' scores alone. Vectors that share a filter, and a
label, are verified by their cosine in double precision. At similarity 0.98 one code misses 0.01 of pairs at most (measured on planted
pairs; 0.006 at 64 components and 4096 words, less with fewer words), and codes are
independent, so three miss one in a million at most. Short vectors take fewer words, as
their caps would else become smaller than the least similarity is wide.

Equal vectors are one class before filtering. Ids meet filters first, and only filters with
two vectors or more are kept; vectors are fetched for these alone. A filter with many vectors is split into
tiles of bounded size; inside a tile pairs are counted by matrix products, each pair in
the least filter it shares, and only the tile's spanning links leave it. So neither a
task nor a row count holds all pairs of a hot group.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without label or id, link with nothing and keep their row. Vectors link only
with others of equal length. Repeated rows are vectors each, with a row each; unlike
vectors of one id are apart. Labels of any type are compared by a 64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import join_facts, reachable, tiled, whole_runs
from regionflow.llm.top_k import usable
from regionflow.session import cut_lineage, temporary_tables

SIMILARITY = 0.98
#: Independent codes, and filters a vector passes in each.
CODES, PASSED = 3, 10
#: Filters above the fixed cap height, on average.
MEAN_PASSED = 5
#: Filters per vector of the table, which bounds the vectors in a filter on average.
FILTERS_PER_VECTOR = 8.0
#: Beyond FILTERS_PER_VECTOR * rows = MOST_WORDS ** 2 (2 million vectors) filters hold more vectors
#: each; more words keep them small, but one code then misses more pairs and decoding costs more.
LEAST_WORDS, MOST_WORDS = 32, 4096
#: Most words at 8 components; each five components more double them.
SHORT_WORDS = 128
#: Vectors of a filter that are compared at once.
TILE = 512
#: Runs up to this size are compared as lists of pairs, all runs of a batch together.
SHORT = 32


class CapCode:
    """Rotation, two codebooks and cap height for one dimension."""

    def __init__(self, dim: int, words: int, seed: int):
        self.size = max(8, dim + dim % 2)
        rng = np.random.default_rng([seed, self.size, words])
        self.rotation = np.linalg.qr(rng.normal(size=(self.size, self.size)))[0]
        half = self.size // 2
        books = rng.normal(size=(2, words, half))
        # Each half of a direction carries half of its square length.
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(2)
        self.words = words
        grid = np.linspace(-1, 1, 200_001)
        density = np.maximum(0, 1 - grid**2) ** ((self.size - 3) / 2)
        above = np.cumsum(density[::-1])[::-1] / density.sum()
        self.height = float(grid[np.argmax(above <= min(0.5, MEAN_PASSED / words**2))])

    def own_heights(self, first: np.ndarray, second: np.ndarray, passed: int) -> np.ndarray:
        """For each row of the halves' scores the height that ``passed`` filters reach."""
        # The n-th best filter is made of words with places x * y <= n in their halves' order.
        most = min(passed, self.words)
        best = [-np.sort(np.partition(-half, most - 1, axis=1)[:, :most], axis=1) for half in (first, second)]
        place = np.arange(1, most + 1)
        x, y = np.nonzero(place[:, None] * place <= passed)
        sums = best[0][:, x] + best[1][:, y]
        return np.partition(sums, sums.shape[1] - passed, axis=1)[:, sums.shape[1] - passed]

    def decode(self, unit: np.ndarray, passed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a unit vector exceeds the cap height with.

        With ``passed`` the height of each vector is at most what so many filters reach.
        """
        padded = np.zeros((len(unit), self.size))
        padded[:, : unit.shape[1]] = unit
        turned = padded @ self.rotation
        half = self.size // 2
        first, second = turned[:, :half] @ self.books[0].T, turned[:, half:] @ self.books[1].T
        height = np.full(len(unit), self.height) if passed is None else np.minimum(self.height, self.own_heights(first, second, passed))
        # A word can take part only if the other half's best word lifts it over the cap.
        a_row, a_word = np.nonzero(first + second.max(axis=1, keepdims=True) >= height[:, None])
        b_row, b_word = np.nonzero(first.max(axis=1, keepdims=True) + second >= height[:, None])
        n_b = np.bincount(b_row, minlength=len(unit))
        b_start = np.cumsum(n_b) - n_b
        many = n_b[a_row]
        left = np.repeat(np.arange(len(a_row)), many)
        right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b_start[a_row], many)
        row, x, y = a_row[left], a_word[left], b_word[right]
        good = first[row, x] + second[row, y] >= height[row]
        return row[good], x[good] * self.words + y[good]


def words_for(rows: int) -> int:
    """Code words per half, so that the number of filters follows the number of vectors."""
    return int(min(MOST_WORDS, max(LEAST_WORDS, np.ceil(np.sqrt(rows * FILTERS_PER_VECTOR)))))


def most_words(dim: int) -> int:
    """The most words by which one code misses 0.01 of pairs at most."""
    return int(min(MOST_WORDS, SHORT_WORDS * 2 ** (max(0, dim - 8) / 5)))


def decode(classes: DataFrame, words: int) -> DataFrame:
    """(id, label, dim, filter): every filter of every one of ``classes`` (id, label, dim, v), over all codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[CapCode]] = {}
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            own = [batch.column(c).to_numpy() for c in ("id", "label", "dim")]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                unit = flat[starts[at][:, None] + np.arange(dim)]
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                made = codes.setdefault(int(dim), [CapCode(int(dim), min(words, most_words(int(dim))), k) for k in range(CODES)])
                for c, code in enumerate(made):
                    for k in range(0, len(at), 256):
                        row, found = code.decode(unit[k : k + 256], PASSED)
                        row = at[k + row]
                        yield pa.RecordBatch.from_arrays([*(pa.array(o[row]) for o in own), pa.array(found * CODES + c)], names=["id", "label", "dim", "filter"])

    return classes.select("id", "label", "dim", "v").mapInArrow(run, "id long, label long, dim long, filter long")


def shared_filters(passed: DataFrame) -> DataFrame:
    """(id, filters): of each vector its filters that another one passes too, by rising filter, with their sizes."""
    keys = ["label", "dim", "filter"]
    sizes = cut_lineage(passed.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1"))
    # A list holds what one vector passes: about CODES * PASSED filters.
    return passed.join(sizes, keys).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("filter", "size"))).alias("filters"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place it reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def common_before(filters_a: np.ndarray, filters_b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether each pair of padded filter lists shares a filter less than ``here``."""
    out = np.zeros(len(here), bool)
    step = max(1, 20_000_000 // max(1, filters_a.shape[1] * filters_b.shape[1]))
    for k in range(0, len(here), step):
        a, b = filters_a[k : k + step, :, None], filters_b[k : k + step, None, :]
        out[k : k + step] = ((a == b) & (a >= 0) & (a < here[k : k + step, None, None])).any(axis=(1, 2))
    return out


def padded(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), max(1, sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Comparison:
    """Links of one run of vectors that share a filter."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def tile(self, unit, side, filters, here):
        """(a, b) places of linked pairs whose least shared filter is this one."""
        n = len(unit)
        linked = np.triu(unit @ unit.T >= self.similarity, 1)
        if side.any() and not side.all():
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.where((filters >= 0) & (filters < here), filters, -1)
        known, where = np.unique(before, return_inverse=True)
        member = np.zeros((n, len(known)), np.float32)
        member[np.repeat(np.arange(n), before.shape[1]), where.reshape(-1)] = 1
        member = member[:, known >= 0]
        if member.shape[1]:
            linked &= member @ member.T == 0
        return np.nonzero(linked)


def links(decoded: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n_a): from each tile its spanning links (n_a null), and link counts per vector (b null)."""
    # Where a pair counts is told by the filters before this one, so only these go along.
    spread = decoded.select("*", F.posexplode("filters").alias("place", "own"))
    before = F.transform(F.slice("filters", 1, F.col("place")), lambda f: f["filter"])
    spread = spread.select("id", "label", "dim", "n", "v", before.alias("filters"), "own.filter", "own.size")
    keys = ["label", "dim", "filter"]
    names = [*keys, "low", "high"]
    sorted_tiles = tiled(spread, keys, "id", TILE, "size")
    compare = Comparison(similarity)

    def finish(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        n = table.num_rows
        ids, weight = table.column("id").to_numpy(), table.column("n").to_numpy()
        side, here = table.column("side").to_numpy(), table.column("filter").to_numpy()
        alone = table.column("low").to_numpy() == table.column("high").to_numpy()
        filters = padded(table.column("filters").combine_chunks())
        column = table.column("v").combine_chunks()
        offsets = column.offsets.to_numpy()
        flat = column.flatten().to_numpy().astype(np.float64)
        dims = np.diff(offsets)
        units = np.zeros((n, int(dims.max(initial=1))))
        units[np.arange(units.shape[1]) < dims[:, None]] = flat
        units /= np.abs(units).max(axis=1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, SHORT + 1):
            begin = starts[sizes == size]
            x, y = np.triu_indices(size, 1)
            for k in range(0, len(begin), max(1, 200_000 // len(x))):
                at = begin[k : k + max(1, 200_000 // len(x))][:, None]
                a, b = (at + x).reshape(-1), (at + y).reshape(-1)
                good = np.einsum("ij,ij->i", units[a], units[b]) >= similarity
                a, b = a[good], b[good]
                apart = alone[a] | (side[a] != side[b])
                a, b = a[apart], b[apart]
                new = ~common_before(filters[a], filters[b], here[a])
                a_all.append(a[new])
                b_all.append(b[new])
        for at, size in zip(starts.tolist(), sizes.tolist()):
            if size > SHORT:
                a, b = compare.tile(units[at : at + size], side[at : at + size], filters[at : at + size], here[at])
                a_all.append(a + at)
                b_all.append(b + at)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        counts = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        root = forest(n, a, b)
        spanning, counted = np.flatnonzero(root != np.arange(n)), np.flatnonzero(counts)
        none = pa.nulls(len(counted), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[spanning], ids[counted]])),
                pa.concat_arrays([pa.array(ids[root[spanning]]), none]),
                pa.concat_arrays([pa.nulls(len(spanning), pa.int64()), pa.array(counts[counted].astype(np.int64))]),
            ],
            names=["a", "b", "n_a"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(batches, names):
            yield finish(table, starts, sizes)

    wanted = sorted_tiles.select(*names, "side", "id", "n", "v", "filters")
    return wanted.mapInArrow(run, "a long, b long, n_a long")


def near_vectors(rows: DataFrame, similarity: float = SIMILARITY, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    zero = ~F.exists(vector, lambda x: x != 0)
    good = F.coalesce(usable(key, vector) & ~zero, F.lit(False)) & F.col(label).isNotNull()
    mark = F.col(label).cast("long") if isinstance(rows.schema[label].dataType, T.IntegralType) else F.xxhash64(F.col(label).cast("string"))
    base = rows.select(F.col(key).alias("id"), F.when(good, mark).alias("label"), F.col(vector).alias("v"), good.alias("good"))
    # Two hashes make unequal vectors unequal classes.
    hashed = base.withColumn("h1", F.when(F.col("good"), F.xxhash64(F.lit(1), "v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(2), "v")))
    same = ["label", "h1", "h2"]
    with temporary_tables(rows.sparkSession) as keep:
        # Classes are named by their row, as unlike vectors may share an id.
        grouped = hashed.filter("good").groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
        classes = cut_lineage(grouped.withColumn("dim", F.size("v").cast("long")).withColumn("id", F.monotonically_increasing_id()))
        words = words_for(classes.count())
        passed = cut_lineage(decode(classes, words))
        decoded = classes.select("id", "label", "dim", "n", "v").join(shared_filters(passed), "id")
        found = cut_lineage(links(decoded, similarity))
        counts = found.filter("n_a is not null").groupBy("a").agg(F.sum("n_a").alias("others"))
        roots = reachable(found.filter("b is not null").select("a", "b"))
        placed = cut_lineage(
            classes.select(*same, "id", "least", "n")
            .join(counts.withColumnRenamed("a", "id"), "id", "left")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select(*same, "least", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
        )
        heads = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
        known = cut_lineage(join_facts(placed.drop("least"), heads, ["root"], "classes"))
        joined = join_facts(cut_lineage(hashed.select("id", *same)), known.drop("root"), same, "n")
        component = F.coalesce("component_id", "id")
        result = joined.select(
            F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
        return keep(result)
