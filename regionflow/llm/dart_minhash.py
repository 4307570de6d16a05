"""Operator 5: near-duplicate texts by DartMinHash.

A text is the weighted set of its five-word shingles; a shingle that occurs c times
weighs 1 + ln c. Above each shingle lies a plane of weight and rank, cut into dyadic
regions. A region gets a Poisson number of darts, all fixed by a hash of shingle and
region; a text sees the darts under its weights, about k ln k of the lowest ranks in
all, and keeps the earliest dart per coordinate. Two texts agree in a coordinate with
the probability of their weighted Jaccard similarity, sum of minima over sum of maxima.

Equal weighted sets are one class first. Bands of coordinates are joined: every member of
a bucket is verified against the bucket's first one on the whole texts, and links are
followed. Buckets that still hold several components are taken in tiles: by signature,
members with a likely partner in another component are found, each pair in the first
band it shares; then their whole weighted sets are compared by matrix products, and only
the spanning links leave a tile. So rows stay in proportion to the members. A pair that
shares a band is left unverified if it is joined already, or if its signatures agree in
less than ``PLAUSIBLE``: at similarity 0.8 that adds 9e-6 of pairs to the bands' 7e-6.

Defined cases: a text of one to four words is one shingle of all its words; null texts
and texts without words are alone. Repeated rows are documents each; the kept row of a
group is the one with the smallest id, and of equal ids one. Without an id a document
takes part, but its group is named by the ids that exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import join_facts, lists_of, reachable, slices, tiled, whole_runs, worker_state
from regionflow.llm.near_vectors import forest
from regionflow.session import cut_lineage, temporary_tables

SIMILARITY = 0.8
SHINGLE = 5
#: At similarity 0.8 a pair shares none of the bands with probability 7e-6.
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
#: Signatures that agree in less than this share are no candidates: 4.6 deviations below 0.8.
PLAUSIBLE = 0.65
#: Members of a bucket that are compared at once.
TILE = 512
#: Partners of a text that are verified in one part.
PARTNERS = 1024
#: Ranks start with a region of this height.
RANK = 2.0**-4
MEMORY = 300_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values from 64-bit values (the public splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, *salt: int) -> np.ndarray:
    for s in salt:
        x = mixed(x + np.uint64(int(MIX[2]) * (s + 1) % 2**64))
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def weighted_shingles(texts: list[str], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of every distinct shingle, by text and shingle."""
    split = [t.split() for t in texts]
    new = set().union(*split).difference(memory)
    if len(memory) + len(new) > MEMORY and memory:
        memory.clear()
        new = set().union(*split)
    memory.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((memory[w] for s in split for w in s), np.uint64, int(n_words.sum()))
    n_shingles = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    first = np.cumsum(n_words) - n_words
    at = np.repeat(first - (np.cumsum(n_shingles) - n_shingles), n_shingles) + np.arange(len(owner))
    length = np.minimum(n_words, SHINGLE)[owner]
    hashes = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        there = length > k
        hashes[there] = mixed(hashes[there] * MIX[2] + words[at[there] + k] + np.uint64(k))
    # Text in the upper 20 bits, 44 bits of the shingle below.
    keys, counts = np.unique(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20), return_counts=True)
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), 1 + np.log(counts)



def cumulative(mean: float) -> np.ndarray:
    """Distribution function of the Poisson law up to where it is one."""
    n = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n)))))
    return np.cumsum(np.exp(-mean + np.arange(n) * np.log(mean) - logs))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k values of the earliest darts; a text without shingles has zeros."""
    total = np.bincount(owner, weight, n)
    found = np.zeros((n, k), np.uint32)
    wanted = k * (np.log(k) + 3)
    pending = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[pending] = wanted / total[pending]
    tables: dict[float, np.ndarray] = {}
    while len(pending):
        chosen = np.zeros(n, bool)
        chosen[pending] = True
        mine = chosen[owner]
        o, s, w = owner[mine], shingle[mine], weight[mine]
        earliest = np.full(n * k, np.inf)
        slots, ranks, names = [], [], []
        low_w, high_w, band = 0.0, 1.0, 0
        while True:
            heavy = np.flatnonzero(w > low_w) if band else np.arange(len(w))
            if not len(heavy):
                break
            low_r, high_r, level = 0.0, RANK, 0
            at = heavy
            while True:
                at = at[limit[o[at]] > low_r]
                if not len(at):
                    break
                area = (high_w - low_w) * (high_r - low_r)
                seed = salted(s[at], band, level)
                if area not in tables:
                    tables[area] = cumulative(area)
                darts = np.searchsorted(tables[area], uniform(seed), side="right")
                hit = np.repeat(np.arange(len(at)), darts)
                if len(hit):
                    nth = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
                    dart = mixed(seed[hit] + MIX[0] * (nth + 1).astype(np.uint64))
                    rank = low_r + (high_r - low_r) * uniform(dart)
                    spot = low_w + (high_w - low_w) * uniform(mixed(dart ^ MIX[1]))
                    doc = o[at[hit]]
                    good = (spot < w[at[hit]]) & (rank < limit[doc])
                    name = mixed(dart[good] ^ MIX[2])
                    slot = doc[good] * k + (name % np.uint64(k)).astype(np.int64)
                    np.minimum.at(earliest, slot, rank[good])
                    slots.append(slot)
                    ranks.append(rank[good])
                    names.append((name >> np.uint64(32)).astype(np.uint32))
                low_r, high_r, level = high_r, 2 * high_r, level + 1
            low_w, high_w, band = high_w, 2 * high_w, band + 1
        values = np.zeros(n * k, np.uint32)
        for slot, rank, name in zip(slots, ranks, names):
            won = rank == earliest[slot]
            values[slot[won]] = name[won]
        full = np.isfinite(earliest.reshape(n, k)).all(axis=1)
        done = pending[full[pending]]
        found[done] = values.reshape(n, k)[done]
        pending = pending[~full[pending]]
        limit[pending] *= 2  # an empty coordinate: look at later darts too
    return found


def in_parts(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, most: int = 256) -> np.ndarray:
    """``signatures`` of a few texts at a time: the darts in memory grow with the texts, however short they are."""
    edges = np.searchsorted(owner, np.arange(0, n + most, most))
    parts = [
        signatures(owner[a:b] - k * most, shingle[a:b], weight[a:b], min(most, n - k * most))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return np.concatenate(parts) if parts else np.zeros((0, COORDINATES), np.uint32)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, h, k1, k2, sig) per text: row number, hash of the text, hashes of the weighted
    set (null without words), signature. Written out."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_state("shingle_words", dict)
        row = TaskContext.get().partitionId() << 40
        for batch, texts in slices(batches, text):
            n = len(texts)
            owner, shingle, weight = weighted_shingles(texts, memory)
            values = in_parts(owner, shingle, weight, n)
            there = np.bincount(owner, minlength=n) > 0
            sums = []
            for salt in (101, 102):
                each = salted(shingle ^ (weight * 2**20).astype(np.uint64) << np.uint64(44), salt)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
                ends = np.searchsorted(owner, np.arange(n), side="right")
                begins = np.searchsorted(owner, np.arange(n), side="left")
                sums.append(pa.array((total[ends] - total[begins]).view(np.int64), mask=~there))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(key), batch.column("h"), *sums, lists_of(values.view(np.int32).reshape(-1), [COORDINATES] * n)],
                names=["row", key, "h", "k1", "k2", "sig"],
            )
            row += n

    slim = docs.select(key, F.xxhash64(text).alias("h"), text)
    return cut_lineage(slim.mapInArrow(run, f"row long, `{key}` {kind}, h long, k1 long, k2 long, sig array<int>"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets of sorted shingles."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of the given nodes."""
    wanted = nodes.join(classes.select("node", "id", "h"), "node")
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    met = wanted.join(source, F.col("id").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash")))
    # Repeated rows of one text would repeat a node.
    return met.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Pairs (a, b) of classes whose whole texts reach the similarity. Written out."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut_lineage(texts_of(nodes, classes, docs, key, text))
    # A text with many partners is met in parts, by a hash of the partner.
    often = cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("partners")).withColumn("parts", F.ceil(F.col("partners") / PARTNERS).cast("long")))
    dealt = join_facts(pairs, often, ["a"], "partners").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(often, "a")
    first = first.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(first, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_state("shingle_words", dict)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good, last, held = [], None, None
            for k in range(batch.num_rows):
                wanted = [batch.column("text_b")[k].as_py()] + ([batch.column("text_a")[k].as_py()] if a[k] != last else [])
                owner, shingle, weight = weighted_shingles(wanted, memory)
                if len(wanted) == 2:
                    last, held = a[k], (shingle[owner == 1], weight[owner == 1])
                if similarity(held, (shingle[owner == 0], weight[owner == 0])) >= least - 1e-12:
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in good], pa.int64()) for x in (a, b)], names=["a", "b"])

    return cut_lineage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def likely(members: DataFrame) -> DataFrame:
    """(bucket, node): members of a bucket (bucket, band, node, root, sig) with a partner in
    another component whose signature agrees often enough, and in no earlier band."""
    names = ["bucket", "low", "high"]
    tiles = tiled(members, ["bucket"], "node", TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(batches, names):
            bucket, node, root, side, band = (table.column(c).to_numpy() for c in ("bucket", "node", "root", "side", "band"))
            alone = table.column("low").to_numpy() == table.column("high").to_numpy()
            values = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            found = np.zeros(len(node), bool)
            for at, size in zip(starts.tolist(), sizes.tolist()):
                for x in range(at, at + size - 1):
                    y = np.arange(x + 1, at + size)
                    y = y[(root[y] != root[x]) & (alone[x] | (side[y] != side[x]))]
                    if not len(y):
                        continue
                    same = values[y] == values[x]
                    good = same.mean(axis=1) >= PLAUSIBLE
                    if good.any():
                        shared = same[good].reshape(-1, BANDS, ROWS).all(axis=2)
                        mine = y[good][shared.argmax(axis=1) == band[x]]
                        if len(mine):
                            found[x] = True
                            found[mine] = True
            yield pa.RecordBatch.from_arrays([pa.array(bucket[found]), pa.array(node[found])], names=["bucket", "node"])

    return tiles.select(*names, "side", "band", "node", "root", "sig").mapInArrow(run, "bucket long, node long").distinct()


def weighted_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, weights) of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_state("shingle_words", dict)
        for batch, some in slices(batches):
            owner, shingle, weight = weighted_shingles(some, memory)
            counts = np.bincount(owner, minlength=len(some))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists_of(shingle.view(np.int64), counts), lists_of(weight, counts)], names=["node", "shingles", "weights"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>, weights array<double>")


def similarities(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """n x n similarities of weighted sets: sums of minima as matrix products of who
    reaches each weight, so many shingles at once."""
    total = np.bincount(owner, weight, n)
    _, column, often = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column, weight = owner[shared], column[shared], weight[shared]
    least, below = np.zeros((n, n)), 0.0
    for level in np.unique(weight):
        reach = weight >= level
        _, place = np.unique(column[reach], return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, row = place[order], owner[reach][order]
        for start in range(0, int(place[-1]) + 1, width):
            a, b = np.searchsorted(place, (start, start + width))
            member = np.zeros((n, width), np.float32)
            member[row[a:b], place[a:b] - start] = 1
            least += (level - below) * (member @ member.T)
        below = level
    return least / np.maximum(total[:, None] + total[None, :] - least, 1e-300)


def spanning_links(members: DataFrame, least: float) -> DataFrame:
    """(a, b): links that span each tile's members (bucket, node, root, shingles, weights) of
    different components whose whole weighted sets reach the similarity."""
    names = ["bucket", "low", "high"]
    tiles = tiled(members, ["bucket"], "node", TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_runs(batches, names):
            node, root = (table.column(c).to_numpy() for c in ("node", "root"))
            shingles, weights = (table.column(c).combine_chunks() for c in ("shingles", "weights"))
            ends = shingles.offsets.to_numpy()
            ends = ends - ends[0]
            flat, weight = shingles.flatten().to_numpy(), weights.flatten().to_numpy()
            a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, size in zip(starts.tolist(), sizes.tolist()):
                lo, hi = ends[at], ends[at + size]
                owner = np.repeat(np.arange(size), np.diff(ends[at : at + size + 1]))
                near = similarities(owner, flat[lo:hi], weight[lo:hi], size) >= least - 1e-12
                mine = root[at : at + size]
                a, b = np.nonzero(np.triu(near & (mine[:, None] != mine[None, :]), 1))
                if len(a):
                    reached = forest(size, a, b)
                    tied = np.flatnonzero(reached != np.arange(size))
                    a_all.append(node[at + reached[tied]])
                    b_all.append(node[at + tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_all)), pa.array(np.concatenate(b_all))], names=["a", "b"])

    return tiles.select(*names, "node", "root", "shingles", "weights").mapInArrow(run, "a long, b long")


def near_texts(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, cluster_id, kept) per document: its group's smallest id, and whether it stays."""
    with temporary_tables(docs.sparkSession) as keep:
        rows = signed(docs, key, text)
        first = F.min(F.struct("row", F.col(key).alias("id"), "h", "sig")).alias("f")
        # A missing id sorts last, so that an existing one names the group.
        head = F.min(F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("cluster_id"), F.col("row").alias("stays"))).alias("head")
        classes = cut_lineage(
            rows.filter("k1 is not null").groupBy("k1", "k2").agg(first, head, F.count("*").alias("copies"))
            .select("k1", "k2", F.col("f.row").alias("node"), "f.id", "f.h", "f.sig", "head", "copies")
        )
        # Buckets: one hash per band of coordinates.
        keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])
        banded = cut_lineage(classes.select("node", F.posexplode(keys).alias("band", "bucket")))
        buckets = cut_lineage(banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("size")).filter("size > 1").drop("size"))
        shared = banded.join(buckets, "bucket")
        stars = cut_lineage(shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct())
        linked = verified(stars, classes, docs, key, text, least)
        roots = reachable(linked)
        # What the first members left open.
        placed = cut_lineage(shared.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root")))
        open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
        members = placed.join(open_buckets, "bucket").join(classes.select("node", "sig"), "node")
        left = cut_lineage(likely(members))
        sets = cut_lineage(weighted_sets(texts_of(left.select("node").distinct(), classes, docs, key, text)))
        again = left.join(placed.select("bucket", "node", "root"), ["bucket", "node"]).join(sets, "node")
        linked = linked.unionByName(spanning_links(again, least))
        roots = reachable(linked)
        # Each class learns its group's head, then each row its class's; hot groups and copies are looked up.
        own = classes.select("k1", "k2", "node", "head", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = cut_lineage(own.select("k1", "k2", "root", "head", "copies"))
        heads = cut_lineage(own.groupBy("root").agg(F.min("head").alias("head"), F.count("*").alias("classes")).select("root", "head.cluster_id", "head.stays", "classes"))
        known = cut_lineage(join_facts(own.select("k1", "k2", "root", "copies"), heads, ["root"], "classes").drop("root"))
        placed_rows = join_facts(rows.select("row", key, "h", "k1", "k2"), known, ["k1", "k2"], "copies")
        alone = F.col("k1").isNull()
        result = placed_rows.select(
            key, "h", F.when(alone, F.col(key)).otherwise(F.col("cluster_id")).alias("cluster_id"), (alone | (F.col("row") == F.col("stays"))).alias("kept")
        )
        return keep(result)


def without_copies(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group."""
    # Keys without null, so that one shuffle serves the join and the repeated rows.
    match = {"near_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "near_null": F.col(key).isNull()}
    kept = near_texts(docs, least, key, text).filter("kept").withColumns(match).select(*match, F.col("h").alias("near_hash"))
    marked = docs.withColumns(match | {"near_hash": F.xxhash64(text)})
    names = [*match, "near_hash"]
    return marked.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
