"""Operator 1: packing by non-negative least squares over a length histogram.

Documents are cut at the window; whole windows stand alone and the last piece of each
document is packed. All combinations of up to three lengths that fill the window are
enumerated, a projected accelerated gradient solves for non-negative repeat counts that
reproduce the histogram of those pieces, the counts are rounded against what is left,
and the residual pieces are packed greedily, best fit first. The histogram has at most
``window`` entries and the plan at most a few per combination, so both are bounded by
the window alone, whatever the number of documents.

Defined cases: a null or empty text is one piece holding only the end id. Repeated rows,
and rows with equal ids, are packed each on its own. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import slices, worker_state
from regionflow.llm.encoding import byte_letters
from regionflow.session import cut_lineage

WINDOW = 1024
#: Pieces of one length are ranked in this many parts, so that no length is one task.
PARTS = 1024
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of the vocabulary file, as the tokenizers library gives them.

    In this kind of vocabulary an id is also its merge's rank, so a rank encoder gives
    the same ids several times faster. It is used only where that is proven: the ids
    must follow the merges, and each block of characters must come out alike from both
    encoders. All other texts, and those with special strings, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        made = [model["vocab"][a + b] for a, b in model["merges"]]
        self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unproven = re.compile("[^" + "".join(f"{chr(a)}-{chr(a + 255)}".replace("\\", "\\\\") for a in self.alike()) + "]") if made == sorted(made) else re.compile("")

    def alike(self) -> list[int]:
        """Starts of the blocks of 256 characters that both encoders take alike."""
        starts = [a for a in range(0, 0x10000, 256) if not 0xD800 <= a < 0xE000]
        blocks = ["".join(f"a{c}{c} {c}1\n{c}" for c in map(chr, range(a, a + 256))) for a in starts]
        return [a for a, block, ids in zip(starts, blocks, self.library(blocks)) if self.ranked(block) == ids]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ranked(self, text: str) -> bytes:
        return np.fromiter(self.by_rank.encode_ordinary(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        apart = [k for k, t in enumerate(texts) if self.unproven.search(t) or any(s in t for s in self.special)]
        skip = set(apart)
        out = [b"" if k in skip else self.ranked(t) for k, t in enumerate(texts)]
        for k, ids in zip(apart, self.library([texts[k] for k in apart])):
            out[k] = ids
        return out


def cut(docs: DataFrame, path: str, window: int = WINDOW, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (row, key, start, length, doc_tokens, ids), written out; ``row`` tells rows apart."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField(key, kind), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(f"byte_bpe:{path}", lambda: ByteBpe(path))
        tail = np.array([end], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch, texts in slices(batches, text):
            keys = batch.column(key)
            at, rows, starts, lengths, totals, ids = [], [], [], [], [], []
            for k, got in enumerate(bpe.encode(texts)):
                got += tail
                for a in range(0, len(got), 4 * window):
                    piece = got[a : a + 4 * window]
                    at.append(k)
                    rows.append(row)
                    starts.append(a // 4)
                    lengths.append(len(piece) // 4)
                    totals.append(len(got) // 4)
                    ids.append(piece)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), keys.take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return cut_lineage(docs.select(key, text).mapInArrow(run, schema), compression="zstd")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of the given lengths that sum to the window; c = 0 for pairs."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there[1:]) + 1, np.flatnonzero(there[1:]) + 1, indexing="ij")
    c = window - a - b
    good = (a >= b) & (c >= 0) & (c <= b)
    good[good] = there[c[good]]
    return np.stack([a[good], b[good], c[good]], axis=1)


def repeats(combos: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings A x near ``wanted``; A counts each length in each combination."""
    size = len(wanted)
    used = combos > 0

    def forward(x):
        return sum(np.bincount(combos[:, k], np.where(used[:, k], x, 0.0), size) for k in range(3))

    def back(r):
        r = np.where(np.arange(size) > 0, r, 0.0)
        return r[combos].sum(axis=1)

    x = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        x = back(forward(x))
        x /= np.linalg.norm(x)
    step = 1.0 / (1.02 * np.linalg.norm(back(forward(x))))
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - wanted))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Ranges: pieces of ``length`` ranked from ``first`` on, ``count`` of them, go to the
    sequences from ``sequence`` on, at ``offset``. Sorted by length and first rank."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_for(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The packing plan for so many pieces of each length below the window."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    done = np.zeros(window + 1, np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, count: int, sequence: int, offset: int) -> None:
        entries.append((length, int(done[length]), count, sequence, offset))
        done[length] += count
        left[length] -= count

    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        total = left.sum()
        x = repeats(combos, left / total) * total
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.25:
                break
            need: dict[int, int] = defaultdict(int)
            for n in combos[k]:
                need[int(n)] += 1
            need.pop(0, None)
            count = min(int(np.ceil(x[k])), *(int(left[n]) // m for n, m in need.items()))
            if count > 0:
                offset = 0
                for n in combos[k]:
                    if n:
                        take(int(n), count, sequences, offset)
                        offset += int(n)
                sequences += count
    # Residual: longest first into the open sequences with the least room that suffices.
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of sequences
    for n in range(window, 0, -1):
        while left[n]:
            room = next((r for r in range(n, window) if rooms[r]), None)
            if room is None:
                start, count, room = sequences, -(-int(left[n]) // (window // n)), window
                sequences += count
            else:
                start, count = rooms[room].pop()
            used = min(count, int(left[n]))
            take(n, used, start, window - room)
            if room > n:
                rooms[room - n].append((start, used))
            if count > used:
                rooms[room].append((start + used, count - used))
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def place(pieces: DataFrame, window: int = WINDOW, parts: int = PARTS) -> DataFrame:
    """(row, start, sequence_id, offset) for every piece that ``cut`` wrote."""
    spark = pieces.sparkSession
    ends = pieces.filter(F.col("start") + F.col("length") == F.col("doc_tokens")).select(
        "row", "length", F.floor(F.col("doc_tokens") / window).alias("full"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")
    )
    sizes = cut_lineage(ends.groupBy("length", "part").agg(F.count("*").alias("n"), F.sum("full").alias("full")))
    histogram = {r[0]: r[1] for r in sizes.filter(F.col("length") < window).groupBy("length").agg(F.sum("n")).collect()}
    plan = plan_for(histogram, window)

    # Rank of each last piece among those of its length, and whole windows before its row.
    before = sizes.select(
        "length", "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("n_before"),
    )
    full = sizes.groupBy("part").agg(F.sum("full").alias("full")).select(
        "part", (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("full_before")
    )
    in_part = Window.partitionBy("part").orderBy("row")
    ranked = (
        ends.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1)
        .withColumn("windows", F.sum("full").over(in_part) - F.col("full"))
        .join(before, ["length", "part"])
        .join(full, "part")
        .select("row", "length", (F.col("rank") + F.col("n_before")).alias("rank"), (F.col("windows") + F.col("full_before")).alias("windows"))
    )
    shared = spark.sparkContext.broadcast(plan)
    schema = "row long, windows long, sequence long, offset long"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p.length * (1 << 44) + p.first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            if len(keys):
                at = np.maximum(np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1, 0)
                sequence, offset = p.sequence[at] + rank - p.first[at], p.offset[at]
            else:
                sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("windows"), pa.array(sequence), pa.array(offset)], names=["row", "windows", "sequence", "offset"])

    placed = ranked.mapInArrow(look_up, schema)
    whole = F.col("length") == window
    return pieces.select("row", "start", "length").join(placed, "row").select(
        "row", "start",
        F.when(whole, plan.sequences + F.col("windows") + F.floor(F.col("start") / window)).otherwise(F.col("sequence")).cast("long").alias("sequence_id"),
        F.when(whole, 0).otherwise(F.col("offset")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = 0, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and where each lies: (row, start, sequence_id, offset)."""
    pieces = cut(docs, path, window, end, key, text)
    return pieces, place(pieces, window)


def sequences(pieces: DataFrame, placed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, length, ids): training rows, padded to the window unless a power of two long.

    A sequence holds at most ``window`` ids, so its list of pieces is bounded.
    """
    parts = pieces.join(placed, ["row", "start"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length")
    )
    blank = bytes(np.full(window, pad, "<u4").tobytes())
    joined = F.aggregate("parts", F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"]))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    padded = F.when(power, F.col("all")).otherwise(F.substring(F.concat(F.col("all"), F.lit(blank)), 1, 4 * window))
    return parts.withColumn("all", joined).select("sequence_id", "length", padded.alias("ids"))
