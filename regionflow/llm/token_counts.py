"""Operator 8: token counts with the whole-token shortcut.

Offline, every vocabulary string that starts a word is encoded alone; those that come
out as one token are proven and counted directly. Two facts read off the vocabulary let
the rest be counted in small units: no piece has a word mark after another character,
so nothing merges across a word's start; and two neighbouring characters that stand
together in no piece never end up in one token. Only units left over are merged.

Defined cases: null and empty texts count 0 tokens and 0 bytes. Control strings inside a
text are ordinary text. Repeated rows give repeated counts; further columns are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import slices, worker_state
from regionflow.llm.segment_bpe import Merges

#: Word mark of the vocabulary.
MARK = "▁"
#: Chunks kept per worker; with more, the memory starts anew. Results do not depend on it.
MEMORY = 1_000_000


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = [i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
        skip = set(odd)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if i not in skip}
        if any(MARK in p.strip(MARK) or (p.rstrip(MARK) != p and p.strip(MARK)) for p in pieces):
            raise ValueError("a piece has a word mark after another character")
        letters = sorted({c for p in pieces for c in p})
        symbol = {c: k for k, c in enumerate(letters)}
        for p in pieces:
            symbol.setdefault(p, len(symbol))
        rank = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rows = [(symbol[p[:k]], symbol[p[k:]], rank[pieces[p]], symbol[p]) for p in pieces for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.merges = Merges(*zip(*rows), len(symbol))
        # Tokens of a symbol that is left: one, or its bytes where it is no piece.
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbol], np.int64)
        self.codes = np.array([ord(c) for c in letters])
        together = sorted({(ord(p[k]) << 32) | ord(p[k + 1]) for p in pieces for k in range(len(p) - 1)})
        self.together = np.array(together, np.int64)
        whole = [p for p in pieces if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        counts = self.merged(whole)
        self.proven = {p[1:]: 1 for p, n in zip(whole, counts) if n == 1}
        self.memory = dict(self.proven)

    def merged(self, units: list[str]) -> list[int]:
        """Tokens of each unit, a run of word marks with what follows it."""
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, points), len(self.codes) - 1)
        flat = np.where(self.codes[at] == points, at, -1)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        first = np.zeros(len(points), bool)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        key = (points[:-1] << 32) | points[1:]
        near = np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)
        first[1:] |= self.together[near] != key
        starts = np.flatnonzero(first)
        ids, kept = self.merges.merge_all(flat, np.diff(np.append(starts, len(points))))
        # A character outside the vocabulary stays alone, so its bytes are its tokens.
        cost = np.where(ids >= 0, self.cost[np.maximum(ids, 0)], 0)
        ends = np.concatenate(([0], np.cumsum(cost)))[np.concatenate(([0], np.cumsum(kept)))]
        per_point = np.zeros(len(points) + 1, np.int64)
        per_point[starts] = np.diff(ends)
        per_point[:-1] += np.where(flat < 0, sizes, 0)
        total = np.concatenate(([0], np.cumsum(per_point)))
        stops = np.cumsum(lengths)
        return (total[stops] - total[stops - lengths]).tolist()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """What follows each word mark; a further mark before it stays in the chunk."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return [u[1:] for u in re.findall(r" +[^ ]*", " " + text)] if "" in parts else parts

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.chunks(t) for t in texts]
        new = set().union(*parts).difference(self.memory)
        if len(self.memory) + len(new) > MEMORY and len(self.memory) > len(self.proven):
            self.memory = dict(self.proven)
            new = set().union(*parts).difference(self.memory)
        if new:
            new = list(new)
            self.memory.update(zip(new, self.merged([MARK + c.replace(" ", MARK) for c in new])))
        found = self.memory
        return [sum([found[c] for c in p]) for p in parts]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in docs.schema if f.name not in added]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"piece_counts:{path}", lambda: PieceCounter(path))
        for batch, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counter.count(texts), pa.int64())], names=[*names, "n_tokens"])

    counted = docs.drop(*added).mapInArrow(run, schema)
    return counted.select(
        *names, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
