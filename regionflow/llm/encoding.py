"""Operator 7: byte-pair encoding and decoding with a lower-casing word vocabulary.

Each pre-token is merged by ``segment_bpe``; a worker keeps the ids of the chunks
(runs between white space) it has seen, so frequent words are merged once.

Defined cases: a null or empty text has no ids and decodes to the empty text. Special
strings in a text become their special ids, as the tokenizers library does by default.
Repeated rows give repeated results; further columns are carried along unchanged.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regionflow.llm.common import lists_of, slices, worker_state
from regionflow.llm.segment_bpe import Merges

#: Chunks kept per worker; with more, the memory starts anew. Results do not depend on it.
MEMORY = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """The vocabulary file's merges, special strings and pre-token pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.pattern = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pairs = [(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(model["merges"])]
        self.merges = Merges(*zip(*pairs), max(self.names) + 1)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters])
        self.last = np.array([vocab[x + self.suffix] for x in letters])
        self.memory: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no exception)."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str]:
        """Chunks between white space; special strings are chunks of their own.

        A marker U+0000 before a special string keeps it apart from ordinary text.
        """
        if not any(s in text for s in self.special):
            return self.parted(self.normal(text))
        out = []
        for k, part in enumerate(self.splitter.split(text)):
            out += ["\0" + part] if k % 2 else self.parted(self.normal(part))
        return out

    @staticmethod
    def parted(text: str) -> list[str]:
        # str.split also parts at four control characters that are no white space here.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in regex.split(r"\s+", text) if x]
        return text.split()

    def learn(self, new: list[str]) -> None:
        """Encode unseen chunks, all their pre-tokens side by side."""
        new = list(new)
        for c in [c for c in new if c[0] == "\0" and c[1:] in self.special]:
            ident = self.special[c[1:]]
            self.memory[c] = (np.int32(ident).tobytes(), c[1:])
        new = [c for c in new if c not in self.memory]
        words = [self.pattern.findall(c) for c in new]
        coded = [w.encode("utf-8", "surrogatepass") for w in itertools.chain.from_iterable(words)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        flat = self.inner[raw]
        ends = np.cumsum(lengths)
        if len(ends):
            flat[ends - 1] = self.last[raw[ends - 1]]
        ids, kept = self.merges.merge_all(flat, lengths)
        ids = ids.astype(np.int32)
        per_chunk = np.fromiter(map(len, words), np.int64, len(words))
        word_ends = np.concatenate(([0], np.cumsum(kept)))
        chunk_ends = word_ends[np.concatenate(([0], np.cumsum(per_chunk)))].tolist()
        raw_ids, names = ids.tobytes(), list(map(self.names.__getitem__, ids.tolist()))
        for c, a, b in zip(new, chunk_ends, chunk_ends[1:]):
            self.memory[c] = (raw_ids[4 * a : 4 * b], " ".join(names[a:b]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text its ids (int32) and the decoded text."""
        parts = [self.chunks(t) for t in texts]
        new = set().union(*parts).difference(self.memory)
        if len(self.memory) + len(new) > MEMORY and self.memory:
            self.memory.clear()
            new = set().union(*parts)
        if new:
            self.learn(list(new))
        found = self.memory
        out = []
        for p in parts:
            got = [found[c] for c in p]
            # A chunk without pre-tokens (none exists in this pattern) would add nothing.
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the columns ``ids`` (array of int) and ``decoded`` (the text read back)."""
    keep = [f for f in docs.schema if f.name not in (ids, decoded)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(f"word_bpe:{path}", lambda: WordBpe(path))
        for batch, texts in slices(batches, text):
            got = bpe.encode(texts)
            flat = np.frombuffer(b"".join([g[0] for g in got]), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), lists_of(flat, [len(g[0]) // 4 for g in got]), pa.array([g[1] for g in got], pa.string())],
                names=[*names, ids, decoded],
            )

    return docs.mapInArrow(run, schema)
