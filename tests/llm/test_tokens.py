"""Operators 1, 7 and 8 against the tokenizer libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from regionflow.llm import encoding, packing, segment_bpe, token_counts

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = "abcABZ  ''0139.,;-\n\t▁éßü你好𝄞　\xa0\x1c\x00ΣςİÅ<>|/[]s"


def texts(n=400, seed=3):
    rnd = random.Random(seed)
    odd = [
        None, "", " ", "  a", "a  ", "<|endoftext|>x <|startoftext|> <|endoftext|>", "it's we'LL don't", "</s><s><unk>", "x" * 5000, "ab" * 3000,
        "the same", "the same", "word " * 3000, "\n\n \n",
    ]
    return odd + ["".join(rnd.choices(LETTERS, k=rnd.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"kept {k}", 7) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, ids string, n_tokens long").repartition(3).cache()


def test_word_bpe_equals_library(docs):
    library = Tokenizer.from_file(WORD)
    got = encoding.encode(docs, WORD).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids, r["text"]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_piece_counts_equal_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in token_counts.count_tokens(docs, PIECE, limit=1000).collect():
        text = r["text"] or ""
        assert r["n_tokens"] == len(library.encode(text)), text
        assert r["n_bytes"] == len(text.encode())
        assert r["over_limit"] == (r["n_tokens"] > 1000)


def test_whole_tokens_are_proven():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    proven = random.Random(1).sample(sorted(token_counts.PieceCounter(PIECE).proven), 500)
    assert all(len(library.encode(p)) == 1 for p in proven)


def test_trees_equal_plain_merging():
    rng = np.random.default_rng(0)
    table = {}
    while len(table) < 36:
        table.setdefault((int(rng.integers(0, 4 + len(table))), int(rng.integers(0, 4 + len(table)))), (len(table), 4 + len(table)))
    merges = segment_bpe.Merges([a for a, _ in table], [b for _, b in table], [r for r, _ in table.values()], [m for _, m in table.values()], 40)
    lengths = np.concatenate([rng.integers(0, 30, 300), [64, 65, 66, 150, 0]])
    flat = rng.integers(-1, 4, lengths.sum())
    out, kept = merges.merge_all(flat, lengths)
    start = at = 0
    for n, k in zip(lengths, kept):
        word = flat[start : start + n].tolist()
        while pairs := [(table[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in table]:
            i = min(pairs)[1]
            word[i : i + 2] = [table[word[i], word[i + 1]][1]]
        assert out[at : at + k].tolist() == word
        start, at = start + n, at + k


def test_packing_keeps_every_id_once(spark, docs):
    pieces, placed = packing.pack(docs, BYTE)
    rows = pieces.join(placed, ["row", "start"]).collect()
    library = Tokenizer.from_file(BYTE)
    held, lies = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["row"]].append((r["start"], bytes(r["ids"]), r["doc_id"], r["doc_tokens"]))
        lies[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) >= 0 and len(r["ids"]) == 4 * r["length"]
    assert len(held) == docs.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for parts in held.values():
        ids = [*library.encode(by_id[parts[0][2]], add_special_tokens=False).ids, 0]
        assert b"".join(p[1] for p in sorted(parts)) == np.array(ids, "<u4").tobytes()
        assert all(p[3] == len(ids) for p in parts)
    for at in lies.values():
        at.sort()
        assert [o for o, _ in at] == np.concatenate(([0], np.cumsum([n for _, n in at])[:-1])).tolist()
        assert sum(n for _, n in at) <= 1024
    for r in packing.sequences(pieces, placed).collect():
        n = r["length"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 1024)


def test_plan_fills_windows():
    rng = np.random.default_rng(4)
    lengths = np.minimum(1023, 1 + rng.exponential(300, 20_000).astype(int))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.plan_for(histogram)
    assert lengths.sum() / (1024 * plan.sequences) > 0.995
    taken, used = defaultdict(int), defaultdict(list)
    for n, first, count, sequence, offset in zip(plan.length, plan.first, plan.count, plan.sequence, plan.offset):
        assert taken[n] == first
        taken[n] += count
        for k in range(count):
            used[sequence + k].append((offset, n))
    assert dict(taken) == histogram
    for at in used.values():
        at.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0 and sum(at[-1]) <= 1024


def test_packing_of_one_length_and_of_nothing(spark):
    assert packing.plan_for({}).sequences == 0
    assert packing.plan_for({300: 10}).sequences == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    pieces, placed = packing.pack(empty, BYTE)
    assert pieces.join(placed, ["row", "start"]).count() == 0
    assert encoding.encode(empty, WORD).count() == token_counts.count_tokens(empty, PIECE).count() == 0
