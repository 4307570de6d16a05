"""The queries of operators as registered, on a small table folder: against their SQL in
full, or against libraries and plain code where there is none."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from regionflow.llm import personal_data, queries
from tests.llm.test_texts import groups, plain_spans

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    found = dict(zip(table.column("doc_id").to_pylist(), (t or "" for t in table.column("text").to_pylist())))
    assert len(found) == table.num_rows > 0
    return found


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got and got == Counter(cur.fetchall())


def test_packing(spark, texts):
    library = Tokenizer.from_file(BYTE)
    pieces, lies = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op1_packing"):
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        lies[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = {}
    for ident, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        cuts = [(start, length) for start, length, *_ in sorted(pieces[ident])]
        assert [s for s, _ in cuts] == np.cumsum([0, *(n for _, n in cuts)])[:-1].tolist() and sum(n for _, n in cuts) == len(ids)
        expected[ident] = [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cuts]
    assert {k: sorted(v) for k, v in pieces.items()} == expected
    for at in lies.values():
        at.sort()
        assert [o for o, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist() and sum(n for _, n in at) <= 1024


def test_near_texts(spark, texts):
    ids = sorted(texts)
    expected = {(i, ids[g], ids[g] == i) for i, g in zip(ids, groups([texts[i] for i in ids]))}
    got = [tuple(r) for r in rows_of(spark, "op5_near_texts")]
    assert len(got) == len(ids) and set(got) == expected


def test_bpe(spark, texts):
    library = Tokenizer.from_file(WORD)
    expected = {}
    for ident, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        expected[ident] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = rows_of(spark, "op7_bpe")
    assert len(got) == len(expected) and {r["doc_id"]: tuple(r)[1:] for r in got} == expected


def test_token_counts(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = rows_of(spark, "op8_token_counts")
    assert len(got) == len(texts)
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got}
    assert counted == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_personal_data(spark, texts):
    got = rows_of(spark, "op10_personal_data")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]]
        base = [(personal_data.BASE[kind], start, end) for start, kind, end in plain_spans(text)]
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(b[0] == k for b in base) for k in personal_data.BASE]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [tuple([k, int(s), int(e)]) for k, s, e in spans if k in personal_data.BASE] == base
        assert all(0 <= int(s) < int(e) <= len(text) for _, s, e in spans)
    assert any(r["spans"] for r in got)
