"""Each stage of the pipeline, row by row, against a plain version of it."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from regionflow.llm import personal_data, queries
from tests.llm.test_texts import SF, groups, plain_spans

STAGES = dict(corpus_pipeline.STAGES)
COPY, TWIN = 10**6, 2 * 10**6


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, some with a near copy (one word more) or an equal one, and odd rows."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.orderBy("doc_id").limit(150).collect()]
    at, text = table.columns.index("doc_id"), table.columns.index("text")

    def like(row, ident, words):
        return (*row[:at], ident, *row[at + 1 : text], words, *row[text + 1 :])

    rows += [like(r, r[at] + COPY, r[text] + " once") for r in rows[::3]] + [like(r, r[at] + TWIN, r[text]) for r in rows[::10]]
    odd = [None, "", "123 456", "$$$ @@@ " * 40, "call +1 (555) 555-1234 or a.b@mail.example.com " * 3]
    rows += [like(rows[0], 3 * COPY + k, t) for k, t in enumerate(odd)]
    return spark.createDataFrame(rows, table.schema).repartition(5).cache()


def kept(spark, name, docs):
    made = STAGES[name](spark, docs, SF)
    assert made.columns == docs.columns
    return sorted((tuple(r) for r in made.collect()), key=repr)


def those(docs, wanted):
    return sorted((tuple(r) for r in docs.collect() if r["doc_id"] in wanted), key=repr)


def test_language_drops_the_unknown_alone(spark, docs):
    found = queries.identified(spark, SF, docs).collect()
    wanted = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert 0 < len(wanted) < docs.count() == len(found)
    assert kept(spark, "language", docs) == those(docs, wanted)


def test_quality_drops_the_bad_alone(spark, docs):
    found = queries.scored_quality(spark, SF, docs).collect()
    wanted = {r["doc_id"] for r in found if r["score"] >= 0.3}
    assert 0 < len(wanted) < docs.count() == len(found)
    assert kept(spark, "quality", docs) == those(docs, wanted)


def test_near_duplicates_drop_copies_alone(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    least = groups([r["text"] for r in rows])
    wanted = {r["doc_id"] for k, r in enumerate(rows) if least[k] == k}
    assert len(wanted) <= len(rows) - 60
    assert kept(spark, "near_duplicates", docs) == those(docs, wanted)


def test_personal_data_keeps_rows_and_changes_spans_alone(spark, docs):
    spans = {r["doc_id"]: r["found"] for r in personal_data.find(docs, personal_data.learn(docs)).collect()}
    expected = []
    for r in docs.collect():
        row, text = r.asDict(), r["text"]
        for s in sorted(spans[r["doc_id"]], key=lambda s: -s["start"]):
            text = text[: s["start"]] + f"<{s['kind'].upper()}>" + text[s["end"] :]
        if spans[r["doc_id"]]:
            row |= {"text": text, "n_chars": len(text)}
        assert not plain_spans(text or "")
        # Base kinds are never told where no pattern is.
        assert all(s["kind"] not in personal_data.BASE for s in spans[r["doc_id"]]) or plain_spans(r["text"])
        expected.append(tuple(row.values()))
    assert any(spans.values()) and not all(spans.values())
    assert kept(spark, "personal_data", docs) == sorted(expected, key=repr)


def test_packing_has_every_token_of_every_row(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, lies = defaultdict(list), defaultdict(list)
    for r in STAGES["packing"](spark, docs, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        lies[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == {r["doc_id"] for r in docs.collect()}
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        end = 0
        for start, n, crc, total in sorted(pieces[r["doc_id"]]):
            assert start == end and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            end += n
        assert end == len(ids)
    for at in lies.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end
            end += n
        assert end <= 1024
