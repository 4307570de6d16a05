import random
import re
import time
import uuid
from collections import Counter

from pyspark.sql import functions as F

from regionflow.session import shared_dir, stream_settings
from regionflow.streaming import chunks, regions


def upper(batches):
    """Stub translator; breaks on one text, answers short on another."""
    return batches.select(
        "doc_id", "batch_idx",
        F.when(F.array_contains("texts", "short"), F.slice("texts", 1, F.size("texts") - 1))
        .otherwise(F.transform("texts", lambda t: F.concat(F.lit("T:"), t))).alias("translations"),
        F.when(F.array_contains("texts", "boom"), F.lit("503")).alias("error"),
    )


def expected_rows(docs, size):
    out = []
    for d, rows in docs.items():
        pending, n = [], 0

        def flush():
            nonlocal pending, n
            texts = [t for _, t in pending if t]
            tr = [f"T:{t}" for t in texts]
            if "short" in texts:
                tr = texts[:-1]
            k = 0
            for i, t in pending:
                if "boom" in texts:
                    got = "[TRANSLATE_ERROR]"
                elif not t:
                    got = ""
                else:
                    got = tr[k] if k < len(tr) else "[MISSING]"
                    k += 1
                out.append((d, i, t, got))
            pending, n = [], 0

        for i, (t, bad) in enumerate(rows):
            if bad:
                out.append((d, i, "[OCR_ERROR]", "[OCR_ERROR]"))
                continue
            pending.append((i, t))
            n += t != ""
            if n == size:
                flush()
        flush()
    return sorted(out)


def test_stream_matches_plain_order(spark):
    rnd = random.Random(5)
    docs = {
        d: [("" if rnd.random() < 0.3 else f"t{d}_{i}", rnd.random() < 0.05) for i in range(n)]
        for d, n in ((1, 0), (2, 3), (3, 23))
    }
    docs[3][4], docs[3][12] = ("boom", False), ("short", False)
    rows = [(d, i, i // 5, i % 5, t, bad, False) for d, r in docs.items() for i, (t, bad) in enumerate(r)]
    rows += [(d, len(r), -1, -1, "", d == 2, True) for d, r in docs.items()]
    rnd.shuffle(rows)
    for files in (1, 3):
        src, work = shared_dir(spark, "src"), shared_dir(spark, "work")
        spark.createDataFrame(rows, regions.REGION_INPUT).repartition(files).write.parquet(src)
        got = regions.run_region_stream(spark, src, work, upper, size=4, files_per_trigger=1)
        result = sorted(
            (r.doc_id, r.global_idx, r.original_text, r.translated_text)
            for r in got.filter("kind = 'result'").collect()
        )
        assert result == expected_rows(docs, 4)
        assert {r.doc_id: r.global_idx for r in got.filter("kind = 'complete'").collect()} == {
            d: len(r) for d, r in docs.items() if d != 2
        }
    events = regions.released_events(got).filter("kind <> 'result' AND doc_id < 3").orderBy("doc_id").collect()
    assert [e.event for e in events] == [
        'event: complete\ndata: {"stats":{"bubbles":0}}\n\n', 'event: error\ndata: {"error":"source failed"}\n\n',
    ]


def test_live_stages_release_while_regions_arrive(spark):
    asked = []

    def ocr(rows):
        asked.append([tuple(r) for r in rows.groupBy("ocr_batch").count().collect()])
        return rows.withColumn("text", F.concat(F.lit("read "), F.col("ocr_batch").cast("string")))

    src, work = shared_dir(spark, "live"), shared_dir(spark, "live-work")

    def arrive(rows):
        spark.createDataFrame(rows, regions.REGION_INPUT).coalesce(1).write.mode("append").parquet(src)

    def released(n):
        for _ in range(60):
            try:
                got = spark.read.schema(regions.RELEASED).parquet(f"{work}/released").collect()
            except Exception:
                got = []
            if len(got) >= n:
                break
            time.sleep(1)
        return sorted((r.kind, r.global_idx, r.translated_text) for r in got)

    def rows(*numbers):
        return [(1, k, 0, k, "", False, False) for k in numbers]

    arrive(rows(0, 1, 2, 3))
    running = regions.start_region_stream(spark, src, work, upper, size=2, stall_ms=None, state_partitions=2, ocr=ocr)
    try:
        # A nine is asked whole: over two micro-batches, and out of order.
        time.sleep(4)
        arrive(rows(8, 12, 6, 5, 11))
        time.sleep(3)
        assert released(0) == []
        arrive(rows(7, 4))
        assert released(8) == [("result", k, "T:read 0") for k in range(8)]
        arrive(rows(10, 9) + [(1, 13, -1, -1, "", False, True)])
        assert released(14) == sorted([("complete", 13, "")] + [("result", k, f"T:read {k // 9}") for k in range(13)])
        sizes = {}
        for part in asked:
            for batch in part:
                sizes.setdefault(batch[0], []).append(batch[1])
        assert sizes == {0: [9], 1: [4]}
    finally:
        for query in running:
            query.stop()


def test_a_micro_batch_is_made_once(spark, tmp_path, monkeypatch):
    """However often a stage's own work reads its micro-batch, the stateful step before it runs once."""
    calls, base = tmp_path / "steps", regions.RegionBatcher
    calls.mkdir()

    class Noting(base):
        def handleInputRows(self, key, rows, timerValues):
            (calls / uuid.uuid4().hex).touch()
            yield from base.handleInputRows(self, key, rows, timerValues)

    monkeypatch.setattr(regions, "batch_regions", lambda stream, size, stall_ms: stream.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=Noting(size, stall_ms), outputStructType=regions.BATCHED, outputMode="Append", timeMode="None"))
    src, work = shared_dir(spark, "once"), shared_dir(spark, "once-work")
    rows = [(d, k, 0, k, f"t{k}", k == 1, k == 3) for d in range(5) for k in range(4)]
    spark.createDataFrame(rows, regions.REGION_INPUT).coalesce(1).write.parquet(src)
    assert regions.run_region_stream(spark, src, work, upper, size=2).filter("kind = 'complete'").count() == 5
    assert len(list(calls.iterdir())) == 5


def test_a_batch_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(batches):
        def ask(frames):
            for frame in frames:
                for r in frame.itertuples(index=False):
                    (calls / uuid.uuid4().hex).touch()
                yield frame.assign(translations=frame["texts"], error=None)

        return batches.repartition(1).mapInPandas(ask, "doc_id bigint, batch_idx bigint, texts array<string>, translations array<string>, error string")

    rows = [(1, "region", 0, k, k, 0, k, f"t{k}") for k in range(3)] + [(1, "end", -1, 3, -1, -1, -1, "")]
    done = regions.translate_batched(spark.createDataFrame(rows, regions.BATCHED), counting)
    assert sorted((r.kind, r.global_idx) for r in done.collect()) == [("end", 3), ("result", 0), ("result", 1), ("result", 2)]
    assert len(list(calls.iterdir())) == 1


def judged(out, n):
    """Why to stop reading a grid reply of which ``out`` has arrived."""
    seen = [int(d) for d in re.findall(r"\[(\d+)\]:", out)]
    if over := [d for d in seen if d >= n]:
        return f"index_overflow:{over[0]}_vs_{n}"
    if len(set(seen)) > 2 * n:
        return f"too_many_indices:{len(set(seen))}"
    bodies = [t.strip()[:50] for t in re.findall(r"\[\d+\]:\s*([^\[]+)", out)]
    loops = [(c, t) for t, c in Counter(bodies[-6:]).items() if c >= 3 and len(t) > 2]
    if len(bodies) >= 4 and loops:
        return f"repetition:{loops[0][0]}x'{loops[0][1][:20]}'"
    tail = out[-100:].split()
    if len(out) > 100 and len(tail) >= 10 and sum(len(w) == 1 for w in tail) >= 8:
        return "single_char_spam"
    return None


def test_watch_equals_the_judgement_of_each_prefix(spark):
    rnd = random.Random(8)
    bits = ["[0]:", "[1]:", "[2]: ", "[9]:", "[3", "]", "[", " ", "\n", "same words", "x ", "a longer body of words that goes on and on ", "[1]: again "]
    texts = ["".join(rnd.choice(bits) * rnd.choice((1, 1, 2, 5)) for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    rows = [(k, t, rnd.randint(1, 12)) for k, t in enumerate(texts)]
    replies = spark.createDataFrame(rows, "reply_id bigint, output string, expected bigint")
    got = {(r.reply_id, r.chunk_no, r.reason) for r in chunks.first_abort(replies, 9).collect()}
    first = {}
    for k, text, n in rows:
        for place in range(0, len(text), 9):
            if reason := judged(text[: place + 9], n):
                first[k] = (place // 9, reason)
                break
    assert got == {(k, *v) for k, v in first.items()} and len(got) > 50


def judged_translation(out, n, non_cjk):
    """Why to stop reading a translation of which ``out`` has arrived."""
    numbered = len(re.findall(r"^\d+[\.\)]", out, re.MULTILINE))
    if n and numbered > 2 * n:
        return f"too_many_lines:{numbered}"
    lines = [t.strip() for t in out.split("\n") if t.strip()]
    if len(out) > 200 and len(lines) >= 4:
        for text, count in Counter(lines[-8:]).items():
            if count >= 3 and len(text) > 5:
                return f"repetition:{count}x"
    cjk = len(re.findall("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]", out))
    if non_cjk and len(out) > 150 and cjk > len(out) * 0.5:
        return f"still_cjk:{cjk}/{len(out)}"
    return None


def translated_texts():
    rnd = random.Random(12)
    bits = ["1. ", "2) ", "33.", "4", "\n", "\n\n", " \t", "same line again", "日本語のまま", "words of it ", " ", ".", "٣. ", "x\n", "long " * 8]
    texts = []
    for _ in range(300):
        some = rnd.sample(bits, rnd.randint(2, 5))
        texts.append(("".join(rnd.choice(some) * rnd.choice((1, 1, 2, 4)) for _ in range(rnd.randint(1, 90))), rnd.randint(0, 9)))
    return texts


def first_judged(texts, piece, non_cjk):
    first = {}
    for k, (text, n) in enumerate(texts):
        for place in range(0, len(text), piece):
            if reason := judged_translation(text[: place + piece], n, non_cjk):
                first[k] = (place // piece, reason)
                break
    return {(k, *v) for k, v in first.items()}


def test_translations_are_watched_as_each_prefix_is_judged(spark):
    texts = translated_texts()
    replies = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(texts)], "reply_id bigint, output string, expected bigint")
    for language, non_cjk in (("English", True), ("Korean", False)):
        for piece in (1, 7):
            got = {(r.reply_id, r.chunk_no, r.reason) for r in chunks.first_abort(replies, piece, chunks.translations(language)).collect()}
            expected = first_judged(texts, piece, non_cjk)
            assert got == expected and len({r.split(":")[0] for _, _, r in got}) == 2 + non_cjk
    watch = chunks.TranslationWatch()
    for _ in range(400):
        watch.feed("a long line without any end, ", 5)
    assert len(watch.dump()) < 300


def test_translation_stream_equals_batch_form(spark):
    texts, piece = translated_texts()[:60], 7
    rows = [(k, i, t[i * piece : (i + 1) * piece], n, (i + 1) * piece >= len(t)) for k, (t, n) in enumerate(texts) for i in range(-(-len(t) // piece))]
    src, work = shared_dir(spark, "said"), shared_dir(spark, "said-watch")
    spark.createDataFrame([r for r in rows if r[1] % 3 == 1], chunks.CHUNKS).coalesce(1).write.parquet(src)
    time.sleep(1.1)
    spark.createDataFrame([r for r in rows if r[1] % 3 != 1], chunks.CHUNKS).coalesce(1).write.mode("append").parquet(src)
    with stream_settings(spark, 4):
        stream = spark.readStream.schema(chunks.CHUNKS).option("maxFilesPerTrigger", 1).parquet(src)
        query = (
            chunks.watch_chunks(stream, chunks.translations("English")).writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/check").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = {(r.reply_id, r.chunk_no, r.reason) for r in spark.read.parquet(f"{work}/out").collect()}
    assert got == first_judged(texts, piece, True) and len(got) > 5


def test_chunk_watcher_equals_batch_form(spark):
    texts = {
        1: ("[0]: fine words here [1]: more words", 2),
        2: ("[0]: a [1]: b [7]: c", 3),
        3: (" ".join(f"[{i}]: same" for i in range(8)), 8),
        4: ("[0]: " + "word " * 20 + "x y z " * 20, 2),
    }
    piece = 7
    replies = spark.createDataFrame(
        [(k, t, n) for k, (t, n) in texts.items()], "reply_id bigint, output string, expected bigint"
    )
    want = {(r.reply_id, r.chunk_no, r.reason) for r in chunks.first_abort(replies, piece).collect()}
    rows = [
        (k, i, t[i * piece:(i + 1) * piece], n, (i + 1) * piece >= len(t))
        for k, (t, n) in texts.items() for i in range(-(-len(t) // piece))
    ]
    src, work = shared_dir(spark, "chunks"), shared_dir(spark, "watch")
    # One file holds what comes late: each reply's first piece among it.
    spark.createDataFrame([r for r in rows if r[1] % 3], chunks.CHUNKS).coalesce(1).write.parquet(src)
    time.sleep(1.1)
    spark.createDataFrame([r for r in rows if r[1] % 3 == 0], chunks.CHUNKS).coalesce(1).write.mode("append").parquet(src)
    with stream_settings(spark, 4):
        stream = spark.readStream.schema(chunks.CHUNKS).option("maxFilesPerTrigger", 1).parquet(src)
        q = (
            chunks.watch_chunks(stream).writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/check").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = {(r.reply_id, r.chunk_no, r.reason) for r in spark.read.parquet(f"{work}/out").collect()}
    assert got == want and {k for k, _, _ in want} == {2, 3, 4}


def test_a_lost_result_ends_in_an_error_row(spark):
    """Two documents: one lacks a result though its end is known, of the other the end is not known yet."""
    src, work = shared_dir(spark, "lost"), shared_dir(spark, "lost-out")
    rows = [(1, "result", k, 0, k, f"s{k}", f"t{k}") for k in (0, 2)] + [(1, "end", 3, -1, -1, "", "")] + [(2, "result", 1, 0, 1, "s", "t")]
    spark.createDataFrame(rows, regions.RESULT).coalesce(1).write.parquet(src)
    with stream_settings(spark, 4):
        query = (
            regions.release_in_order(spark.readStream.schema(regions.RESULT).parquet(src), stall_ms=1500, worker_ms=3000).writeStream.format("parquet")
            .option("path", f"{work}/out").option("checkpointLocation", f"{work}/check").trigger(processingTime="1 second").start()
        )
        for _ in range(40):
            query.awaitTermination(2)
            got = sorted(tuple(r) for r in spark.read.schema(regions.RELEASED).parquet(f"{work}/out*").collect())
            if len(got) >= 2:
                break
        query.awaitTermination(4)
        query.stop()
    got = sorted(tuple(r) for r in spark.read.schema(regions.RELEASED).parquet(f"{work}/out").collect())
    message = "Timeout waiting for result 1"
    assert got == [(1, "error", 1, -1, -1, message, message), (1, "result", 0, 0, 0, "s0", "t0")]


def test_held_rows_go_to_state_only_when_they_wait():
    class Counting(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    state = Counting()
    held = regions._Held(state, 0)
    for k in range(100):
        held.put(k, (k,))
        assert held.get(k) == (k,) and held.get(k + 1) is None
        held.drop(k)
    assert state.calls == 0
    held.put(7, ("a",))
    held.flush()
    held.put(7, ("b",))
    held.flush()
    again = regions._Held(state, held.stored)
    assert again.stored == 1 and again.get(7) == ("b",)
    again.drop(7)
    assert again.stored == 0 and not state


def test_stalled_document_gives_an_error_row_at_the_end(spark):
    src, work = shared_dir(spark, "stall"), shared_dir(spark, "stall-out")
    rows = [(1, 0, 0, 0, "a", False, False), (1, 2, 0, 2, "c", False, False)]
    spark.createDataFrame(rows, regions.REGION_INPUT).coalesce(1).write.parquet(src)
    with stream_settings(spark, 4):
        stream = spark.readStream.schema(regions.REGION_INPUT).parquet(src)
        query = (
            regions.batch_regions(stream, 4, stall_ms=2000).writeStream.format("parquet")
            .option("path", f"{work}/out").option("checkpointLocation", f"{work}/check")
            .trigger(processingTime="1 second").start()
        )
        batched = spark.read.schema(regions.BATCHED).parquet(f"{work}/out*")
        for _ in range(40):
            query.awaitTermination(2)
            batched = spark.read.schema(regions.BATCHED).parquet(f"{work}/out*")
            if batched.filter("kind = 'error'").count():
                break
        query.stop()
        regions.translate_batched(batched, upper).write.parquet(f"{work}/results")
        released = (
            regions.release_in_order(spark.readStream.schema(regions.RESULT).parquet(f"{work}/results"))
            .writeStream.format("parquet").option("path", f"{work}/released")
            .option("checkpointLocation", f"{work}/check2").trigger(availableNow=True).start()
        )
        released.awaitTermination()
    out = spark.read.schema(regions.RELEASED).parquet(f"{work}/released").collect()
    assert sorted((r.kind, r.global_idx, r.translated_text) for r in out) == [
        ("error", 1, "Timeout waiting for result 1"), ("result", 0, "T:a"),
    ]
