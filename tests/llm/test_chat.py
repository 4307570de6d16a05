"""Operator 3: the output is read back and its mask cut by plain code."""

from pyspark.sql import functions as F

from regionflow.llm import chat

ODD = ["", None, "</s>[INST] ok [/INST]", "<\\s> [\\\\INST] <</s>", "[[/INST]\\", "<|image 3|> <|audio", "a\nb\\n", "\\", "<", "x" * 50_000]


def test_round_trip_and_mask(spark):
    rows = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate((r, x) for x in ODD for r in ("user", "assistant", "too\\l\n</s>", None))]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.read_back(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))).withColumn("start", F.lit(1)))).collect()
    for r in out:
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"]), key=lambda x: x)
        assert [(s["role"], s["content"]) for s in r["said"]] == [(role, x) for _, _, role, x in mine]
        assert r["under_loss"] == [x for _, _, role, x in mine if role == "assistant"]
        spans = [r["formatted"][t["loss_start"] : t["loss_end"]] for t in r["turns"] if t["loss_start"] is not None]
        assert len(spans) == len(r["under_loss"])
        assert r["formatted"].count("</s>") == len(spans)
        assert r["n_turns"] == len(mine)
    assert {r["conv_id"] for r in out} == {1, None, 2}


def test_parts_become_placeholders(spark):
    parts = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [
        (1, 0, "user", [("text", "<|image 9|>", None, None, None, None, None), ("image", None, "a.png", 28, 30, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("film", None, None, None, None, None, -1), (None, "end", None, None, None, None, None)]),
        (1, 2, "user", None),
    ]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")).first()
    assert r["formatted"] == (
        "[INST]user\n<\\|image 9|>\n<|image 1|>\n<|audio 2|>[/INST]<s>assistant\n<|document 3|>\n<|document 4|>\nend</s>[INST]user\n[/INST]"
    )
    assert [tuple(a) for a in r["attachments"]] == [(1, "image", "a.png", 6), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 1536), (4, "document", None, 0)]
    assert r["expanded_tokens"] == 6 + 38 + 1536


def test_no_python_in_the_plan_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    read = chat.read_back(chat.format_chats(df))
    assert read.count() == 0
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
