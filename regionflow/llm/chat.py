r"""Operator 3: chat formatting with typed content parts, in DataFrame functions only.

A visitor over each message's parts escapes text and turns image, audio and document
parts into placeholders numbered by their place in the conversation; references and
the number of tokens a placeholder expands to are recorded beside the text.

The template opens an assistant turn with ``<s>`` and closes it with ``</s>``; any other
turn stands between ``[INST]`` and ``[/INST]``. After the opening come the role, a line
break and the content, its parts joined by line breaks. A control string inside a text gets a backslash after its first
character (one more, if some are there), so it no longer reads as control and the
escape can be taken back. Messages are formatted row by row; one shuffle by conversation
numbers them, adds up offsets and puts each conversation together.

Defined cases: null text, parts or kind are empty text or text; a null role is empty; an
unknown kind is a document; sizes that are missing or negative expand to no tokens.
Messages go by turn, then role, then content, so ties and repeated rows have one order.
Rows without a conversation id form one conversation. Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
KINDS = ("image", "audio", "document")
#: Tokens of a placeholder: image patches of this edge, audio tokens a second, tokens a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512
CONTROL = r"(s>|/s>|INST\]|/INST\]|\|image|\|audio|\|document)"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def role_line(role: Column) -> Column:
    """The role on one line: its own backslashes and line breaks are written out."""
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def role_of(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of plain text as one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"))).cast("array<struct<kind:string,text:string>>")


def full_parts(parts: Column, fields: list[str]) -> Column:
    """Parts with all fields of ``PART``; those that the table lacks are null."""
    names = [f.split(":")[0] for f in PART[7:-1].split(",")]
    kinds = dict(f.split(":") for f in PART[7:-1].split(","))
    filled = F.transform(parts, lambda p: F.struct(*[(p[n] if n in fields else F.lit(None)).cast(kinds[n]).alias(n) for n in names]))
    return F.coalesce(filled, F.array().cast(f"array<{PART}>"))


def kind_of(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *KINDS), kind).otherwise("document")


def tokens_of(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    def some(x: Column) -> Column:
        return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))

    patches = F.ceil(some(part["width"]) / PATCH) * F.ceil(some(part["height"]) / PATCH)
    return (
        F.when(kind_of(part) == "image", patches)
        .when(kind_of(part) == "audio", F.ceil(some(part["seconds"]) * PER_SECOND))
        .when(kind_of(part) == "document", some(part["pages"]) * PER_PAGE)
        .otherwise(0).cast("long")
    )


def visit(parts: Column, before: Column) -> Column:
    """Escaped text and placeholders in order; ``before`` parts came earlier in the conversation."""
    def one(part: Column, at: Column) -> Column:
        mark = F.concat(F.lit("<|"), kind_of(part), F.lit(" "), (before + at).cast("string"), F.lit("|>"))
        return F.when(kind_of(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)

    return F.array_join(F.transform(parts, one), "\n")


def attachments(parts: Column, before: Column) -> Column:
    numbered = F.transform(parts, lambda p, i: F.struct((before + i).alias("place"), kind_of(p).alias("kind"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    return F.filter(numbered, lambda p: p["kind"] != "text")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, turns, attachments, expanded_tokens).

    ``turns`` has per turn its start and, for an assistant, the loss mask's ``loss_start`` and
    ``loss_end`` (code points of ``formatted``, end exclusive).
    """
    fields = [f.name for f in messages.schema[parts].dataType.elementType]
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), full_parts(F.col(parts), fields).alias("parts")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("at", F.row_number().over(order)).withColumn("before", F.sum(F.size("parts")).over(so_far) - F.size("parts"))
    speaks = F.col("role") == ASSISTANT
    head = F.concat(F.when(speaks, "<s>").otherwise("[INST]"), role_line(F.col("role")), F.lit("\n"))
    made = numbered.select(
        "conv_id", "at", speaks.alias("speaks"), head.alias("head"), visit(F.col("parts"), F.col("before")).alias("content"),
        attachments(F.col("parts"), F.col("before")).alias("attached"),
    )
    tail = F.when(F.col("speaks"), "</s>").otherwise("[/INST]")
    pieces = made.withColumn("piece", F.concat("head", "content", tail)).withColumn("size", F.length("piece").cast("long"))
    by_place = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("start", F.sum("size").over(by_place) - F.col("size"))
    loss_start = F.when(F.col("speaks"), F.col("start") + F.length("head"))
    turn_facts = F.struct("start", loss_start.alias("loss_start"), (loss_start + F.length("content")).alias("loss_end"))
    whole = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece", turn_facts.alias("facts"), "attached"))).alias("all"),
    )
    attached = F.flatten(F.col("all.attached"))
    return whole.select(
        "conv_id", "n_turns", F.array_join(F.col("all.piece"), "").alias("formatted"), F.col("all.facts").alias("turns"), attached.alias("attachments"),
        F.aggregate(F.transform(attached, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``said`` (role and unescaped content of each turn, parsed from ``formatted``)
    and ``under_loss`` (the unescaped texts under the loss mask, in order)."""
    pieces = F.split("formatted", r"\[/INST\]|</s>")
    # After the last closing string nothing follows.
    opened = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(p.alias("piece"), F.when(p.startswith("<s>"), 3).otherwise(6).alias("skip")))

    def parsed(x: Column) -> Column:
        body = F.substring(x["piece"], x["skip"] + 1, F.length(x["piece"]))
        line = F.substring_index(body, "\n", 1)
        return F.struct(role_of(line).alias("role"), unescape(F.substring(body, F.length(line) + 2, F.length(body))).alias("content"))

    def masked(x: Column) -> Column:
        fact = x["turns"]
        return unescape(F.substring(x["opened"]["piece"], (fact["loss_start"] - fact["start"] + 1).cast("int"), (fact["loss_end"] - fact["loss_start"]).cast("int")))

    split = chats.withColumn("opened", opened)
    under = F.transform(F.filter(F.arrays_zip("opened", "turns"), lambda x: x["turns"]["loss_start"].isNotNull()), masked)
    return split.withColumn("said", F.transform("opened", parsed)).withColumn("under_loss", under).drop("opened")
