"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.llm import (
    chat, dart_minhash, divergence, encoding, importance, language, near_vectors, packing, personal_data, quality, token_counts, top_k, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces, placed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("row", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return digests.join(placed, ["row", "start"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op2_near_vectors"] = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links,
       c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.a = e.vec_id
"""


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    read = chat.read_back(chat.format_chats(messages))
    turns = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    loss = F.array_join("under_loss", "")
    return read.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op3_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|image|\|audio|\|document)', '\1\\\2\3', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 1 + length(escaped) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def scored_quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``docs`` scored by a machine that learned from the labelled documents of the table."""
    learnable = table(spark, sf_dir, "documents").filter(F.coalesce(remainder(5), F.lit(-1)) != 0)
    return quality.classify(docs, learnable, table(spark, sf_dir, "labels"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return scored_quality(spark, sf_dir, docs).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op5_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return dart_minhash.near_texts(table(spark, sf_dir, "documents")).select("doc_id", "cluster_id", "kept")


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by inner product of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k.search(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


SQL["op6_top_k"] = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and read-back text of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def identified(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``docs`` with the language of each, learned from the documents of the table."""
    labelled = table(spark, sf_dir, "documents").filter(F.coalesce(remainder(4), F.lit(-1)) != 2)
    return language.identify(labelled, docs)


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return identified(spark, sf_dir, docs).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.learn(docs))
    base = F.filter("found", lambda s: s["kind"].isin(*personal_data.BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in personal_data.BASE], F.sha2(personal_data.listed(base), 256).alias("base_sha256"),
        personal_data.listed(F.col("found")).alias("spans"),
    )


#: Longest first decides; written host and path.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"),
]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by rules, and by trees where no rule fits."""
    found = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn by importance towards the benchmark."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Words as in the operator; the CRC of each distinct word by a table of 256 remainders.
SQL["op12_importance"] = r"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i)) AS m
), d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words,
    CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM documents
), b AS (
  SELECT unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word
  FROM benchmark
), in_docs AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word
), in_target AS (SELECT word, count(*) AS n FROM b GROUP BY word),
coded AS (
  SELECT word, xor(list_reduce(
    list_transform(range(length(hex(word)) // 2), lambda k: CAST('0x' || substr(hex(word), 2 * k + 1, 2) AS BIGINT)),
    lambda c, byte: xor(c >> 8, m[xor(c & 255, byte) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM in_docs UNION SELECT word FROM in_target), remainders
), s AS (SELECT bucket, sum(n) AS s FROM in_docs JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM in_target JOIN coded USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM in_docs)::DOUBLE + 10000)
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM in_target)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), by_word AS (SELECT word, gain FROM coded JOIN gain USING (bucket)),
weighed AS (
  SELECT w.doc_id, sum(gain)::HUGEINT AS total FROM (SELECT doc_id, unnest(words) AS word FROM d) w JOIN by_word USING (word) GROUP BY w.doc_id
), scored AS (
  SELECT doc_id, len(words) AS n_features,
    CASE WHEN len(words) = 0 THEN 0 ELSE CAST((total - ((total % len(words)) + len(words)) % len(words)) / len(words) AS BIGINT) END AS weight, h
  FROM d LEFT JOIN weighed USING (doc_id)
), keyed AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM keyed WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM keyed LEFT JOIN ranked USING (doc_id)
"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and the terms each source over-uses most."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
in_lang AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
of_source AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, v, coalesce((SELECT sum(n) FROM of_source s WHERE s.lang = g.lang AND s.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN in_lang USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
    1 + CAST((1000000000 * (coalesce(s.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v) AS BIGINT) AS p,
    1 + CAST((1000000000 * (k.n + 5)::HUGEINT) // (l.total + 5 * l.v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN in_lang l USING (lang)
  LEFT JOIN of_source s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source AS one, b.source AS other, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.one = a.source AND x.other = b.source
), over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM over)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
