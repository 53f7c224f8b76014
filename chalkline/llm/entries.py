"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import bpe, langid, warc
from chalkline.llm.collocations import collocations
from chalkline.llm.conversations import damaged, repair_conversations
from chalkline.llm.jaccard import near_classes
from chalkline.llm.mixing import mix_sources, word_count
from chalkline.llm.quality import apply_quality
from chalkline.llm.quotes import reply_ordered
from chalkline.llm.repeats import remove_repeats
from chalkline.llm.scratch import Scratch
from chalkline.llm.sharding import shard_by_splitters
from chalkline.llm.tokencount import count_tokens
from chalkline.llm.topk import exact_top_k, quantised

def tokenizer_path(name: str) -> str:
    """File of a public vocabulary: in the folder TOKENIZER_DIR if it is set, else where the installed package has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    dealt = shard_by_splitters(_table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id", 8)
    return dealt.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, then read back from the archives."""
    path = Scratch(spark, "archives").where("warc")
    warc.write_warc(_table(spark, sf_dir, "pages", "page_id", "url", "html"), path, "page_id", "url", "html")
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return warc.read_warc(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, ... of their sources."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = mix_sources(docs, word_count(F.col("text")), "source", "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdicts of all documents."""
    judged = apply_quality(_table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
x AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS win FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE win IS NOT NULL) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, len(string_split(t, chr(10))) AS n_lines
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 10 * n_symbols <= n_words
       AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * n_lines) AND 10 * letters >= 6 * word_chars AS kept
FROM b
"""


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class and number of links."""
    found = near_classes(_table(spark, sf_dir, "documents", "doc_id", "text"), "text", "doc_id")
    return found.select("doc_id", "class_id", "n_links")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that repeat in the corpus."""
    found = remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"), "text", ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotations."""
    return reply_ordered(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of each embedding whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(vectors, "vec_id", quantised(F.col("embedding")), F.col("vec_id") % 100 == 0, 10)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; the digests of both."""
    path = tokenizer_path("word_bpe_49k.json")
    told = bpe.encode_texts(_table(spark, sf_dir, "documents", "doc_id", "text"), "text", path, ["doc_id"], decode=True)
    return told.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), "text", "lang", "doc_id", vocabulary)
    found = langid.identify(docs, "text", model, vocabulary, ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a rule, then repaired: their faults, the cheapest edits and the digest of what they hold then."""
    talk = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(talk, "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text").conversations
    ids = talk.select(F.col("conv_id").alias("_id")).distinct()
    whole = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return whole.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def _edit(state: str, cost: str, edit: str) -> str:
    """A state of the SQL, its cost in nine digits before its audit, after one more edit."""
    return f"lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{edit}'"


def _taken(state: str, initial: str) -> str:
    rerole = "NULL" if initial == "s" else _edit(state, "more + 1", "R")
    return f"CASE WHEN gone THEN NULL WHEN initial = '{initial}' THEN {_edit(state, 'more', 'K')} ELSE {rerole} END"


OP11_SQL = rf"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(key) + 1),
              lambda i: list_prepend(CAST(ascii(key[i]) AS BIGINT), CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[]))))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS fault
  FROM spaced),
rows_ AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM rows_),
judged AS (
  SELECT *, role[1:1] AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS short
  FROM placed),
weighed AS (SELECT *, blank OR seen AS gone, CASE WHEN short THEN 5 ELSE 0 END AS more FROM judged),
counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
         count(*) FILTER (short AND NOT gone) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM weighed GROUP BY conv_id),
chart AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000005I' AS v2, '000000010II' AS v3 FROM weighed
  UNION ALL
  SELECT conv_id, place, v0, v1, w2, least(w3, {_edit("w2", "5", "I")}) FROM (
    SELECT conv_id, place, w0 AS v0, w1 AS v1, w3, least(w2, {_edit("w0", "5", "I")}, {_edit("w1", "5", "I")}, {_edit("w3", "5", "I")}) AS w2 FROM (
      SELECT c.conv_id, r.place, {_edit("v0", "2", "D")} AS w0,
             least({_edit("v1", "2", "D")}, {_taken("v0", "s")}) AS w1,
             least({_edit("v2", "2", "D")}, {_taken("v0", "u")}, {_taken("v1", "u")}, {_taken("v3", "u")}) AS w2,
             least({_edit("v3", "2", "D")}, {_taken("v2", "a")}) AS w3
      FROM chart c JOIN weighed r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.place = c.place + 1))),
best AS (
  SELECT c.conv_id, least(v0, v3) AS v FROM chart c JOIN (SELECT conv_id, max(place) AS place FROM weighed GROUP BY conv_id) l
    ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.place = c.place),
parsed AS (SELECT conv_id, CAST(v[1:9] AS BIGINT) AS cost, v[10:] AS audit FROM best),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM parsed),
lettered AS (
  SELECT conv_id, i, audit[i] AS edit, length(replace(audit[1:i], 'I', '')) AS place, length(replace(audit[1:i], 'D', '')) AS k,
         length(replace(audit, 'D', '')) % 2 AS odd
  FROM edits),
said AS (
  SELECT l.conv_id, i, CASE WHEN edit = 'K' THEN r.role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
         || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
  FROM lettered l LEFT JOIN weighed r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.place = l.place WHERE edit <> 'D'),
digests AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM said GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN parsed p ON p.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language that stand out most, from all documents."""
    return collocations(_table(spark, sf_dir, "documents", "text", "lang"), "text", "lang")


OP12_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS gram FROM starts, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, words, gram, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
phrases AS (SELECT *, string_split(gram, ' ') AS w FROM counts WHERE words > 1),
inner_ AS (
  SELECT p.lang, array_to_string(p.w[i:i + k - 1], ' ') AS gram, p.f
  FROM phrases p, range(2, 5) AS t(k), range(1, 5) AS s(i) WHERE k < p.words AND i + k - 1 <= p.words),
covered AS (SELECT lang, gram, max(f) AS over FROM inner_ GROUP BY lang, gram),
kept AS (
  SELECT p.* FROM phrases p LEFT JOIN covered c ON p.lang = c.lang AND p.gram = c.gram WHERE c.over IS NULL OR 100 * c.over < 100 * p.f),
cuts AS (
  SELECT c.lang, c.gram AS phrase, c.f AS a, l.f AS l, r.f AS r, s.n, k,
         CAST((CAST(1000 AS HUGEINT) * c.f * s.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM kept c JOIN sizes s ON s.lang = c.lang, range(1, 5) AS t(k), counts l, counts r
  WHERE k < c.words AND l.lang = c.lang AND r.lang = c.lang
    AND l.gram = array_to_string(c.w[1:k], ' ') AND r.gram = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents, and which have over 4096."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = count_tokens(docs, "text", tokenizer_path("piece_bpe_32k.model"), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_warc": op2_warc,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_jaccard": op5_jaccard,
        "op6_suffix": op6_suffix,
        "op7_chat": op7_chat,
        "op8_topk": op8_topk,
        "op9_bpe": op9_bpe,
        "op10_langid": op10_langid,
        "op11_repair": op11_repair,
        "op12_phrases": op12_phrases,
        "op13_tokens": op13_tokens,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_quality": OP4_SQL, "op8_topk": OP8_SQL, "op11_repair": OP11_SQL, "op12_phrases": OP12_SQL}
