"""A training-data pipeline over ``documents``: each stage calls one operator and is written before the next reads it.

Every stage reads the columns of COLUMNS alone, whatever else there is, works on
all rows that it gets and gives none for an empty table. Rows that repeat and
rows without an id are rows of their own. A stage's working tables go when the
next one begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import bpe, langid
from chalkline.llm.entries import tokenizer_path
from chalkline.llm.jaccard import near_classes
from chalkline.llm.mixing import mix_sources, word_count
from chalkline.llm.repeats import remove_repeats
from chalkline.llm.scratch import Scratch, pipeline_stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its best language has a lower posterior.
LEAST_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(body: Stage) -> Stage:
    """A stage at whose begin the working tables of the stages before go: its input has been written."""

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return pipeline_stage(docs, "doc_id", lambda: body(spark, docs, sf_dir))

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labels.

    A null or empty text, and one without a letter, goes; so does one whose best
    language has a posterior under LEAST_SCORE. Where no label says anything all
    texts with a letter stay. Labels may be null; they and the source decide
    nothing. Very long texts are scored as a whole.
    """
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    docs = docs.select(COLUMNS)
    model = langid.fit(docs, "text", "lang", "doc_id", vocabulary)
    if not model[0]:  # no label to learn from: only texts without a letter are rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, "text", model, vocabulary, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; of rows that share it, one.

    Null and empty texts are equal to each other, so one of them stays; a class
    that has null ids only keeps one row.
    """
    return near_classes(docs, "text", "doc_id", COLUMNS, count_links=False).where("is_first").select(COLUMNS)


@_stage
def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that repeat; a character that an edge cuts through goes as a whole.

    All documents stay, those that lose everything with an empty text; a null
    text stays null. n_chars follows the text.
    """
    found = remove_repeats(docs, "text", COLUMNS)
    left = F.col("kept").cast("string")
    valid = F.when(F.is_valid_utf8(left), left).otherwise(F.regexp_replace(F.make_valid_utf8(left), "�", ""))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(valid)
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


@_stage
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Null sources are one source, the last; texts without a word (null, empty)
    are taken once. Which of equal documents is repeated is drawn by a hash of
    id and text, so reruns agree.
    """
    numbered = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_by"), F.monotonically_increasing_id().alias("_row"))
    numbered = Scratch(spark, "mix").keep(numbered, "numbered")
    mixed = mix_sources(numbered, word_count(F.col("text")), "source", "_row", by="_by").where("copies > 0")
    return numbered.join(mixed.select("_row", "copies"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


@_stage
def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the text that the ids stand for; a null or empty text has no ids."""
    encoded = bpe.encode_texts(docs, "text", tokenizer_path("word_bpe_49k.json"), COLUMNS, decode=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("mixing", mix_to_targets),
    ("bpe", encode_and_decode),
]

#: No SQL states the near-duplicate classes or the learned languages; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is a table in the shared folder before the next begins."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
