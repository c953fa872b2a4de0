"""A corpus pipeline: language, repeated lines, near duplicates, source mix and tokens, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_mixing, op4_line_dedup, op7_language, op8_bpe, op10_near
from .common import keep, table

#: Rows (id, hash) of documents that go, up to which they are sent to all tasks: 8 MB. More are joined by a shuffle.
MOST_SENT = 500_000
#: Below this score the model doesn't tell a text's language.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of which no language is sure; `lang` is the predicted one.

    The model is learnt from the documents table. A null text goes.
    """
    said = op7_language.predict_language(docs, op7_language.learn(table(spark, sf_dir, "documents")), keep_cols=True)
    sure = said.filter((F.col("_li_lang") != "und") & (F.col("_li_score") >= LEAST_SCORE))
    return sure.select(*(F.col("_li_lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each repeated chunk of lines once; a document of which nothing is left goes."""
    return _counted(op4_line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (five words, similarity 0.8).

    Rows are told apart by id and text, so rows equal in both stay or go together. A row with a null
    id is never compared and stays; null and empty texts are copies of each other.
    """
    groups = op10_near.near_duplicates(docs)
    gone = keep(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_near_id"), F.col("version").alias("_near_version")).distinct(), "pipeline-gone")
    same = (F.col("doc_id") == F.col("_near_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_near_version"))
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, same, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings each source near its target: a document stays as many times as the mix takes it.

    That is the words taken by its size, rounded up or down by a hash of its id and text, so 3 times
    at most; documents that the mix doesn't take go, as texts without words do. Rows with a null id
    are mixed like others; rows equal in id and text are taken alike, as the one of them taken most.
    """
    keyed = docs.withColumn("_mix_key", F.xxhash64("doc_id", "text"))
    took = op1_mixing.taken(op1_mixing.mix(keyed, id_col="_mix_key")).filter("taken > 0")
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    times = took.groupBy(F.col("doc_id").alias("_mix_of")).agg(F.max(F.floor(F.col("taken") / F.col("size") + chance).cast("int")).alias("_mix_times")).filter("_mix_times > 0")
    chosen = keyed.join(times.hint("merge"), F.col("_mix_key") == F.col("_mix_of")).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return chosen.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the digests of each text's ids and of what they decode to.

    A row a document, repeats and null ids included; a null text counts as empty and has no tokens.
    """
    return op8_bpe.token_digests(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("source_mix", mix), ("bpe", tokens)]

#: SQL can't express the model, the fingerprints, the draws or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written, and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
