"""Audits that need not be done again, batches and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import content_hash
from pagewright.operators.scoring import audit_corpus
from pagewright.operators.validate import sanitize, split_valid

KEY = ["content_hash", "format"]


def hashed(docs: DataFrame) -> DataFrame:
    """Documents with the cache key: hash and format, so the same text as HTML and Markdown is two entries."""
    return docs.withColumn("content_hash", content_hash(F.col("content"))).withColumn("format", F.coalesce("format", F.lit("markdown")))


def live(audits: DataFrame, at: Column) -> DataFrame:
    return audits.filter(F.col("expires_at") > at)


def expire(audits: DataFrame, at: Column, days: int | None = None) -> DataFrame:
    """Audits to keep: not expired, or created within a retention of 0 to 90 days."""
    return live(audits, at) if days is None else audits.filter(F.col("created_at") > at - F.make_dt_interval(F.lit(min(max(days, 0), 90))))


def new_documents(docs: DataFrame, audits: DataFrame, at: Column) -> DataFrame:
    return hashed(docs).join(live(audits, at).select(*KEY).distinct(), KEY, "left_anti")


def cached(docs: DataFrame, audits: DataFrame, at: Column) -> DataFrame:
    return hashed(docs).join(live(audits, at).select(*KEY).distinct(), KEY, "left_semi")


def dedup_content(docs: DataFrame) -> DataFrame:
    """(content_hash, format, doc_id, copies): the first document of each content."""
    return hashed(docs).groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def recent_audits(audits: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The n latest audits of each user, newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "doc_id")
    own = audits.join(users.select("user_id", "name"), "user_id")
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("user_id", "name", "rank", "doc_id", "score", "created_at")


def batch_audit(docs: DataFrame) -> DataFrame:
    """(doc_id, url, status, score, error): an error in one document doesn't touch the others."""
    ok, bad = split_valid(docs)
    done = audit_corpus(ok.withColumn("content", F.when(F.col("format") == "html", F.col("content")).otherwise(sanitize(F.col("content")))))
    return done.select("doc_id", "url", F.lit("success").alias("status"), "score", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "url", F.lit("error").alias("status"), F.lit(None).cast("double").alias("score"), F.col("error_code").alias("error")))
