"""Input checks: what is cut, what is refused and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import word_count

#: Limits, error codes and the form of a URL.
MAX_CHARS = 10 * 1024 * 1024
MAX_WORDS = 50_000
TOO_LARGE, FETCH_FAILED, INVALID = "CONTENT_TOO_LARGE", "FETCH_FAILED", "INVALID_REQUEST"
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)\n?$"


def sanitize(content: Column) -> Column:
    """Without NUL characters, cut to the largest size."""
    bare = F.when(F.contains(content, F.lit("\x00")), F.translate(content, "\x00", "")).otherwise(content)
    return F.substring(bare, 1, MAX_CHARS)


def size_error(content: Column) -> Column:
    """CONTENT_TOO_LARGE or null. Words are counted where there are characters enough for so many, each but the last with a space."""
    chars = F.char_length(content)
    return F.when(chars > MAX_CHARS, F.lit(TOO_LARGE)).when(chars > 2 * MAX_WORDS, F.when(word_count(content) > MAX_WORDS, F.lit(TOO_LARGE)))


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(URL), F.lit(False))


def resolve_input(df: DataFrame) -> DataFrame:
    """The URL wins over the content and makes the format html; neither is an error."""
    return df.withColumn("input", F.when(F.col("url").isNotNull(), F.lit("url")).when(F.col("content").isNotNull(), F.lit("content")).otherwise(F.lit("none"))).withColumn("input_format", F.when(F.col("url").isNotNull(), F.lit("html")).otherwise(F.coalesce("format", F.lit("markdown"))))


def error_code(docs: DataFrame) -> DataFrame:
    """Add error_code: markdown is sanitised and then sized, pages are sized by characters alone and must be there."""
    html = F.col("format") == "html"
    md = F.when(F.col("content").isNull(), F.lit(INVALID)).otherwise(size_error(sanitize(F.col("content"))))
    page = F.when(F.col("content").isNull(), F.lit(FETCH_FAILED)).when(F.char_length("content") > MAX_CHARS, F.lit(TOO_LARGE))
    return docs.withColumn("error_code", F.when(F.coalesce(html, F.lit(False)), page).otherwise(md))


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents to audit, and the refused ones with their code. A bad row never fails the batch."""
    coded = error_code(docs)
    return coded.filter("error_code is null").drop("error_code"), coded.filter("error_code is not null")


def language_gate(docs: DataFrame, lang: str = "en") -> DataFrame:
    """Documents of another language, where it is known, are errors."""
    return docs.withColumn("lang_error", F.when(F.col("lang").isNotNull() & (F.col("lang") != lang), F.lit("UNSUPPORTED_LANGUAGE")))
