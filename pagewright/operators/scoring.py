"""Totals, penalties, grades and the corpus audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import r1, words
from pagewright.operators.benchmarks import engine_scores, percentile_band
from pagewright.operators.detectors import PATTERNS, Detector, detect, registry
from pagewright.operators.structure import parse_corpus

#: Each pattern's weight, which is its highest score. They add up to 125.
WEIGHTS = {"structured_data": 20, "entity_density": 15, "citation_hooks": 10, "recursive_depth": 15, "temporal_anchoring": 10, "comparison_tables": 15, "definitional_precision": 10, "procedural_clarity": 5, "faq_injection": 15, "meta_context": 10}
GRADES = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")]


def total_score(weights: dict[str, float] | None = None, cap: float | None = None) -> Column:
    """Sum of score / max * weight, to one decimal. It can pass 100; `cap` stops it."""
    out = F.lit(0.0)
    for p in weights or WEIGHTS:
        part = F.col(f"{p}.score")
        # Divided even where a given weight is the maximum: x / 10 * 10 can differ from x in its last bit, and so its rounding.
        out = out + (part / F.col(f"{p}.max") * weights[p] if weights else part)
    out = r1(out)
    return F.least(out, F.lit(float(cap))) if cap is not None else out


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def penalty_density() -> Column:
    """20 for more than 10 structures in 1,000 words."""
    n = F.size("tables") + F.size("lists") + F.size("headers")
    return F.when((F.col("word_count") > 0) & (n / F.nullif(F.col("word_count"), F.lit(0)) * 1000 > 10), 20).otherwise(0)


def with_stuffing(parsed: DataFrame, text_col: str = "text", share: float = 0.05, length: int = 4) -> DataFrame:
    """Add penalty_stuffing: 15 if a word of more than `length` letters makes more than `share` of all words.

    In the sorted words, one comes more than m times if it equals the word m places on: no shuffle.
    """
    split = parsed.withColumn("_words", words(F.lower(text_col)))
    long = split.withColumn("_long", F.sort_array(F.filter("_words", lambda w: F.char_length(w) > length))).withColumn("_most", F.floor(F.size("_words") * share).cast("int"))
    same = F.exists(F.zip_with("_long", F.slice("_long", F.col("_most") + 1, F.greatest(F.size("_long"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return long.withColumn("penalty_stuffing", F.when(same, 15).otherwise(0)).drop("_words", "_long", "_most")


def penalty_structure() -> Column:
    """15 for more than 1,000 words without a table or list."""
    return F.when((F.col("word_count") > 1000) & (F.size("tables") == 0) & (F.size("lists") == 0), 15).otherwise(0)


def score_parsed(parsed: DataFrame, detectors: dict[str, Detector] | None = None, weights: dict[str, float] | None = None, cap: float | None = None) -> DataFrame:
    """Add the detectors' structs, total, the three penalties, score, grade, percentile and the engines' scores."""
    found = with_stuffing(detect(parsed, detectors))
    sums = found.withColumns({"total": total_score(weights, cap), "penalty_density": penalty_density(), "penalty_structure": penalty_structure()})
    score = F.greatest(F.lit(0.0), F.col("total") - F.col("penalty_density") - F.col("penalty_stuffing") - F.col("penalty_structure"))
    final = sums.select("*", F.explode(F.array(score)).alias("score"))  # behind a generator, so an audit isn't computed again for a condition on it
    return final.withColumns({"grade": grade(F.col("score")), "percentile": percentile_band(F.col("score")), "engine_scores": engine_scores(F.col("score"))})


def audit_corpus(docs: DataFrame, entities: str = "off", **options: object) -> DataFrame:
    """One row a document: structure, detectors, penalties, score and grade, in one pass without a shuffle.

    `entities` is off or surface. Null content is an empty document, whose score is 0.
    """
    return score_parsed(parse_corpus(docs), registry(entities), **options)


def flat(audits: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """An audit as plain columns: <pattern>_score for each pattern, and the sums."""
    return audits.select(*keep, "word_count", *(F.col(f"{p}.score").alias(f"{p}_score") for p in PATTERNS), "total", "penalty_density", "penalty_stuffing", "penalty_structure", "score", "grade")


def keyword_density(parsed: DataFrame, length: int = 4, share: float = 0.05) -> DataFrame:
    """(doc_id, word, n, share): words of more than `length` letters that make more than `share` of a document.

    As with the stuffing penalty, such words are found within the row: in the sorted words they equal
    the one some places on. Only they are counted and become rows, so words aren't shuffled.
    """
    split = parsed.select("doc_id", words(F.lower("text")).alias("w")).withColumn("total", F.size("w"))
    long = split.select("doc_id", "total", F.sort_array(F.filter("w", lambda w: F.char_length(w) > length)).alias("w"), F.floor(F.col("total") * share).cast("int").alias("most"))
    often = F.filter("w", lambda w, i: F.coalesce(F.get("w", i + F.col("most")) == w, F.lit(False)))
    counted = long.withColumn("word", F.explode(F.array_distinct(often))).withColumn("n", F.size(F.filter("w", lambda w: w == F.col("word"))).cast("long"))
    return counted.select("doc_id", "word", "n", (F.col("n") / F.col("total")).alias("share"))


def score_report(audits: DataFrame) -> DataFrame:
    """(lang, source, documents, avg, min, max) with subtotals by language and in all; null marks a subtotal."""
    return audits.rollup("lang", "source").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def grade_histogram(audits: DataFrame) -> DataFrame:
    return audits.groupBy("grade").agg(F.count("*").alias("documents"))


def detection_rate(scores: DataFrame) -> DataFrame:
    """(pattern, rate, avg_score) over the long form."""
    return scores.groupBy("pattern").agg(F.avg(F.col("detected").cast("double")).alias("rate"), F.round(F.avg("score"), 6).alias("avg_score"))


def pattern_percent(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "pattern", r1(F.col("score") / F.col("max") * 100).alias("percent"))
