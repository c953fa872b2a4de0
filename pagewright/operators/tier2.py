"""Further measures: density, freshness, claims, correlation, experiments, readability, labels, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import matches, word_count

#: Our own thresholds; the words that make a claim, and the vowels of a syllable.
CLAIMS = r"(?:^|[^\p{L}\p{N}])(?:always|never|best|proven|guaranteed|most|every)(?:[^\p{L}\p{N}]|$)"
VOWELS = r"[aeiouyäöüáéíóúàèìòùâêîôû]+"


def content_penalties(audits: DataFrame, year: int = 2024) -> DataFrame:
    """(doc_id, low_density, stale, unsupported): 10 for over 500 words with less than one date in 500, 10 for no date or none of the last two years, 5 for claims without a citation."""
    dates, cites, claims = F.col("temporal_anchoring.date_count"), F.col("citation_hooks.citation_count"), matches(F.col("text"), CLAIMS)
    years = F.transform(F.regexp_extract_all("text", F.lit(r"(?:19|20)[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    low = (F.col("word_count") > 500) & (dates / F.greatest(F.col("word_count"), F.lit(1)) * 500 < 1)
    stale = (dates == 0) | (F.coalesce(F.array_max(years), F.lit(year)) < year - 2)
    return audits.select("doc_id", F.when(low, 10).otherwise(0).alias("low_density"), F.when(stale, 10).otherwise(0).alias("stale"), F.when((claims > 0) & (cites == 0), 5).otherwise(0).alias("unsupported"))


def score_citation_corr(audits: DataFrame, citations: DataFrame) -> DataFrame:
    """(pages, r): Pearson's correlation of a page's mean score with its citations."""
    score = audits.groupBy("url").agg(F.avg("score").alias("score"))
    cited = citations.groupBy("url").agg(F.count("*").cast("double").alias("n"))
    r = F.covar_pop("score", "n") / F.nullif(F.stddev_pop("score") * F.stddev_pop("n"), F.lit(0.0))  # null where one doesn't vary
    return score.join(cited, "url").agg(F.count("*").alias("pages"), F.round(r, 6).alias("r"))


def arm(id_col: Column, seed: int = 7) -> Column:
    """treatment or control, by halves, from a hash of the id and seed."""
    return F.when(F.substring(F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}"))), 1, 1) < "8", "treatment").otherwise("control")


def ab_compare(rows: DataFrame, value: str) -> DataFrame:
    """(n_t, n_c, mean_t, mean_c, difference, t): Welch's t of rows(arm, value)."""
    side = lambda f, a: f(F.when(F.col("arm") == a, F.col(value)))
    s = rows.agg(*(side(f, a).alias(f"{n}_{a[0]}") for a in ("treatment", "control") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    t = (F.col("mean_t") - F.col("mean_c")) / F.sqrt(F.nullif(F.col("var_t") / F.nullif(F.col("n_t"), F.lit(0)) + F.col("var_c") / F.nullif(F.col("n_c"), F.lit(0)), F.lit(0.0)))
    return s.select("n_t", "n_c", F.round("mean_t", 6).alias("mean_t"), F.round("mean_c", 6).alias("mean_c"), F.round(F.col("mean_t") - F.col("mean_c"), 6).alias("difference"), F.round(t, 6).alias("t"))


def readability(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, words, sentences, syllables, grade): Flesch-Kincaid, with runs of vowels as syllables."""
    n = docs.select(*keep, word_count(F.col(text_col)).alias("words"), F.greatest(F.regexp_count(text_col, F.lit(r"[.!?]+")), F.lit(1)).alias("sentences"), F.regexp_count(F.lower(text_col), F.lit(VOWELS)).alias("syllables"))
    return n.withColumn("grade", F.when(F.col("words") > 0, F.round(0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("syllables") / F.nullif(F.col("words"), F.lit(0)) - 15.59, 4)).otherwise(F.lit(0.0)))


def detection_quality(citations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(precision, recall) of confident citations against those that were verified."""
    said, right = F.col("confidence") >= threshold, F.col("verified")
    hit = F.sum(F.when(said & right, 1).otherwise(0))
    return citations.agg((hit / F.nullif(F.sum(F.when(said, 1).otherwise(0)), F.lit(0))).alias("precision"), (hit / F.nullif(F.sum(F.when(right, 1).otherwise(0)), F.lit(0))).alias("recall"))


def plan_usage(requests: DataFrame, at: Column) -> DataFrame:
    """(api_key, today, this_month): requests on the day and in the month of a time."""
    day, month = F.date_trunc("day", "ts") == F.date_trunc("day", at), F.date_trunc("month", "ts") == F.date_trunc("month", at)
    return requests.groupBy("api_key").agg(F.sum(F.when(day, 1).otherwise(0)).alias("today"), F.sum(F.when(month, 1).otherwise(0)).alias("this_month"))
