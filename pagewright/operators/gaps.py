"""What a document lacks: gaps, their ranks, recommendations and work-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Category, severity and description of each pattern's gap.
GAPS = {
    "structured_data": ("structure", "high", "Missing structured data (tables, lists, headers)"),
    "comparison_tables": ("comparison", "high", "No comparison tables found"),
    "recursive_depth": ("recursion", "high", "Missing recursive depth (nested Q&A)"),
    "entity_density": ("entities", "medium", "Low entity density"),
    "temporal_anchoring": ("temporal", "medium", "Missing temporal anchors (dates, versions)"),
    "citation_hooks": ("citations", "medium", "Missing citation hooks"),
    "definitional_precision": ("definition", "low", "Missing explicit definitions"),
    "procedural_clarity": ("procedural", "low", "Missing step-by-step procedures"),
    "faq_injection": ("faq", "medium", "Missing FAQ section"),
    "meta_context": ("meta", "low", "Missing meta-context explanations"),
}
# The pattern library (id, the detector's name, name, category, description, boost from, boost to).
LIBRARY = [
    ("structured_data", "structured_data", "Structured Data", "structure", "Convert prose into tables, lists, structured formats", 15, 25),
    ("entity_density", "entity_density", "Entity Density", "content", "Increase named entities (people, places, products, dates) per paragraph", 10, 20),
    ("citation_hooks", "citation_hooks", "Citation Hooks", "metadata", "Explicit source attribution: 'According to [source]', '[Study] found...'", 5, 15),
    ("recursive_depth", "recursive_depth", "Recursive Depth", "content", "Answer questions within questions (nested Q&A format)", 20, 30),
    ("temporal_anchoring", "temporal_anchoring", "Temporal Anchoring", "metadata", "Explicit dates, version numbers, 'as of [date]' statements", 10, 15),
    ("comparison_tables", "comparison_tables", "Comparison Tables", "format", "Side-by-side comparisons in tabular format", 25, 40),
    ("definitional_precision", "definitional_precision", "Definitional Precision", "content", "Explicit definitions: 'X is defined as...', 'X means...'", 8, 12),
    ("step_by_step", "procedural_clarity", "Step-by-Step Procedures", "format", "Numbered steps: 'Step 1: ... Step 2: ...'", 12, 18),
    ("faq_injection", "faq_injection", "FAQ Injection", "content", "Anticipate and answer common questions inline", 15, 25),
    ("meta_context", "meta_context", "Meta-Context", "content", "Explain why information matters: 'This is important because...'", 5, 10),
]
SEVERITIES = {"high": 0, "medium": 1, "low": 2}


def patterns_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIBRARY, "id string, score_key string, name string, category string, description string, boost_min int, boost_max int")


def lookup_patterns(requests: DataFrame) -> DataFrame:
    """requests(request_id, pattern_id) with the library's row, or the status NOT_FOUND."""
    dim = F.broadcast(patterns_dim(requests.sparkSession).select(F.col("id").alias("pattern_id"), "name", "category", "boost_min", "boost_max"))
    return requests.join(dim, "pattern_id", "left").withColumn("status", F.when(F.col("name").isNull(), "NOT_FOUND").otherwise("OK"))


def gap_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c, s, SEVERITIES[s], d) for p, (c, s, d) in GAPS.items()], "pattern string, category string, severity string, sev_rank int, description string")


def _spaced(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("_"), F.lit(" "))


def gaps(scores: DataFrame) -> DataFrame:
    """A row for each pattern that a document lacks: gap_id, category, severity, description, example_fix and rank.

    The rank goes by severity and then by the detectors' order. `scores` is the long form.
    """
    dim = F.broadcast(gap_dim(scores.sparkSession))
    order = Window.partitionBy("doc_id").orderBy("sev_rank", "ord")
    found = scores.filter(~F.col("detected")).join(dim, "pattern")
    return found.select("doc_id", F.concat(F.lit("gap_"), "pattern").alias("gap_id"), "pattern", "category", "severity", "description", F.concat(F.lit("Add "), _spaced(F.col("pattern")), F.lit(" to improve score")).alias("example_fix"), F.row_number().over(order).alias("rank"))


def top_gaps(found: DataFrame, n: int = 5) -> DataFrame:
    return found.filter(F.col("rank") <= n)


def gap_census(found: DataFrame) -> DataFrame:
    """Counts by severity for each document, in all, and both: grouping sets, where null marks a sum."""
    return found.groupingSets([["doc_id"], ["severity"], []], "doc_id", "severity").agg(F.count("*").alias("gaps"))


def severity_pivot(found: DataFrame) -> DataFrame:
    wide = found.groupBy("doc_id").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, list(SEVERITIES))


def gap_boosts(found: DataFrame) -> DataFrame:
    """Each gap with the boost that mending it promises, and its priority by that boost."""
    dim = F.broadcast(patterns_dim(found.sparkSession).select(F.col("score_key").alias("pattern"), "boost_min", "boost_max"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("boost_max"), F.desc("boost_min"), "pattern")
    return found.join(dim, "pattern").select("doc_id", "pattern", "severity", "boost_min", "boost_max", F.row_number().over(order).alias("priority"))


def _number(x: Column) -> Column:
    """10.0 as 10, 12.5 as 12.5."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def recommendations(scores: DataFrame) -> DataFrame:
    """Up to three high gaps among a document's first ten, then the first three patterns below half their maximum.

    High gaps come first in the ranks, so a gap's rank is its number among them. Both kinds come from
    one pass over the scores: an audit isn't run twice.
    """
    dim = F.broadcast(gap_dim(scores.sparkSession))
    each = scores.join(dim, "pattern", "left").withColumn("_gap", ~F.col("detected") & F.col("sev_rank").isNotNull()).withColumn("_weak", F.coalesce(F.col("score") / F.col("max") < 0.5, F.lit(False)))
    per_doc = Window.partitionBy("doc_id")
    numbered = each.withColumn("_rank", F.row_number().over(per_doc.orderBy(F.desc("_gap"), "sev_rank", "ord"))).withColumn("_n", F.row_number().over(per_doc.orderBy(F.desc("_weak"), "ord")))
    said = F.concat(F.lit("Current score: "), _number(F.col("score")), F.lit("/"), F.col("max").cast("string"), F.lit(". Increase "), _spaced(F.col("pattern")), F.lit(" to boost citations."))
    row = lambda n, priority, category, title, description, impact, effort: F.struct(n.alias("n"), F.lit(priority).alias("priority"), F.col(category).alias("category"), title.alias("title"), description.alias("description"), F.lit(impact).alias("expected_impact"), F.lit(effort).alias("effort"))
    high = F.when(F.col("_gap") & (F.col("severity") == "high") & (F.col("_rank") <= 3), row(F.col("_rank"), "high", "category", F.concat(F.lit("Fix "), F.initcap(_spaced(F.col("category"))), F.lit(" Gap")), F.col("description"), "High citation boost (+20-30%)", "Medium"))
    low = F.when(F.col("_weak") & (F.col("_n") <= 3), row(F.col("_n") + 3, "medium", "pattern", F.concat(F.lit("Improve "), F.initcap(_spaced(F.col("pattern")))), said, "Medium citation boost (+10-20%)", "Low"))
    return numbered.select("doc_id", F.explode(F.array(high, low)).alias("r")).filter("r is not null").select("doc_id", "r.*")


def gap_arrays(found: DataFrame, n: int) -> DataFrame:
    """(doc_id, descriptions): the first n gaps' descriptions in order."""
    some = found.filter(F.col("rank") <= n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "description"))).alias("g"))
    return some.select("doc_id", F.transform("g", lambda x: x["description"]).alias("descriptions"))


def planned_changes(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """For pairs(doc_id, original, optimized): a change for each of the first ten gaps if the text differs."""
    changed = pairs.filter(~F.col("original").eqNullSafe(F.col("optimized"))).select("doc_id")
    return changed.join(top_gaps(found, 10), "doc_id").select("doc_id", F.col("rank").alias("n"), F.lit("inject").alias("type"), F.concat(F.lit("Fixed: "), "description").alias("description"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("original_text"), F.lit("").alias("optimized_text"), F.lit(5).alias("expected_uplift"))


TASKS = ["structured data (tables, lists)", "more named people, places, products and dates", "citation hooks", "answers to follow-up questions", "dates and versions", "comparison tables", "explicit definitions", "step-by-step procedures", "a FAQ section", "why the information matters"]
STYLES = {"preserve": "Keep the style and tone of the original.", "aggressive": "The style may change to raise the score."}


def rewrite_requests(docs: DataFrame, found: DataFrame, style: str = "preserve") -> DataFrame:
    """(doc_id, prompt): a work-list for an external rewriter, with each document's first five gaps."""
    asks = F.array_join(F.transform(F.coalesce("descriptions", F.array().cast("array<string>")), lambda d: F.concat(F.lit("- "), d)), "\n")
    steps = "\n".join(f"{i}. {t}" for i, t in enumerate(TASKS, 1))
    prompt = F.concat_ws("\n\n", F.lit("Rewrite the content so that answer engines cite it more."), F.concat(F.lit("Gaps to mend:\n"), asks), F.lit(STYLES[style]), F.lit(f"Work in, where it fits:\n{steps}"), F.concat(F.lit("Content:\n"), F.coalesce("content", F.lit(""))))
    return docs.select("doc_id", "content").join(gap_arrays(found, 5), "doc_id", "left").select("doc_id", prompt.alias("prompt"))


