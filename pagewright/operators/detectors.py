"""The ten pattern detectors, and a registry to which a user adds more.

A detector takes no frame: it is a function from nothing to a struct column over the columns of
parse_corpus(), text_lc, the counts in COUNTS and what detect() adds to them. All of a registry are
applied in one select. Each count is a column of its own below that select, so its patterns run once
a text: words by searching for them in the text with its case folded, other patterns only in texts
that have their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import contains_any, folded, matches, r1, times

# What the detectors look for.
CITATION_HOOKS = [r"according to", r"research (from|by|at)", r"study (found|shows|indicates)", r"\[.*\]\(.*\)", r"source:", r"references?:"]
TEMPORAL = [r"\d{4}", r"(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}", r"as of", r"updated", r"version\s+\d+", r"v\d+\.\d+"]
COMPARISON = ["vs", "versus", "compare", "comparison", "difference", "better", "worse"]
DEFINITIONS = [r"is defined as", r"means", r"refers to", r"is a", r"is an", r"\*\*.*\*\*.*is"]
STEPS = [r"step\s+\d+", r"step\s+[a-z]", r"first.*second.*third", r"\d+\.\s+"]
FAQ = r"frequently asked questions|faq|common questions"
META = [r"this is important because", r"this is critical because", r"this matters because", r"significantly", r"crucially", r"essential"]
NESTED = r"(?:what|how|why|when|where|which)[^?\n]*\?.*(?:but|however|additionally|furthermore|moreover)"
ENTITY = r"(?<!\p{L})\p{Lu}[\p{L}\p{N}-]+(?: \p{Lu}[\p{L}\p{N}-]+)+|(?<!\d)(?:19|20)\d{2}(?!\d)|(?<!\p{L})v\d+(?:\.\d+)+|(?<!\p{L})\p{Lu}{2,}-?\d+"

Detector = Callable[[], Column]


def _scored(score: Column, most: int, detected: Column, **evidence: Column) -> Column:
    fields = [score.cast("double").alias("score"), F.lit(most).alias("max"), F.coalesce(detected, F.lit(False)).alias("detected")]
    return F.struct(*fields, *(c.alias(n) for n, c in evidence.items()))


#: In place of a pattern, over the folded text: what it needs at least one of, and a pattern with the same number of matches.
NEEDS = {
    CITATION_HOOKS[1]: (["research "], None),
    CITATION_HOOKS[2]: (["study "], None),
    # These three match a line once, from the first of their parts to the last, so each line is looked at once.
    CITATION_HOOKS[3]: (["]("], r"(?m)^(?>.*?\[)(?>.*?\]\().*?\)"),
    DEFINITIONS[5]: (["**"], r"(?m)^(?>.*?\*\*)(?>.*?\*\*).*?is"),
    STEPS[2]: (["first"], r"(?m)^(?>.*?first)(?>.*?second).*?third"),
    CITATION_HOOKS[5]: (["reference"], None),
    TEMPORAL[1]: (["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"], None),
    TEMPORAL[4]: (["version"], None),
    STEPS[0]: (["step"], None),
    STEPS[1]: (["step"], None),
}
#: Patterns that begin with a number look at the text's numbers alone, each with a `v` before and a space behind.
NUMBERS, NUMERIC = r"(?U)v?\d[\d.]*\s?", [TEMPORAL[0], TEMPORAL[5], STEPS[3]]
DAY_YEAR = r"(?U)(?:^|\|)\d{1,2}\s?\|\d{4}"
#: NESTED, of which the first word and the first mark after it decide, so a line is looked at once.
NESTED_ONCE = r"(?dU)^(?>.*?(?:what|how|why|when|where|which))(?>.*?\?).*?(?:but|however|additionally|furthermore|moreover)"


def _matches(text: str, pattern: str) -> Column:
    """matches() of a text whose case is folded in the column `text`, with the numbers in it in `numbers`."""
    if pattern in NUMERIC:
        return F.regexp_count(F.col("numbers"), F.lit("(?dU)" + pattern))
    if pattern not in NEEDS:
        return times(F.col(text), pattern)
    parts, other = NEEDS[pattern]
    needed = contains_any(F.col(text), parts)
    if r"\d" in pattern:  # a date has a day and a year next to each other among the numbers
        needed = (F.col("numbers").rlike(DAY_YEAR) if pattern == TEMPORAL[1] else F.col("numbers") != "") & needed
    return F.when(needed, matches(F.col(text), other or pattern, ignore_case=False)).otherwise(0)


def _total(text: str, patterns: list[str]) -> Column:
    out = _matches(text, patterns[0])
    for p in patterns[1:]:
        out = out + _matches(text, p)
    return out


#: What detectors share: the column of each count, the text it is of (in detect()), and its patterns.
COUNTS = {"n_hooks": ("folded_lc", CITATION_HOOKS), "n_dates": ("folded", TEMPORAL), "n_definitions": ("folded", DEFINITIONS), "n_steps": ("folded", STEPS), "n_meta": ("folded", META)}


def _per_word(count: Column, by: int) -> Column:
    return F.when(F.col("word_count") > 0, count / F.col("word_count") * by).otherwise(F.lit(0.0))


def structured_data() -> Column:
    rate = _per_word(F.size("tables") + F.size("lists") + F.size("headers"), 500)
    return _scored(r1(F.least(F.lit(20.0), rate / 2 * 20)), 20, rate >= 1, elements_per_500=rate)


def entity_density(mode: str = "off") -> Detector:
    """`off` finds nothing, `surface` counts distinct names, years, versions and product tokens: it approximates entities.

    `given` takes the count from the column n_entities, as entities.entity_scores() joins it from a dictionary.
    """

    def detect() -> Column:
        count = F.lit(0) if mode == "off" else F.col("n_entities") if mode == "given" else F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))))
        rate = _per_word(count, 100)
        return _scored(r1(F.least(F.lit(15.0), rate / 3 * 15)), 15, rate >= 2, entity_count=count)

    return detect


def citation_hooks() -> Column:
    count = F.col("n_hooks")
    return _scored(r1(F.least(F.lit(10.0), _per_word(count, 1000) / 2 * 10)), 10, count > 0, citation_count=count)


def recursive_depth() -> Column:
    marks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("?"), F.lit("")))
    asked, nested = F.floor(marks / 2).cast("int"), F.col("n_nested")
    return _scored(F.least(F.lit(7.5), asked * 1.5) + F.least(F.lit(7.5), nested * 2.5), 15, (asked > 0) | (nested > 0), question_count=asked, nested_count=nested)


def temporal_anchoring() -> Column:
    count = F.col("n_dates")
    return _scored(F.least(F.lit(10), count * 2), 10, count > 0, date_count=count)


def comparison_tables() -> Column:
    tables, words = F.size("tables"), F.col("compares")
    return _scored(F.least(F.lit(10), tables * 5) + F.when(words, 5).otherwise(0), 15, (tables > 0) | words, table_count=tables, has_keywords=words)


def definitional_precision() -> Column:
    count = F.col("n_definitions")
    return _scored(F.least(F.lit(10), count * 2), 10, count > 0, definition_count=count)


def procedural_clarity() -> Column:
    steps = F.col("n_steps")
    ordered = F.filter("lists", lambda x: x["type"] == "ordered")
    items = F.aggregate(ordered, F.lit(0), lambda s, x: s + x["item_count"])
    return _scored(r1(F.least(F.lit(3.0), steps * 0.5) + F.least(F.lit(2.0), items / 5)), 5, (steps > 0) | (F.size(ordered) > 0), step_count=steps, ordered_items=items)


def faq_injection() -> Column:
    section = F.col("has_faq")
    asking = F.size(F.filter("headers", lambda h: F.contains(h["text"], F.lit("?"))))
    return _scored(F.when(section, 10).otherwise(0) + F.least(F.lit(5), asking), 15, section | (asking > 0), has_section=section, question_headers=asking)


def meta_context() -> Column:
    count = F.col("n_meta")
    return _scored(F.least(F.lit(10), count * 2), 10, count > 0, meta_count=count)


def registry(entities: str = "off") -> dict[str, Detector]:
    return {"structured_data": structured_data, "entity_density": entity_density(entities), "citation_hooks": citation_hooks, "recursive_depth": recursive_depth, "temporal_anchoring": temporal_anchoring, "comparison_tables": comparison_tables, "definitional_precision": definitional_precision, "procedural_clarity": procedural_clarity, "faq_injection": faq_injection, "meta_context": meta_context}


PATTERNS = list(registry())


def detect(parsed: DataFrame, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """Add a struct column for each detector: score, max, detected and its evidence."""
    lower = F.col("text_lc")  # its own lower case, too
    ready = parsed.withColumn("text_lc", F.lower("text")).withColumn("folded", folded(F.col("text"), lower))
    ready = ready.withColumns({"folded_lc": folded(lower, lower), "numbers": F.array_join(F.regexp_extract_all("folded", F.lit(NUMBERS), F.lit(0)), "|")})
    ready = ready.withColumns({name: _total(text, patterns) for name, (text, patterns) in COUNTS.items()})
    lines = F.size(F.filter(F.split("folded", "\n", -1), lambda x: x.rlike(NESTED_ONCE)))
    shared = {"n_nested": F.when(F.contains("folded", F.lit("?")), lines).otherwise(0), "compares": contains_any(F.col("text_lc"), COMPARISON), "has_faq": contains_any(F.col("folded"), FAQ.split("|"))}
    ready = ready.withColumns(shared)
    return ready.select(*parsed.columns, *(d().alias(n) for n, d in (detectors or registry()).items()))


def long_form(detected: DataFrame, patterns: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, ord, pattern, score, max, detected): a row for each document and pattern."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"), F.col(f"{p}.score").alias("score"), F.col(f"{p}.max").alias("max"), F.col(f"{p}.detected").alias("detected")) for i, p in enumerate(patterns or PATTERNS)))
    return detected.select(*keep, F.explode(rows).alias("p")).select(*keep, "p.*")
