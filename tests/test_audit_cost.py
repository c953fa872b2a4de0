"""What an audit does once a text, and that its shortcuts give what the patterns give."""

import random

from pyspark.sql import functions as F

from pagewright.functions.text import contains_any, has, words
from pagewright.operators import scoring, structure
from pagewright.plans import registry
from pagewright.sources import tables

PIECES = ["# ", "## a", "```", "```py\n", "|", "| a | b |", "|---|---|", "- ", "* x", "+\t", "1. ", "12.\t", "![", "](", ")", "[", "]", "`", "**", "\n", "\n\n", " \n", "\t\n", "\r\n", "\x0b", "\f\n", "word", "é", "—", "　", " ", "  ", "?"]


def _texts(seed):
    r = random.Random(seed)
    return ["", *PIECES, *("".join(r.choice(PIECES) for _ in range(r.randrange(2, 30))) for _ in range(1500))]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_audit_looks_for_each_fold_letter_once_a_text(spark):
    """Before, each of the four letters doubled the expression, twice an audit."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        audits = scoring.score_parsed(structure.parse_markdown(tables.articles(spark, "/root/testdata/sf0.001")))
        assert _plan(audits.select("doc_id", "score")).count("\u0131") == 4  # found and replaced, in the text and in its lower case
        # A condition on the score stays above the audit.
        assert _plan(audits.filter("score >= 10").select("doc_id")).count("\u0131") == 4
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_text_of_markdown_is_what_all_patterns_leave(spark):
    t = F.col("content")
    for _, pattern, to in structure.UNSEEN:
        t = F.regexp_replace(t, pattern, to)
    t = F.btrim(F.regexp_replace(t, r"[ \t\x0b\f\r]*+\n\s*+", " "), F.lit(" \t\n\x0b\f\r"))
    docs = spark.createDataFrame([(x,) for x in _texts(5)], "content string").withColumn("want", t)
    blocks = F.transform(F.split(F.regexp_replace("content", structure.FENCED, "\n\n"), structure.BLANK, -1), lambda b: F.regexp_replace(b, r"^\n+|\n+$", ""))
    docs = docs.withColumn("lists_", F.size(F.filter(blocks, lambda b: b.rlike(structure.LIST)))).withColumn("tables_", F.size(F.filter(blocks, lambda b: b.rlike(structure.TABLE))))
    rows = structure.parse_markdown(docs).select("*", F.size("lists").alias("n_lists"), F.size("tables").alias("n_tables")).collect()
    for r in rows:
        assert (r["text"], r["n_lists"], r["n_tables"]) == (r["want"], r["lists_"], r["tables_"]), r["content"]
    assert sum(r["n_lists"] for r in rows) and sum(r["n_tables"] for r in rows)


def test_parts_are_found_from_their_rarest_letter_on(spark):
    parts = ["is a", "as of", "faq", "source:", "step", "significantly", "](", " \n", "x", "ſ"]
    texts = [*parts, *(p[1:] for p in parts), *(f"a {p} b" for p in parts), "quently", "source", ":", ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", *(has(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(parts)), contains_any(F.col("t"), parts).alias("any")).collect():
        assert [r[f"p{i}"] for i in range(len(parts))] == [p in r["t"] for p in parts] and r["any"] == any(p in r["t"] for p in parts)


def test_simple_and_other_texts_have_the_same_words(spark):
    texts = _texts(6) + ["a\xa0b", "a\x7fb c", "naïve café\nß  x", "a—b c", "a\x1fb", "😀 a".encode("utf-16", "surrogatepass").decode("utf-16"), "a" * 50_000 + " b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w")).collect()
    assert all(r["w"] == r["t"].split() for r in rows)


def test_lower_case_is_its_own(spark):
    """folded_lc takes the text's lower case for that of the lower case."""
    letters = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for t in (F.col("c"), F.concat(F.lit("a"), "c"), F.concat("c", F.lit("a")), F.concat(F.lit("AΣ"), "c")):
        assert letters.filter(F.lower(F.lower(t)) != F.lower(t)).count() == 0


def test_a_search_among_scored_articles_audits_them_once(spark):
    """Before, each use of the vectors ran the audit: the count, the buckets' sizes and the vectors themselves."""
    _, vectors = registry._top_scored(spark, "/root/testdata/sf0.001")
    assert "common questions" not in _plan(vectors) and vectors.count() > 0
