"""Counts over folded text against the detectors' own patterns, and what decides an audit's time and totals."""

import random

from pyspark.sql import functions as F

from pagewright.functions.text import folded, matches, words
from pagewright.operators import detectors as d
from pagewright.sources import tables

PIECES = ["According to", "research by", "Study Found", "study İndicates", "[", "]", "](", ")", "source:", "References:", "reference:", "2021", "12345678", "١٢٣٤", "May 3, 2020", "maY\n12 1999", "mayor", "as of", "Aſ of", "Updated", "version  7", "V1.2", "v1..2", "v3.4.5", "1. ", "2.\n", "3.x", "vs", "is a", "is an", "iſ a", "ıs a", "means", "K", "refers to", "is defined as", "**", "step 1", "ſTEP b", "step  K", "first", "SECOND", "third", "what", "How", "?", "but", "However", "FAQ", "common questıons", "this matters because", "essential", "crucially", " ", "  ", "\n", "　", "Жи", "x", "\x1c", "\x85"]


def _texts():
    r = random.Random(3)
    return ["", *PIECES, *("".join(r.choice(PIECES) + r.choice(["", " ", " "]) for _ in range(r.randrange(2, 25))) for _ in range(1500))]


def test_counts_are_those_of_the_patterns(spark):
    parsed = spark.createDataFrame([(t,) for t in _texts()], "text string").repartition(8)
    own = {"n_hooks": ("text_lc", d.CITATION_HOOKS), "n_dates": ("text", d.TEMPORAL), "n_definitions": ("text", d.DEFINITIONS), "n_steps": ("text", d.STEPS), "n_meta": ("text", d.META)}
    names = list(own)
    found = d.detect(parsed, {n: (lambda n=n: F.col(n)) for n in [*names, "n_nested", "has_faq"]}).withColumn("text_lc", F.lower("text"))
    for n, (text, patterns) in own.items():
        found = found.withColumn(f"want_{n}", sum((matches(F.col(text), p) for p in patterns[1:]), matches(F.col(text), patterns[0])))
    found = found.withColumn("want_n_nested", F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike("(?diuU)" + d.NESTED)))).withColumn("want_has_faq", F.col("text").rlike("(?iu)" + d.FAQ))
    rows = found.collect()
    for r in rows:
        for n in [*names, "n_nested", "has_faq"]:
            assert r[n] == r[f"want_{n}"], (n, r["text"], r[n], r[f"want_{n}"])
    assert all(any(r[n] for r in rows) for n in [*names, "n_nested", "has_faq"])


def test_every_letter_that_equals_an_ascii_letter_is_folded(spark):
    letters = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    both = letters.select("c", F.col("c").rlike("(?iu)^[a-z]$").alias("equal"), folded(F.col("c")).alias("f"))
    assert both.filter(F.col("equal") != F.col("f").rlike("^[a-z]$")).collect() == []
    assert both.filter("equal").count() == 56  # 52, and the four of FOLDS


def test_words_are_those_of_python(spark):
    texts = _texts()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w")).collect()
    assert all(r["w"] == r["t"].split() for r in rows)


def test_lines_of_many_openings_take_no_time(spark):
    """Quadratic or worse by the patterns as they are: 20,000 openings that nothing closes."""
    texts = ["first second " * 20_000, "** " * 20_000, "what how when " * 20_000 + "?", "[ ](" * 20_000, "first " * 20_000 + "third"]
    parsed = spark.createDataFrame([(t,) for t in texts], "text string")
    out = d.detect(parsed, {n: (lambda n=n: F.col(n)) for n in ("n_steps", "n_definitions", "n_nested", "n_hooks")}).collect()
    assert [(r["n_steps"], r["n_definitions"], r["n_nested"], r["n_hooks"]) for r in out] == [(0, 0, 0, 0)] * 5


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(20_000).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= 8
        most = tables.spread(table).groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
        assert most <= 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
