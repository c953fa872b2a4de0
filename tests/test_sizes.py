from pyspark.sql import functions as F

from pagewright.operators import compare, detectors, gaps, ranks, validate


def test_sizes_at_the_limit(spark):
    texts = ["w " * 50_000, "w " * 50_000 + "w", "w " * 49_999 + "w", "word  " * 50_001, "\x00w" * 60_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, content string").withColumn("format", F.lit("markdown"))
    assert [r["error_code"] for r in validate.error_code(rows).orderBy("i").collect()] == [None, "CONTENT_TOO_LARGE", None, "CONTENT_TOO_LARGE", None, "INVALID_REQUEST"]


def test_text_diff_shuffles_no_words(spark):
    pairs = spark.createDataFrame([(1, "a b a\x1cc", "a a a d"), (2, None, ""), (3, None, "x\u3000y")], "doc_id long, original string, optimized string")
    out = compare.text_diff_stats(pairs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0.5), (2, 0, 1.0), (3, 2, 0.0)]


def test_recommendations_read_the_scores_once(spark):
    rows = [(1, i, p, s, 10, s > 3) for i, (p, s) in enumerate(zip(detectors.PATTERNS, [9.0, 0.0, 1.5, 0.0, 4.0, 0.0, 9.0, 4.5, 0.0, 9.0], strict=True))]
    scores = spark.createDataFrame(rows, "doc_id long, ord int, pattern string, score double, max int, detected boolean")
    out = gaps.recommendations(scores.repartition(3))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    got = sorted((r["n"], r["priority"], r["category"]) for r in out.collect())
    assert got == [(1, "high", "recursion"), (2, "high", "comparison"), (4, "medium", "entity_density"), (5, "medium", "citation_hooks"), (6, "medium", "recursive_depth")]


def test_ranks_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        seen.add(1)
        return float(x % 50)

    rows = spark.range(400).select("id", slow("id").alias("v"))
    out = ranks.ranked(rows, [], "v", bucket=10).collect()
    assert len(out) == 50 and seen.value <= 800  # once or, if a filter repeats it, twice, and not for each use of the counts
