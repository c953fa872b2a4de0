"""Cases worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import domain, word_count
from pagewright.operators import benchmarks, citations, compare, detectors, edits, gaps, scoring, structure, usage, validate
from pagewright.operators.usage import admit

CASES = [
    ("# Test Article\n\nThis is a test article.", 8, 22.0, 35, 8),
    ("# Comparison\n\n| Feature | A |\n|---------|---|\n| Price | $10 |", 14, 25.0, 35, 8),
    ("# Article\n\nOpenAI released GPT-4 in March 2023. The model was updated in 2024.", 14, 24.5, 35, 7),
    ("# Test\n\nSimple content without patterns.", 6, 20.0, 35, 9),
]


def docs(spark, texts, fmt="markdown"):
    return spark.createDataFrame([(i, None, t, fmt) for i, t in enumerate(texts)], "doc_id long, url string, content string, format string")


@pytest.mark.parametrize("case", [0, 2, 3])
def test_short_documents(spark, case):
    text, words, total, penalty, lacking = CASES[case]
    a = scoring.audit_corpus(docs(spark, [text]))
    row = a.first()
    if case == 2:  # "updated" counts as well
        assert row["temporal_anchoring"]["date_count"] == 3
        total += 2
    else:
        assert row["word_count"] == words
    assert row["total"] == total
    assert row["penalty_density"] + row["penalty_stuffing"] == penalty
    assert (row["score"], row["grade"]) == (0.0, "F")
    assert gaps.gaps(detectors.long_form(a)).count() == lacking


def test_gap_order(spark):
    g = gaps.gaps(detectors.long_form(scoring.audit_corpus(docs(spark, [CASES[3][0]])))).orderBy("rank")
    assert [r["pattern"] for r in g.collect()] == ["recursive_depth", "comparison_tables", "entity_density", "citation_hooks", "temporal_anchoring", "faq_injection", "definitional_precision", "procedural_clarity", "meta_context"]


def test_replay_of_counts(spark):
    """Recorded counts must give 92.5, a penalty of 20 and 72.5, grade B."""
    text = "word " * 3333
    row = spark.range(1).select(F.lit(3333).alias("word_count"), F.array_repeat(F.lit(1), 11).alias("tables"), F.array_repeat(F.struct(F.lit("ordered").alias("type"), F.lit(10).alias("item_count")), 24).alias("lists"), F.array_repeat(F.struct(F.lit("x").alias("text")), 52).alias("headers"), F.lit(text).alias("text"))
    assert row.select(detectors.structured_data().alias("k")).first()["k"]["score"] == 20.0
    score = dict(structured_data=20.0, entity_density=0.0, citation_hooks=10.0, recursive_depth=12.5, temporal_anchoring=10.0, comparison_tables=15.0, definitional_precision=4.0, procedural_clarity=5.0, faq_injection=10.0, meta_context=6.0)
    flat = row.select("*", *(F.struct(F.lit(s).alias("score"), F.lit(scoring.WEIGHTS[p]).alias("max"), F.lit(s > 0).alias("detected")).alias(p) for p, s in score.items()), F.lit(1).alias("doc_id"))
    got = flat.select(scoring.total_score().alias("total"), scoring.penalty_density().alias("p")).first()
    assert (got["total"], got["p"]) == (92.5, 20)
    assert spark.range(1).select(scoring.grade(F.lit(72.5)).alias("g")).first()["g"] == "B"
    assert [r["pattern"] for r in gaps.gaps(detectors.long_form(flat)).collect()] == ["entity_density"]
    said = gaps.recommendations(detectors.long_form(flat)).orderBy("n").collect()
    assert [(r["title"], r["description"]) for r in said] == [("Improve Entity Density", "Current score: 0/15. Increase entity density to boost citations."), ("Improve Definitional Precision", "Current score: 4/10. Increase definitional precision to boost citations.")]


@pytest.mark.parametrize(("marks", "asked"), [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)])
def test_question_marks_count_in_pairs(spark, marks, asked):
    p = structure.parse_markdown(docs(spark, ["a? " * marks]))
    assert detectors.detect(p).first()["recursive_depth"]["question_count"] == asked


def test_words_within_words(spark):
    p = detectors.detect(structure.parse_markdown(docs(spark, ["tvs", "is an owl", "March 5, 2023", "20245678", "show this? button"])))
    rows = {r["doc_id"]: r for r in p.collect()}
    assert rows[0]["comparison_tables"]["detected"]
    assert rows[1]["definitional_precision"]["definition_count"] == 2
    assert rows[2]["temporal_anchoring"]["date_count"] == 2
    assert rows[3]["temporal_anchoring"]["date_count"] == 2
    assert rows[4]["recursive_depth"]["nested_count"] == 1


def test_stuffing_border(spark):
    texts = ["longer " + "a " * 18, "longer " + "a " * 19, "longer longer " + "a " * 18]
    rows = scoring.with_stuffing(structure.parse_markdown(docs(spark, texts))).orderBy("doc_id").collect()
    assert [r["penalty_stuffing"] for r in rows] == [15, 0, 15]


def test_borders(spark):
    at = spark.createDataFrame([(x,) for x in (49.9, 50.0, 59.9, 60.0, 69.9, 70.0, 79.9, 80.0, 89.9, 90.0)], "s double")
    rows = at.select(scoring.grade(F.col("s")).alias("g"), benchmarks.percentile_band(F.col("s")).alias("b")).collect()
    assert [r["g"] for r in rows] == ["F", "D", "D", "C", "C", "B", "B", "A", "A", "A+"]
    assert [r["b"] for r in rows] == [15, 30, 30, 50, 50, 70, 70, 85, 85, 95]


def test_empty_and_null(spark):
    rows = scoring.audit_corpus(docs(spark, ["", None])).collect()
    assert [(r["word_count"], r["score"], r["penalty_density"]) for r in rows] == [(0, 0.0, 0)] * 2
    assert scoring.audit_corpus(docs(spark, [])).count() == 0


def test_structure(spark):
    text = "## Second\n\n# First\n\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\n\n- x\n- y\n\n1. one\n\n```\n# no header\n- no item\n```\n\nSee [t](http://u/) and ![i](p.png). **Bold** `code`"
    r = structure.parse_markdown(docs(spark, [text])).first()
    assert [(h["level"], h["text"], h["position"]) for h in r["headers"]] == [(1, "First", 0), (2, "Second", 1)]
    assert [(t["column_count"], t["row_count"]) for t in r["tables"]] == [(3, 2)]
    assert [(x["type"], x["item_count"]) for x in r["lists"]] == [("unordered", 2), ("ordered", 1)]
    assert [(x["text"], x["url"]) for x in r["links"]] == [("t", "http://u/")]
    assert "Bold code" in r["text"] and "http" not in r["text"] and "|" not in r["text"]
    assert structure.doc_elements(structure.parse_markdown(docs(spark, [text]))).count() == 6


def test_html(spark):
    page = '<html><head><title>T</title><script>var t="</p><h1>x</h1>";</script></head><body><h2>B</h2><h1>A &amp; C</h1><p><b>one<br><p>two<!-- <li> --><ul><li>x<li>y</ul><table><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr></table><a href="/u">go</a></body></html>'
    r = structure.parse_html(docs(spark, [page], "html")).first()
    assert [(h["level"], h["text"]) for h in r["headers"]] == [(1, "A & C"), (2, "B")]
    assert [(t["column_count"], t["row_count"]) for t in r["tables"]] == [(2, 2)]
    assert [x["type"] for x in r["lists"]] == ["unordered"]
    assert [(x["text"], x["url"]) for x in r["links"]] == [("go", "/u")]
    assert r["text"].startswith("T B A & C one two") and "var" not in r["text"]
    assert r["word_count"] == 12  # B A & C one two x y h 1 2 go


def test_scalars(spark):
    u = ["example.com/a", "http://u:p@h.org:81/x?y", "https://h.org#f", ""]
    rows = spark.createDataFrame([(x,) for x in u], "u string").select(domain(F.col("u")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["example.com/a", "u:p@h.org:81", "h.org", ""]
    assert spark.createDataFrame([("a b\x1cc d\x85e　f",)], "t string").select(word_count(F.col("t")).alias("n")).first()["n"] == 6


def test_validation(spark):
    urls = [("http://a.com", True), ("https://localhost:80/x", True), ("http://1.2.3.4?q", True), ("ftp://a.com", False), ("http://a", False), (None, False), ("HTTP://A.COM/\n", True)]
    rows = spark.createDataFrame(urls, "u string, ok boolean").select("ok", validate.is_valid_url(F.col("u")).alias("v")).collect()
    assert all(r["ok"] == r["v"] for r in rows)
    text = spark.createDataFrame([("a\x00b",)], "t string").select(validate.sanitize(F.col("t")).alias("t")).first()["t"]
    assert text == "ab"
    ok, bad = validate.split_valid(docs(spark, ["x", None, "w " * 50_001]))
    assert ok.count() == 1 and sorted(r["error_code"] for r in bad.collect()) == ["CONTENT_TOO_LARGE", "INVALID_REQUEST"]


def test_line_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nb", "b\nc\na"), (2, "x", "x"), (3, None, "--y")], "doc_id long, original string, optimized string")
    rows = sorted((r["doc_id"], r["type"], r["line"], r["text"]) for r in compare.line_diff(pairs).collect())
    assert rows == [(1, "add", 2, "c"), (1, "remove", 3, "b"), (3, "add", 1, "--y"), (3, "remove", 1, "")]
    exact = {r["doc_id"]: r for r in edits.sequence_stats(pairs).collect()}
    assert exact[2]["changed_blocks"] == 1 and exact[2]["edited_blocks"] == 0


def test_admission():
    ok, _ = admit([i * 0.5 for i in range(60)] + [29.9, 59.9, 60.0, 60.4], [], 60, 60)
    assert ok[:60] == [True] * 60 and ok[60:] == [False, False, True, False]


def test_breaches_run_over_batches_and_gaps(spark):
    times = [i * 700_000 for i in range(900)] + [900_000_000 + i * 400_000 for i in range(400)] + [1_120_000_000 + i * 900_000 for i in range(100)]
    rows = spark.createDataFrame([(i, k, t) for k in ("a", "b", None) for i, t in enumerate(times)], "request_id long, api_key string, us long").select("request_id", "api_key", F.timestamp_micros("us").alias("ts"))
    want = {i for i, ok in enumerate(admit(times, [], 60, 60_000_000)[0]) if not ok}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = usage.rate_breaches(rows)
        got = [(r["api_key"], r["request_id"]) for r in out.collect()]
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and sorted(got, key=str) == sorted(((k, i) for k in ("a", "b", None) for i in want), key=str)
    assert usage.stretches(rows, 60).select("api_key", "stretch").distinct().count() == 9
    assert "FlatMapGroupsInPandas" not in plan  # no group in one frame


def test_rate_and_dates(spark):
    rows = spark.createDataFrame([("1", "u", "d", "grok", "2024-01-01 00:00:00"), ("2", "u", "d", "grok", "2023-12-31 23:59:59")], "id string, url string, domain string, engine string, at string").withColumn("detected_at", F.col("at").cast("timestamp"))
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert [r["id"] for r in citations.filter_citations(rows, at).collect()] == ["1"]
    assert citations.filter_citations(rows, at, engine="gpt").count() == 0
    assert usage.requests_per_minute(rows.select(F.lit("k").alias("api_key"), F.col("detected_at").alias("ts")), 0).count() == 2


def test_scores_stay_in_bounds(spark):
    texts = ["word " * 50 + "? " * k + "\n\n- a\n- b" * k for k in range(6)]
    for r in scoring.audit_corpus(docs(spark, texts)).collect():
        assert 0 <= r["score"] <= r["total"] <= 125
        assert all(0 <= r[p]["score"] <= r[p]["max"] for p in detectors.PATTERNS)


def test_scoring_does_not_shuffle(spark):
    plan = scoring.audit_corpus(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_only_runs_that_may_be_quoted_leave_their_rows(spark):
    passages = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(40))), (2, "too short"), (3, None)], "passage_id long, text string")
    texts = [" ".join(f"a{k}x{i}" for i in range(300)) for k in range(50)] + [" ".join(["q"] * 9 + [f"P{i}" for i in range(35)]), None, ""]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string")
    runs = citations.shingles(passages, "passage_id", "text", 8).select("h")
    kept = citations.sifted(answers, "answer_id", "text", 8, runs).collect()
    assert sum(r["answer_id"] == 50 for r in kept) >= 28 and len(kept) < 28 + 0.07 * 50 * 293
    got = citations.quoted_passages(answers, passages).collect()
    assert [(r["answer_id"], r["passage_id"], round(r["containment"], 6)) for r in got] == [(50, 1, round(28 / 33, 6))]
