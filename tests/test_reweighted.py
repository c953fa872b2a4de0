import math
import random

from pyspark.sql import functions as F

from pagewright.operators import detectors as d
from pagewright.operators import scoring


def test_reweighted_scores_are_divided_as_the_sql_does(spark):
    """sums that differ in their last digit if a pattern whose weight stays is not divided by its maximum."""
    r, weights, rows = random.Random(5), dict.fromkeys(d.PATTERNS, 10), []
    up = lambda x: math.floor(x * 10 + 0.5) / 10
    while len(rows) < 20:
        s = {p: r.randrange(0, scoring.WEIGHTS[p] * 10 + 1) / 10 for p in d.PATTERNS}
        whole, mixed = 0.0, 0.0
        for p in d.PATTERNS:
            whole += s[p] / scoring.WEIGHTS[p] * 10
            mixed += s[p] if scoring.WEIGHTS[p] == 10 else s[p] / scoring.WEIGHTS[p] * 10
        if up(whole) != up(mixed):
            rows.append((*(s[p] for p in d.PATTERNS), up(whole)))
    df = spark.createDataFrame(rows, ", ".join(f"{p}_s double" for p in d.PATTERNS) + ", want double")
    found = df.select("want", *(F.struct(F.col(f"{p}_s").alias("score"), F.lit(scoring.WEIGHTS[p]).alias("max")).alias(p) for p in d.PATTERNS))
    assert all(x["total"] == x["want"] for x in found.select("want", scoring.total_score(weights).alias("total")).collect())
