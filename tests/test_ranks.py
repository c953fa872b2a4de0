import numpy as np
import pandas as pd
import pytest

from pagewright.operators import ranks, usage


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("bucket", [3, 10**6])
def test_percent_ranks_and_quantiles(spark, bucket):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 200), ("b", 31), (None, 17), ("one", 1)) for v in np.round(rng.normal(size=n), 1)] + [("a", 5.0)] * 300
    p = pd.DataFrame(rows, columns=["k", "v"])
    p["k"] = p["k"].fillna("-")
    got = ranks.percent_ranks(frame(spark, rows), "v", "k", bucket=bucket).toPandas().fillna({"k": "-"})
    want = p.groupby("k")["v"].rank(method="min") - 1
    want = want / (p.groupby("k")["v"].transform("size") - 1).clip(lower=1)
    assert sorted(zip(got["k"], got["v"], got["corpus_percentile"].round(12), strict=True)) == sorted(zip(p["k"], p["v"], want.round(12), strict=True))
    whole = ranks.percent_ranks(frame(spark, rows), "v", bucket=bucket).toPandas()
    assert sorted(whole["corpus_percentile"].round(12)) == sorted(((p["v"].rank(method="min") - 1) / (len(p) - 1)).round(12))
    q = ranks.quantiles(frame(spark, rows), ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 0.99}, bucket=bucket).toPandas().fillna({"k": "-"}).set_index("k")
    for k, g in p.groupby("k")["v"]:
        assert q.loc[k, ["low", "mid", "high"]].tolist() == pytest.approx([g.min(), g.median(), g.quantile(0.99)])


def test_odd_values(spark):
    rows = [("a", None), ("a", float("nan")), ("a", float("-inf")), ("a", float("inf")), ("a", -0.0), ("a", 0.0), (None, None)]
    got = ranks.percent_ranks(frame(spark, rows), "v", "k", bucket=1).toPandas()
    assert len(got) == 7 and got["corpus_percentile"].isna().sum() == 3
    assert sorted(got["corpus_percentile"].dropna()) == [0.0, 1 / 3, 1 / 3, 1.0]
    assert ranks.percent_ranks(frame(spark, []), "v", "k").count() == 0
    assert ranks.quantiles(frame(spark, []), ["k"], "v", {"mid": 0.5}).count() == 0


def test_latency_of_odd_paths(spark):
    t = spark.createDataFrame([(None, 200, 1.0), (None, 500, 3.0), ("/a", 200, None)], "path string, status int, duration_s double")
    got = {r["path"]: (r["requests"], r["p50_s"], r["p99_s"], r["error_rate"]) for r in usage.latency_report(t).collect()}
    assert got == {None: (2, 2.0, 2.98, 0.5), "/a": (1, None, None, 0.0)}
    plan = usage.latency_report(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
