import zlib

import numpy as np

from pagewright.llm import op6_quality as m
from tests.llm import edge


def test_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = m.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_score_is_the_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    model = m.fit(x, (x[:, 0] > 0.3).astype(float), rounds=10)
    row = x[:1]
    total = model.base + sum(t[np.searchsorted(e, row[0, j], "right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    total += sum(t[np.searchsorted(model.coarse[i], row[0, i], "right"), np.searchsorted(model.coarse[j], row[0, j], "right")] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    assert abs(model.margin(row)[0] - total) < 1e-9


def test_held_out(spark):
    p = m.op6_quality_score(spark, "/root/testdata/sf0.1").toPandas()
    assert p["score"].between(0, 1).all()
    assert (p["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in p["doc_id"]]).all()
    assert (p["predicted"] == (p["score"] >= 0.3)).all()
    j = p[p["held_out"]].merge(edge.table(spark, "labels", "sf0.1").toPandas(), on="doc_id")
    assert len(j) > 500
    assert (j["predicted"] == j["quality"]).mean() > 0.97
    assert (j["predicted"][j["quality"] == 1] == 1).mean() > 0.99


def test_edges(spark):
    docs = edge.docs(spark)
    out = m.score_quality(docs, m.learn(docs, edge.labels(spark)))
    assert out.count() == len(edge.ROWS) and out.filter("score is null or held_out is null").count() == 0
    scores = {r["score"] for r in out.filter("doc_id = 2 or doc_id = 1").collect()}
    assert len(scores) == 1  # null as empty
    none = m.learn(edge.empty(spark), edge.labels(spark))
    assert {r["score"] for r in m.score_quality(docs, none).collect()} == {0.5}
    assert m.score_quality(edge.empty(spark), none).count() == 0
    assert set(m.text_features(None)) == {0.0}


def test_repeated_ids_dont_grow_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(900)] + [(7, "the same")] * 900 + [(i, f"own {i}") for i in range(100, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, 1)] + [(i, i % 2) for i in range(100, 200)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(m, "fit", lambda x, y: seen.update(n=len(x)))
    m.learn(docs, labels, most_rows=300)
    assert 50 < seen["n"] < 450
    m.learn(docs, labels, most_rows=10**6)
    assert seen["n"] > 1800  # each text with each label, the repeated row once
