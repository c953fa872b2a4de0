import zlib

import numpy as np

from pagewright.llm import op7_language as m
from tests.llm import edge


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = m.linear_svm([(np.arange(5), v) for v in x], y, 5)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_held_out(spark):
    p = m.op7_language_id(spark, "/root/testdata/sf0.01").toPandas()
    assert (p["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p["doc_id"]]).all()
    assert p["score"].between(0, 1).all()
    j = p[p["held_out"]].merge(edge.table(spark, "documents", "sf0.01").toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (j["lang_pred"] == j["lang"]).mean() > 0.98


def test_three_languages_of_a_family_vote():
    texts = [("en", "the and of with that this"), ("de", "der die und nicht eine mit"), ("nl", "het een van voor niet zijn"), ("xx", "qqq zzz xxq zqx")]
    counts = [m.gram_counts(t) for _, t in texts for _ in range(20)]
    model = m.fit([(np.flatnonzero(c), c[c > 0]) for c in counts], [lang for lang, _ in texts for _ in range(20)])
    assert model.families == {"germanic": ["de", "en", "nl"], "xx": ["xx"]} and len(model.pairs) == 3
    assert model.predict(np.stack([m.gram_counts(t) for _, t in texts]))[0] == [lang for lang, _ in texts]


def test_edges(spark):
    docs = edge.docs(spark)
    model = m.learn(docs)
    out = m.predict_language(docs, model).toPandas()
    assert len(out) == len(edge.ROWS)
    said = dict(zip(out["doc_id"], out["lang_pred"], strict=True))
    assert said[1] == said[2] == said[3] == said[7] == "und" and said[6] != "und"
    assert m.predict_language(edge.empty(spark), model).count() == 0
    none = m.learn(edge.empty(spark))
    assert {r["lang_pred"] for r in m.predict_language(docs, none).collect()} == {"und"}
    kept = m.predict_language(docs, model, keep_cols=True)
    assert kept.columns[:-2] == docs.columns


def test_sample_does_not_empty_with_size():
    from pagewright.llm.common import hash_bound

    assert hash_bound(750, 700) == hash_bound(750, 750) == 1 << 62
    for rows in (10**6, 10**10, 10**13):
        assert abs(hash_bound(750, rows) / (1 << 62) * rows - 750) < 1


def test_dirty_languages_and_repeats_dont_grow_the_sample(spark, monkeypatch):
    rows = [(i, f"some words of text {i}", f"x{i % 300}") for i in range(1200)] + [(7, "the same row", "en")] * 2000 + [(None, f"a row {i}", "de") for i in range(500)]
    seen = {}
    monkeypatch.setattr(m, "fit", lambda grams, langs: seen.update(n=len(grams), langs=set(langs)))
    m.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=100)
    assert seen["n"] <= 120 and "de" in seen["langs"] and len(seen["langs"]) <= 5  # the repeated row is one, in the sample or not
