import numpy as np

from pagewright.operators import benchmarks, nearest
from pagewright.plans import registry

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], SCHEMA)


def rows(df):
    return {(r["query_id"], r["vec_id"]): r["similarity"] for r in df.collect()}


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
        queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
        want, got = rows(benchmarks.similar_top_scored(queries, vectors, 5)), rows(nearest.similar_indexed(queries, vectors, 5))
        assert len(set(want) & set(got)) >= 0.9 * len(want), sf
        assert all(got[x] == want[x] for x in set(want) & set(got))
        ranks = nearest.similar_indexed(queries, vectors, 5).toPandas().sort_values(["query_id", "rank"])
        assert (ranks.groupby("query_id")["rank"].max() == 5).all() and (ranks.groupby("query_id")["similarity"].diff().dropna() <= 0).all()


def test_query(spark):
    want = rows(registry.queries()["similar_top_scored"](spark, "/root/testdata/sf0.001"))
    got = rows(registry.queries()["similar_indexed"](spark, "/root/testdata/sf0.001"))
    assert len(set(want) & set(got)) >= 0.9 * len(want)


def test_clustered_vectors_meet_few_others(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    v = np.repeat(centres, 50, axis=0) + 0.15 * rng.standard_normal((3000, 32))
    vectors = frame(spark, enumerate(v))
    queries = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    want, got = rows(benchmarks.similar_top_scored(queries, vectors, 5)), rows(nearest.similar_indexed(queries, vectors, 5, bits=8, tables=4))
    assert len(set(want) & set(got)) >= 0.98 * len(want)
    p = nearest.planes(32, 0, 8)
    codes = (v @ p > 0) @ (1 << np.arange(8))
    met = sum(np.isin(codes, nearest.probed(x / np.linalg.norm(x) @ p, 7)).mean() for x in v[::50]) / 60
    assert met < 0.25
    # Buckets in small blocks give the same.
    monkeypatch.setattr(nearest, "BLOCK", 7)
    assert rows(nearest.similar_indexed(queries.limit(9), vectors.filter("vec_id < 300"), 5)) == rows(nearest.similar_indexed(queries.limit(9), vectors.filter("vec_id < 300"), 5))


def test_all_probes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 5)
    rng = np.random.default_rng(2)
    v = [*enumerate(rng.integers(-2, 3, (120, 3)).tolist()), (500, [1, 1, 1]), (501, [1, 1, 1]), (502, [1, 1, 1])]
    queries = frame(spark, v).filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    some = frame(spark, v)
    want = benchmarks.similar_top_scored(queries.filter("exists(embedding, x -> x <> 0)"), some, 4)
    assert sorted(map(tuple, nearest.similar_indexed(queries, some, 4, tables=1, probes=64, bits=6).collect())) == sorted(map(tuple, want.collect()))


def test_codes_are_the_nearest():
    m = np.array([0.1, -0.9, 0.3, 0.2])
    cost = {c: sum(x**2 for b, x in enumerate(m) if (c >> b & 1) != (x > 0)) for c in range(16)}
    assert nearest.probed(m, 6) == sorted(cost, key=cost.get)[:6]


def test_edges(spark):
    v = [(1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [1, 2, 3]), (6, [1, 2]), (7, [2, 4]), (None, [1, 2]), (8, [float("nan"), 1])]
    got = rows(nearest.similar_indexed(frame(spark, v).filter("vec_id = 6 or vec_id = 3 or vec_id = 1").withColumnRenamed("vec_id", "query_id"), frame(spark, v).filter("vec_id is not null")))
    assert got == {(6, 7): 1.0}
    assert nearest.similar_indexed(frame(spark, []).withColumnRenamed("vec_id", "query_id"), frame(spark, v)).count() == 0
