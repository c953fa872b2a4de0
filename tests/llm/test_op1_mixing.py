import numpy as np
import pytest

from pagewright.llm import op1_mixing as m
from tests.llm import edge


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = m.permute(np.arange(n), n, 99)
    assert sorted(p) == list(range(n))
    assert (m.permute(p, n, 99, inverse=True) == np.arange(n)).all()


def test_water_fill():
    assert m.water_fill([10, 10, 10], [5, 2, 1], 30, 3) == [18.75, 7.5, 3.75]
    t = m.water_fill([1, 100, 100], [5, 2, 1], 201, 3)
    assert t[0] == 3 and abs(sum(t) - 201) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert m.water_fill([0, 0], [1, 1], 0, 3) == [0, 0]
    assert m.water_fill([], [], 0, 3) == []


def test_query(spark):
    p, q = (edge.by_id(m.op1_mix_sources(spark, "/root/testdata/sf0.001")) for _ in range(2))
    assert p.equals(q)
    d = edge.by_id(edge.table(spark, "documents"))
    words = d["text"].map(lambda t: len(t.encode().split()))
    assert (p["size"] == words).all()
    assert (p["taken"] <= 3 * p["size"]).all()
    by = p.assign(source=d["source"]).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (by["source_size"] == by["size"]).all()
    assert ((by["taken"] - by["target"]).abs() <= 1).all()
    assert abs(by["target"].sum() - words.sum()) < 1e-6


def test_blocks_hold_the_words(spark):
    d = edge.table(spark, "documents")
    x = m.mix(d, block=32, shard_blocks=16)
    text = m.mixed_text(x, d).toPandas()
    assert text["text"].map(lambda t: len(t.encode().split())).sum() == sum(x.plan.quota)
    slots = m.draw_slots(spark, x.plan, 16).toPandas()
    assert not slots.duplicated(["shard", "slot"]).any()
    assert slots.groupby("src").size().to_dict() == dict(enumerate(x.plan.slots))
    first = slots[slots["src"] == 0].groupby("block").size()
    assert first.max() - first.min() <= 1  # no block comes again before all came
    took = m.taken(x).agg({"taken": "sum"}).first()[0]
    assert took == sum(x.plan.quota)


def test_edges(spark):
    out = m.taken(m.mix(edge.docs(spark), block=64)).toPandas()
    assert len(out) == len(edge.ROWS)
    assert (out["taken"] <= 3 * out["size"]).all()
    assert out[out["size"] == 0]["taken"].sum() == 0
    assert m.taken(m.mix(edge.empty(spark))).count() == 0
