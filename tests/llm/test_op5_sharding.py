import zlib

import numpy as np

from pagewright.llm import op5_sharding as m
from tests.llm import edge


def test_differencing():
    loads = np.zeros((6, 2), np.int64)
    loads[:, 0] = [8, 7, 6, 5, 4, 0]
    part, sums = m.difference(loads)
    assert sorted(sums) == [14, 16]  # 8, 7, 6, 5, 4 difference to 2
    own = [loads[part[:, 0] == p, 0].sum() for p in (0, 1)]
    assert sorted(own) == [14, 16]
    rng = np.random.default_rng(1)
    big = np.zeros((3000, 40), np.int64)
    big[:, 0] = rng.integers(16, 10_000, 3000)
    part, sums = m.difference(big)
    assert sorted(np.bincount(part[:, 0], big[:, 0], 40).astype(int).tolist()) == sorted(sums.tolist())
    assert sums.max() - sums.min() < 100
    assert m.difference(np.array([[5, 3, 1]]))[0].tolist() == [[0, 1, 2]]


def plain(loads):
    """The parts' loads by Karmarkar-Karp over plain lists: the two of largest spread, the earlier first, again and again."""
    todo = [(i, sorted(map(int, row), reverse=True)) for i, row in enumerate(loads)]
    made = len(todo)
    while len(todo) > 1:
        todo.sort(key=lambda x: (-(x[1][0] - x[1][-1]), x[0]))
        (_, a), (_, b), *todo = todo
        todo.append((made, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)))
        made += 1
    return todo[0][1]


def test_differencing_against_plain_lists():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 6))
        loads = np.zeros((n, k), np.int64)
        loads[:, : int(rng.integers(1, k + 1))] = rng.integers(0, 50, (n, 1))
        part, sums = m.difference(loads)
        assert sums.tolist() == plain(loads)
        own = np.zeros(k, np.int64)
        np.add.at(own, part.ravel(), loads.ravel())  # each item's columns go to different parts
        assert own.tolist() == sums.tolist() and all(sorted(p) == list(range(k)) for p in part.tolist())


def check(p, shards):
    assert sorted(p["shard"].unique()) <= list(range(shards))
    for _, g in p.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert p.groupby("text_crc32")["shard"].nunique().max() == 1


def test_query(spark):
    p = edge.by_id(m.op5_shard_balance(spark, "/root/testdata/sf0.01"))
    d = edge.by_id(edge.table(spark, "documents", "sf0.01"))
    assert (p["size"] == [len(t.encode()) + 16 for t in d["text"]]).all()
    assert (p["text_crc32"] == [zlib.crc32(t.encode()) for t in d["text"]]).all()
    assert (p["law"] == "bytes").all() and p["grown_shard"].isna().all()
    check(p, 40)
    load = p.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() - load.min() < 0.01 * load.mean()


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(m, "FAN_IN", 8)  # so 900 groups need four levels
    p = edge.by_id(m.shard_documents(edge.table(spark, "documents", "sf0.01"), 10))
    check(p, 10)
    load = p.groupby("shard")["size"].sum()
    assert len(p) == 1000 and load.max() - load.min() < 0.1 * load.mean()  # eight items a task leave more than 4,096 do


def test_edges(spark):
    p = m.shard_documents(edge.docs(spark), 4).toPandas()
    assert len(p) == len(edge.ROWS)
    check(p, 4)
    assert m.shard_documents(edge.empty(spark), 4).count() == 0
    assert m.shard_documents(edge.docs(spark), 1).select("shard").distinct().count() == 1
