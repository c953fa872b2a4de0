import collections

import numpy as np
import xxhash

from pagewright.llm import op10_near
from pagewright.llm import op10_simhash as m
from tests.llm import edge


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    """The smallest id that links reach, by comparing all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_code_is_perfect():
    assert len(np.unique(m.decode(np.arange(1 << 23)))) == 4096
    rng = np.random.default_rng(0)
    word = m.decode(v := rng.integers(0, 1 << 23, 500))
    assert len(word) == 500 and v.max() < 1 << 23


def test_fingerprints_within_three_bits_meet():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        a = b = int(rng.integers(0, 2**63))
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        row, key = m.golay_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_query_against_brute_force(spark):
    p = m.op10_simhash_groups(spark, "/root/testdata/sf0.01").toPandas()
    d = edge.table(spark, "documents", "sf0.01").toPandas()
    fps = {int(i): fingerprint(t) for i, t in zip(d["doc_id"], d["text"], strict=True)}
    want = groups(fps)
    assert {int(r.doc_id): (r.fingerprint, int(r.component_id)) for r in p.itertuples()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def links(spark, fps, **options):
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    roots = {r["node"]: r["root"] for r in m.components(m.links_of(m.keyed(nodes), **options)).collect()}
    return {i: roots.get(i, i) for i in fps}


def test_chains_and_dense_groups(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {}
    for i in range(300):  # a cloud around one fingerprint, so that keys have many rows
        f = base
        for bit in rng.choice(14, rng.integers(0, 8), replace=False):
            f ^= 1 << int(bit) * 4
        fps[i] = f
    for i in range(300, 340):  # a chain of links of 3 bits
        fps[i] = int(rng.integers(0, 2**63)) if i == 300 else fps[i - 1] ^ (7 << (i - 300))
    fps = dict(zip(fps, dict.fromkeys(fps.values()), strict=False)) if len(set(fps.values())) < len(fps) else fps
    want = groups(fps)
    assert links(spark, fps) == want
    assert links(spark, fps, most_run=20) == want  # long runs go round again with further bits


def test_near_duplicates(spark):
    d = edge.table(spark, "documents", "sf0.1").toPandas()
    sets = {int(i): frozenset(hash(tuple(w[k : k + 5])) for w in [t.encode().lower().split()] for k in range(max(1, len(w) - 4))) for i, t in zip(d["doc_id"], d["text"], strict=True)}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    of = collections.defaultdict(list)
    for s, i in first.items():
        for h in s:
            of[h].append(i)
    common = collections.Counter((a, b) for ids in of.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    true = [(a, b) for (a, b), c in common.items() if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    got = {r["doc_id"]: r["component_id"] for r in op10_near.near_duplicates(edge.table(spark, "documents", "sf0.1")).collect()}
    assert len(true) > 30 and all(got[a] == got[b] for a, b in true)
    assert all(got[i] == got[first[s]] for i, s in sets.items())
    members = collections.defaultdict(set)
    for i, c in got.items():
        members[c].add(first[sets[i]])
    for ids in members.values():
        for a in ids if len(ids) > 1 else ():
            assert any(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in ids)


def test_edges(spark):
    out = m.simhash_groups(edge.docs(spark)).toPandas()
    assert len(out) == len(edge.ROWS)
    of = {r.doc_id: (r.fp, r.component_id) for r in out.itertuples() if r.doc_id == r.doc_id}
    assert of[1] == of[2] == of[3] == (0, 1) and of[4] == of[5] and of[4][1] == 4
    assert out[out["doc_id"].isna()]["component_id"].isna().all()
    assert m.simhash_groups(edge.empty(spark)).count() == 0
    near = op10_near.near_duplicates(edge.docs(spark)).toPandas()
    assert len(near) == len(edge.ROWS)
    assert op10_near.near_duplicates(edge.empty(spark)).count() == 0


def near_groups(spark, texts, **options):
    """The groups that near_duplicates() finds and those of all pairs compared."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: frozenset(tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {r["doc_id"]: r["component_id"] for r in op10_near.near_duplicates(docs, **options).collect()}, {i: top(i) for i in texts}


def test_appended_passages_are_found(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    texts = {}
    for i in range(0, 240, 2):
        words = draw(int(rng.integers(150, 600)))
        texts[i], texts[i + 1] = " ".join(words), " ".join(words + draw(int(len(words) * (0.1, 0.15, 0.22)[i // 2 % 3])))
    got, want = near_groups(spark, texts)
    assert sum(want[i] == want[i + 1] for i in range(0, 240, 2)) > 100
    assert got == want


def twins_of_a_template(groups):
    """Pairs that share over 0.8, in groups of one template of which others share about 0.6."""
    rng = np.random.default_rng(8)
    texts = {}
    for g, pairs in enumerate(groups):
        template = [f"t{g}_{i}" for i in range(120)]
        for p in range(pairs):
            words = list(template)
            for at in rng.choice(120, 6, replace=False):
                words[int(at)] = f"p{g}_{p}_{at}"
            twin = list(words)
            twin[60:60] = [f"q{g}_{p}_{i}" for i in range(int(rng.integers(4, 14)))]
            texts[len(texts)], texts[len(texts)] = " ".join(words), " ".join(twin)
    return texts


def test_twins_in_a_hot_group_are_found(spark):
    got, want = near_groups(spark, twins_of_a_template([500, 5]))
    assert len(set(want.values())) > 100
    assert got == want


def test_long_runs_are_compared_whole(spark):
    rng = np.random.default_rng(9)
    texts, template = {}, [f"t{i}" for i in range(150)]
    for i in range(260):  # near copies of one template, many of which differ by more than 0.2
        words = list(template)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            words[int(at)] = f"p{rng.integers(0, 40)}"
        texts[i] = " ".join(words)
    for i in range(260, 300):
        texts[i] = " ".join(f"w{x}" for x in rng.integers(0, 3000, 100))
    for options in ({}, {"short_run": 3, "block": 16}, {"short_run": 1, "block": 4}):
        got, want = near_groups(spark, texts, **options)
        assert len(set(want.values())) > 40 and got == want


def test_shingles_are_those_of_the_words():
    texts = ["", None, " \n", "one", "One two", "a b c d e f", "A  b\tc\x0bd e f", "b c d e f a", "x " * 9, "é à ü ö ß ñ"]
    sets = [frozenset(s.tolist()) for s in op10_near.shingle_sets(texts, 5)]
    want = [frozenset(tuple(w[k : k + 5]) for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4)) if w) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a, x in zip(sets, want, strict=True):
        for b, y in zip(sets, want, strict=True):
            assert len(a & b) == len(x & y)
    long = " ".join(f"w{i}" for i in range(400_000))
    assert len(op10_near.shingle_sets([long, "one", long], 5)[2]) == 399_996


def test_rows_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(4, a), (4, b), (2, b + " more"), (9, a + " more"), (None, a), (5, None), (6, "")], "doc_id long, text string")
    out = [(r["doc_id"], r["component_id"]) for r in op10_near.near_duplicates(docs).collect()]
    assert sorted(out, key=str) == sorted([(4, 4), (4, 2), (2, 2), (9, 4), (None, None), (5, 5), (6, 5)], key=str)


def test_two_texts_of_one_id_are_two_nodes(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    a, near, b = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in rng.integers(0, 10**6, 400))
    assert (fingerprint(a) ^ fingerprint(near)).bit_count() <= 3 < (fingerprint(a) ^ fingerprint(b)).bit_count()
    df = spark.createDataFrame([(4, a), (4, b), (2, near), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in m.simhash_groups(df).collect())
    assert got == [(2, 2), (4, 2), (4, 4), (9, 4)]


def test_groups_of_links_take_few_jobs(spark):
    rng = np.random.default_rng(13)
    chain = np.stack([np.arange(1, 1500), np.arange(1500 - 1)], axis=1)
    pairs = np.concatenate([chain, rng.integers(2000, 6000, (2500, 2)), [[-5, 7000], [7000, -9], [8000, 8000]]])
    pairs = np.concatenate([pairs, pairs[::3, ::-1]])[rng.permutation(len(pairs) + len(pairs[::3]))]
    links, root = spark.createDataFrame(pairs.tolist(), "a long, b long"), {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs.tolist():
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = sorted((x, top(x)) for x in list(root))
    spark.sparkContext.setJobGroup("few-jobs", "groups")
    got = m.components(links)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Links of one piece are one task's work: however long the chain, no rounds of jobs.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 6
    assert sorted((r["node"], r["root"]) for r in got.collect()) == want
    some = links.filter("abs(a) < 40 or abs(b) < 40")
    small = sorted((r["node"], r["root"]) for r in m.components(some).collect())
    assert len(small) > 40 and sorted((r["node"], r["root"]) for r in m.components(some, 20).collect()) == small
