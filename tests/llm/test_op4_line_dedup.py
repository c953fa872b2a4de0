import random

import pandas as pd
import xxhash

from pagewright.llm import op4_line_dedup as m
from tests.llm import edge


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chunks_of(text, long_line=50):
    """The chunker again, in plain Python."""
    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    roll = [signed(v ^ (((h[i - 1] << 1) | (h[i - 1] >> 63)) & (2**64 - 1) if i else 0)) for i, v in enumerate(h)]
    wide = [len(x.encode().split()) >= long_line for x in lines]
    starts = [i for i in range(len(lines)) if i == 0 or wide[i] or wide[i - 1] or (roll[i] < roll[i - 1] and roll[i] < (roll[i + 1] if i + 1 < len(lines) else 2**63 - 1))]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        body = "\n".join(lines[a:b])
        out.append((body, (b - a > 1 and bool(body.encode().split())) or (b - a == 1 and wide[a])))
    return out


def passages_of(lines, long_line=50):
    """(line, lines) of the fewest lines from each line with words on that make `long_line` words."""
    count = [len(x.encode().split()) for x in lines]
    for i in range(len(lines)):
        total = 0
        for j in range(i, len(lines)):
            total += count[j]
            if count[i] and total >= long_line:
                yield i, j - i + 1
                break


def brute(texts, long_line=50, bad=None):
    """What goes: chunks and passages that came before as a whole. `bad`: a line that is in none of them."""
    seen, out = set(), {}
    for doc in sorted(texts):
        lines, at, gone, units = texts[doc].split("\n"), 0, set(), []
        for body, counts in chunks_of(texts[doc], long_line):
            n = body.count("\n") + 1
            if counts:
                units.append((at, n, "chunk"))
            at += n
        units += [(i, n, "passage") for i, n in passages_of(lines, long_line)]
        for i, n, kind in sorted(units):
            body = (kind, *lines[i : i + n])
            if body in seen and bad not in body:
                gone |= set(range(i, i + n))
            seen.add(body)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def run(spark, texts):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    return {r["doc_id"]: r["text"] for r in m.dedup_lines(df).collect()}


def test_against_brute_force(spark):
    d = edge.by_id(edge.table(spark, "documents", "sf0.01"))
    texts = dict(zip(d["doc_id"].tolist(), d["text"], strict=True))
    got = {r["doc_id"]: r["text"] for r in m.op4_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(texts)


def test_shifted_passages_are_found(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(10**6)) for _ in range(8))
    passage = [line() for _ in range(40)]
    texts = {i: "\n".join([line() for _ in range(i * 3)] + passage + [line() for _ in range(i)]) for i in range(5)}
    got = run(spark, texts)
    assert got == brute(texts)
    for i in range(1, 5):
        assert not any(x in got[i].split("\n") for x in passage)
    assert sum(x in got[0].split("\n") for x in passage) == 40
    wide = " ".join(f"w{i}" for i in range(60))
    got = run(spark, {1: f"a\n{wide}\nb", 2: f"c\n{wide}\nd", 3: "own line"})
    assert wide in got[1] and wide not in got[2] and got[3] == "own line"


def test_edges(spark):
    df = edge.docs(spark)
    out = m.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(edge.ROWS)
    rows = out.collect()
    assert sum(r["text"] is None for r in rows) == 2
    same = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in (4, 5)]
    assert sorted(same) == [(4, edge.ROWS[3][1])] * 2 + [(5, "")]  # the repeated row stays, the later copy goes
    assert [r["text"] for r in rows if r["doc_id"] == 6] == [edge.LONG]
    assert m.dedup_lines(edge.empty(spark)).count() == 0
    assert m.dedup_lines(df).filter("length(text) > 3").count() > 0


def test_short_passages_of_several_lines_go(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = {n: [line(-(-52 // n)) for _ in range(n)] for n in (2, 3, 4, 5, 7)}
    short = [line(24), line(25)]  # 49 words: below the limit, unless it is a chunk
    texts, doc = {}, 0
    for _ in range(6):
        for body in [*passages.values(), short]:
            doc += 1
            texts[doc] = "\n".join([line(9) for _ in range(rng.randrange(5))] + body + [line(9) for _ in range(rng.randrange(5))])
    got = run(spark, texts)
    assert got == brute(texts)
    for body in passages.values():
        assert [sum(x in t.split("\n") for t in got.values()) for x in body] == [1] * len(body)


def test_first_of_all_equal_lines_stays(spark):
    rng = random.Random(6)
    pool = [" ".join(f"p{i}x{j}" for j in range(rng.choice([1, 20, 40, 60]))) for i in range(40)] + [""]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for i in range(60)}
    got = run(spark, texts)
    assert got == brute(texts)
    assert {x for t in got.values() for x in t.split("\n")} >= {x for t in texts.values() for x in t.split("\n")}


def test_equal_hashes_of_other_bytes_stay(spark, monkeypatch):
    shared = "\n".join(" ".join(f"s{i}x{j}" for j in range(30)) for i in range(3))
    texts = {i: f"own {i}\n{shared}\nend {i}" for i in range(4)}
    assert run(spark, texts) == brute(texts) != texts
    df = spark.createDataFrame(pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    real = m.unlike_units

    def clash(marked, text):
        line = m.F.xxhash64(m.F.lit(shared.split("\n")[1]))
        return real(marked, text).unionByName(spark.range(1).select(line.alias("hash")))

    monkeypatch.setattr(m, "unlike_units", clash)
    # The line in the middle is in both passages of the three, so only chunks without it could go.
    assert {r["doc_id"]: r["text"] for r in m.dedup_lines(df).collect()} == brute(texts, bad=shared.split("\n")[1]) != brute(texts)


def test_null_ids_come_last_and_texts_of_one_id_are_apart(spark):
    shared = "\n".join(" ".join(f"s{i}x{j}" for j in range(30)) for i in range(3))
    rows = [(None, f"a\n{shared}"), (None, f"b\nc\n{shared}"), (7, f"d\n{shared}"), (7, f"e\n{shared}"), (7, f"e\n{shared}")]
    got = [r["text"] for r in m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    whole = [t for t in got if shared in t]
    assert sorted(t.split("\n")[0] for t in got) == ["a", "b", "d", "e", "e"]
    assert len(set(whole)) == 1 and whole[0][0] in "de"


def test_a_chain_of_known_pairs_is_no_repeat(spark):
    for words in (12, 24):  # two lines have fewer than 50 words, three or five have more
        a, b, c, d = (" ".join(f"{x}{i}" for i in range(words)) for x in "abcd")
        texts = {1: f"p1\n{a}\n{b}\nq1", 2: f"p2\n{b}\n{c}\nq2", 3: f"p3\n{c}\n{d}\nq3", 4: f"p4\n{a}\n{b}\n{c}\n{d}\nq4"}
        assert brute(texts)[4] == texts[4]
        assert run(spark, texts) == texts
    rng = random.Random(8)  # dialogue of few lines
    pool = [" ".join(f"{i}w{j}" for j in range(rng.choice([3, 9, 20]))) for i in range(7)] + ["", " "]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for i in range(80)}
    got = run(spark, texts)
    assert got == brute(texts)


def test_both_sides_of_the_limit(spark):
    own = lambda i, x: f"{i} own\n{x}\n{i} end"
    short, long = (" ".join(f"w{j}" for j in range(n)) for n in (49, 50))
    got = run(spark, {1: own(1, short), 2: own(2, short), 3: own(3, long), 4: own(4, long)})
    assert short in got[2] and long in got[3] and long not in got[4]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": [own(1, "a b c"), own(2, "a b c")]}))
    assert [r["text"] for r in m.dedup_lines(df, long_line=3).orderBy("doc_id").collect()] == ["1 own\na b c\n1 end", "2 own\n2 end"]


def test_no_python(spark):
    plan = m.dedup_lines(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
