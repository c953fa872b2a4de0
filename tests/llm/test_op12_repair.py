import hashlib
import random
import zlib

import pytest

from pagewright.llm import op12_repair as m
from tests.llm import edge

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, sha int"


def whole(s):
    """(s?(ua)+)?"""
    return not s or (len(s.removeprefix("s")) >= 2 and s.removeprefix("s") == "ua" * (len(s.removeprefix("s")) // 2))


def marked(rows):
    """Faults of (turn, role, text) in order, in plain Python."""
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying all edits, up to two turns put in at a place."""
    faults, best = marked(rows), None

    def go(i, cost, audit, kept):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for extra in ([], ["user"], ["assistant"], ["user", "assistant"]):
                done = kept + [(r, "") for r in extra]
                if whole("".join(r[:1] for r, _ in done)) and all(r[:1] for r, _ in done):
                    key = (cost + 3 * len(extra), audit + "I" * len(extra))
                    if best is None or key < best[:2]:
                        best = (*key, "\n".join(f"{r}:{t}" for r, t in done))
            return
        _, role, text = rows[i]
        late = 3 * (faults[i] == "truncated")
        for extra in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            base, c, a = kept + [(r, "") for r in extra], cost + 3 * len(extra), audit + "I" * len(extra)
            go(i + 1, c + 4, a + "D", base)
            if faults[i] in ("", "truncated"):
                go(i + 1, c + late, a + "K", [*base, (role, text)])
                go(i + 1, c + 3 + late, a + "R", [*base, ("user", text)])
                go(i + 1, c + 3 + late, a + "R", [*base, ("assistant", text)])

    go(0, 0, "", [])
    return best


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, turns = marked(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, text = brute(rows)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        conv, role, text = (" " if v is None else v for v in (conv, role, text))
        place = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if place:
            text = "" if place == 1 else "".join(c for c in text if c not in ".!?") if place == 2 else text
            out += [(turn, "user" if place == 4 else role, text)] * (2 if place == 3 else 1)
    return out


def compare(got, rows_of):
    assert sorted(got, key=str) == sorted(rows_of, key=str)
    for conv, rows in rows_of.items():
        assert got[conv] == expected(rows), (conv, rows)


def results(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in edge.table(spark, "conversations", "sf0.01").collect()]
    small = {c for c in {r[0] for r in rows} if len(spoilt([r for r in rows if r[0] == c])) <= 5}
    got = results(m.op12_repair(spark, "/root/testdata/sf0.01"))
    assert set(got) == {r[0] for r in rows} and len(small) > 50
    compare({c: got[c] for c in small}, {c: spoilt([r for r in rows if r[0] == c]) for c in small})


@pytest.mark.parametrize("segment", [1, 2, 256])
def test_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(m, "SEGMENT", segment)
    rng, rows_of = random.Random(segment), {}
    for conv in range(120):
        rows_of[conv] = [(rng.choice([None, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", "User"] if rng.random() < 0.3 else ["user", "assistant", "system"]), rng.choice(["Yes.", "No!", "Cut", " ", "", "What?\n", "a.b"])) for _ in range(rng.randrange(1, 6))]
    frame = spark.createDataFrame([(c, *r, "k", 7, 8) for c, rows in rows_of.items() for r in rows], SCHEMA)
    compare(results(m.repair(frame)), rows_of)


def test_weights_of_long_conversations():
    rng = random.Random(9)
    turns = [(rng.choice("sua"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(2000)]
    one = m.cheapest([m.segment_ways(turns)])
    for size in (1, 7, 300):
        assert m.cheapest([m.segment_ways(turns[i : i + size]) for i in range(0, 2000, size)]) == one
    assert len(one[1].replace("I", "")) == 2000
    assert m.cheapest([]) == (0, "")


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 2, "user", "x" * 500_000 + "."), (1, 2, "user", "x" * 500_000 + "."), (1, 9, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, "k", 7, 8) for r in rows], SCHEMA)
    others = spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id long")
    got = results(m.repair(frame, others))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[2] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[None][:7] == (0, 1, 0, 0, 1, 7, "DKI") and got[1] == (6, 0, 1, 0, 1, 4, "KDK", hashlib.sha256(("user:" + "x" * 500_000 + ".\nassistant:Yes.").encode()).hexdigest())
    assert m.repair(frame.limit(0)).count() == 0
    assert results(m.repair(frame.limit(0), others)) == {k: (0, 0, 0, 0, 0, 0, "", nothing) for k in (1, 2, None)}


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(30) for t in [None, 0, 1]] + [(None, None, None, None)]
    got = m.damaged(spark.createDataFrame([(*r, "k", 7, 8) for r in rows], SCHEMA)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["turn"], r["role"], r["text"]) for r in got), key=key) == sorted(spoilt(rows), key=key)
