"""Edit scripts: what changed between two versions of a text, by lines in hunks and by words in blocks.

Spark splits, hashes, joins and explodes; the helpers in tasks see arrays of 64-bit hashes alone.
Lines are matched by a longest common subsequence, found bit-parallel: a row of its table is one
whole number. Words are matched as the longest common run, then the longest on either side of it,
and so on, where runs of a length are compared by rolling hashes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.ship import ship
from pagewright.functions.text import words

#: Equal lines around a change that its hunk shows.
CONTEXT = 3
#: Bits of the table that is held to find the way back; larger ones are halved.
MOST_BITS = 1 << 28
#: In sequences of so many words, those that are more than a hundredth (and one) of them begin no run.
MANY, SHARE = 200, 100
_MULTIPLIER = 0x9E3779B97F4A7C15


# ---- lines ----


def _masks(b: list[int]) -> dict[int, int]:
    at: dict[int, int] = defaultdict(int)
    for j, y in enumerate(b):
        at[y] |= 1 << j
    return at


def _rows(a: list[int], b: list[int]) -> list[int]:
    """The table of common lengths: bit j of row i is 0 where a[:i] and b[:j + 1] have one more in common than a[:i] and b[:j]."""
    full, at = (1 << len(b)) - 1, _masks(b)
    rows, v = [full], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """How much a has in common with b[:j], for j from 0."""
    full, at = (1 << len(b)) - 1, _masks(b)
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence; where there is a choice, what is removed comes late."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        split = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:split]) + [(i + half, j + split) for i, j in _common(a[half:], b[split:])]
    rows, out, i, j = _rows(a, b), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i] >> (j - 1) & 1:  # b[j - 1] adds nothing
            j -= 1
        else:
            i -= 1
    return out[::-1]


def line_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, n): runs of equal lines of a longest common subsequence.

    Equal ends are always in one, and lines that only one side has in none.
    """
    n, m = len(a), len(b)
    short = min(n, m)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    rest = short - head
    differs = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1])
    tail = int(differs[0]) if len(differs) else rest
    i_of, j_of = np.arange(head, n - tail), np.arange(head, m - tail)
    i_of, j_of = i_of[np.isin(a[i_of], b[j_of])], j_of[np.isin(b[j_of], a[i_of])]
    pairs = [(int(i_of[i]), int(j_of[j])) for i, j in _common(a[i_of].tolist(), b[j_of].tolist())]
    out: list[list[int]] = [[0, 0, head]] if head else []
    for i, j, k in [*((i, j, 1) for i, j in pairs), *([(n - tail, m - tail, tail)] if tail else [])]:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1][2] += k
        else:
            out.append([i, j, k])
    return [tuple(x) for x in out]


def line_changes(a: np.ndarray, b: np.ndarray, context: int = CONTEXT) -> list[tuple[int, int, int, int, int, int]]:
    """(hunk, i, n, j, m, shown): n lines from i on go and m from j on come, in hunks of `context` equal lines around.

    `shown` is how many lines that come or stay the hunks show before. Changes with at most twice
    `context` equal lines between them are in one hunk.
    """
    out, at_i, at_j, hunk, shown, kept = [], 0, 0, 0, 0, 0
    for i, j, k in [*line_blocks(a, b), (len(a), len(b), 0)]:
        if i > at_i or j > at_j:
            if not out or kept > 2 * context:
                hunk += 1
                shown += min(kept, context) * (2 if out else 1)
            else:
                shown += kept
            out.append((hunk, at_i, i - at_i, at_j, j - at_j, shown))
            shown += j - at_j
            kept = 0
        at_i, at_j, kept = i + k, j + k, kept + k
    return out


def _lines(text: str) -> Column:
    """Lines with their ends; the last has none if the text ends without."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\r\n|[\n\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]|\r(?!\n))", -1), lambda x: x != "")


def _hashed(parts: str) -> Column:
    return F.transform(parts, lambda x: F.xxhash64(x))


def _changes(pairs: DataFrame, context: int) -> DataFrame:
    ship(pairs.sparkSession)

    @F.pandas_udf("array<struct<hunk: int, i: int, n: int, j: int, m: int, shown: int>>")
    def changes(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("hunk", "i", "n", "j", "m", "shown")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in line_changes(np.asarray(x), np.asarray(y), context)] for x, y in zip(a, b, strict=True)])

    split = pairs.select("doc_id", _lines("original").alias("a"), _lines("optimized").alias("b"))
    return split.withColumn("changes", changes(_hashed("a"), _hashed("b")))


def edit_script(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, hunk, seq, type, line, shown, text): the lines that go and come between pairs(doc_id, original, optimized).

    As few as can be, so a line that moved is removed and added. `line` is the number in the line's
    own version from 1, `shown` the number of kept and added lines that the hunks, with `context`
    equal lines around each change, show before it. Text has its line end. Equal versions have no
    rows, a null version is an empty one; repeated ids are pairs of their own.
    """
    kind = lambda name, start, lines, c, seq: F.transform(F.sequence(F.lit(0), c[lines] - 1), lambda k: F.struct(c["hunk"].alias("hunk"), (seq + k).alias("seq"), F.lit(name).alias("type"), (c[start] + k + 1).alias("line"), (c["shown"] + (k if name == "add" else 0)).alias("shown"), F.get("a" if name == "remove" else "b", c[start] + k).alias("text")))
    none = F.filter(F.array(F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in (("hunk", 0, "int"), ("seq", 0, "int"), ("type", "", "string"), ("line", 0, "int"), ("shown", 0, "int"), ("text", "", "string"))))), lambda _: F.lit(False))
    both = lambda c: F.concat(F.when(c["n"] > 0, kind("remove", "i", "n", c, c["i"] + c["j"])).otherwise(none), F.when(c["m"] > 0, kind("add", "j", "m", c, c["i"] + c["n"] + c["j"])).otherwise(none))
    return _changes(pairs, context).select("doc_id", F.explode(F.flatten(F.transform("changes", both))).alias("e")).select("doc_id", "e.*")


def edit_summary(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, kept, removed, added, hunks): lines that stay, go and come, and in how many hunks."""
    total = lambda c: F.aggregate(F.transform("changes", lambda x: x[c]), F.lit(0), lambda s, x: s + x)
    return _changes(pairs, context).select("doc_id", (F.size("a") - total("n")).alias("kept"), total("n").alias("removed"), total("m").alias("added"), F.coalesce(F.array_max(F.transform("changes", lambda x: x["hunk"])), F.lit(0)).alias("hunks"))


# ---- words ----


class _Runs:
    """Hashes of the runs of any length of a sequence, by prefix sums of word hashes times powers of an odd number, modulo 2^64."""

    def __init__(self, x: np.ndarray):
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(x), _MULTIPLIER, np.uint64))
            self.down = np.cumprod(np.full(len(x), inverse, np.uint64))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x.astype(np.int64).view(np.uint64) * up)])

    def of(self, low: int, high: int, length: int) -> np.ndarray:
        """Of the runs that begin at low and end at high at most."""
        with np.errstate(over="ignore"):
            at = np.arange(low, high - length + 1)
            return (self.sums[at + length] - self.sums[at]) * self.down[at]


def word_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, n): equal runs of words, the longest first taken (of these the earliest in a, then in b), then those on either side.

    In a second version of MANY words or more, very common words begin no run, but lengthen one.
    """
    n, m = len(a), len(b)
    common = np.zeros(m, bool)
    if m >= MANY:
        _, which, times = np.unique(b, return_inverse=True, return_counts=True)
        common = times[which] > m // SHARE + 1
    popular = np.unique(b[common])
    rare_b = np.concatenate([[0], np.cumsum(common)])  # common words before
    rare_a = np.concatenate([[0], np.cumsum(np.isin(a, popular))])
    runs_a, runs_b = _Runs(a), _Runs(b)

    def shared(i0: int, i1: int, j0: int, j1: int, length: int) -> tuple[int, int] | None:
        x, y = runs_a.of(i0, i1, length), runs_b.of(j0, j1, length)
        at, to = np.arange(i0, i1 - length + 1), np.arange(j0, j1 - length + 1)
        ok, good = rare_a[at + length] == rare_a[at], rare_b[to + length] == rare_b[to]
        hit = np.flatnonzero(ok & np.isin(x, y[good]))
        if not len(hit):
            return None
        return int(at[hit[0]]), int(to[np.flatnonzero(good & (y == x[hit[0]]))[0]])

    out, todo = [], [(0, n, 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        i, j, size = i0, j0, 0
        low, high = 0, min(i1 - i0, j1 - j0)
        step = 1
        while low < high:  # the longest length that is shared: doubling, then halving
            length = min(low + step, high)
            found = shared(i0, i1, j0, j1, length)
            if found:
                (i, j), size, low, step = found, length, length, step * 2
            else:
                high, step = length - 1, max(1, (length - 1 - low + 1) // 2)
        while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < i1 and j + size < j1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            out.append((i, j, size))
            todo += [(i0, i, j0, j), (i + size, i1, j + size, j1)]
    merged: list[list[int]] = []
    for i, j, k in sorted(out):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1][2] += k
        else:
            merged.append([i, j, k])
    return [tuple(x) for x in merged]


def sequence_stats(pairs: DataFrame) -> DataFrame:
    """(doc_id, similarity, added_words, changed_blocks, edited_blocks) of pairs(doc_id, original, optimized), by words in sequence.

    similarity is twice the words in equal blocks by all words, 1 for two texts without words;
    changed_blocks counts equal blocks and what lies between, edited_blocks the latter alone. Null
    counts as empty.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("struct<same: long, blocks: int, edited: int>")
    def matched(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            blocks, at, edited = word_blocks(np.asarray(x, np.int64), np.asarray(y, np.int64)), (0, 0), 0
            for i, j, k in [*blocks, (len(x), len(y), 0)]:
                edited += (i, j) != at
                at = (i + k, j + k)
            out.append((sum(k for _, _, k in blocks), len(blocks) + edited, edited))
        return pd.DataFrame(out, columns=["same", "blocks", "edited"])

    split = pairs.select("doc_id", words(F.col("original")).alias("a"), words(F.col("optimized")).alias("b"))
    hashed = split.select("doc_id", _hashed("a").alias("a"), _hashed("b").alias("b"), F.size("a").alias("n"), F.size("b").alias("m")).withColumn("s", matched("a", "b"))
    share = F.when(F.col("n") + F.col("m") > 0, 2 * F.col("s.same") / F.nullif(F.col("n") + F.col("m"), F.lit(0))).otherwise(F.lit(1.0))
    return hashed.select("doc_id", share.alias("similarity"), (F.col("m") - F.col("n")).alias("added_words"), F.col("s.blocks").alias("changed_blocks"), F.col("s.edited").alias("edited_blocks"))
