"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The perfect Golay code of 23
bits has a code word within 3 bits of any vector, so a segment and its one-bit neighbours decode to
at most six words: its near keys. If two fingerprints differ in at most 3 bits then either one
segment is equal and another differs in at most one bit, or each segment differs in one. The first
case meets under (equal segment, word of the other), the second under a triple of words, of which
one side lists the near keys of two segments and the other side those of the third. Rows that meet
under a key are verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, keep, ship, table

RADIUS = 3
#: Rows of one key that a task compares at once; longer runs are cut by further bits.
MOST_RUN = 2048
#: Up to this many rows of a key are compared pair by pair without a matrix.
SHORT_RUN = 16
#: Beyond so many links, nodes that very many of them have are joined apart.
MANY_LINKS = 100_000
#: Links that a task ties together at once: 4 MB.
PIECE = 250_000
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
CUTS = ((0, 23), (23, 23), (46, 18))

# ---- fingerprints ----


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words are one shingle, none have none."""
    if not words:
        return np.array([], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half the hashes; zero for none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _pack(2 * total > len(hashes))


# ---- Golay keys ----

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at its three places, and the error of at most 3 bits for each syndrome."""
    global _tables
    if _tables is None:

        def remainder(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= GENERATOR << (i - 11)
            return v

        place = np.array([[remainder((b << s) & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)])
        one = [remainder(1 << i) for i in range(23)]
        error = np.zeros(2048, np.int64)
        for i in range(23):
            error[one[i]] = 1 << i
            for j in range(i):
                error[one[i] ^ one[j]] = 1 << i | 1 << j
                for k in range(j):
                    error[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
        _tables = place, error
    return _tables


def decode(v: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the code word nearest to each 23-bit vector."""
    place, error = _code()
    return (v ^ error[place[0][v & 255] ^ place[1][v >> 8 & 255] ^ place[2][v >> 16]]) >> 11


def near_words(v: np.ndarray, width: int) -> np.ndarray:
    """Indices of the code words of each vector and its one-bit neighbours, as rows of six; -1 fills up."""
    around = np.sort(decode(np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(width))], axis=1)), axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = 1 << 20
    around = np.sort(around, axis=1)[:, :6]
    return np.where(around == 1 << 20, -1, around)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of some fingerprints; any two within 3 bits have one in common."""
    raw = [(fingerprints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in CUTS]
    near = [near_words(v, w) for v, (_, w) in zip(raw, CUTS, strict=True)]
    own = [decode(v) for v in raw]
    rows, keys = [], []

    def add(kind: int, key: np.ndarray, real: np.ndarray) -> None:
        row, *_ = np.nonzero(real)
        rows.append(row)
        keys.append(key[real] | kind << 40)

    for kind, (equal, other) in enumerate(permutations(range(3), 2)):
        add(kind, raw[equal][:, None] << 12 | near[other], near[other] >= 0)
    first, third = near[0][:, :, None], near[2][:, None, :]
    add(6, first << 24 | own[1][:, None, None] << 12 | third, (first >= 0) & (third >= 0))
    add(6, own[0][:, None] << 24 | near[1] << 12 | own[2][:, None], near[1] >= 0)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp, node) of nodes(node, fp): all keys of each fingerprint."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                fp, node = (pdf[c].to_numpy()[k : k + 2000] for c in ("fp", "node"))
                row, key = golay_keys(fp.view(np.uint64))
                order = np.lexsort((row, key))
                row, key = row[order], key[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                yield pd.DataFrame({"key": key[new], "fp": fp[row[new]], "node": node[row[new]]})

    return nodes.select("node", "fp").mapInPandas(make, "key long, fp long, node long")


# ---- runs of rows that share a key ----

_OUT = {"kind": np.int8, "a": np.int64, "b": np.int64, "mask": np.int64}


def _frame(kind: int, a: np.ndarray, b: np.ndarray, mask: np.ndarray | int) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b, "mask": np.broadcast_to(np.asarray(mask, np.int64), len(a))})


def _long_run(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a run's links: at most one link a row, and the same groups as all of them."""
    u = fp.view(np.uint64)
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= RADIUS
    left, a, b = np.ones(len(fp), bool), [], []
    while left.any():
        hub = int(np.argmax(left))
        group = front = np.zeros(len(fp), bool)
        front[hub] = True
        while front.any():
            group = group | front
            front = close[front].any(axis=0) & left & ~group
        left &= ~group
        members = np.flatnonzero(group)
        members = members[members != hub]
        a.append(np.full(len(members), node[hub]))
        b.append(node[members])
    return np.concatenate(a), np.concatenate(b)


def link_runs(rows: DataFrame, most_run: int = MOST_RUN) -> DataFrame:
    """Compare the rows (key, fp, node, mask) that share a key, where rows of a key stand together.

    Gives links (kind 0: nodes a, b) and, for keys with more than most_run rows, the rows themselves
    (kind 1: fp, node and mask) for refine(). A task holds most_run rows and a batch at once.
    """

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pd.DataFrame]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        inside = np.repeat(size <= SHORT_RUN, size)
        u = fp.view(np.uint64)
        a, b = [], []
        for s in range(1, int(min(SHORT_RUN, size.max(initial=1)))):
            at = np.flatnonzero((key[:-s] == key[s:]) & inside[:-s])
            at = at[(np.bitwise_count(u[at] ^ u[at + s]) <= RADIUS) & (node[at] != node[at + s])]
            a.append(node[at])
            b.append(node[at + s])
        for start, n in zip(edge[:-1][size > SHORT_RUN], size[size > SHORT_RUN], strict=True):
            x, y = _long_run(fp[start : start + n], node[start : start + n])
            a.append(x)
            b.append(y)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield _frame(0, both[:, 0], both[:, 1], 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, deferred = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            if deferred is not None:
                more = (pdf["key"] == deferred).to_numpy()
                if more.any():
                    yield _frame(1, pdf["fp"][more].to_numpy(), pdf["node"][more].to_numpy(), pdf["mask"][more].to_numpy())
                    pdf = pdf[~more]
                if not len(pdf):
                    continue
                deferred = None
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["key"] == pdf["key"].iloc[-1]).to_numpy()
            whole, rest = pdf[~last], pdf[last]
            size = whole.groupby("key")["key"].transform("size").to_numpy() if len(whole) > most_run else np.zeros(len(whole))
            if (big := size > most_run).any():
                part = whole[big]
                yield _frame(1, part["fp"].to_numpy(), part["node"].to_numpy(), part["mask"].to_numpy())
                whole = whole[~big]
            if len(whole):
                yield from links(*(whole[c].to_numpy() for c in ("key", "fp", "node")))
            if len(rest) > most_run:
                yield _frame(1, rest["fp"].to_numpy(), rest["node"].to_numpy(), rest["mask"].to_numpy())
                deferred, rest = rest["key"].iloc[-1], None
        if rest is not None and len(rest):
            yield from links(*(rest[c].to_numpy() for c in ("key", "fp", "node")))

    return rows.mapInPandas(run, "kind byte, a long, b long, mask long")


def refine(deferred: DataFrame) -> DataFrame:
    """Cut runs that are too long: of four parts of the bits not pinned yet one is equal in any pair within 3 bits.

    The new key has that part's bits (with those pinned before, which `mask` tells from the others),
    so three quarters of the bits stay open. Where few are open, there are few fingerprints.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mask, part in pdf.groupby("mask"):
                bits = np.flatnonzero(np.unpackbits(np.array([mask], "<i8").view(np.uint8), bitorder="little"))
                u = part["a"].to_numpy().view(np.uint64)
                for cut in np.array_split(bits, RADIUS + 1):
                    pinned = np.uint64(sum(1 << int(i) for i in cut))
                    now = ~np.array([mask], np.int64).view(np.uint64)[0] | pinned  # all bits pinned so far
                    with np.errstate(over="ignore"):
                        h = (u & now) ^ (now * np.uint64(0x9E3779B97F4A7C15))
                        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pd.DataFrame({"key": (h ^ (h >> np.uint64(29))).view(np.int64), "fp": part["a"].to_numpy(), "node": part["b"].to_numpy(), "mask": (~np.array([now], np.uint64)).view(np.int64)[0]})

    return deferred.mapInPandas(make, "key long, fp long, node long, mask long")


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp", "node")


def links_of(keys: DataFrame, most_run: int = MOST_RUN) -> DataFrame:
    """Links (a < b) between nodes under common keys, each once. Runs that are too long go round again, with more bits."""
    found = None
    rows = together(keys).withColumn("mask", F.lit(-1).cast("long"))
    while True:
        out = keep(link_runs(rows, most_run), "simhash-links")
        some = out.filter("kind = 0").select("a", "b")
        found = some if found is None else found.unionByName(some)
        again = out.filter("kind = 1")
        if again.isEmpty():
            return found.distinct()
        rows = together(refine(again.select("a", "b", "mask").distinct()).distinct())


# ---- groups ----


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the links' nodes that can reach a smaller one: the smallest."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    under = root < np.arange(len(node))
    return node[under], node[root[under]]


def tie_pieces(links: DataFrame, pieces: int) -> DataFrame:
    """Links (u, v) that tie the same nodes together, at most one a node and piece: a task ties each node of its piece to the smallest one that the piece reaches."""

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            u, v = stars(*(np.concatenate([pdf[c].to_numpy() for pdf in held]) for c in ("u", "v")))
            yield pd.DataFrame({"u": u, "v": v})

    return links.select("u", "v").repartition(max(1, pieces)).mapInPandas(tie, "u long, v long")


def components(links: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, root) of all linked nodes: the root is the smallest node that can be reached.

    First tasks tie pieces of the links, as long as that halves them; links of one piece are done
    then, in one job. What is left of more goes through large-star and small-star in turn: each node's
    neighbours are tied to its smallest one, until nothing changes. Links are tables in the shared
    folder, never collected; where links are many, a node that very many of them have is sent to all
    tasks instead of gathering its links in one.
    """

    def tied(left: DataFrame, right: DataFrame) -> DataFrame:
        return join_by_key(left, right, "u", "copies", rows) if rows > MANY_LINKS else left.join(right, "u")

    def placed(now: DataFrame) -> DataFrame:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

    ship(links.sparkSession)
    now, seen = keep(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v"), "groups-links"), None
    rows = now.count()
    while True:
        pieces, before = math.ceil(rows / piece), rows
        now = keep(tie_pieces(now, pieces), "groups-links")
        if pieces <= 1:
            return placed(now)
        rows = now.count()
        if rows > before / 2:
            break
    now = keep(now.distinct(), "groups-links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("copies"))
        large = tied(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies"))
        small = tied(large, below).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = keep(small, "groups-links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return placed(now)
        seen, rows = state, state[0]


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null and empty texts have zero."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([majority(shingle_hashes(words_of(t), width)) for t in pdf["text"]], np.uint64)
            yield pdf[["doc_id"]].assign(fp=fp.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(make, f"doc_id {kind}, fp long")


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row: fingerprints link at 3 or fewer differing bits, exactly.

    component_id is the smallest id that links reach, the row's own included. Work is on distinct
    fingerprints; a row that many share counts once. Rows with a null id have a fingerprint and a
    null component, and link nothing. Rows with the same id are linked each by its own text, so one id
    may be in several groups. Other columns of `docs` don't enter, whatever their names.
    """
    rows = keep(fingerprints(docs, width, id_col, text_col), "simhash-fingerprints")
    named = rows.filter(F.col("doc_id").isNotNull())
    least = keep(named.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    # A node is its fingerprint, since one id may have several.
    roots = components(links_of(keyed(least.select("fp", F.col("fp").alias("node")))))
    placed = keep(least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    groups = placed.groupBy("root").agg(F.min("least").cast("long").alias("component_id"), F.count("*").alias("members"))
    grouped = join_by_key(placed, groups, "root", "members", placed.count()).select("fp", "copies", "component_id")
    return join_by_key(named, grouped, "fp", "copies", named.count()).drop("copies").select("doc_id", "fp", "component_id").unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents' three-word shingles and the groups they link."""
    out = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
