"""Near duplicates of whole texts by their word shingles: SimHash links under Golay keys, and an exact join for what they miss.

A text's SimHash differs in up to 18 bits from that of a text of similarity 0.8, so links within 3
bits are only the cheap part. The rest comes from a prefix join: two sets of similarity s have a
common element among the first n - ceil(s * n) + 1 of each, in any order of all elements, and how
many they have in common there bounds the similarity from above. Texts that meet under a key that
many texts have are compared whole, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_of, bitmap, has_bit, join_by_key, keep, ship
from .op10_simhash import components, keyed, links_of, majority

#: Rows of a key up to which its pairs are listed; texts under a key with more are compared in blocks.
SHORT_RUN = 64
#: Texts of a block, of which a task compares two.
BLOCK = 256
#: Shingles among which a task counts those that come again.
TOGETHER = 2_000_000
#: Characters of texts that are hashed at once.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

# ---- shingles ----


def _power(base: int, n: int) -> np.ndarray:
    """base to the power 0..n-1, modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, PIECE), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_piece(texts: list[bytes], width: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)))])
    word = _mixed((total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts])
    doc_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(doc_end, starts, "right")
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    padded, of = np.concatenate([word, np.zeros(width, np.uint64)]), np.concatenate([doc, np.full(width, -1)])
    h = np.zeros(len(word), np.uint64)
    for k in range(width):
        h = _mixed((h ^ np.where(of[k : k + len(word)] == doc, padded[k : k + len(word)], np.uint64(0))) + np.uint64(k + 1))
    whole = first | (of[width - 1 : width - 1 + len(word)] == doc)
    h, doc = h[whole], doc[whole]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's runs of `width` words, sorted; fewer words are one run, none have none.

    Words stand between ASCII white space, with A-Z in lower case. Hashes are polynomials of a word's
    bytes over 64 bits, mixed, and mixed again over a run's words.
    """
    out: list[np.ndarray] = []
    piece: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            piece.append((text or "").encode())
            size += len(piece[-1])
            if size >= PIECE:
                out += _hash_piece(piece, width)
                piece, size = [], 0
        return out + (_hash_piece(piece, width) if piece else [])


def _least(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many of n shingles a text of at least the similarity has too."""
    return np.ceil(similarity * n - 1e-9)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def described(own: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, version, node, fp, n) of each row: its set of shingles, the set's SimHash and size. kind 1: (node, n), shingles that come again.

    What comes again is counted among the different sets that a task reads together. It only orders
    a text's shingles, for which any order is right.
    """

    def again(sets: list[np.ndarray], nodes: list[int]) -> pd.DataFrame:
        _, first = np.unique(np.array(nodes, np.uint64), return_index=True)
        seen, times = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
        seen, times = seen[times > 1], times[times > 1]
        return pd.DataFrame({"kind": np.int8(1), "doc_id": 0, "version": 0, "node": seen.view(np.int64), "fp": 0, "n": times.astype(np.int32)})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        names: list[int] = []
        size = 0
        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), width)
            node, fp = np.array([_digest(s) for s in sets], np.uint64), np.array([majority(s) for s in sets], np.uint64)
            yield pd.DataFrame({"kind": np.int8(0), "doc_id": pdf["doc_id"], "version": pdf["version"], "node": node.view(np.int64), "fp": fp.view(np.int64), "n": np.array([len(s) for s in sets], np.int32)})
            held, names, size = held + sets, names + node.tolist(), size + sum(map(len, sets))
            if size > TOGETHER:
                yield again(held, names)
                held, names, size = [], [], 0
        if held:
            yield again(held, names)

    return own.select("doc_id", "version", "text").mapInPandas(make, "kind byte, doc_id long, version long, node long, fp long, n int")


def _sets_of(own: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """(node, s): the sets of the documents whose id is an owner's; others may be among them, and repeats."""

    bits = bitmap(owners, bit_of(F.col("owner")))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(pdf["text"][has_bit(bits.value, pdf["bit"].to_numpy())].tolist(), width)
            if sets:
                yield pd.DataFrame({"node": np.array([_digest(s) for s in sets], np.uint64).view(np.int64), "s": [s.view(np.int64) for s in sets]})

    return own.select("text", bit_of(F.col("doc_id")).alias("bit")).mapInPandas(make, "node long, s array<long>")


# ---- pairs under common shingles ----


def prefix_rows(own: DataFrame, nodes: DataFrame, again: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, node, n): the first shingles of each set, those that come seldom first. A row may come twice.

    The order is by how often the 100,000 most frequent ones come, then those that come again, as far
    as a map of bits tells them, before them all others, and among equals by the hash.
    """
    top = again.groupBy("node").agg(F.sum("n").alias("n")).filter("n > 3").orderBy(F.desc("n"), "node").limit(100_000).toArrow()
    g, count = top["node"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(g)
    sent = own.sparkSession.sparkContext.broadcast((g[order], count[order]))
    bits, owners = bitmap(again, F.pmod("node", F.lit(FILTER_BITS)) + 1), bitmap(nodes, bit_of(F.col("owner")))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, count = sent.value

        def first(s: np.ndarray) -> np.ndarray:
            if len(s):
                at = np.minimum(np.searchsorted(g, s), max(len(g) - 1, 0))
                known = g[at] == s if len(g) else np.zeros(len(s), bool)
                s = s[np.argsort(np.where(known, count[at] if len(g) else 0, has_bit(bits.value, s.view(np.int64) % FILTER_BITS + 1)), kind="stable")]
            return s[: len(s) - int(_least(len(s), similarity)) + 1] if len(s) else s

        for pdf in batches:
            sets = shingle_sets(pdf["text"][has_bit(owners.value, pdf["bit"].to_numpy())].tolist(), width)
            firsts = [first(s) for s in sets]
            size = np.array([len(s) for s in firsts], np.int64)
            if size.sum():
                node, n = np.array([_digest(s) for s in sets], np.uint64).view(np.int64), np.array([len(s) for s in sets], np.int32)
                yield pd.DataFrame({"key": np.concatenate(firsts).view(np.int64), "node": np.repeat(node, size), "n": np.repeat(n, size)})

    return own.select("text", bit_of(F.col("doc_id")).alias("bit")).mapInPandas(make, "key long, node long, n int")


def meet(rows: DataFrame, similarity: float, short_run: int = SHORT_RUN) -> DataFrame:
    """Rows (key, node, n) that share a key: kind 0, pairs (a, b, na, nb) of sets whose sizes allow the similarity; kind 1, rows (a: key, b: node) of keys with more than short_run sets."""

    def frame(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray | int, nb: np.ndarray | int) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b, "na": na, "nb": nb}).astype({"na": np.int32, "nb": np.int32})

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, n = key[new], node[new], n[new]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        long = np.repeat(size > short_run, size)
        yield frame(1, key[long], node[long], 0, 0)
        some = np.repeat((size > 1) & (size <= short_run), size)
        key, node, n = key[some], node[some], n[some]
        for s in range(1, int(size[size <= short_run].max(initial=1))):
            i = np.flatnonzero(key[:-s] == key[s:])
            x, y = n[i], n[i + s]
            i = i[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9]
            if len(i):
                yield frame(0, node[i], node[i + s], n[i], n[i + s])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, many = None, None
        for pdf in batches:
            if many is not None:  # more rows of a key that has too many
                more = (pdf["key"] == many).to_numpy()
                yield frame(1, *(pdf[c].to_numpy()[more] for c in ("key", "node")), 0, 0)
                pdf = pdf[~more]
            if not len(pdf):
                continue
            many = None
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["key"] == pdf["key"].iloc[-1]).to_numpy()
            whole, rest = pdf[~last], pdf[last]
            if len(whole):
                yield from pairs(*(whole[c].to_numpy() for c in ("key", "node", "n")))
            if rest["node"].nunique() > short_run:
                yield frame(1, *(rest[c].to_numpy() for c in ("key", "node")), 0, 0)
                many, rest = rest["key"].iloc[-1], None
        if rest is not None:
            yield from pairs(*(rest[c].to_numpy() for c in ("key", "node", "n")))

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, "kind byte, a long, b long, na int, nb int")


def enough(similarity: float) -> Column:
    """Whether pairs (na, nb) with `common` equal shingles among their first can have the similarity.

    What they have in common beyond is among the last shingles of one of them, so at most as many as
    the larger one has after its first.
    """
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)
    return F.col("common") > least - F.ceil(F.lit(similarity) * F.greatest("na", "nb") - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.filter(common >= F.lit(similarity) * (total - common) - 1e-9).select("a", "b")


# ---- texts under keys that many have ----


def forest(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> pd.DataFrame:
    """Links (a, b) that tie together all texts which similarities of at least `similarity` do, at most one a text.

    Every pair of different roots is compared, on counts of common shingles: products of 0-1
    matrices, some thousand shingles at a time.
    """
    n = np.array([len(s) for s in sets])
    row, value = np.repeat(np.arange(len(sets)), n), np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    row, place = row[place >= 0], place[place >= 0]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(place, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], place[a:b] - start] = 1
        common += part @ part.T
    close = (common >= similarity * (n[:, None] + n[None, :] - common) - 1e-6) & (root[:, None] != root[None, :])
    left, out = np.ones(len(sets), bool), []
    while left.any():
        front = np.flatnonzero(left)[:1]
        left[front] = False
        while len(front):
            reached = close[front] & left[None, :]
            new = np.flatnonzero(reached.any(axis=0))
            out.append(np.stack([node[front[reached[:, new].argmax(axis=0)]], node[new]], axis=1))
            left[new] = False
            front = new
    links = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def compared(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the roots of the texts of each cell (cell, node, root), of which a task holds one at a time."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].to_numpy()
        return forest(root, root, list(pdf["s"]), similarity)

    return cells.join(sets.hint("merge"), "node").select("cell", "node", "root", "s").groupBy("cell").applyInPandas(compare, "a long, b long")


def rooted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): each node's group, once links between the roots tie groups together."""
    higher = components(links).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return keep(roots.join(higher, "root", "left").select("node", F.coalesce("_top", "root").alias("root")), "near-roots")


def hot_groups(hot: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root) of all nodes of `links` and `hot` (key, node): their groups by `links` and by the similarity of texts that share a key of `hot`.

    First texts of one least key are compared in groups of bounded size, then the roots of what that
    ties, as long as it ties a tenth of them: most near copies are one group then. Any two texts of
    different groups that keys connect are compared last, in cells of two blocks each. Links that are
    found lie between roots, so only these are grouped again, not all links so far.
    """
    least = keep(hot.groupBy("node").agg(F.min("key").alias("lead")), "near-leads")
    roots = keep(least.select("node").join(components(links), "node", "full").select("node", F.coalesce("root", "node").alias("root")), "near-roots")
    some, before = least, None
    while True:
        counted = some.groupBy("lead").agg(F.count("*").alias("n"))
        parts = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (2 * block)))
        cells = join_by_key(some, counted.filter("n > 1"), "lead", "n", some.count()).select(F.xxhash64("lead", parts).alias("cell"), "node").join(roots, "node")
        roots = rooted(roots, compared(cells, sets, similarity))
        some = keep(least.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi"), "near-leads")
        now = some.count()
        if before is not None and now > 0.9 * before or now < 2 * block:
            break
        before = now
    # Keys under which more than one group is left connect texts to clusters; a cluster's largest group needs no comparison with itself.
    split = hot.join(roots, "node")
    open_keys = split.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).filter("x <> y")
    edges = keep(join_by_key(split, open_keys.select("key", "rows"), "key", "rows", hot.count()).select(F.col("key").alias("a"), F.col("node").alias("b")), "near-edges")
    inside = components(edges).select("node", F.col("root").alias("cluster"))
    placed = keep(inside.join(roots, "node"), "near-clusters")
    groups = placed.groupBy("cluster", "root").agg(F.count("*").alias("rows"))
    sizes = groups.groupBy("cluster").agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.max("rows").alias("most"), F.sum("rows").alias("rows"))
    cut = sizes.select("cluster", "major", F.ceil((F.col("rows") - F.col("most")) / block).cast("int").alias("p"), F.ceil(F.col("most") / block).cast("int").alias("q"), "rows")
    return rooted(roots, compared(in_cells(join_by_key(placed, cut, "cluster", "rows", placed.count())), sets, similarity))


def in_cells(placed: DataFrame) -> DataFrame:
    """Deal the texts of clusters (cluster, node, root, major, p, q) into cells such that any two of different groups meet in one.

    The largest group has q blocks and the others p. Each of the p blocks has a cell with itself and
    with each block after it.
    """
    large = F.col("root") == F.col("major")
    x = F.when(large, F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).otherwise(F.pmod(F.xxhash64("node"), F.col("p"))).cast("int")
    at = placed.withColumn("x", x)
    before = F.when(F.col("p") > 0, F.transform(F.sequence(F.lit(0), F.least("x", F.col("p") - 1)), lambda i: F.struct(i.alias("i"), F.col("x").alias("j"))))
    last = F.col("p") + F.col("q") - 1
    after = F.when((F.col("x") < F.col("p")) & (F.col("x") < last), F.transform(F.sequence(F.col("x") + 1, last), lambda j: F.struct(F.col("x").alias("i"), j.alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    dealt = at.withColumn("c", F.explode(F.concat(F.coalesce(before, none), F.coalesce(after, none))))
    return dealt.select(F.xxhash64("cluster", "c.i", "c.j").alias("cell"), "node", "root")


# ---- groups ----


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", short_run: int = SHORT_RUN, block: int = BLOCK) -> DataFrame:
    """(doc_id, version, component_id) of each row: texts whose shingles of `width` words have a Jaccard similarity of `similarity` or more are linked, exactly.

    component_id is the smallest id that links reach. Texts of the same shingles are one node, of
    which the document of the smallest id is the owner; an empty or null text has none, and such
    texts are linked to each other alone. Rows of one id are nodes of their own by their texts, which
    `version` (xxhash64 of the text, null counting as empty) tells apart. Rows with a null id get a
    null component and link nothing. Columns of any other name are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    own = every.filter("doc_id is not null")
    said = keep(described(own, width), "near-described")
    rows = said.filter("kind = 0").select("doc_id", "version", "node", "fp", "n")
    again = said.filter("kind = 1").select("node", "n")
    nodes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("owner"), F.first("fp").alias("fp"), F.count("*").alias("copies")), "near-nodes")
    by_bits = keep(links_of(keyed(nodes.select("node", "fp"))), "near-fingerprint-pairs")
    met = keep(meet(prefix_rows(own, nodes, again, width, similarity), similarity, short_run), "near-met")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    by_prefix = met.filter("kind = 0").groupBy(*pair).agg(F.count("*").alias("common"), F.first(F.least("na", "nb")).alias("na"), F.first(F.greatest("na", "nb")).alias("nb")).filter(enough(similarity)).select("a", "b")
    pairs = keep(by_bits.select(*pair).unionByName(by_prefix).distinct(), "near-pairs")
    hot = keep(met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node")).distinct(), "near-hot")
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct().join(nodes.select("node", "owner"), "node"), "near-wanted")
    sets = keep(_sets_of(own, wanted, width).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    links = keep(verified(pairs, sets, similarity), "near-links")
    tied = components(links) if hot.isEmpty() else hot_groups(hot, links, sets, similarity, block)
    # Tables between the joins: one plan of them all has hundreds of nodes, of which the driver keeps each version.
    groups = keep(nodes.join(tied, "node", "left").select("node", "owner", "copies", F.coalesce("root", "node").alias("root")), "near-groups")
    smallest = groups.groupBy("root").agg(F.min("owner").alias("component_id"), F.count("*").alias("nodes"))
    smallest = keep(smallest, "near-smallest")
    placed = keep(join_by_key(groups, smallest, "root", "nodes", groups.count()).select("node", "copies", "component_id"), "near-placed")
    out = join_by_key(rows.select("doc_id", "version", "node"), placed, "node", "copies", rows.count())
    return out.select("doc_id", "version", "component_id").unionByName(every.filter("doc_id is null").select("doc_id", "version", F.lit(None).cast("long").alias("component_id")))
