"""Mixing sources to target weights from fixed-length blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keep, running_sum, table

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def _hash(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key & (2**64 - 1))
    for m in _MIX[:2]:
        x = (x ^ (x >> _MIX[2])) * m
    return x ^ (x >> _MIX[2])


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`, without a table: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = np.asarray(index).astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            a, b = x >> shift, x & mask
            for r in range(3, -1, -1) if inverse else range(4):
                if inverse:
                    a, b = b ^ (_hash(a, key * 31 + r) & mask), a
                else:
                    a, b = b, a ^ (_hash(b, key * 31 + r) & mask)
            out[todo] = (a << shift) | b
            todo = out >= np.uint64(n)
    return out.astype(np.int64)


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share `total` by weight; a share stops at `most` times its size and the excess is shared again."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left, mass = total - sum(target[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / mass > most * sizes[i]}
        for i in over or free:
            target[i] = float(most * sizes[i]) if over else left * weights[i] / mass
        free -= over or free
    return target


@dataclass
class MixPlan:
    """What a mix takes of each source: a row a source, so it is as long as the table of weights."""

    sources: list
    sizes: list[int]
    targets: list[float]
    block: int
    seed: int
    quota: list[int] = field(init=False)
    blocks: list[int] = field(init=False)
    slots: list[int] = field(init=False)
    short_at: list[list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.quota = [round(t) for t in self.targets]
        self.blocks = [math.ceil(s / self.block) for s in self.sizes]
        self.short_at = [[int(permute(np.array([n - 1]), n, self.key(i, e), True)[0]) for e in range(math.ceil(q / s) + 1)] if s else [] for i, (n, q, s) in enumerate(zip(self.blocks, self.quota, self.sizes, strict=True))]
        self.slots = [self._slots(i) for i in range(len(self.sizes))]

    def key(self, i: int, epoch: int) -> int:
        return (self.seed * 1_000_003 + int(i)) * 1_000_003 + int(epoch)

    def before(self, i: int, slot: np.ndarray) -> np.ndarray:
        """Words in the slots of source i before `slot`; one block of each epoch, the last, may be short."""
        n, missing = self.blocks[i], self.blocks[i] * self.block - self.sizes[i]
        epoch = slot // n
        return slot * self.block - missing * (epoch + (slot % n > np.array(self.short_at[i])[epoch]))

    def _slots(self, i: int) -> int:
        lo, hi = 0, self.blocks[i] * len(self.short_at[i])
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if mid // self.blocks[i] >= len(self.short_at[i]) or self.before(i, np.array([mid]))[0] >= self.quota[i] else (mid + 1, hi)
        return lo


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = 512, seed: int = 42) -> MixPlan:
    """Targets by source for rows (source, size): sources by code point, null last, get the weights in turn."""
    found = sorted(((r["source"], r["size"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in found]
    return MixPlan([s for s, _ in found], sizes, water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], float(sum(sizes)), most), block, seed)


def draw_slots(spark: SparkSession, plan: MixPlan, shard_blocks: int = 1024) -> DataFrame:
    """(shard, slot, src, block, used): the block in each slot of each output shard and the words it gives.

    Each shard draws its sources' counts from a multinomial. A source's k-th slot over all shards
    takes block P(k) of a pseudorandom permutation that is new in each epoch, so no block comes again
    before all others came. Slots beyond a source's quota go to the sources that drew too few; a
    source's last block is cut where its quota ends.
    """
    total = sum(plan.slots)
    shards = math.ceil(total / shard_blocks)
    share = np.array(plan.slots, float) / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                n = min(shard_blocks, total - shard * shard_blocks)
                count = np.random.Generator(np.random.PCG64(np.random.SeedSequence([plan.seed, shard]))).multinomial(n, share)
                yield pd.DataFrame({"shard": shard, "src": np.arange(len(share), dtype=np.int32), "n": count, "at": np.cumsum(count) - count})[count > 0]

    drawn = keep(spark.range(shards).mapInPandas(draw, "shard long, src int, n long, at long"), "mix-counts")
    got = {r["src"]: r["n"] for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    drew = np.array([got.get(i, 0) for i in range(len(share))], np.int64)
    quota = np.array(plan.slots, np.int64)
    over, under = np.maximum(drew - quota, 0), np.maximum(quota - drew, 0)
    over_at, under_end = np.cumsum(over) - over, np.cumsum(under)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, src, n, at, base in pdf[["shard", "src", "n", "at", "base"]].itertuples(index=False):
                k, own = base + np.arange(n), np.full(n, src)
                extra = k >= quota[src]
                if extra.any():
                    r = over_at[src] + k[extra] - quota[src]
                    to = np.searchsorted(under_end, r, "right")
                    own[extra], k[extra] = to, drew[to] + r - (under_end[to] - under[to])
                block, used = np.empty(n, np.int64), np.empty(n, np.int64)
                for i in np.unique(own):
                    mine = own == i
                    j = k[mine]
                    epoch = j // plan.blocks[i]
                    b = np.empty(len(j), np.int64)
                    for e in np.unique(epoch):
                        b[epoch == e] = permute(j[epoch == e] % plan.blocks[i], plan.blocks[i], plan.key(i, int(e)))
                    block[mine] = b
                    used[mine] = np.minimum(np.minimum(plan.block, plan.sizes[i] - b * plan.block), plan.quota[i] - plan.before(i, j))
                place = permute(at + np.arange(n), min(shard_blocks, total - shard * shard_blocks), plan.key(-1, shard))
                yield pd.DataFrame({"shard": shard, "slot": place, "src": own.astype(np.int32), "block": block, "used": used})

    placed = running_sum(drawn, "src", ["shard"], F.col("n"), "base", shards).repartition(max(1, math.ceil(shards / 16)), "shard")
    return placed.mapInPandas(slots, "shard long, slot long, src int, block long, used long")


def pack_blocks(sized: DataFrame, plan: MixPlan, rows: int) -> DataFrame:
    """Rows (.., src, size, mark) laid end to end by source, those of one id by size and their text's hash: adds `start`, the row's first word in its source's stream."""
    return running_sum(sized, "src", ["doc_id", "size", "mark"], F.col("size"), "start", max(1, rows)).drop("mark")


def mix_spans(slots: DataFrame, packed: DataFrame, block: int) -> DataFrame:
    """Join blocks by index: (shard, slot, src, at, doc_id, start, first, n): words first..first+n-1 of a document stand at word `at` of the slot."""
    size = F.lit(block).cast("long")
    pieces = packed.filter("size > 0").select("src", "doc_id", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    pieces = pieces.select("src", "block", "doc_id", "start", F.greatest(F.col("start") - F.col("block") * size, F.lit(0)).alias("at"), F.greatest(F.col("block") * size - F.col("start"), F.lit(0)).alias("first"), F.least(F.col("start") + F.col("size") - F.col("block") * size, size).alias("to"))
    # Neither side is bounded, and Spark's estimate of what Python makes is low: so a merge join.
    both = slots.hint("merge").join(pieces, ["src", "block"]).withColumn("n", F.least("to", "used") - F.col("at"))
    return both.filter("n > 0").select("shard", "slot", "src", "at", "doc_id", "start", "first", "n")


@dataclass
class Mix:
    plan: MixPlan
    packed: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = 512, shard_blocks: int = 1024, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix documents of several sources towards weights, in blocks of `block` words.

    A null or empty text has no words and is never taken; a null source is a source of its own. Rows
    with the same or a null id are documents of their own. Without any word the mix is empty. `plan`
    has a row a source (as the weights have), `packed` a row a document, `spans` what each slot holds.
    """
    spark = docs.sparkSession
    sized = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("mark")), "mix-sizes")
    plan = plan_mix(sized, weights, most, block, seed)
    names = spark.createDataFrame([(s, i) for i, s in enumerate(plan.sources)] or [], "name string, src int")
    src = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # a row a source, as the weights
    packed = keep(pack_blocks(src, plan, sized.count()), "mix-packed")
    return Mix(plan, packed, mix_spans(draw_slots(spark, plan, shard_blocks), packed, block))


def mixed_text(mixed: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, source, text): the blocks' words, space-joined. For ids that are unique."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("words"))
    names = docs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(mixed.plan.sources)], "src int, source string")
    piece = F.struct("at", F.array_join(F.slice("words", F.col("first").cast("int") + 1, F.col("n").cast("int")), " ").alias("text"))
    blocks = mixed.spans.join(texts, "doc_id").groupBy("shard", "slot", "src").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return blocks.join(F.broadcast(names), "src").select("shard", "slot", "source", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def taken(mixed: Mix) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken."""
    per = mixed.spans.groupBy("src", "start").agg(F.sum("n").alias("taken"))
    some = mixed.packed.filter("size > 0").join(per.hint("merge"), ["src", "start"], "left").select("src", "doc_id", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = mixed.packed.filter("size = 0").select("src", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    facts = mixed.packed.sparkSession.createDataFrame([(i, int(s), float(t)) for i, (s, t) in enumerate(zip(mixed.plan.sizes, mixed.plan.targets, strict=True))], "src int, source_size long, target double")
    return some.unionByName(none).join(F.broadcast(facts), "src").select("doc_id", "size", "source_size", "target", "taken")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 by source, a target being at most 3 times its source."""
    return taken(mix(table(spark, sf_dir, "documents")))
