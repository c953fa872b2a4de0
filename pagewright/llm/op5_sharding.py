"""Sharding by Karmarkar-Karp differencing: near-equal bytes a shard though groups are indivisible."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, keep, running_sum, table, utf8

#: Items that one task differences; a level above combines as many partial partitions.
FAN_IN = 4096


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions.

    `loads` has a row for each item and a column for each part. The two partitions of the largest
    spread are combined again and again, the heaviest part of one with the lightest of the other.
    Returns the part that each item's column goes to, and the parts' loads.
    """
    n, k = loads.shape
    first = np.argsort(-loads, axis=1, kind="stable")
    sums: list = list(np.take_along_axis(loads, first, axis=1))
    heap = [(-(int(s[0]) - int(s[-1])), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        made.append((a, b, order))
        sums.append(both)
        heapq.heappush(heap, (-(int(both[0]) - int(both[-1])), len(sums) - 1))
    part: list = [None] * len(sums)
    part[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        to, part[n + i] = part[n + i], None
        part[a], part[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        part[a][order] = to
        part[b][k - 1 - order] = to
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, first, np.array(part[:n]), axis=1)
    return out, sums[-1]


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Give each row of groups(grp, bytes) a part from 0 to shards-1 so that the parts' bytes are near equal.

    Groups are dealt into buckets of about FAN_IN by a hash of their key. Each bucket is differenced
    in a task of its own, then the buckets' partial partitions are differenced in the same way, level
    by level, until one is left: no task or driver sees more than FAN_IN items at once.
    """
    buckets = max(1, math.ceil(groups.count() / FAN_IN))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ignore_index=True)
        loads = np.zeros((len(pdf), shards), np.int64)
        loads[:, 0] = pdf["bytes"]
        return pdf.assign(part=difference(loads)[0][:, 0].astype("int32"))

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part"], ignore_index=True)
        own, row = np.unique(pdf["bucket"], return_inverse=True)
        loads = np.zeros((len(own), shards), np.int64)
        loads[row, pdf["part"]] = pdf["bytes"]
        return pdf.assign(to=difference(loads)[0][row, pdf["part"]].astype("int32"))

    items = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("long"))
    items = keep(items.groupBy("bucket").applyInPandas(leaves, T.StructType([*items.schema, T.StructField("part", T.IntegerType())])), "shard-groups")
    while buckets > 1:
        loads = items.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).withColumn("above", F.expr(f"bucket div {FAN_IN}"))
        moves = loads.groupBy("above").applyInPandas(level, T.StructType([*loads.schema, T.StructField("to", T.IntegerType())])).select("bucket", "part", "to")
        items = items.join(moves, ["bucket", "part"]).select(*(c for c in items.columns if c not in ("bucket", "part")), F.expr(f"bucket div {FAN_IN}").alias("bucket"), F.col("to").alias("part"))
        buckets = math.ceil(buckets / FAN_IN)
        if buckets > 1:
            items = keep(items, "shard-level")
    return items.drop("bucket")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Deal documents into `shards` shards of near-equal bytes; documents of equal text stay together.

    Returns the id, size (UTF-8 bytes and `overhead`), text_crc32, shard and slot (gapless from 0 in
    each shard). A null text counts as empty, and so is in one group with empty texts. Rows with the
    same or a null id are documents of their own, in slots by id, size and crc; columns of `docs` of other
    names, whatever they are, don't enter. A table without rows gives no rows.
    """
    rows = docs.select(F.col(id_col).alias(id_col), (F.length(utf8(F.col(text_col))) + overhead).cast("long").alias("size"), F.crc32(utf8(F.col(text_col))).alias("text_crc32"), F.unhex(F.sha2(utf8(F.col(text_col)), 256)).alias("grp"))
    rows = keep(rows, "shard-rows")
    groups = keep(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "shard-sizes")
    total = rows.count()
    placed = join_by_key(rows, assign_groups(groups, shards).select("grp", "copies", F.col("part").alias("shard")), "grp", "copies", total)
    placed = keep(placed.select(id_col, "size", "text_crc32", "shard"), "shard-placed")
    return running_sum(placed, "shard", [id_col, "size", "text_crc32"], F.lit(1), "slot", max(1, total // shards))


def op5_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law `bytes`."""
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
