"""Nearest vectors by an index: buckets of random hyperplanes in several tables, candidates compared exactly.

A vector's code in a table has a bit for the side of each hyperplane that it is on; the queries look
into their own bucket and those behind the hyperplanes nearest to them. A bucket is cut into blocks
of vectors and of queries, so a task compares two small matrices however full a bucket is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.ship import ship

#: Vectors in a block of a bucket, and the mean of a bucket that the number of bits aims at.
BLOCK, MEAN = 2_000, 200
FEWEST_BITS, MOST_BITS = 6, 14


def planes(dims: int, table: int, bits: int) -> np.ndarray:
    """The hyperplanes of a table: orthogonal as far as there are dimensions, the same in every task."""
    rng = np.random.default_rng([17, table, dims])
    made = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-bits // dims))]
    return np.concatenate(made, axis=1)[:, :bits]


def probed(margins: np.ndarray, probes: int) -> list[int]:
    """The codes nearest to a query: its own, then those that flip bits of the least sum of squared margins."""
    own = int(((margins > 0) @ (1 << np.arange(len(margins)))).item())
    # The best flips are among the smallest margins: log2(probes) + 4 of them give far more codes than asked for.
    near = np.argsort(margins**2, kind="stable")[: min(len(margins), probes.bit_length() + 4)]
    sets = np.arange(1 << len(near))[:, None] >> np.arange(len(near)) & 1
    best = np.argsort(sets @ margins[near] ** 2, kind="stable")[:probes]
    return [own ^ int((sets[i] * (1 << near)).sum()) for i in best]


def similar_indexed(queries: DataFrame, corpus: DataFrame, k: int = 5, tables: int = 8, probes: int = 7, bits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k nearest by cosine of corpus(vec_id, embedding) for queries(query_id, embedding), as far as the index finds them.

    Similarities are exact, to six digits; ties go by id, and a query isn't its own neighbour. What is
    missed depends on the data: with more tables and probes less is. Unless given, `bits` makes buckets
    of MEAN vectors on average. Vectors that are null, of length zero or of other dimensions than the
    queries have no neighbours; repeated ids are told apart only by their vectors.
    """
    ship(corpus.sparkSession)
    names = {"query_id": queries.schema["query_id"].dataType.simpleString(), "vec_id": corpus.schema["vec_id"].dataType.simpleString()}
    if bits is None:
        bits = min(MOST_BITS, max(FEWEST_BITS, round(math.log2(max(corpus.count(), 1) / MEAN + 1))))

    def coder(few: int):
        @F.pandas_udf("array<long>")
        def code(vectors: pd.Series) -> pd.Series:
            out: list[list[int]] = []
            for v in vectors:
                x = np.asarray(v, np.float64)
                if not len(x) or not np.isfinite(x).all() or not (size := np.linalg.norm(x)) > 0:
                    out.append([])
                    continue
                codes = []
                for t in range(tables):
                    margins = x / size @ _planes(len(x), t, bits)
                    codes += [t << MOST_BITS | c for c in probed(margins, few)]
                out.append(codes)
            return pd.Series(out)

        return code

    vectors = lambda df, name, few: df.select(name, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())).withColumn("key", F.explode(coder(few)("embedding")))
    asked, held = vectors(queries, "query_id", probes), vectors(corpus, "vec_id", 1)
    # A row a bucket: tables * 2^bits at most.
    blocks = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cuts = F.broadcast(blocks(held, "held").join(blocks(asked, "asked"), "key"))

    def dealt(df: DataFrame, own: str, other: str, of: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("embedding", of), F.col(own)).cast("int")
        return df.join(cuts, "key").select(of, "embedding", "key", mine.alias(f"{own}_at"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"))

    def compare(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dims, some in there.groupby(there["embedding"].map(len)):
            mine = asking[asking["embedding"].map(len) == dims]
            if not len(mine):
                continue
            some = some.sort_values("vec_id", kind="stable")
            q, v = np.stack(mine["embedding"].to_numpy()), np.stack(some["embedding"].to_numpy())
            near = np.round(q / np.linalg.norm(q, axis=1, keepdims=True) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
            ids, own = some["vec_id"].to_numpy(), mine["query_id"].to_numpy()
            near[own[:, None] == ids[None, :]] = -2
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(near, top, axis=1).ravel()
            found.append(pd.DataFrame({"query_id": np.repeat(own, top.shape[1]), "vec_id": ids[top].ravel(), "similarity": best})[best > -2])
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    keys = ["key", "held_at", "asked_at"]
    both = dealt(asked, "asked", "held", "query_id").groupBy(*keys).cogroup(dealt(held, "held", "asked", "vec_id").groupBy(*keys))
    hits = both.applyInPandas(compare, f"query_id {names['query_id']}, vec_id {names['vec_id']}, similarity double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


_held: dict[tuple[int, int, int], np.ndarray] = {}


def _planes(dims: int, table: int, bits: int) -> np.ndarray:
    """planes(), made once a worker."""
    if (dims, table, bits) not in _held:
        _held[dims, table, bits] = planes(dims, table, bits)
    return _held[dims, table, bits]
