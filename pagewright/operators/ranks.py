"""Exact ranks and quantiles of any measure, without a window over a whole group.

Equal values become one row with their number first. The distinct values are then cut by bounds from
an approximate sketch into buckets: one window adds up within a bucket and one over the buckets'
sums, so no task sorts more than a bucket, however large or hot a group is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that a bucket aims at, and how many buckets there are at most.
BUCKET, MOST = 200_000, 2_000


def once(rows: DataFrame) -> DataFrame:
    """Rows that are computed here and now, and not again wherever they are used."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def ranked(rows: DataFrame, keys: list[str], value: str, bucket: int = BUCKET) -> DataFrame:
    """(keys, value, equal, below, total): each distinct value of each group, with how many rows have it, less, and any.

    Null and NaN values have no rank and don't count. Keys may be null.
    """
    at = F.col(value).cast("double")
    counts = rows.filter(at.isNotNull() & ~F.isnan(at)).groupBy(*keys, at.alias(value)).agg(F.count("*").alias("equal"))
    counts = once(counts)  # its number, its bounds, its sums and its rows are asked for
    parts = min(MOST, -(-counts.count() // bucket))
    if parts > 1:
        bounds = sorted({x for x in counts.approxQuantile(value, [i / parts for i in range(1, parts)], 0.2 / parts) if abs(x) < float("inf")})
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=value, outputCol="_bucket").transform(counts)
    else:
        cut = counts.withColumn("_bucket", F.lit(0.0))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = before(Window.partitionBy(*keys, "_bucket").orderBy(value))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("equal").alias("_sum"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy("_bucket"))), F.lit(0))).withColumn("total", F.sum("_sum").over(Window.partitionBy(*keys))).drop("_sum")
    offsets = offsets.select(*(F.col(c).alias(f"_of_{c}") for c in [*keys, "_bucket"]), "_before", "total")
    inner = cut.withColumn("_inner", F.coalesce(F.sum("equal").over(own), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return inner.join(offsets, on).select(*keys, value, "equal", (F.col("_inner") + F.col("_before")).alias("below"), "total")


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float], bucket: int = BUCKET) -> DataFrame:
    """(keys, a column a name in `wanted`): exact quantiles of each group, between two values in proportion."""
    ranks = ranked(rows, keys, value, bucket)
    at = {name: (F.col("total") - 1) * F.lit(p) for name, p in wanted.items()}
    hit = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("equal")), F.col(value)))
    found = ranks.groupBy(*keys).agg(*(hit(f(x)).alias(f"_{name}_{f.__name__}") for name, x in at.items() for f in (F.floor, F.ceil)), F.max("total").alias("total"))
    between = lambda name, x: F.col(f"_{name}_floor") + (F.col(f"_{name}_ceil") - F.col(f"_{name}_floor")) * (x - F.floor(x))
    return found.select(*keys, *(between(name, x).alias(name) for name, x in at.items()))


def percent_ranks(rows: DataFrame, value: str, by: str | None = None, out: str = "corpus_percentile", bucket: int = BUCKET) -> DataFrame:
    """Add `out`: the share of the other rows (of the same `by`) with a lower value, 0 for a row alone; null where the value is null or NaN."""
    keys = [by] if by else []
    share = F.when(F.col("total") > 1, F.col("below") / F.nullif(F.col("total") - 1, F.lit(0))).otherwise(F.lit(0.0))
    ranks = ranked(rows, keys, value, bucket).select(*(F.col(c).alias(f"_pr_{c}") for c in [*keys, value]), share.alias(out))
    on = F.col(value).cast("double") == F.col(f"_pr_{value}")
    if by:
        on = on & F.col(by).eqNullSafe(F.col(f"_pr_{by}"))
    return rows.join(ranks, on, "left").drop(*(f"_pr_{c}" for c in [*keys, value]))
