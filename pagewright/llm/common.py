"""Helpers that the corpus operators share: shared storage, running sums and joins that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import spread

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows for Python: texts are long.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: Bits of a filter over ids: 8 MB, whatever the input.
FILTER_BITS = 1 << 26

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, as in tests, one of our own if it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _own_dir[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once an application.

    Where the session doesn't set it, batches of rows for Python become smaller: texts are long.
    """
    for name, value in ARROW.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    app, top = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app not in _shipped:
        _shipped.add(app)
        name = f"{tempfile.mkdtemp(prefix='spark-code-', dir='/tmp')}/{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; none if it is null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def crc_of_id(col: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def hash_place(salt: str, *cols: str) -> Column:
    """A pseudorandom place of a row, by an id and a text as it were, in 0..2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(salt)), 2)


def hash_bound(wanted: int, rows: int) -> int:
    """The place below which about `wanted` of so many rows lie: never 0, however many rows there are."""
    return 1 << 62 if rows <= wanted else (wanted << 62) // rows


def running_sum(df: DataFrame, group: str, order: list[str], value: Column, out: str, rows: int) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same `group` that come before.

    The order is by (a hash bucket of `order`, `order`); rows equal in `order` should be equal in
    `value`, so that reruns agree. A group is cut into about sqrt(rows) buckets: one window runs over
    the buckets' sums and one over the rows of a bucket, so no task holds more than about the square
    root of the largest group. `group` must not be null.
    """
    if isinstance(order, str):
        raise TypeError("order must be a list of columns")
    buckets = max(1, math.isqrt(max(rows, 1)))
    b, s, f = f"_{out}_bucket", f"_{out}_inner", f"_{out}_offset"
    cut = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inner = cut.withColumn(s, F.coalesce(F.sum(value).over(Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    sums = cut.groupBy(group, b).agg(F.sum(value).alias(f))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(f, F.coalesce(F.sum(f).over(before), F.lit(0)).cast("long"))
    return inner.join(offsets, [group, b]).withColumn(out, F.col(s) + F.col(f)).drop(b, s, f)


def bit_of(col: Column) -> Column:
    """The bit of a filter that an id has; piece 0 of Spark's bitmaps is not used."""
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)) + 1


def bitmap(df: DataFrame, at: Column) -> Broadcast:
    """A map with the bits that `at` (1..FILTER_BITS) names, of fixed size (8 MB), built by Spark in pieces of 4 KB and sent to all tasks."""
    pieces = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for piece, bits in zip(pieces["piece"].to_pylist(), pieces["bits"], strict=True):
        start = (piece - 1) * 4096
        whole[start : start + 4096] = np.frombuffer(bits.as_buffer(), np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits from bit_of() are set."""
    return bits[(at - 1) >> 3] >> ((at - 1) & 7).astype(np.uint8) & 1 == 1


def hot_limit(rows: int) -> int:
    """Copies beyond which a key counts as hot. At most 2,000 keys can have more, whatever the input."""
    return max(1000, rows // 2000)


def join_by_key(left: DataFrame, right: DataFrame, key: str | list[str], copies: str, rows: int, merge: bool = False) -> DataFrame:
    """Inner join of `left`, where one key may hold a third of all rows, with `right`, which has one row a key.

    `right.copies` is the number of rows that `left` has of the key and `rows` those of `left` in all.
    Hot keys, of which there are 2,000 at most, are sent to all tasks; the rest is shuffled. With
    `merge` it is so for small tables too: a broadcast's hash table takes 64 MB of the driver, however
    small the table is.
    """
    limit = hot_limit(rows)
    hot = F.broadcast(right.filter(F.col(copies) > limit))
    cold = right.filter(F.col(copies) <= limit)
    cold = cold.hint("merge") if merge else cold
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))
