"""API usage: keys, latencies and request rates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.ship import ship
from pagewright.operators.ranks import quantiles


def key_usage(requests: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """keys(key_hash, name, is_active, expires_at) with usage_count, last_used and whether each can be used."""
    used = requests.groupBy(F.sha2("api_key", 256).alias("key_hash")).agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used"))
    usable = F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > at))
    return keys.join(used, "key_hash", "left").select("key_hash", "name", F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "last_used", usable.alias("usable"))


def unknown_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    asked = requests.groupBy(F.sha2("api_key", 256).alias("key_hash")).agg(F.count("*").alias("requests"))
    return asked.join(keys, "key_hash", "left_anti")


def latency_report(requests: DataFrame) -> DataFrame:
    """By path: requests, mean, median and 99th percentile of the duration, share of errors. The percentiles are exact, by ranks."""
    sums = requests.groupBy("path").agg(F.count("*").alias("requests"), F.round(F.avg("duration_s"), 6).alias("mean_s"), F.avg(F.when(F.col("status") >= 500, 1.0).otherwise(0.0)).alias("error_rate"))
    points = quantiles(requests, ["path"], "duration_s", {"p50_s": 0.5, "p99_s": 0.99}).withColumnRenamed("path", "_path")
    both = sums.join(points, F.col("path").eqNullSafe(F.col("_path")), "left")
    return both.select("path", "requests", "mean_s", F.round("p50_s", 6).alias("p50_s"), F.round("p99_s", 6).alias("p99_s"), "error_rate")


def admit(times: list[float], recent: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Whether each request is admitted: while fewer than `limit` admitted ones lie within `seconds`. Refused ones don't count."""
    window, out = deque(recent), []
    for t in times:
        while window and window[0] <= t - seconds:
            window.popleft()
        out.append(len(window) < limit)
        if out[-1]:
            window.append(t)
    return out, list(window)


def stretches(requests: DataFrame, seconds: int) -> DataFrame:
    """Add `stretch`: a key's requests are cut where `seconds` or more lie between two, over which no limit reaches.

    Such a gap is never within one piece of `seconds`, so the cuts are found from the pieces' first
    and last times alone.
    """
    cut = requests.withColumn("piece", F.expr(f"unix_micros(ts) div {seconds * 1_000_000}"))
    pieces = cut.groupBy("api_key", "piece").agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last"))
    order = Window.partitionBy("api_key").orderBy("piece")
    starts = F.when(F.coalesce(F.col("first") - F.lag("last").over(order) >= seconds * 1_000_000, F.lit(True)), F.col("piece"))
    marked = pieces.withColumn("start", starts).withColumn("stretch", F.last("start", ignorenulls=True).over(order))
    marked = marked.select(F.col("api_key").alias("of"), F.col("piece").alias("at"), "stretch")
    return cut.join(marked, F.col("api_key").eqNullSafe(F.col("of")) & F.col("piece").eqNullSafe(F.col("at"))).drop("of", "at", "piece")


def rate_breaches(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(request_id, api_key, ts) of refused requests, exactly: the state runs along each key's requests in order.

    A task reads a stretch in batches and holds one batch and the last admitted times, `limit` at
    most. Stretches of a key go to different tasks; one without a gap of `seconds` stays in one.
    """

    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, []
        for pdf in batches:
            ok = []
            for now, part in pdf.groupby(["api_key", "stretch"], sort=False, dropna=False):
                now = tuple(None if pd.isna(x) else x for x in now)
                if now != key:
                    key, recent = now, []
                some, recent = admit(part["us"].tolist(), recent, limit, seconds * 1_000_000)
                ok.extend(some)
            yield pdf[[not x for x in ok]][["request_id", "api_key", "ts"]]

    rows = stretches(requests.select("request_id", "api_key", "ts"), seconds).withColumn("us", F.unix_micros("ts"))
    placed = rows.repartition("api_key", "stretch").sortWithinPartitions("api_key", "stretch", "ts", "request_id")
    return placed.mapInPandas(run, "request_id long, api_key string, ts timestamp")


def requests_per_minute(requests: DataFrame, limit: int = 60) -> DataFrame:
    """(api_key, minute, requests) of minutes with more than `limit` requests: the cheap form, in which refused ones count."""
    return requests.groupBy("api_key", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests")).filter(F.col("requests") > limit)
