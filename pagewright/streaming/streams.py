"""Structured Streaming forms: counts, rates, audits on arrival, request limits, alerts and sessions.

stream_counts, rolling_rate and usage_sessions also take batch frames and give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pagewright.functions.ship import ship
from pagewright.operators.cache import hashed
from pagewright.operators.scoring import audit_corpus
from pagewright.operators.usage import admit
from pagewright.sources.tables import dated_audits


def stream_counts(s: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(period, engine, citations) in tumbling windows; rows later than the watermark are dropped."""
    counts = s.withWatermark("detected_at", late).groupBy(F.window("detected_at", window).alias("w"), "engine").agg(F.count("*").alias("citations"))
    return counts.select(F.col("w.start").alias("period"), "engine", "citations")


def rolling_rate(s: DataFrame, days: int = 30, step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(period_start, period_end, citations) in windows of `days` that move by `step`.

    Citations are counted by step and engine first, and those counts, not the citations, go to each
    window that they are in. On a stream these are two stateful operators in one query, in append mode.
    """
    counts = s.withWatermark("detected_at", late).groupBy(F.window("detected_at", step).alias("w"), "engine").agg(F.count("*").alias("citations"))
    sums = counts.groupBy(F.window("w", f"{days} days", step).alias("w")).agg(F.sum("citations").alias("citations"))
    return sums.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "citations")


def audit_stream(s: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, now: bool = True):
    """Audit docs(.., arrived_at) as they come, each content once in (at least) 24 hours; `sink` gets each batch of audits."""
    fresh = hashed(s).withWatermark("arrived_at", "24 hours").dropDuplicatesWithinWatermark(["content_hash", "format"])
    out = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(audit_corpus(batch.drop("content_hash")), n))
    return (out.trigger(availableNow=True) if now else out).start()


def audit_sink(path: str, at: Column) -> Callable[[DataFrame, int], None]:
    """A sink for audit_stream() that a replayed batch adds nothing to.

    Each batch is a folder of its own (batch_id=N under `path`, days within), which the same batch
    overwrites when it comes again after a failure. Read it with spark.read.parquet(path).
    """

    def write(audits: DataFrame, batch: int) -> None:
        dated_audits(audits, at).write.mode("overwrite").partitionBy("audit_date").parquet(f"{path}/batch_id={batch}")

    return write


class _Limit(StatefulProcessor):
    """A key's state is the times of its admitted requests in the last `seconds`, in microseconds; a timer clears it when all are older."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = np.sort(np.concatenate([pdf["us"].to_numpy() for pdf in rows]))
        ok, recent = admit(came.tolist(), sorted(t for (t,) in self.times.get()), self.limit, self.seconds * 1_000_000)
        self.times.put([(int(t),) for t in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(recent[-1] // 1000) + self.seconds * 1000 + 1)
        refused = came[~np.asarray(ok)]
        yield pd.DataFrame({"api_key": key[0], "us": refused})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        yield pd.DataFrame({"api_key": pd.Series([], dtype=object), "us": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_breaches(s: DataFrame, limit: int = 60, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """(api_key, ts) of refused requests, as admit() has them: `limit` in any `seconds`, refused ones not counted.

    Requests are taken in order within a batch, and batches as they come; those that come more than
    `late` after the newest are dropped. A task holds the times alone of a key's requests in a batch,
    whose size the source's limit per trigger sets. The state is in RocksDB, which this sets as the
    session's state store, and a key that has been idle for `seconds` has none. A null key is one.
    """
    ship(s.sparkSession)
    s.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # Watermarks begin at 1970 itself, and what is not later is late: so event times are a millisecond on.
    timed = s.select("api_key", F.unix_micros("ts").alias("us"), (F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).alias("at"))
    keyed = timed.withWatermark("at", late).groupBy("api_key")
    refused = keyed.transformWithStateInPandas(_Limit(limit, seconds), "api_key string, us long", "Append", "eventTime")
    return refused.select("api_key", F.timestamp_micros("us").alias("ts"))


def alerts(s: DataFrame, watched: DataFrame) -> DataFrame:
    """(payload): a JSON event for each citation of a watched URL."""
    hit = s.join(watched.select("url").distinct(), "url")
    body = F.struct("id", "url", "engine", "prompt", F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"))
    return hit.select(F.to_json(F.struct(F.lit("citation.detected").alias("event"), body.alias("data"))).alias("payload"))


def alert_stream(s: DataFrame, watched: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, now: bool = True):
    out = alerts(s, watched).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (out.trigger(availableNow=True) if now else out).start()


def usage_sessions(s: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(api_key, session_start, session_end, requests): runs of requests without a gap."""
    found = s.withWatermark("ts", late).groupBy("api_key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return found.select("api_key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests")
