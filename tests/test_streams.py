"""Streams over replayed files give what batches give."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagewright.operators.usage import admit
from pagewright.sources import tables
from pagewright.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def files(spark, tmp_path):
    """A function that writes a frame as files in time order and reads them as a stream."""

    def stream(df, order, parts=3):
        path = str(tmp_path / "in")
        df = df.orderBy(order)
        rows = df.collect()
        step = -(-len(rows) // parts)
        for k in range(parts):
            spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


def drain(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_counts(spark, files, tmp_path):
    c = tables.citations(spark, SF)
    got = drain(streams.stream_counts(files(c, "detected_at")), tmp_path, "update")
    want = {(r["period"], r["engine"]): r["citations"] for r in streams.stream_counts(c).collect()}
    have = {k: max(n) for k, n in _by_key(got).items()}
    assert have == want


def _by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["period"], r["engine"]), []).append(r["citations"])
    return out


def test_audits_on_arrival(spark, files, tmp_path):
    docs = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 02:00:00")], "doc_id long, content string, at string").select("doc_id", "content", F.lit("markdown").alias("format"), F.col("at").cast("timestamp").alias("arrived_at"))
    seen = []
    streams.audit_stream(files(docs, "arrived_at", 1), lambda b, n: seen.extend(r["doc_id"] for r in b.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert len(seen) == 2 and 3 in seen


def test_request_limit(spark, files, tmp_path):
    r = spark.createDataFrame([("k", i) for i in range(10)], "api_key string, s long").select("api_key", F.timestamp_seconds("s").alias("ts"))
    got = drain(streams.stream_breaches(files(r, "ts", 2), limit=4, seconds=6), tmp_path)
    assert sorted(int(x["ts"].timestamp()) for x in got.collect()) == [4, 5]


@pytest.mark.parametrize("cuts", [(40,), (7, 61, 62), (1, 2, 3)])
def test_limits_over_batches_cut_anywhere(spark, tmp_path, cuts):
    rng = random.Random(sum(cuts))
    times = {k: sorted(rng.randrange(0, 90_000) for _ in range(n)) for k, n in (("a", 60), ("b", 30), (None, 12))}
    rows = sorted(((t, k) for k, ts in times.items() for t in ts), key=lambda r: r[0])
    rows = [(k, t) for t, k in rows] + [("end", 10_000_000), ("end", 20_000_000)]
    path, at = str(tmp_path / "in"), [0, *cuts, len(rows) - 2, len(rows) - 1, len(rows)]
    for i, j in zip(at, at[1:], strict=False):
        spark.createDataFrame(rows[i:j], "api_key string, ms long").select("api_key", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("api_key string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    got = drain(streams.stream_breaches(s, limit=5, seconds=10), tmp_path)
    want = sorted((str(k), t) for k, ts in times.items() for t, ok in zip(ts, admit([x * 1000 for x in ts], [], 5, 10_000_000)[0], strict=True) if not ok)
    assert sorted((str(r["api_key"]), round(r["ts"].timestamp() * 1000)) for r in got.collect()) == want
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "times").load()
    assert {r["key"][0] for r in state.select("key").collect()} == {"end"}  # the others were idle


def test_rolling_rate_from_daily_counts(spark, files, tmp_path):
    c = tables.citations(spark, SF)
    want = {(r["period_start"], r["period_end"]): r["citations"] for r in streams.rolling_rate(c, 7).collect()}
    got = {(r["period_start"], r["period_end"]): r["citations"] for r in drain(streams.rolling_rate(files(c, "detected_at"), 7), tmp_path).collect()}
    assert len(got) > 15 and all(want[k] == n for k, n in got.items())
    direct = c.groupBy(F.window("detected_at", "7 days", "1 day").alias("w")).count().select("w.start", "w.end", "count")
    assert {(r[0], r[1]): r[2] for r in direct.collect()} == want


def test_replayed_batches_add_nothing(spark, files, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"2024-01-0{i % 3 + 1} 00:00:00") for i in range(9)], "doc_id long, content string, at string").select("doc_id", "content", F.lit("markdown").alias("format"), F.col("at").cast("timestamp").alias("arrived_at"))
    path, failed = str(tmp_path / "out"), []
    write = streams.audit_sink(path, tables.as_of())

    def once_more(batch, n):
        write(batch, n)
        if n == 1 and not failed:  # the batch is written, but the stream stops before it knows
            failed.append(n)
            raise RuntimeError("stopped")

    s = files(docs, "arrived_at")
    with pytest.raises(StreamingQueryException):
        streams.audit_stream(s, once_more, str(tmp_path / "cp")).awaitTermination(120)
    assert failed == [1] and spark.read.parquet(path).count() == 6
    streams.audit_stream(s, once_more, str(tmp_path / "cp")).awaitTermination(120)
    back = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(9)) and {r["batch_id"] for r in back.collect()} == {0, 1, 2}


def test_alerts(spark, files, tmp_path):
    c, seen = tables.citations(spark, SF), []
    watched = tables.read(spark, SF, "pages").filter("page_id = 1")
    streams.alert_stream(files(c, "detected_at"), watched, lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp3")).awaitTermination(120)
    assert len(seen) == streams.alerts(c, watched).count() > 0


def test_sinks(spark, tmp_path):
    at = tables.as_of()
    a = spark.createDataFrame([(1, 5.0)], "doc_id long, score double")
    for _ in range(2):
        tables.write_audits(a, str(tmp_path / "audits"), at)
    back = spark.read.parquet(str(tmp_path / "audits"))
    assert back.count() == 2 and "audit_date" in back.columns
    tables.write_citations(tables.citations(spark, SF), str(tmp_path / "citations"), at)
    assert tables.read_citations(spark, str(tmp_path / "citations"), F.lit("2024-01-20").cast("timestamp")).count() == tables.citations(spark, SF).filter("detected_at >= '2024-01-20'").count()
    assert tables.to_json_lines(a).first()["value"] == '{"doc_id":1,"score":5.0}'
    tables.export_csv(a, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["score"] == "5.0"
    (tmp_path / "x.md").write_text("# Hi\n\nThere")
    assert tables.read_markdown(spark, str(tmp_path / "*.md")).first()["content"] == "# Hi\n\nThere"
