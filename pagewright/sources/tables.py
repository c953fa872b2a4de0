"""Readers, adapter views over the driver's tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import contains_any

AS_OF = "2024-01-31 00:00:00"

#: Which engine each kind of event stands for.
ENGINES = {"click": "grok", "view": "claude", "purchase": "gpt", "signup": "gemini", "error": "perplexity"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files, dealt to all cores: its rows cost far more to work on than to move. Larger tables stay as they are.

    Files count, not the plan's partitions: a file is cut into ranges of bytes, but all of a row group
    falls to one of them, so a file of one row group is one task's work whatever the plan says.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 2 * cores:
        return df
    return df.repartition(max(2 * cores, df._jdf.queryExecution().toRdd().getNumPartitions()))


def as_of(at: str = AS_OF) -> Column:
    """A fixed time, never the clock, so that runs repeat."""
    return F.lit(at).cast("timestamp")


def read_markdown(spark: SparkSession, glob: str) -> DataFrame:
    """Whole Markdown files as documents."""
    files = spark.read.text(glob, wholetext=True).withColumn("url", F.input_file_name())
    return files.select(F.xxhash64("url").alias("doc_id"), "url", F.col("value").alias("content"), F.lit("markdown").alias("format"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages as HTML documents."""
    return spread(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("content"), F.lit("html").alias("format"))


def _page_urls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages, max(1, pages.count())


def _content() -> Column:
    """The article of a document: its text and the structures that its id calls for."""
    i = F.col("doc_id")
    every = lambda k, text: F.when(i % k == 0, text)
    table = F.lit("| Item | Value |\n|---|---|\n| A | 1 |\n| B | 2 |\n\nItem A vs Item B")
    marks = "#|*_[]`"
    body = F.when(contains_any(F.col("text"), list(marks)), F.translate("text", marks, " " * len(marks))).otherwise(F.col("text"))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), "source", F.lit(" report")),
        every(2, F.concat(F.lit("Updated "), (i % 25 + 2000).cast("string"), F.lit(", version "), (i % 9).cast("string"))),
        every(3, table),
        every(4, F.lit("What is it? How does it work? However it helps.")),
        every(5, F.lit("- alpha\n- beta\n- gamma")),
        every(6, F.lit("Step 1 begins here\n\n1. one\n2. two\n3. three\n4. four")),
        every(7, F.lit("## Frequently Asked Questions\n\n### Why?")),
        every(8, F.lit("According to research from the lab [source](https://example.com/lab)")),
        every(9, F.lit("This is important because it means more")),
        body,
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Markdown articles, with the structures that their id calls for."""
    pages, n = _page_urls(spark, sf_dir)
    made = spread(read(spark, sf_dir, "documents")).select("doc_id", "lang", "source", _content().alias("content"), (F.col("doc_id") % n).alias("page_id"))
    return made.join(pages, "page_id", "left").select("doc_id", "url", "content", F.lit("markdown").alias("format"), "lang", "source")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as citations: which engine cited which page, when."""
    pages, n = _page_urls(spark, sf_dir)
    engine = F.create_map(*(F.lit(x) for kv in ENGINES.items() for x in kv))[F.col("event_type")]
    e = read(spark, sf_dir, "events").withColumn("page_id", F.col("event_id") % n).join(pages, "page_id", "left")
    return e.select(F.col("event_id").cast("string").alias("id"), "url", domain_of("url").alias("domain"), engine.alias("engine"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("prompt"), (F.concat(F.lit("cat"), (F.col("user_id") % 3).cast("string"))).alias("prompt_category"), F.lit("cited").alias("citation_text"), (F.col("event_id") % 5 + 1).cast("int").alias("position"), (F.col("value") / 500).alias("confidence"), F.col("ts").cast("timestamp").alias("detected_at"), (F.col("event_id") % 4 == 0).alias("verified"))


def domain_of(name: str) -> Column:
    from pagewright.functions.text import domain

    return domain(F.col(name))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as API requests, 30 days told in 30 minutes."""
    ts = F.timestamp_micros((F.lit(1704067200000000).cast("long") + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000).cast("long")) / 1440)).cast("long"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), ts.alias("ts"), F.concat(F.lit("key"), "event_type").alias("api_key"), F.concat(F.lit("/p"), (F.col("user_id") % 7).cast("string")).alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 100).alias("duration_s"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers of engines; every second conversation names a source."""
    pages, n = _page_urls(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("page_id", F.col("conv_id") % n).join(pages, "page_id", "left")
    text = F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" Source: "), "url")).otherwise(F.col("text"))
    engine = F.element_at(F.array(F.lit("grok"), F.lit("claude"), F.lit("gpt")), (F.col("conv_id") % 3 + 1).cast("int"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), engine.alias("engine"), text.alias("text"))


#: Name columns of the tables that make up the dictionary of entities.
NAMED = {"supplier": "s_name", "part": "p_name", "nation": "n_name", "customer": "c_name", "region": "r_name"}


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind): the names of suppliers, parts, nations, customers and regions, each once."""
    some = [read(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(t).alias("kind")) for t, c in NAMED.items()]
    out = some[0]
    for df in some[1:]:
        out = out.unionByName(df)
    return out.distinct()


def mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a last line that names a supplier, a part of it, its nation and a region, by the document's id.

    What an id calls for is looked up for the ids alone, so that however large the tables are, texts
    are moved once: when they are dealt out by id, to meet it.
    """
    count = lambda t: max(1, read(spark, sf_dir, t).count())
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_sk"), "s_name", F.col("s_nationkey").alias("_nk"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("_pk"), "p_name")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_nk"), "n_name", F.col("n_regionkey").alias("_rk"))
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("_rk"), "r_name")
    pages, n = _page_urls(spark, sf_dir)
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ids = docs.select(i).distinct().withColumns({"page_id": i % n, "_sk": i % count("supplier"), "_pk": i % count("part")})
    told = ids.join(pages, "page_id", "left").join(supplier, "_sk", "left").join(part, "_pk", "left").join(nation, "_nk", "left").join(region, "_rk", "left")
    line = F.concat(F.lit("(A "), "p_name", F.lit(", by "), "s_name", F.lit("; of "), "n_name", F.lit(", "), "r_name", F.lit(".)"))
    told = told.select("doc_id", "url", line.alias("_line"))
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), docs._jdf.queryExecution().toRdd().getNumPartitions())
    dealt = docs.select("doc_id", "source", "text").repartition(parts, "doc_id")
    # Hashes of the ids, as sorting would move the texts again, to disk where they are many.
    made = dealt.join(told.hint("shuffle_hash"), "doc_id", "left")
    return made.select("doc_id", "url", F.concat_ws("\n\n", _content(), "_line").alias("content"), F.lit("markdown").alias("format"))


# ---- sinks ----


def dated_audits(audits: DataFrame, at: Column) -> DataFrame:
    """Audits with when they were made and, 24 hours later, expire."""
    out = audits.withColumn("created_at", at).withColumn("expires_at", at + F.expr("INTERVAL 24 HOURS"))
    return out.withColumn("audit_date", F.to_date("created_at"))


def write_audits(audits: DataFrame, path: str, at: Column) -> None:
    """Append audits by day. A batch that may come twice goes through streams.audit_sink()."""
    dated_audits(audits, at).write.mode("append").partitionBy("audit_date").parquet(path)


def store_citations(rows: DataFrame, at: Column) -> DataFrame:
    """Citations to be stored: the domain is derived, confidence, verified and time have their defaults."""
    return rows.select("id", "url", domain_of("url").alias("domain"), "engine", "prompt", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("detected_at", at).alias("detected_at"))


def write_citations(rows: DataFrame, path: str, at: Column) -> None:
    store_citations(rows, at).withColumn("detected_date", F.to_date("detected_at")).write.mode("append").partitionBy("detected_date").parquet(path)


def read_citations(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """Citations since a time; the date prunes partitions."""
    return spark.read.parquet(path).filter((F.col("detected_date") >= F.to_date(since)) & (F.col("detected_at") >= since))


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
