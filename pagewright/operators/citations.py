"""Citation facts: filters, lists, dashboards, shares, drops, probes and detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import domain

DEFAULT_ENGINES = ["grok", "claude"]


def days_before(at: Column, days: int) -> Column:
    return at - F.make_dt_interval(F.lit(days))


def filter_citations(df: DataFrame, at: Column, url: str | None = None, domain: str | None = None, engine: str | None = None, days: int = 30) -> DataFrame:
    """All given conditions hold, and the citation is at most `days` old. A detected_date column prunes partitions."""
    since = days_before(at, days)
    out = df.filter(F.col("detected_date") >= F.to_date(since)) if "detected_date" in df.columns else df
    for name, value in (("url", url), ("domain", domain), ("engine", engine)):
        out = out.filter(F.col(name) == value) if value is not None else out
    return out.filter(F.col("detected_at") >= since)


def citation_view(df: DataFrame) -> DataFrame:
    """Nine columns, the time as ISO text."""
    return df.select("id", "url", "domain", "engine", "prompt", "citation_text", "position", "confidence", F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"))


def list_citations(df: DataFrame, limit: int = 50, cursor: tuple | None = None) -> DataFrame:
    """The latest citations, newest first, 1 to 100 of them; after `cursor`, the (detected_at, id) of the last one seen."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        df = df.filter((F.col("detected_at") < at) | ((F.col("detected_at") == at) & (F.col("id") > last)))
    return df.orderBy(F.desc("detected_at"), "id").limit(min(max(limit, 1), 100))


def list_summary(df: DataFrame, limit: int = 50) -> DataFrame:
    """(returned_count, total_count, has_more): a full page claims that more follows."""
    n = min(max(limit, 1), 100)
    return df.agg(F.count("*").alias("total_count")).select(F.least("total_count", F.lit(n)).alias("returned_count"), "total_count", (F.col("total_count") >= n).alias("has_more"))


def by_engine(df: DataFrame) -> DataFrame:
    return df.groupBy("engine").agg(F.count("*").alias("citations"))


def top_cited(df: DataFrame, n: int = 10) -> DataFrame:
    """The pages with the most citations; equal ones by the latest citation, then by URL."""
    pages = df.groupBy("url").agg(F.count("*").alias("citations"), F.max("detected_at").alias("latest"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    return pages.orderBy(F.desc("citations"), F.desc("latest"), "url").limit(n)


def citation_trend(df: DataFrame, at: Column, days: int = 30, grain: str = "day") -> DataFrame:
    """(period, citations) for every period of the last `days`, empty ones with 0."""
    spark = df.sparkSession
    start = F.date_trunc(grain, days_before(at, days))
    spine = spark.range(1).select(F.explode(F.sequence(start, F.date_trunc(grain, at), F.expr(f"INTERVAL 1 {grain}"))).alias("period"))
    counts = df.filter(F.col("detected_at") >= days_before(at, days)).groupBy(F.date_trunc(grain, "detected_at").alias("period")).agg(F.count("*").alias("n"))
    return spine.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("citations"))


def share_of_voice(df: DataFrame, by: str = "engine") -> DataFrame:
    """(by, domain, citations, share): a domain's part of all citations of an engine or prompt category.

    The sums are joined instead of windowed, so that the domains of one engine needn't be in one task.
    """
    counts = df.groupBy(by, "domain").agg(F.count("*").alias("citations"))
    sums = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("citations").alias("_all"))
    return counts.join(sums, F.col(by).eqNullSafe(F.col("_by"))).select(by, "domain", "citations", (F.col("citations") / F.col("_all")).alias("share"))


def voice_cube(df: DataFrame) -> DataFrame:
    """Counts by engine and domain with all subtotals; null marks a sum."""
    return df.cube("engine", "domain").agg(F.count("*").alias("citations"))


def citation_drops(df: DataFrame, threshold: float = 0.2, grain: str = "week") -> DataFrame:
    """Periods in which a domain's citations fell by more than `threshold` against the period before it."""
    counts = df.groupBy("domain", F.date_trunc(grain, "detected_at").alias("period")).agg(F.count("*").alias("citations"))
    order = Window.partitionBy("domain").orderBy("period")
    both = counts.withColumn("before", F.lag("citations").over(order))
    return both.filter(F.col("citations") < F.col("before") * (1 - threshold)).select("domain", "period", "before", "citations", ((F.col("before") - F.col("citations")) / F.col("before")).alias("drop"))


def dashboard(df: DataFrame, at: Column, days: int = 30) -> dict[str, DataFrame]:
    """Totals, engines, pages and trend of the last days, as four frames over one filtered input."""
    recent = filter_citations(df, at, days=days)
    return {"total_citations": recent.agg(F.count("*").alias("total_citations")), "by_engine": by_engine(recent), "top_cited_pages": top_cited(recent), "citation_rate": citation_trend(recent, at, days)}


def probe_plan(urls: DataFrame, prompts: DataFrame, engines: list[str] | None = None, history: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """(url, prompt, engine) to ask: each URL has the whole list of prompts and engines, less what was asked within 24 hours.

    Prompts are a list that a user writes, so it is kept as an array on each URL.
    """
    asks = prompts.agg(F.array_sort(F.collect_set("prompt"))).first()[0]
    names = engines or DEFAULT_ENGINES
    plan = urls.select("url", F.explode(F.array(*map(F.lit, asks)) if asks else F.array().cast("array<string>")).alias("prompt")).select("url", "prompt", F.explode(F.array(*map(F.lit, names))).alias("engine"))
    if history is None:
        return plan
    done = history.filter(F.col("detected_at") >= at - F.expr("INTERVAL 24 HOURS")).select("url", "prompt", "engine").distinct()
    return plan.join(done, ["url", "prompt", "engine"], "left_anti")


URL_IN_TEXT = r"https?://[^\s)>\]\"']+"


def detect_citations(answers: DataFrame, tracked: DataFrame) -> DataFrame:
    """(answer_id, engine, url, domain, match, position, excerpt): tracked pages and domains that an answer names.

    `match` is url or domain; position counts the answer's URLs from 1 and is that of the first mention.
    """
    found = answers.select("answer_id", "engine", "text", F.posexplode(F.regexp_extract_all("text", F.lit(URL_IN_TEXT), F.lit(0))).alias("i", "raw")).withColumn("url", F.regexp_replace("raw", r"[.,;:!?]+$", "")).withColumn("domain", domain(F.col("url")))
    first = found.groupBy("answer_id", "engine", "url", "domain").agg((F.min("i") + 1).alias("position"), F.first("text").alias("text"))
    pages = tracked.select(F.col("url").alias("t_url")).distinct()
    sites = tracked.select(F.col("domain").alias("t_domain")).distinct()
    hit = first.join(sites, F.col("domain") == F.col("t_domain")).join(pages, F.col("url") == F.col("t_url"), "left")
    at = F.position(F.col("url"), F.col("text"))
    return hit.select("answer_id", "engine", "url", "domain", F.when(F.col("t_url").isNotNull(), "url").otherwise("domain").alias("match"), "position", F.substr(F.col("text"), F.greatest(at - 40, F.lit(1)), F.lit(80)).alias("excerpt"))


def _runs(text_col: str, n: int) -> Column:
    """Hashes of all runs of n lower-case words of a text."""
    from pagewright.functions.text import words

    def of(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))

    return F.get(F.transform(F.array(words(F.lower(text_col))), of), F.lit(0))


def shingles(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, h): the distinct runs of n lower-case words of each text."""
    return docs.select(id_col, F.explode(F.array_distinct(_runs(text_col, n))).alias("h"))


def bits_of(hashes: DataFrame, longs: int) -> DataFrame:
    """One row with `bits`: a bitmap of so many longs in which the bit of each hash of hashes(h) is set."""
    own = hashes.groupBy(_long_of(F.col("h"), longs).alias("i")).agg(F.bit_or(_mask_of(F.col("h"))).alias("v"))
    full = hashes.sparkSession.range(longs).select(F.col("id").cast("int").alias("i")).join(own, "i", "left").select("i", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("bits"))


def _long_of(h: Column, longs: int) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(longs)).cast("int")


def _mask_of(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def has_bit(bits: Column, h: Column, longs: int) -> Column:
    """Whether the bit of a hash is set in a bitmap of so many longs."""
    return F.get(bits, _long_of(h, longs)).bitwiseAND(_mask_of(h)) != 0


def sifted(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(id, h): the distinct runs of each text that may be in wanted(h): all that are, and of others about one in sixteen or less.

    A bitmap of the wanted hashes, 16 bits each within 8 KB and 8 MB, is asked within the row, so
    texts that share nothing give no rows.
    """
    longs = 1 << max(10, min(20, (wanted.count() // 4).bit_length()))
    kept = lambda h: has_bit(F.col("_bits"), h, longs)
    asked = docs.select(id_col, _runs(text_col, n).alias("_runs"), bits_of(wanted, longs).scalar().alias("_bits"))
    return asked.select(id_col, F.explode(F.array_distinct(F.filter("_runs", kept))).alias("h"))


def quoted_passages(answers: DataFrame, passages: DataFrame, n: int = 8, least: float = 0.5) -> DataFrame:
    """(answer_id, passage_id, containment): the share of a passage's n-word runs that an answer has, where it is `least` or more."""
    p = shingles(passages, "passage_id", "text", n)
    sizes = p.groupBy("passage_id").agg(F.count("*").alias("runs"))
    hits = sifted(answers, "answer_id", "text", n, p.select("h")).join(p, "h").groupBy("answer_id", "passage_id").agg(F.count("*").alias("hits"))
    share = hits.join(sizes, "passage_id").withColumn("containment", F.col("hits") / F.col("runs"))
    return share.filter(F.col("containment") >= least).select("answer_id", "passage_id", "containment")
