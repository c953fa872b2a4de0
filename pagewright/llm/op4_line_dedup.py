"""Line dedup: content-defined chunks of lines that repeat anywhere in the corpus are kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_by_key, keep, table

_LAST = (1 << 63) - 1


def _rolling(hashes: Column) -> Column:
    """For each line a hash of it and the line before: cyclic shift and xor, so a window of two rolls on."""
    before = lambda i: F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long"))
    return F.transform(hashes, lambda h, i: h.bitwiseXOR(F.shiftleft(before(i), 1).bitwiseOR(F.shiftrightunsigned(before(i), 63))))


def chunk_lines(docs: DataFrame, id_col: str, text_col: str, long_line: int) -> DataFrame:
    """(doc, version, lines, hashes, words, starts): the lines of each text, their words and the lines at which its chunks start.

    A chunk starts where the rolling hash has a local minimum, so it has two lines or more and its
    bounds depend on five lines around them alone: text put in or taken out elsewhere doesn't shift
    them. A line of `long_line` words or more is a passage itself and so a chunk of its own.
    """
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.split(text_col, "\n", -1).alias("lines"))
    hashed = text.select("*", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
    rolled = hashed.select("*", _rolling(F.col("hashes")).alias("roll"))
    at = lambda i: F.get("roll", i)
    low = lambda i: (at(i) < at(i - 1)) & (at(i) < F.coalesce(at(i + 1), F.lit(_LAST)))
    wide = lambda i: F.coalesce(F.get("words", i), F.lit(0)) >= long_line
    cut = lambda i: (i == 0) | wide(i) | wide(i - 1) | F.coalesce(low(i), F.lit(False))
    return rolled.select("doc", "version", "lines", "hashes", "words", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), cut).alias("starts"))


def line_units(chunked: DataFrame, long_line: int) -> DataFrame:
    """(doc, version, at, n, hash), a row a stretch of `n` lines from line `at` that may repeat: chunks and passages.

    A chunk counts if it has a word and two lines or more, or is one long line. A passage begins at
    a line with words and has as few lines as make `long_line` words, so equal text from a line on
    has equal passages whatever is around it. Lines without words within count by their bytes.
    """
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    spans = F.transform("starts", lambda s, k: F.struct(s.alias("at"), (end(k) - s).alias("n")))
    wordy = lambda c: F.exists(F.slice("words", c["at"] + 1, c["n"]), lambda x: x > 0)
    counts = lambda c: (F.get("words", c["at"]) >= long_line) | ((c["n"] > 1) & wordy(c))
    hashed = lambda c, mark: F.xxhash64(F.slice("hashes", c["at"] + 1, c["n"]), F.lit(mark))
    unit = lambda mark: lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), hashed(c, mark).alias("hash"))

    # Each line here has a word, so a passage has `long_line` of them at most; mostly a few will do.
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    more = lambda s, w: F.when(s["words"] >= long_line, s).otherwise(F.struct((s["words"] + w).alias("words"), (s["n"] + 1).alias("n")))
    reach = lambda k, most: F.aggregate(F.slice("full_words", k + 1, most), none, more)
    far = lambda k: F.get(F.transform(F.array(reach(k, 8)), lambda s: F.when(s["words"] >= long_line, s).otherwise(reach(k, long_line))), F.lit(0))
    full = chunked.select("*", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("words", i) > 0).alias("full"))
    reached = full.select("*", F.transform("full", lambda i: F.get("words", i)).alias("full_words"))
    # The last lines have no passage: too few words follow.
    found = reached.select("*", F.transform("full", lambda i, k: F.struct(i.alias("at"), k.alias("k"), far(k).alias("to"))).alias("reach"))
    passage = lambda x: F.struct(x["at"].alias("at"), (F.get("full", x["k"] + x["to"]["n"] - 1) - x["at"] + 1).alias("n"))
    passages = F.transform(F.filter("reach", lambda x: x["to"]["words"] >= long_line), passage)
    spanned = found.select("doc", "version", "hashes", F.filter(spans, counts).alias("spans"), passages.alias("passages"))
    units = F.concat(F.transform("spans", unit("chunk")), F.transform("passages", unit("passage")))
    return spanned.select("doc", "version", F.explode(units).alias("u")).select("doc", "version", "u.*")


def _order() -> Column:
    """What tells which of equal units comes first: the document's id, nulls last, its text, the line."""
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "version", "at")


def repeated_units(units: DataFrame) -> DataFrame:
    """(doc, version, units): of each text the units that come more than once, with whether an earlier one `repeats` in them."""
    twice = units.groupBy("hash").agg(F.count("*").alias("copies"), F.min(_order()).alias("first")).filter("copies > 1")
    found = join_by_key(units, keep(twice, "lines-repeated"), "hash", "copies", units.count(), merge=True)
    marked = F.struct("at", "n", "hash", (_order() > F.col("first")).alias("repeats"))
    return found.groupBy("doc", "version").agg(F.collect_set(marked).alias("units"))


def _hashes(text: Column | str) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))


def unlike_units(marked: DataFrame, text: str) -> DataFrame:
    """(hash): hashes of lines that belong to different bytes and of units that belong to different lines; `marked` has the texts beside their units.

    A line is compared once a text, however many units it is in.
    """
    both = marked.select(F.split(text, "\n", -1).alias("lines"), "units").withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    numbers = F.array_distinct(F.flatten(F.transform("units", lambda u: F.sequence(u["at"], u["at"] + u["n"] - 1))))
    lines = F.transform(numbers, lambda i: F.struct(F.get("hashes", i).alias("hash"), F.encode(F.get("lines", i), "UTF-8").alias("bytes")))
    units = F.transform("units", lambda u: F.struct(u["hash"].alias("hash"), F.encode(F.array_join(F.transform(F.slice("hashes", u["at"] + 1, u["n"]), lambda h: h.cast("string")), ","), "UTF-8").alias("bytes")))
    told = lambda what: both.select(F.explode(what).alias("b")).select("b.*").distinct().groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return told(lines).unionByName(told(units)).distinct()


def _settle(marked: DataFrame, unlike: DataFrame, text: str) -> DataFrame:
    """Take back the repeats whose hash, or that of one of their lines, also belongs to other bytes."""
    one = marked.filter(F.size("units") > 0).select("_ld_of", F.col("_ld_id").alias("doc"), _hashes(F.col(text)).alias("hashes"), F.explode("units").alias("u"))
    hashes = F.array_append(F.slice("hashes", F.col("u.at") + 1, F.col("u.n")), F.col("u.hash"))
    wrong = one.select("_ld_of", "doc", "u", F.explode(hashes).alias("hash")).join(unlike, "hash", "left_semi")
    back = wrong.groupBy(F.col("doc").alias("_ld_doc"), F.col("_ld_of").alias("_ld_version")).agg(F.collect_set("u").alias("_ld_back"))
    joined = marked.join(back, F.col("_ld_id").eqNullSafe(F.col("_ld_doc")) & (F.col("_ld_of") == F.col("_ld_version")), "left")
    left = F.when(F.col("_ld_back").isNull(), F.col("units")).otherwise(F.array_except("units", "_ld_back"))
    return joined.withColumn("units", left).drop("_ld_doc", "_ld_version", "_ld_back")


def _kept_text(cut: DataFrame) -> DataFrame:
    """Add `new`: the text of (text, units) without the lines of repeated units."""
    split = cut.withColumn("lines", F.split("text", "\n", -1)).withColumn("again", F.filter("units", lambda u: u["repeats"]))
    dropped = F.flatten(F.transform("again", lambda u: F.sequence(u["at"], u["at"] + u["n"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped)
    return split.withColumn("left", left).withColumn("new", F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int = 50) -> DataFrame:
    """Drop the chunks and passages of lines that come earlier in the corpus byte for byte.

    Chunks are of two lines or more with a word, or one line of `long_line` words. Since a repeated
    text of few lines has no chunk of its own and a longer one ends within chunks, passages are
    compared as well: the fewest lines from a line on that make `long_line` words. So all lines of a
    repeated stretch of `long_line` words go, and each that goes is in a chunk or passage that came
    before as a whole; lines whose neighbours alone came before stay. Earlier is by id, then place in
    the text, so the first of all equal lines always stays. A shorter stretch that is no chunk stays.

    Returns the columns of `docs`, with the text cut. A null text stays null, an empty one empty; a
    text of which all goes becomes empty, and its row stays. Rows equal in id and text count as one
    document and get the same text; a null id comes after all others, and texts of one id go by
    their hash. Units whose 64-bit hash belongs to other bytes too stay. Columns of `docs` of any
    name pass through.
    """
    units = keep(line_units(chunk_lines(docs.filter(F.col(text_col).isNotNull()), id_col, text_col, long_line), long_line), "lines-units")
    found = repeated_units(units).select(F.col("doc").alias("_ld_doc"), F.col("version").alias("_ld_version"), F.col("units").alias("_ld_units"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_ld_id"), F.xxhash64(text_col).alias("_ld_of"))
    joined = rows.join(found.hint("merge"), F.col("_ld_id").eqNullSafe(F.col("_ld_doc")) & (F.col("_ld_of") == F.col("_ld_version")), "left")
    marked = keep(joined.select("row", "_ld_id", "_ld_of", F.col("_ld_units").alias("units")), "lines-marked")
    unlike = keep(unlike_units(marked.filter("units is not null").select("row", "units"), f"row.`{text_col}`"), "lines-unlike")
    if not unlike.isEmpty():
        marked = _settle(marked, unlike, f"row.`{text_col}`")
    some = F.exists("units", lambda u: u["repeats"])
    cut = _kept_text(marked.select("row", F.when(some, F.col("units")).alias("units")).withColumn("text", F.when(F.col("units").isNotNull(), F.col("row")[text_col])))
    text = F.when(F.col("units").isNotNull(), F.col("new")).otherwise(F.col("row")[text_col])
    # The new text comes out of a generator, so conditions that a user sets on it aren't computed from the lines again.
    out = cut.select("row", F.explode(F.array(text)).alias("_ld_text")).select("row.*", "_ld_text")
    return out.select(*(F.col("_ld_text").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that earlier documents have as chunks or passages: doc_id, text, chars_before, chars_after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("chars_before"))
    return dedup_lines(docs).withColumn("chars_after", F.length("text"))
