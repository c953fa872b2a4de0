"""Named entities by a dictionary table: runs of words of the text that are names in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagewright.functions.text import words
from pagewright.operators import detectors
from pagewright.operators.citations import bits_of, has_bit

#: Bits of the filter that each name of a larger one has in it, and the most longs that it takes (8 MB).
PLACES, MOST_LONGS = 4, 1 << 20
#: A dictionary of so many names and characters goes to all tasks; a larger one is joined by a shuffle.
MOST_NAMES, MOST_CHARS = 200_000, 8_000_000
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def plain_words(text: Column) -> Column:
    """Words without the marks at their ends, which part no names; a word of marks alone is an empty one, and parts what is around it."""
    return F.transform(words(text), lambda w: F.regexp_replace(w, EDGES, ""))


def dictionary(names: DataFrame) -> DataFrame:
    """(entity, kind, first, n) of names(name, kind), each once: its words, the first of them and their number. Names without words aren't there."""
    parts = names.select("kind", F.filter(plain_words(F.col("name")), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    return parts.select(F.array_join("w", " ").alias("entity"), "kind", F.get("w", F.lit(0)).alias("first"), F.size("w").alias("n")).distinct()


def mentions(docs: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, entity, kind, mentions): how often each document's text has each name of names(name, kind), case as it is.

    Names may lie within others, and all count. Rows of one id are one document; null texts and names
    have none. Of the runs with some name's number of words, those that begin with some name's first
    word leave their row if the dictionary is small. A larger one is asked within the row by a filter
    of up to 8 MB, so that of other runs few are shuffled: one in 400, up to four million names.
    """
    known = dictionary(names)
    shape = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("entity")), F.lit(0)).alias("chars"), F.sort_array(F.collect_set("n")).alias("sizes")).first()
    small = shape["n"] <= MOST_NAMES and shape["chars"] <= MOST_CHARS
    if not shape["sizes"]:
        return docs.select("doc_id", F.lit("").alias("entity"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("mentions")).limit(0)
    # Behind generators, so that a text and its words are made once, not for each use and condition.
    texts = docs.select("doc_id", F.explode(F.array(F.col(text_col))).alias("_text"))
    split = texts.select("doc_id", F.explode(F.array(plain_words(F.col("_text")))).alias("w")).filter(F.size("w") > 0)
    runs = _begun(split, known, shape["sizes"]) if small else _sifted(split, known, shape)
    named = known.select("entity", "kind")
    return runs.join(F.broadcast(named) if small else named, "entity").groupBy("doc_id", "entity", "kind").agg(F.count("*").alias("mentions"))


def _begun(split: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, entity): the runs of words w that begin with the first word of a name, by a dictionary that all tasks have."""
    run = lambda i, n: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " "))
    at = lambda i: F.struct(F.get("w", i).alias("first"), F.array(*(run(i, F.lit(n)) for n in sizes)).alias("runs"))
    begun = split.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), at)).alias("p")).select("doc_id", "p.*")
    near = begun.join(F.broadcast(known.select("first").distinct()), "first", "left_semi")
    return near.select("doc_id", F.explode("runs").alias("entity")).filter(F.col("entity").isNotNull())


def _place(entity: Column, k: Column) -> Column:
    """A hash of a name for its k-th bit in the filter."""
    return F.xxhash64(entity, k)


def _sifted(split: DataFrame, known: DataFrame, shape: Row) -> DataFrame:
    """(doc_id, entity): the runs of words w that may be names. All that are have all their bits set in the filter."""
    longs = 1 << max(10, min(MOST_LONGS.bit_length() - 1, (shape["n"] // 4).bit_length()))
    places = F.array(*(F.lit(k) for k in range(PLACES)))
    bits = bits_of(known.select(F.explode(F.transform(places, lambda k: _place(F.col("entity"), k))).alias("h")), longs).scalar()
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        one = lambda n: lambda i: F.array_join(F.slice(w, i, n), " ")
        return F.concat(*(w if n == 1 else F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), one(n))).otherwise(none) for n in shape["sizes"]))

    may_be = lambda run: F.forall(places, lambda k: has_bit(F.col("_bits"), _place(run, k), longs))
    asked = split.select("doc_id", of(F.col("w")).alias("_runs"), bits.alias("_bits"))
    # In a step of its own, which takes the filter in by name: as a column of the rows that explode() sees it would be copied to each.
    some = asked.select("doc_id", F.filter("_runs", may_be).alias("_some"))
    # Of a mere column explode() would have its size asked before, and all above done twice.
    return some.select("doc_id", F.explode(F.transform("_some", lambda x: x)).alias("entity"))


def entity_scores(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, score, detected, entity_count): the entity density of parsed documents, by the distinct names in them."""
    found = mentions(parsed, names).groupBy("doc_id").agg(F.countDistinct("entity").alias("n_entities"))
    # Null ids are joined and then have none: a join that leaves them out would read the documents otherwise than `parsed`, and move them again.
    found = found.withColumnRenamed("doc_id", "_found")
    n = F.when(F.col("doc_id").isNotNull(), F.col("n_entities"))
    counted = parsed.join(found, F.col("doc_id").eqNullSafe(F.col("_found")), "left").withColumn("n_entities", F.coalesce(n, F.lit(0)).cast("int"))
    return counted.select("doc_id", detectors.entity_density("given")().alias("k")).select("doc_id", "k.score", "k.detected", "k.entity_count")
