"""Two versions of the same documents: uplift and differences as multisets; edits.py has them in sequence."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.ship import ship
from pagewright.operators.scoring import audit_corpus


def uplift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, before, after, uplift) of two tables of documents, both scored as Markdown."""
    score = lambda d, name: audit_corpus(d.withColumn("format", F.lit("markdown"))).select("doc_id", F.col("score").alias(name))
    return score(before, "before").join(score(after, "after"), "doc_id").withColumn("uplift", F.col("after") - F.col("before"))


def negative_uplift(changes: DataFrame) -> DataFrame:
    """Rewrites that made a document worse."""
    return changes.filter("uplift < 0")


def _lines(pairs: DataFrame, column: str) -> DataFrame:
    rows = pairs.select("doc_id", F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n", -1)).alias("line", "text"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("line")))


def line_diff(pairs: DataFrame) -> DataFrame:
    """(doc_id, type, line, text): lines that only one version of pairs(doc_id, original, optimized) has.

    Lines are compared as multisets, so a line that only moved is no change. Numbers are those in
    the line's own version, from 1.
    """
    a, b = _lines(pairs, "original"), _lines(pairs, "optimized").withColumnRenamed("line", "to")
    both = a.join(b, ["doc_id", "text", "nth"], "full_outer").filter(F.col("line").isNull() | F.col("to").isNull())
    return both.select("doc_id", F.when(F.col("line").isNull(), "add").otherwise("remove").alias("type"), (F.coalesce("line", "to") + 1).alias("line"), "text")


def text_diff_stats(pairs: DataFrame) -> DataFrame:
    """(doc_id, added_words, similarity): similarity is 2 * common / all words, as multisets.

    The words of a pair are counted within its row, so they aren't shuffled. Python splits at the white
    space that functions.text.words() does.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("struct<n1: int, n2: int, common: long>")
    def counted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = x.split(), y.split()
            out.append((len(p), len(q), sum((Counter(p) & Counter(q)).values())))
        return pd.DataFrame(out, columns=["n1", "n2", "common"])

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sizes = pairs.select("doc_id", counted(text("original"), text("optimized")).alias("c")).select("doc_id", "c.*")
    share = F.when(F.col("n1") + F.col("n2") > 0, 2 * F.col("common") / F.nullif(F.col("n1") + F.col("n2"), F.lit(0))).otherwise(F.lit(1.0))
    return sizes.select("doc_id", (F.col("n2") - F.col("n1")).alias("added_words"), share.alias("similarity"))
