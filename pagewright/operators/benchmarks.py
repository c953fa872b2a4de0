"""Where a score stands: bands, engines, the corpus and similar documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Percentile bands, and what each engine takes off.
BANDS = [(90, 95), (80, 85), (70, 70), (60, 50), (50, 30)]
LOWEST_BAND = 15
ENGINE_OFFSETS = {"grok": 5, "claude": 3, "gpt": 2}


def percentile_band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, band in BANDS[1:]:
        out = out.when(score >= least, band)
    return out.otherwise(LOWEST_BAND)


def engine_scores(score: Column) -> Column:
    return F.create_map(*(x for e, off in ENGINE_OFFSETS.items() for x in (F.lit(e), F.greatest(F.lit(0.0), score - off))))


def corpus_percentile(audits: DataFrame, by: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Add corpus_percentile: the share of documents (of the same `by`) with a lower score.

    There are at most 1,251 different scores, so the ranks come from a histogram, which all tasks get.
    The scores are dealt out once by `id_col`, for the histogram and the join: an audit isn't run twice.
    """
    keys = [by] if by else []
    audits = audits.repartition(id_col)
    counts = audits.groupBy(*keys, "score").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("score")
    ranks = counts.withColumn("_below", F.coalesce(F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    share = ranks.withColumn("corpus_percentile", F.when(F.col("_all") > 1, F.col("_below") / F.nullif(F.col("_all") - 1, F.lit(0))).otherwise(F.lit(0.0)))
    ranked = share.select(*keys, "score", "corpus_percentile")
    return audits.join(ranked if by else F.broadcast(ranked), [*keys, "score"])


def similar_top_scored(queries: DataFrame, corpus: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k nearest by cosine of corpus(vec_id, embedding) for queries(query_id, embedding).

    A query isn't its own neighbour. Queries go in blocks to all partitions of the corpus, each of
    which gives its k best; ties go by id. Vectors of length zero have no neighbours.
    """
    ids, found = queries.select("query_id").distinct(), None
    parts = max(1, -(-ids.count() // block))
    for part in range(parts):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", F.col("embedding").cast("array<double>")).toPandas()
        if not len(some):
            continue
        q = np.stack(some["embedding"].to_numpy())
        q, names = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), some["query_id"].to_numpy()

        def near(batches: Iterator[pd.DataFrame], q: np.ndarray = q, names: np.ndarray = names) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v = np.stack(pdf["embedding"].to_numpy()).astype(float)
                size = np.linalg.norm(v, axis=1)
                v, own = v[size > 0] / size[size > 0, None], pdf["vec_id"].to_numpy()[size > 0]
                if not len(own):
                    continue
                near = np.round(q @ v.T, 6)
                near[names[:, None] == own[None, :]] = -2
                # Columns go by id and the sort is stable, so ties go to smaller ids.
                order = np.argsort(own, kind="stable")
                top = order[np.argsort(-near[:, order], axis=1, kind="stable")[:, :k]]
                best = np.take_along_axis(near, top, axis=1)
                at, real = np.repeat(names, top.shape[1]), best.ravel() > -2
                yield pd.DataFrame({"query_id": at[real], "vec_id": own[top].ravel()[real], "similarity": best.ravel()[real]})

        hits = corpus.select("vec_id", F.col("embedding").cast("array<double>")).mapInPandas(near, "query_id long, vec_id long, similarity double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
