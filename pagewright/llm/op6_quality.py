"""Quality by a generalised additive model with pairwise interactions, learnt as lookup tables."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, hash_bound, hash_place, ship, table

FEATURES = ["log_chars", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "marks", "symbols", "distinct_words", "top_word", "short_words", "line_words", "repeated_lines", "word_ends"]
_CLASSES = "LUNZPS"
_class_of: np.ndarray | None = None


def _classes() -> np.ndarray:
    """For each code point of the basic plane: lower letter 0, upper 1, digit 2, space 3, punctuation 4, symbol 5, other 6."""
    global _class_of
    if _class_of is None:
        kind = [unicodedata.category(chr(c)) for c in range(0x10000)]
        _class_of = np.array([1 if k in ("Lu", "Lt") else 0 if k[0] in "LM" else 2 if k[0] == "N" else 3 if k[0] == "Z" or chr(c).isspace() else 4 if k[0] == "P" else 5 if k[0] == "S" else 6 for c, k in enumerate(kind)], np.uint8)
    return _class_of


def text_features(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(points)
    lower, upper, digit, space, mark, symbol, _ = np.bincount(_classes()[np.minimum(points, 0xFFFF)], minlength=7)[:7] / n
    words = text.split()
    lines = text.split("\n")
    if not words:
        return [np.log1p(n), 0.0, 0.0, 0.0, lower, upper, digit, space, mark, symbol, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    count = Counter(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = sum(1 for w in words if not w[-1].isalnum())
    return [np.log1p(n), np.log1p(len(words)), length.mean(), length.max(), lower + upper, upper / max(lower + upper, 1e-9), digit, space, mark, symbol, len(count) / len(words), max(count.values()) / len(words), (length <= 3).mean(), len(words) / len(lines), 1 - len(set(lines)) / len(lines), ends / len(words)]


@dataclass
class AdditiveModel:
    """score = sigmoid(base + sum of each feature's table at its bin + sum of each pair's table at its two bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edge, x[:, j], "right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """A regression tree over ordered bins with a few leaves: each bin's Newton step."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        found = [(gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)]
        if not found or max(found)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, max(found)[1]])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four: its gain and each cell's Newton step."""
    g, h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (gradient, hessian))
    best, where = -1.0, (0, 0)
    n, m = gradient.shape
    block = lambda t, a, b, c, d: t[b, d] - t[a, d] - t[b, c] + t[a, c]
    for i in range(1, n):
        for j in range(1, m):
            total = sum(block(g, a, b, c, d) ** 2 / (block(h, a, b, c, d) + ridge) for a, b in ((0, i), (i, n)) for c, d in ((0, j), (j, m)))
            if total > best:
                best, where = total, (i, j)
    step = np.zeros((n, m))
    if best >= 0:
        i, j = where
        for a, b in ((0, i), (i, n)):
            for c, d in ((0, j), (j, m)):
                step[a:b, c:d] = block(g, a, b, c, d) / (block(h, a, b, c, d) + ridge)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, coarse: int = 8, pairs: int = 6, leaves: int = 3) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a shallow tree over its bins, then the strongest pairs do.

    Without rows of both labels the model gives the share of label 1 (0.5 without rows) for all.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(y) else np.array([]) for j in range(x.shape[1])]
    edges, rough = quantiles(bins), quantiles(coarse)
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], rough, [], [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    margin = np.full(len(y), model.base)
    chance = lambda: 1 / (1 + np.exp(-margin))
    for _ in range(rounds):
        for j in range(x.shape[1]):
            p = chance()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n), leaves)
            model.tables[j] += step
            margin += step[at[j]]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(rough)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        n, m = len(rough[i]) + 1, len(rough[j]) + 1
        return np.bincount(cell[i] * m + cell[j], values, n * m).reshape(n, m)

    p = chance()
    gains = {(i, j): _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pair_tables = [np.zeros((len(rough[i]) + 1, len(rough[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 5):
        for k, (i, j) in enumerate(model.pairs):
            p = chance()
            step = rate * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            model.pair_tables[k] += step
            margin += step[cell[i], cell[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> AdditiveModel:
    """Fit on labelled documents of the learning folds: about `most_rows`, chosen by a hash of id and text (the documented bound).

    Null ids and labels are left out. A repeated id is learnt once for each of its different texts and
    labels, and all of them count for the bound; rows of equal values tie, as one. A text's null
    counts as empty. Without labels the model scores 0.5. Only doc_id, text and quality
    are read, so other columns may have any name.
    """
    ship(docs.sparkSession)
    known = labels.filter((crc_of_id(F.col("doc_id")) % 5 != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y")).distinct()
    below = hash_bound(most_rows, docs.select("doc_id").join(known, "doc_id").count())
    chosen = docs.filter(hash_place("quality", "doc_id", "text") < below).select("doc_id", "text").join(known, "doc_id").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [text_features(t) for t in pdf["text"]]})

    rows = chosen.mapInPandas(read, "doc_id long, y double, x array<double>").toPandas()
    rows = rows.assign(_by=[tuple(v) for v in rows["x"]]).sort_values(["doc_id", "y", "_by"], ignore_index=True)
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row; a null text is scored as an empty one.

    Equal texts have equal scores. Rows with null or repeated ids each have their own; columns of
    `docs` of other names are ignored.
    """
    ship(docs.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([text_features(t) for t in pdf["text"]], float).reshape(len(pdf), len(FEATURES))
            yield pdf[["id", "held_out"]].assign(score=model.score(x))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (crc_of_id(F.col(id_col)) % 5 == 0).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(read, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of all documents, learnt from four of five label folds."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
