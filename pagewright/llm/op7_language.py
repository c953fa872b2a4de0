"""Language by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, hash_bound, hash_place, ship, table

#: Families of ISO 639-1 codes; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "sl", "cs", "sk", "pl"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "gu", "pa"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "uralic": ["fi", "et", "hu"],
}
DIMS = 8192
#: Texts of a language that a machine is learnt from at least, where there are as many.
LEAST_EACH = 20
_letters: np.ndarray | None = None


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)] + [True])
    return _letters


def gram_counts(text: str) -> np.ndarray:
    """Counts of a whole text's pairs and triples of lower-case letters, hashed to DIMS; what is no letter is a gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    gap = np.zeros(1, np.uint32)
    c = np.concatenate([gap, np.where(_is_letter()[np.minimum(points, 0x10000)], points, 0), gap])
    two = (c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(2246822519)) >> np.uint32(15)
    three = (two[:-1] * np.uint32(3266489917) + c[2:] * np.uint32(668265263)) >> np.uint32(13)
    return np.bincount(np.concatenate([two, three]) & np.uint32(DIMS - 1), minlength=DIMS)


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts as rows of length 1."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def linear_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int = DIMS, cost: float = 4.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent.

    A row of x has the places of its values and the values; y is 1 or -1.
    """
    n = len(x)
    w, alpha = np.zeros(dims + 1, np.float32), np.zeros(n)
    square = np.array([v @ v for _, v in x]) + 1 + 1 / (2 * cost)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, v = x[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / square[i], 0.0)
            if step := (new - alpha[i]) * y[i]:
                w[at] += np.float32(step) * v
                w[-1] += step
            alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """Margins are columns of one matrix: a machine for each family, then one for each pair of languages of a family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return ["und"] * len(counts), np.zeros(len(counts))
        margins = unit(counts) @ self.weights[:-1] + self.weights[-1]
        names = list(self.families)
        top = margins[:, : len(names)].argmax(axis=1)
        ordered = np.sort(margins[:, : len(names)], axis=1)
        sure = 1 / (1 + np.exp(-4 * (ordered[:, -1] - ordered[:, -2]))) if len(names) > 1 else np.ones(len(counts))
        out = np.empty(len(counts), object)
        score = np.empty(len(counts))
        for f, name in enumerate(names):
            rows, langs = np.flatnonzero(top == f), self.families[name]
            votes, chance = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for k, (a, b) in enumerate(self.pairs):
                if a in langs and b in langs:
                    m = margins[rows, len(names) + k]
                    p = 1 / (1 + np.exp(-4 * m))
                    i, j = langs.index(a), langs.index(b)
                    votes[:, i] += (m >= 0) + 1e-3 * p
                    votes[:, j] += (m < 0) + 1e-3 * (1 - p)
                    chance[:, i], chance[:, j] = np.minimum(chance[:, i], p), np.minimum(chance[:, j], 1 - p)
            best = votes.argmax(axis=1)
            out[rows] = [langs[i] for i in best]
            score[rows] = sure[rows] * chance[np.arange(len(rows)), best]
        return out.tolist(), score


def fit(grams: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
    """Machines for the languages that occur, from each text's places and counts. Without any, all texts are `und`."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    x, own = [(at, unit(n)) for at, n in grams], np.array(langs, object)
    kin = np.array([family_of(lang) for lang in langs], object)
    columns = [linear_svm(x, np.where(kin == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [np.ones(DIMS + 1, np.float32) for _ in families]
    pairs = [p for members in families.values() for p in combinations(members, 2)]
    for a, b in pairs:
        rows = np.flatnonzero((own == a) | (own == b))
        columns.append(linear_svm([x[i] for i in rows], np.where(own[rows] == a, 1.0, -1.0)))
    return LanguageModel(families, pairs, np.array(columns, np.float32).T if columns else np.zeros((DIMS + 1, 0), np.float32))


def learn(docs: DataFrame, most_rows: int = 3000) -> LanguageModel:
    """Fit on documents of the learning folds with a language: about most_rows / languages of each, by a hash of id and text (the documented bound).

    Of more than most_rows / LEAST_EACH languages the most frequent are learnt, of equally frequent
    ones the first by name, so dirty values don't make the sample or the machines grow. Null ids
    count as others do, rows equal in id, language and text as one; texts without a letter are left
    out. An empty table gives a model that knows no language. Other columns may have any name.
    """
    ship(docs.sparkSession)
    known = docs.filter((crc_of_id(F.col("doc_id")) % 4 != 2) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, most_rows // LEAST_EACH)).collect()}
    each = most_rows // max(1, len(counts))
    below = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, hash_bound(each, n)))) if counts else F.create_map().cast("map<string,long>")
    chosen = known.filter(hash_place("language", "doc_id", "text") < F.try_element_at(below, F.col("lang"))).select("doc_id", "lang", "text").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            if not len(pdf):
                continue
            grams = [gram_counts(t) for t in pdf["text"]]
            at = [np.flatnonzero(g) for g in grams]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "lang": pdf["lang"].to_numpy(), "at": at, "n": [g[a] for g, a in zip(grams, at, strict=True)]})

    rows = chosen.mapInPandas(read, "doc_id long, lang string, at array<int>, n array<int>").toPandas()
    rows = rows.assign(_by=[(tuple(a), tuple(n)) for a, n in zip(rows["at"], rows["n"], strict=True)]).sort_values(["doc_id", "lang", "_by"], ignore_index=True)
    return fit(list(zip(rows["at"], rows["n"], strict=True)), rows["lang"].tolist())


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep_cols: bool = False) -> DataFrame:
    """id, held_out, lang_pred, score for every row; with keep_cols the columns of `docs` and these two.

    A text that is null or has no letter is `und` with score 0, and so are all without any language learnt.
    """
    ship(docs.sparkSession)

    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            lang[part], score[part] = model.predict(np.stack([gram_counts(texts.iloc[i]) for i in part]))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return of(texts)

    # Not deterministic to the optimiser: a user's filter on the result doesn't predict a second time.
    said = docs.withColumn("_li_of", predict.asNondeterministic()(F.col(text_col)))
    if keep_cols:
        return said.select(*docs.columns, F.col("_li_of.lang_pred").alias("_li_lang"), F.col("_li_of.score").alias("_li_score"))
    return said.select(F.col(id_col), (crc_of_id(F.col(id_col)) % 4 == 2).alias("held_out"), "_li_of.lang_pred", "_li_of.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs.select("doc_id", "text"), learn(docs))
