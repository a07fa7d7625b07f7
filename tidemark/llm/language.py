"""Language identification by nearest centroids of TF-IDF character n-grams.

A text becomes a vector of hashed n-grams of 1 to 4 characters over its lower-cased letters (all else counts as one
space), weighted by (1 + log count) * idf and normalised. Each language has several centroids, found by spherical
k-means over a bounded sample of its texts; a text gets the language of the centroid with the largest cosine.
The distance to it rejects a text: ``rejected`` where the cosine is under what nearly all training texts of that
language reach.

Defined results: a null text, an empty one, or one without a letter is "und" with score 0 and is rejected; ties go to
the language first by name; without training rows everything is "und".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import over_texts, stored

DIMS = 8192
ORDERS = (1, 2, 3, 4)
NON_LETTERS = re.compile(r"[\W\d_]+")
#: Vectors are made of so many characters at once; longer texts are summed over pieces.
PIECE = 500_000


def letters(text: str | None) -> str:
    return NON_LETTERS.sub(" ", (text or "").lower()).strip()


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIMS) and whether a text has a letter."""
    clean = [letters(t) for t in texts]
    out = np.zeros((len(texts), DIMS), np.float32)
    flat = out.reshape(-1)
    first, size = 0, 0
    for i in range(len(clean) + 1):
        if i == len(clean) or size + len(clean[i]) > PIECE:
            _add(clean[first:i], flat, first)
            first, size = i, 0
        if i < len(clean):
            size += len(clean[i])
    return out, np.array([bool(c) for c in clean])


def _add(clean: list[str], flat: np.ndarray, first: int) -> None:
    for start in range(0, len(clean), 64):
        group = clean[start : start + 64]
        padded = [f" {c} " for c in group]
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = [len(p) for p in padded]
        row, ends = np.repeat(np.arange(len(group)), sizes), np.cumsum(sizes)
        h, size = np.zeros(len(codes), np.uint64), len(group) * DIMS
        total = np.zeros(size, np.int64)
        for n in ORDERS:
            h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            slot = ((h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 13)).astype(np.int64)
            slot += row[: len(slot)] * DIMS
            for k in range(1, n):  # an n-gram that would reach over the end of its text is none
                over = ends - k
                slot[over[(over >= 0) & (over < len(slot))]] = size
            total += np.bincount(slot, minlength=size + 1)[:size]
        flat[(first + start) * DIMS : (first + start) * DIMS + size] += total


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    np.log1p(count, out=count)
    count *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", count, count))
    count /= np.where(norm > 0, norm, 1)[:, None]
    return count


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest text, each further one the text farthest from those chosen."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for j in range(len(centre)):
            if (own == j).any():
                mean = x[own == j].sum(0)
                centre[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centre


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # row by row: unit vectors
    owner: np.ndarray  # of each row: number of the language
    limits: np.ndarray  # of each language: the cosine below which a text is rejected

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        count, some = counts(texts)
        if not self.languages or not len(texts):
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
        cosine = weighted(count, self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)
        k = best.argmax(1)
        top = np.where(some, np.clip(best.max(1), 0, 1), 0)
        return pd.DataFrame({"lang_pred": np.where(some, np.array(self.languages, object)[k], "und"), "score": top.astype(float), "rejected": ~some | (top < self.limits[k])})


def train(docs: DataFrame, per_language: int = 400, centroids: int = 4, reject_quantile: float = 0.002) -> Model:
    """Fit on ``docs`` (text, lang; other columns are ignored): ``per_language`` texts of each language, by lowest text hash, at most.

    A language's distinct texts are counted over all rows; a hash threshold that follows from the count picks some more texts
    than are needed (all of them, where they are few), evenly over the whole table, so no language meets in one task; the exact cut
    is made in the small group. Copies change nothing.
    """
    spark = docs.sparkSession
    rows = docs.select("text", "lang").where("lang is not null and text is not null")
    sizes = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 50) / F.col("count"))
    order = (F.xxhash64("text") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    sample = stored(rows.join(F.broadcast(sizes), "lang").withColumn("order", order).where(F.col("order") < share).select("lang", "text", "order").distinct())

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS), 0
        for part in batches:
            for k in range(0, len(part), 256):
                count, _ = counts(part.text[k : k + 256].tolist())
                df += (count > 0).sum(0)
                n += len(count)
        yield pd.DataFrame({"n": [n], "df": [df.tolist()]})

    parts = sample.select("text").mapInPandas(frequency, "n long, df array<double>").collect()
    n, df = sum(p.n for p in parts), np.sum([p.df for p in parts] or [np.zeros(DIMS)], 0)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    shared = spark.sparkContext.broadcast(idf)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "text"]).head(per_language)
        part = part[[bool(letters(t)) for t in part.text]]
        if not len(part):
            return pd.DataFrame({"lang": [], "limit": [], "centre": []})
        x = weighted(counts(part.text.tolist())[0], shared.value)
        found = clusters(x, centroids)
        limit = float(np.quantile((x @ found.T).max(1), reject_quantile)) * 0.9
        return pd.DataFrame({"lang": part.lang.iloc[0], "limit": limit, "centre": [c.tolist() for c in found]})

    found = sorted(sample.groupBy("lang").applyInPandas(fit, "lang string, limit double, centre array<float>").collect(), key=lambda r: (r.lang, r.centre))
    names = sorted({r.lang for r in found})
    limits = np.array([next(r.limit for r in found if r.lang == name) for name in names])
    return Model(names, idf, np.array([r.centre for r in found], np.float32).reshape(-1, DIMS), np.array([names.index(r.lang) for r in found]), limits)


def language(column: Column, model: Model, spark) -> Column:
    """A struct (lang_pred, score, rejected) for each text."""
    shared = spark.sparkContext.broadcast(model)
    return over_texts(column, lambda: shared.value.predict, "lang_pred string, score double, rejected boolean")
