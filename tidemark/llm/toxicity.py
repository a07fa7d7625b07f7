"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon (learned from the training rows, by document frequency of words
and of word beginnings, beside a short list of common insults), nearness of its hits to second-person
pronouns, and rates of capitals, punctuation, digits, repeated letters and obfuscated words. Trees are
fitted to the logistic loss on histograms of the features; scores are calibrated by pool-adjacent-violators
on out-of-fold predictions, for which each fold has a lexicon and trees that are learned without it.

Defined results: a null text counts as empty; an empty text gets the score of its (all zero) features;
without labelled rows every score is 0, with rows of one label only it is that label. Rows that repeat an id
are scored each by itself. Only labelled ids are joined, so documents without a label never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import over_texts, stored, tidied

#: Insults and second-person pronouns of the languages in use, as plain text.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool bastard asshole bitch shit fuck imbecile retard".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros su".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("01345789@$!|€", "oieastbgasiie")
MARKS = re.compile(r"[^\w]|_")
REPEAT = re.compile(r"(.)\1{2,}")
FEATURES = ("hit_rate", "hit_weight", "hit_max", "hit_any", "insult_rate", "obfuscated_hit", "near_you", "you_rate", "capitals", "capital_words", "punctuation", "exclaim", "digits", "obfuscated", "repeats", "log_words", "word_length")
BEGINNINGS = (4, 5, 6)


def plain(word: str) -> str:
    """A word without marks inside, with letters for the characters that stand for them and no letter more than twice in a row."""
    return REPEAT.sub(r"\1", MARKS.sub("", word.lower().translate(LEET)))


class Words:
    """What a word contributes to the features: a row of numbers, remembered for the words seen most recently."""

    LIMIT = 100_000
    COLUMNS = 12  # weight, insult, obfuscated hit, second person, capital word, obfuscated, repeats; upper-case letters, marks, exclamation marks, digits, length

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.known, self.rows = lexicon, {}, np.zeros((1024, self.COLUMNS))

    def weight(self, word: str) -> float:
        get, best = self.lexicon.get, self.lexicon.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) < n:
                break
            best = max(best, get(word[:n] + "*", 0.0))
        return max(best, 0.0)

    def look(self, raw: str) -> tuple:
        low = raw.lower()
        upper = 0 if raw == low else sum(map(str.isupper, raw))
        capital = len(raw) > 2 and upper > 0 and raw.isupper()
        bare = low.strip("\"'.,;:!?()[]{}<>-…*#%&$|")
        repeats = REPEAT.search(bare) is not None
        weight = self.weight(bare)
        if bare.isalpha() and not repeats:  # nothing in it stands for something else
            said = (weight, bare in INSULT_SET, False, bare in SECOND_PERSON, capital, False, False)
        else:
            clear = plain(bare)
            hidden = 0.0 if weight or clear == bare else self.weight(clear)
            odd = bare.isalpha() is False and any(map(str.isalpha, bare)) and len(bare) > 2 and (bool(re.search(r"\w[^\w\s'’-]+\w", bare)) or bool(re.search(r"[^\W\d_]\d+[^\W\d_]", bare)))
            said = (max(weight, hidden), bare in INSULT_SET or clear in INSULT_SET, hidden > 0 or (clear != bare and clear in INSULT_SET), bare in SECOND_PERSON, capital, odd, repeats)
        if raw.isalpha():
            return *said, upper, 0, 0, 0, len(raw)
        return *said, upper, len(MARKS.findall(raw)), raw.count("!"), sum(map(raw.count, "0123456789")), len(raw)

    def seen(self, tokens: list[str]) -> np.ndarray:
        """A row for each token."""
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        new = list(set(tokens).difference(self.known))
        if new:
            first = len(self.known)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = [self.look(t) for t in new]
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))]

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        m = self.seen(tokens)
        weight, insults, hidden, you, capital, odd, repeats, upper, marks, exclaim, digits, letters = m.sum(0).tolist()
        at = np.flatnonzero((m[:, 0] != 0) | (m[:, 1] != 0))
        before = np.concatenate([[0.0], np.cumsum(m[:, 3])])
        near = float((before[np.minimum(n, at + 6)] > before[np.maximum(0, at - 5)]).sum())
        return [len(at) / n, weight / n, float(m[:, 0].max()), float(min(len(at), 5)), insults / n, hidden / n, near / n, you / n, upper / letters, capital / n, marks / letters, exclaim / n, digits / letters, odd / n, repeats / n, float(np.log1p(n)), letters / n]


INSULT_SET = frozenset(INSULTS)


@dataclass
class Trees:
    """Boosted trees of equal depth: for each tree its features and limits by node, and its leaves' values."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 2.0, least: int = 10) -> Trees:
    """Trees by Newton steps on the logistic loss; candidate limits are quantiles of the training values."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    margin = np.full(len(y), np.log(mean / (1 - mean)))
    base, width = float(margin[0]) if len(y) else 0.0, bins + 1
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * width + binned[:, j]
                g, h, c = (np.bincount(key, w, count * width).reshape(count, width).cumsum(1) for w in (grad, hess, np.ones_like(grad)))
                gl, hl, cl = g[:, : len(e)], h[:, : len(e)], c[:, : len(e)]
                gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g[:, -1:] ** 2 / (h[:, -1:] + penalty)
                gain[(cl < least) | (cr < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for q in np.flatnonzero(top > best):
                    best[q], feature[first + q], limit[first + q] = top[q], j, e[k[q]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + penalty)
        margin += value[leaf]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, first score, last score
    for s, label in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([v for b in blocks for v in ((b[0] + 0.02) / (b[1] + 0.04),) * 2])
    return x, np.maximum.accumulate(p)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    constant: float

    def scorer(self):
        look = Words(self.lexicon)

        def score(texts: list[str | None]) -> pd.DataFrame:
            if self.trees is None:
                return pd.DataFrame({"score": np.full(len(texts), self.constant)})
            x = np.array([look.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            return pd.DataFrame({"score": np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)})

        return score


def learned_lexicons(train: DataFrame, folds: int, least: int = 6, ratio: float = 8.0) -> list[dict[str, float]]:
    """Words and beginnings of words ("abcd*") that ``ratio`` times as many toxic as other documents contain, with their log ratio: learned from all rows, and without each fold.

    ``train``: text, label, fold. One aggregation with map-side sums; all terms that qualify come back, which the bound on labelled rows bounds.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    once = train.where("text is not null").select("label", "fold", word.alias("word"))
    forms = F.array(F.col("word"), *(F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS))
    # a document that holds a beginning in several words counts once for each: the ratio is one of word types
    terms = once.select("label", "fold", F.explode(forms).alias("term")).where("term is not null")
    use = [F.lit(True), *(F.col("fold") != k for k in range(folds))]
    sums = [x for k, u in enumerate(use) for x in (F.sum(F.when(u, F.col("label")).otherwise(0)).alias(f"toxic{k}"), F.sum(u.cast("int")).alias(f"n{k}"))]
    totals = train.agg(*sums).first()
    counts = stored(terms.groupBy("term").agg(*sums).where(F.col("toxic0") >= least))
    out = []
    for k in range(folds + 1):
        toxic, clean = float(totals[f"toxic{k}"] or 0), float((totals[f"n{k}"] or 0) - (totals[f"toxic{k}"] or 0))
        if not toxic or not clean:
            out.append({})
            continue
        rate = ((F.col(f"toxic{k}") + 0.5) / toxic) / ((F.col(f"n{k}") - F.col(f"toxic{k}") + 0.5) / clean)
        rows = counts.where(F.col(f"toxic{k}") >= least).withColumn("ratio", rate).where(F.col("ratio") >= ratio).select("term", F.log("ratio")).collect()
        out.append({t: float(w) for t, w in rows})
    return out


def train(labelled: DataFrame, folds: int = 5) -> Model:
    """Fit on ``labelled`` (text, label 0 or 1, order: a hash that deals rows to folds)."""
    spark = labelled.sparkSession
    labelled = labelled.withColumn("fold", F.pmod("order", F.lit(folds)).cast("int"))
    lexicons = learned_lexicons(labelled, folds)
    shared = spark.sparkContext.broadcast(lexicons)

    @tidied
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = [Words(x) for x in shared.value]
        for part in batches:
            yield pd.DataFrame({"label": part.label, "order": part.order, "fold": part.fold, "x": [[v for look in looks for v in look.features(t)] for t in part.text]})

    rows = labelled.mapInPandas(featured, "label int, order long, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r.order, r.label, r.x))
    lexicon, none = lexicons[0], (np.zeros(1), np.zeros(1))
    if not rows:
        return Model(lexicon, None, none, 0.0)
    x, y = np.array([r.x for r in rows]).reshape(len(rows), folds + 1, -1), np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None, none, float(y[0]))
    part, out = np.array([r.fold for r in rows]), np.zeros(len(y))
    for k in range(folds):
        own = part == k
        if own.any() and (~own).any():
            out[own] = boost(x[~own, k + 1], y[~own]).raw(x[own, k + 1])
    return Model(lexicon, boost(x[:, 0], y), isotonic(out, y), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column | None = None, max_train_rows: int = 8000) -> DataFrame:
    """Texts of at most ``max_train_rows`` labelled ids, lowest hash first: text, label, order. Only ids are sorted, and the small sample is what is broadcast."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    if held_out is not None:
        ids = ids.where(~held_out)
    ids = ids.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_train_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return stored(chosen.groupBy("label", "order").agg(F.min("text").alias("text")))


def toxicity(column: Column, model: Model, spark) -> Column:
    """A struct (score) for each text."""
    shared = spark.sparkContext.broadcast(model)
    return over_texts(column, lambda: shared.value.scorer(), "score double")
