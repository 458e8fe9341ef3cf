"""Toxicity: a classifier chain of linear models over hashed words.

Categories are predicted in order; each later model also gets the probabilities of the earlier ones. For training,
those are out-of-fold predictions, so a later model learns from what an earlier one says of texts it hasn't seen.
Each link is an L2-regularised logistic regression over the presence of its most telling hashed features (words and
word beginnings of four and five characters), chosen by chi-square on the same training rows.

Fitting takes at most ``MAX_ROWS`` labelled documents, the first by a hash of doc_id among those that are there (a
bounded, documented sample); of rows that share an id the one with the smallest hash of its text trains. Scoring
runs over every document in Arrow batches with the fitted weights, whose size is fixed.

Cases: null and empty texts have no features and get the models' base rates; repeated rows get equal scores; labels
of unknown documents are ignored, null labels too; a category with one class only predicts that class's rate;
without labels every probability is 0; null ids are scored but don't train; other columns stay or are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import boxed

WIDTH, KEPT, FOLDS, MAX_ROWS = 1 << 18, 384, 4, 8_000
_CLEAR = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of a whole text."""
    if not text:
        return np.zeros(0, np.int32)
    found = set(text.lower().encode().translate(_CLEAR).split())
    starts = {w[:5] for w in found} | {b"4" + w[:4] for w in found}
    out = {zlib.crc32(w) & (WIDTH - 1) for w in found} | {zlib.crc32(w, 1) & (WIDTH - 1) for w in starts}
    return np.fromiter(sorted(out), np.int32, len(out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Link:
    """One logistic regression on chosen features and earlier probabilities."""

    def __init__(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3):
        n, pos = len(y), int(y.sum())
        self.rate = (pos + 0.5) / (n + 1) if n else 0.0
        self.at = np.zeros(0, np.int64)
        self.w = np.zeros(earlier.shape[1])
        self.b = np.log(self.rate / (1 - self.rate)) if n else -30.0
        if not n or pos in (0, n):
            return
        seen = [np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c]), minlength=WIDTH).astype(float) for c in (0, 1)]
        total = seen[0] + seen[1]
        expected = total * pos / n
        chi = np.where(total >= 3, (seen[1] - expected) ** 2 / np.maximum(expected * (1 - total / n) * (1 - pos / n), 1e-9), 0)
        self.at = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
        x = np.hstack([_matrix(rows, self.at), earlier]).astype(np.float32)
        weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos))).astype(np.float32) / n
        w, b = np.zeros(x.shape[1]), 0.0
        move, size = np.zeros_like(w), 4.0 / (x.astype(float) ** 2).sum(1).mean().clip(1)
        for step in range(steps):  # accelerated gradient
            ahead = w + move * step / (step + 3)
            g = weight * (_sigmoid(x @ ahead.astype(np.float32) + b) - y)
            new = ahead - size * (x.T @ g + ridge * ahead)
            move, w, b = new - w, new, b - float(g.sum())
        self.w, self.b = w, b

    def predict(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        k = len(self.at)
        if not k and not len(self.w):
            return np.full(len(rows), float(self.rate))
        return _sigmoid(_matrix(rows, self.at) @ self.w[:k] + earlier @ self.w[k:] + self.b)

    def __call__(self, row: np.ndarray, earlier) -> float:
        return float(self.predict([row], np.asarray(earlier, float).reshape(1, -1))[0])


def _matrix(rows: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Presence of the features ``at`` in each row."""
    column = np.full(WIDTH, -1, np.int32)
    column[at] = np.arange(len(at))
    found = column[np.concatenate(rows)] if rows else np.zeros(0, np.int32)
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = np.zeros((len(rows), len(at)))
    x[own[found >= 0], found[found >= 0]] = 1
    return x


class Chain:
    """Links of a chain, fitted in order."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray):
        earlier, self.links, self.cuts = np.zeros((len(rows), 0)), [], []
        for c in range(labels.shape[1]):
            y, out = labels[:, c], np.zeros(len(rows))
            for f in range(FOLDS):
                train, test = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                link = Link([rows[i] for i in train], earlier[train], y[train])
                out[test] = link.predict([rows[i] for i in test], earlier[test])
            self.links.append(Link(rows, earlier, y))
            self.cuts.append(best_cut(out, y))
            earlier = np.hstack([earlier, out[:, None]])
        self.out_of_fold = earlier

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """A column of probabilities for each link, in order."""
        out = np.zeros((len(rows), 0))
        for link in self.links:
            out = np.hstack([out, link.predict(rows, out)[:, None]])
        return out

    def __call__(self, row: np.ndarray) -> list[float]:
        return self.predict([row])[0].tolist()


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold predictions, in the middle of the gap it falls in."""
    if not len(y) or not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    best = int(np.argmax(f1))
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float((p[order[best]] + below) / 2)


def fit(documents: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> Chain:
    """Fit on labelled documents: ``labels`` has doc_id and a 0/1 column for each category."""
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    known = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumnRenamed("doc_id", "__doc").orderBy(F.xxhash64("__doc"), "__doc").limit(max_rows)
    joined = documents.select("doc_id", "text", F.xxhash64("text").alias("row")).join(F.broadcast(known), F.col("doc_id") == F.col("__doc"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "row": part["row"], "found": [features(t).tobytes() for t in part["text"]], **{f"y{i}": part[c] for i, c in enumerate(categories)}})

    ys = [f"y{i}" for i in range(len(categories))]
    got = joined.select("doc_id", "row", "text", *categories).mapInPandas(run, "doc_id long, row long, found binary, " + ", ".join(f"{y} int" for y in ys))
    got = got.groupBy("doc_id").agg(F.min_by(F.struct("found", *ys), "row").alias("r")).select("doc_id", "r.*")
    frame = got.toPandas().sort_values("doc_id")  # at most max_rows feature lists
    rows = [np.frombuffer(x, np.int32) for x in frame["found"]]
    y = frame[[f"y{i}" for i in range(len(categories))]].to_numpy(np.int64).reshape(len(rows), len(categories))
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in frame["doc_id"]], np.int64)
    return Chain(rows, y, folds)


def with_scores(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``documents`` and __p, the chain's probabilities in order."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for at in range(0, len(part), 256):
                out += chain.predict([features(t) for t in part.iloc[at : at + 256]]).tolist()
            yield pd.Series(out)

    return documents.withColumn("__p", F.pandas_udf(run, "array<double>")(text))


def score(documents: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """(doc_id, p_<category>..., <last category>): probabilities and the last category's verdict."""
    chain = fit(documents, labels, categories)
    out = with_scores(documents.select("doc_id", "text"), chain)
    p = [F.col("__p")[i] for i in range(len(categories))]
    return out.select("doc_id", *[F.round(x, 6).alias(f"p_{c}") for x, c in zip(p, categories, strict=True)], (p[-1] >= chain.cuts[-1]).cast("int").alias(categories[-1]))


def reject(documents: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """``documents`` without those whose last category's probability reaches its threshold; all columns stay."""
    chain = fit(documents, labels, categories)
    scored = with_scores(boxed(documents), chain, "__doc.text")
    return scored.where(F.col("__p")[len(categories) - 1] < chain.cuts[-1]).select("__doc.*")
