"""Toxicity by a chain of linear classifiers over hashed words.

Each category has a logistic model over the words of a text; it also gets the
probabilities of the categories before it in the chain. Those are out-of-fold
predictions while training, so that a later model learns how far to trust them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import map_text
from .wordhash import ALNUM, binary, many, packs

#: Hashed words.
FEATURES = 1 << 18
#: Labelled rows that the chain is fitted on at most, chosen by a hash of the id.
TRAIN_ROWS = 8000
FOLDS, STEPS, L2 = 3, 120, 1e-3
#: Words that a category's model looks at: those whose presence differs most between its classes, in standard errors; the least difference.
SELECTED, CLEAR = 500, 3.5


def _sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The set of hashed words of each text."""
    for lo, hi in packs(texts):
        h, _, _, first, _ = many([(t or b"").lower() for t in texts[lo:hi]], ALNUM)
        h = (h >> np.uint64(46)).astype(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


class _Rows:
    """Sets of features as one sparse matrix of zeros and ones."""

    def __init__(self, sets: Sequence[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        self.n, self.row = len(sets), np.repeat(np.arange(len(sets)), sizes)
        self.column = np.concatenate(sets).astype(np.int64) if len(sets) else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def dense(self, columns: np.ndarray) -> np.ndarray:
        place = np.full(FEATURES, -1)
        place[columns] = np.arange(len(columns))
        at = place[self.column]
        out = np.zeros((self.n, len(columns)), np.float32)
        out[self.row[at >= 0], at[at >= 0]] = 1
        return out

    def telling(self, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """The features whose share of rows differs most between the classes."""
        some = use[self.row]
        n1, n0 = max(1, int(y[use].sum())), max(1, int(use.sum() - y[use].sum()))
        f1 = np.bincount(self.column[some], y[self.row][some], FEATURES)
        f = np.bincount(self.column[some], minlength=FEATURES)
        share = (f + 1) / (n1 + n0 + 2)
        z = np.abs(f1 / n1 - (f - f1) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        z[f < 3] = 0
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] >= CLEAR])


@dataclass
class Link:
    """One category's model: weights of words, of earlier categories' log-odds, and a constant."""

    words: np.ndarray
    earlier: np.ndarray
    constant: float
    threshold: float = 0.5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(rows: _Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int) -> Link:
    """Logistic regression with a quadratic penalty over the rows of `use`, by accelerated gradient steps.

    Both classes weigh the same.
    """
    chosen = rows.telling(y, use, SELECTED)
    x = np.concatenate([rows.dense(chosen), earlier.astype(np.float32), np.ones((rows.n, 1), np.float32)], 1)[use]
    t = y[use].astype(np.float32)
    weight = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, len(t) - t.sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):  # the largest curvature
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    step = 1 / (0.25 * norm * 1.1 + L2)
    penalty = np.full(x.shape[1], L2, np.float32)
    penalty[-1] = 0
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        grad = x.T @ ((_sigmoid(x @ ahead) - t) * weight) + penalty * ahead
        new = (ahead - step * grad).astype(np.float32)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    words = np.zeros(FEATURES)
    words[chosen] = w[: len(chosen)]
    return Link(words, w[len(chosen) : -1].astype(np.float64), float(w[-1]))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which a row is best called positive, by F1."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # equal probabilities fall on one side
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


@dataclass
class Chain:
    categories: list[str]
    links: list[Link] = field(default_factory=list)

    def predict(self, rows: _Rows) -> np.ndarray:
        """Probabilities, rows x categories."""
        out = np.zeros((rows.n, len(self.links)))
        for k, link in enumerate(self.links):
            out[:, k] = _sigmoid(rows.dot(link.words) + _odds(out[:, :k]) @ link.earlier + link.constant)
        return out


def fit_chain(sets: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str], folds: int = FOLDS, steps: int = STEPS) -> Chain:
    """labels: rows x categories, nan where unknown. A category without both values, as without rows, gets a constant model."""
    rows, chain = _Rows(sets), Chain(list(categories))
    fold = np.arange(rows.n) % folds
    earlier = np.zeros((rows.n, 0))
    for k in range(len(categories)):
        y, known = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])
        if len(np.unique(y[known])) < 2:
            p = float(y[known].mean()) if known.any() else 0.0
            chain.links.append(Link(np.zeros(FEATURES), np.zeros(k), float(_odds(np.array(p)))))
            out = np.full(rows.n, p)
        else:
            out = np.zeros(rows.n)
            for f in range(folds):
                part = _fit(rows, earlier, y, known & (fold != f), steps)
                p = _sigmoid(rows.dot(part.words) + earlier @ part.earlier + part.constant)
                out[fold == f] = p[fold == f]
            link = _fit(rows, earlier, y, known, steps)
            link.threshold = _threshold(out[known], y[known])
            chain.links.append(link)
        earlier = np.concatenate([earlier, _odds(out)[:, None]], 1)
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAIN_ROWS, text: str = "text", by: str = "doc_id") -> Chain:
    """A chain over `categories` (name -> 0/1 expression over `labels`), in their order.

    Fitted on `rows` labelled documents at most, the first in the order of a hash of `by`. Null labels
    leave a row out of that category alone; labels without a document, and null texts, out of all. Of
    documents of one id the least text counts, once for each row of labels. Without labels, or without
    documents that have one, every category gets a constant model of probability near 0.
    """
    ship(docs.sparkSession)
    picked = labels.select(F.col(by).alias("__id"), *[c.cast("double").alias(k) for k, c in categories.items()]).where("__id is not null")
    picked = picked.orderBy(F.xxhash64("__id"), "__id", *categories).limit(rows)
    texts = docs.select(F.col(by).alias("__id"), F.col(text).cast("string").alias("__text")).where("__text is not null")
    texts = texts.join(F.broadcast(picked.select("__id").distinct()), "__id", "left_semi").groupBy("__id").agg(F.min("__text").alias("__text"))
    joined = texts.join(F.broadcast(picked), "__id")
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array(list(_sets(binary(batch.column("__text")))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), sets, *[batch.column(n) for n in names]], names=["__id", "words", *names])

    kind = joined.schema["__id"].dataType.simpleString()
    found = joined.mapInArrow(run, f"__id {kind}, words array<int>, " + ", ".join(f"{n} double" for n in names)).toArrow().sort_by("__id")
    sets = [np.asarray(s, np.int64) for s in found["words"].to_pylist()]
    known = np.array([[np.nan if v is None else v for v in found[n].to_pylist()] for n in names]).T.reshape(len(sets), len(names))
    return fit_chain(sets, known, names)


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, and for each category its probability p_<name> double and verdict is_<name> boolean.

    Whole texts are read. A null or empty text gets probability 0 and false in every category.
    The chain is of fixed size; no shuffle.
    """
    names = chain.categories
    light = [Link(k.words.astype(np.float32), k.earlier, k.constant, k.threshold) for k in chain.links]

    def factory():
        own = Chain(names, light)

        def kernel(texts):
            sets = list(_sets(texts))
            p = own.predict(_Rows(sets))
            p[[not len(s) for s in sets]] = 0
            out = []
            for k, link in enumerate(own.links):
                out += [pa.array(p[:, k], pa.float64()), pa.array((p[:, k] >= link.threshold) & (p[:, k] > 0), pa.bool_())]
            return out

        return kernel

    return map_text(docs, ", ".join(f"p_{n} double, is_{n} boolean" for n in names), factory, text, keep)
