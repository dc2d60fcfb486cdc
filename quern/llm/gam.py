"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round each feature's bins get a shallow tree (two cuts) fitted to
the gradient of the log loss, added to the feature's lookup table at a small rate; then the
pairs whose crossed cut explains most of what is left get tables of their own. A document's
score is a sum of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import prepare, quoted
from quern.llm.features import FEATURES, labelled_sample, text_features

#: The model is fitted on at most so many labelled documents.
TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.15
KEEP_AT = 0.5
_RIDGE = 1.0


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(self.edges, columns)]

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        b = self.bins(columns)
        out = np.full(len(columns[0]), self.intercept)
        for at, table in zip(b, self.tables):
            out += table[at]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[b[i], b[j]]
        return out


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + _RIDGE)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values for the bins by a tree of two cuts on gradient and hessian sums of the bins."""
    edges = [0, len(g)]
    for _ in range(2):
        best, at = 1e-9, None
        for lo, hi in zip(edges, edges[1:]):
            cg, ch = g[lo:hi].cumsum(), h[lo:hi].cumsum()
            if hi - lo < 2:
                continue
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = float(gain[k]), lo + k + 1
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best crossed cut of a grid of sums: its gain and the grid of its four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, right, down, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, right - a, down - a, all_ - right - down + a]

    qg, qh = quarters(cg), quarters(ch)
    if not qg[0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(_gain(a, b) for a, b in zip(qg, qh)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    leaves = [_leaf(a[i, j], b[i, j]) for a, b in zip(qg, qh)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return float(gain[i, j]), out


def fit(columns: list[np.ndarray], y: np.ndarray) -> Model:
    """The model for y in {0, 1}; with one class only, or no rows, a constant one."""
    y = y.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(y) else np.empty(0) for c in columns]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = model.bins(columns)
    score = np.full(len(y), model.intercept)

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for at, table in zip(bins, model.tables):
            g, h = grads()
            step = RATE * _tree(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)))
            table += step
            score += step[at]
    g, h = grads()
    ranked = []
    for i, j in combinations(range(len(columns)), 2):
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat = bins[i] * shape[1] + bins[j]
        gain, _ = _cross(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))
        ranked.append((-gain, i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(ranked)[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    flats = [bins[i] * len(model.tables[j]) + bins[j] for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for flat, table in zip(flats, model.pair_tables):
            g, h = grads()
            step = RATE * _cross(np.bincount(flat, g, table.size).reshape(table.shape), np.bincount(flat, h, table.size).reshape(table.shape))[1]
            table += step
            score += step.reshape(-1)[flat]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS, label: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model of label 1, from at most `most` labelled documents."""
    rows = labelled_sample(docs, labels, label, most, text_col, id_col).orderBy("doc", *FEATURES).toPandas()
    return fit([rows[f].to_numpy(dtype=float) for f in FEATURES], rows["label"].to_numpy())


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", id_col: str = "doc_id", keep_at: float = KEEP_AT) -> DataFrame:
    """Rows (doc_id, quality, keep), one for each row of docs: the probability of label 1, and
    whether it is keep_at or more.

    A null or empty text has all statistics 0 and is scored by them; null ids and repeated rows
    each give their row; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(1 / (1 + np.exp(-model.score([c.to_numpy(dtype=float) for c in columns]))))

    stats = text_features(docs, [quoted(id_col).alias("doc_id")], text_col)
    return stats.select("doc_id", scored(*FEATURES).alias("quality")).select("doc_id", "quality", (F.col("quality") >= keep_at).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labels and score every document; see score_documents."""
    prepare(docs.sparkSession)
    return score_documents(docs, fit_quality(docs, labels, most=most))
