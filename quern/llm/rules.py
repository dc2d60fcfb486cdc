"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on text statistics. It is grown on two thirds of the
labelled documents still uncovered, condition by condition by FOIL gain, pruned on the other
third from its end, and kept while its precision there holds. The list becomes one ordered
Spark CASE expression; no Python runs over the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import prepare, quoted
from quern.llm.features import FEATURES, labelled_sample, text_features

#: The list is fitted on at most so many labelled documents.
TRAIN_ROWS = 20_000
MIN_PRECISION = 0.97
MIN_COVER = 3
MAX_CONDITIONS = 4
MAX_RULES = 24
CUTS = 64


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if p0 == 0 or n0 == 0:
            break
        base = math.log2(p0 / (p0 + n0))
        best: tuple[float, Condition] | None = None
        for f in FEATURES:
            v = x[f][inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower"))
            bins = np.searchsorted(cuts, v, side="left")
            pos = np.bincount(bins, weights=y[inside], minlength=len(cuts) + 1).cumsum()
            all_ = np.bincount(bins, minlength=len(cuts) + 1).cumsum()
            for above in (False, True):
                p = (p0 - pos if above else pos)[: len(cuts)]
                t = (p0 + n0 - all_ if above else all_)[: len(cuts)]
                ok = (p > 0) & (t >= MIN_COVER)
                gain = np.where(ok, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(t, 1)) - base), -np.inf)
                if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > (best[0] if best else 1e-9):
                    best = (float(gain[k]), Condition(f, above, float(cuts[k])))
        if best is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    c = covers(rule, x, len(y))
    p, n = int(y[c].sum()), int((~y[c]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Ordered rules that hold for documents to reject (y true). None if y has one class only."""
    rules: list[Rule] = []
    left = np.ones(len(y), dtype=bool)
    order = np.random.default_rng(seed)
    misses = 0
    while len(rules) < MAX_RULES and misses < 3 and y[left].sum() >= MIN_COVER and (~y).any():
        at = order.permutation(np.flatnonzero(left))
        cut = max(1, 2 * len(at) // 3)
        grow, prune = at[:cut], at[cut:]
        part = lambda i: ({f: x[f][i] for f in FEATURES}, y[i])
        rule = _grow(*part(grow))
        px, py = part(prune)
        while len(rule) > 1 and _worth(rule[:-1], px, py) >= _worth(rule, px, py):
            rule = rule[:-1]
        hit = covers(rule, x, len(y)) & left
        on_prune = covers(rule, px, len(py))
        good = bool(rule) and hit.sum() >= MIN_COVER and y[hit].mean() >= MIN_PRECISION and (not on_prune.any() or py[on_prune].mean() >= MIN_PRECISION)
        if not good:
            misses += 1
            continue
        misses = 0
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS, label: str = "quality", text_col: str = "text", id_col: str = "doc_id") -> list[Rule]:
    """Rules that find documents of label 0, learned from at most `most` labelled ones."""
    rows = labelled_sample(docs, labels, label, most, text_col, id_col).orderBy("doc", *FEATURES).toPandas()
    return learn({f: rows[f].to_numpy(dtype=float) for f in FEATURES}, rows["label"].to_numpy() == 0)


def rule_number(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; 0 where none does."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        both = F.lit(True)
        for c in rules[i - 1]:
            both = both & c.column()
        out = F.when(both, F.lit(i)).otherwise(out)
    return out


def used(rules: list[Rule]) -> tuple[str, ...]:
    """The features that the rules read."""
    return tuple(f for f in FEATURES if any(c.feature == f for r in rules for c in r))


def rule_text(rules: list[Rule], number: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, rule in enumerate(rules, 1):
        out = F.when(number == i, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, rule, reason, keep), one for each row of docs.

    rule: number of the first rule that holds, 0 if none; keep: whether none does. A null or
    empty text has all statistics 0 and is judged by them; null ids and repeated rows each give
    their row; other columns are ignored; an empty table gives an empty one.
    """
    found = text_features(docs, [quoted(id_col).alias("doc_id")], text_col, used(rules)).select("doc_id", rule_number(rules).alias("rule"))
    return found.select("doc_id", "rule", rule_text(rules, F.col("rule")).alias("reason"), (F.col("rule") == 0).alias("keep"))


def keep_good(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that no rule rejects; see
    apply_rules for odd rows."""
    row = F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias("row")
    return text_features(docs, [row], text_col, used(rules)).where(rule_number(rules) == 0).select("row.*")


def judge(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labels and judge every document; see apply_rules."""
    prepare(docs.sparkSession)
    return apply_rules(docs, fit_rules(docs, labels, most=most))
