"""Quality rules: decision lists learnt by sequential covering.

Rules reject. A rule is a conjunction of thresholds on statistics of a text. One
after another a rule is grown on two thirds of the rows that no earlier rule
covers, adding the threshold with the highest information gain until it covers no
row to keep; then its last thresholds are cut off again where that makes it
better on the other third. Covering ends when the next rule isn't good enough.
The list comes out as one conditional expression of Spark.

Learning is bounded (``bound`` labelled rows, ``steps`` candidate thresholds per
statistic), and so is what is learnt: ``rules`` rules at most (12), of ``tests`` thresholds
at most (4), so that a list stays readable; covering ends there even if a further rule would be
good enough. Statistics and rules are applied to every whole text. Null texts count
as empty. With nothing to learn from the list has no rule and keeps everything. Of
thresholds with equal gain the first statistic's, "<=" and the lowest is taken; repeated
rows get equal verdicts; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import FEATURES, labelled, with_stats


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, "<=" or ">", threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, sign, bound in self.tests:
            out = out & ((F.col(name) > F.lit(bound)) if sign == ">" else (F.col(name) <= F.lit(bound)))
        return out

    def covers(self, x: np.ndarray, features: tuple[str, ...] = FEATURES) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, bound in self.tests:
            column = x[:, features.index(name)]
            out &= column > bound if sign == ">" else column <= bound
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {b:.6g}" for n, s, b in self.tests)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """Number of the first rule that rejects a row, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(self.rules[k - 1].condition(), F.lit(k)).otherwise(out)
        return out


def _information(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, np.log2(p / (p + n)), -np.inf)


def _best(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[float, int, str, float] | None:
    """The threshold with the highest gain, as (gain, feature, sign, threshold)."""
    p0, n0 = y.sum(), (~y).sum()
    base, best = _information(p0, n0), None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) < 2:
            continue
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > steps:
            # thresholds at even ranks of the rejected rows' values and of all values
            pick = np.concatenate([np.quantile(x[y, j], np.linspace(0, 1, steps // 2)), np.quantile(x[:, j], np.linspace(0, 1, steps // 2))])
            middle = np.unique(middle[np.clip(np.searchsorted(middle, pick), 0, len(middle) - 1)])
        order = np.sort(x[y, j]), np.sort(x[~y, j])
        low = [np.searchsorted(o, middle, side="right") for o in order]
        for sign, p, n in (("<=", low[0], low[1]), (">", p0 - low[0], n0 - low[1])):
            with np.errstate(invalid="ignore"):
                gain = np.where(p > 0, p * (_information(p, n) - base), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), j, sign, float(middle[k])
    return best


def grow(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], steps: int, most: int) -> list[tuple[str, str, float]]:
    tests, here = [], np.ones(len(x), bool)
    while len(tests) < most and (~y[here]).any() and y[here].any():
        found = _best(x[here], y[here], steps)
        if found is None:
            break
        _, j, sign, bound = found
        tests.append((features[j], sign, bound))
        here &= (x[:, j] > bound) if sign == ">" else (x[:, j] <= bound)
    return tests


def prune(tests: list[tuple[str, str, float]], x: np.ndarray, y: np.ndarray, features: tuple[str, ...]) -> tuple[Rule, float]:
    """The leading tests with the best (rejected - kept) / covered on other rows, the shortest such, and its precision."""
    best, worth, precision = Rule(tuple(tests)), -2.0, 0.0
    for k in range(1, len(tests) + 1):
        rule = Rule(tuple(tests[:k]))
        covered = rule.covers(x, features)
        p, n = int((y & covered).sum()), int((~y & covered).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth + 1e-12:
            best, worth, precision = rule, value, p / (p + n) if p + n else 0.0
    return best, precision


def fit(x: np.ndarray, reject: np.ndarray, features: tuple[str, ...] = FEATURES, rules: int = 12, tests: int = 4, steps: int = 128, precision: float = 0.8, seed: int = 11) -> DecisionList:
    left, rng, found = np.ones(len(x), bool), np.random.default_rng(seed), []
    while len(found) < rules and reject[left].any():
        rows = rng.permutation(np.flatnonzero(left))
        rows = np.concatenate([rows[reject[rows]], rows[~reject[rows]]])
        third = np.arange(len(rows)) % 3 == 2
        a, b = rows[~third], rows[third]
        grown = grow(x[a], reject[a], features, steps, tests)
        if not grown:
            break
        rule, good = prune(grown, x[b], reject[b], features)
        if good < precision:
            break
        found.append(rule)
        left &= ~rule.covers(x, features)
    return DecisionList(tuple(found))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000, **how) -> DecisionList:
    x, y = labelled(docs, labels, label_col, may_learn, id_col, text_col, bound)
    return fit(x, y == 0, **how)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Per row: id, statistics, base_failed (fewer than ``least_words``, or more than ``most_repeated`` percent of them in repeated windows), rule (the first that rejects), kept."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = with_stats(docs, text_col, (id_col,)).withColumn("base_failed", base).withColumn("rule", rules.number())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
