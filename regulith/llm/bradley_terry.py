"""Bradley-Terry ranking of documents by quality.

Every pair of a document labelled 1 and one labelled 0 is a preference for the
first. A document's score is linear in its features, and the chance that i is
preferred to j is the logistic function of the scores' difference, so learning is
logistic regression on feature differences without a constant. The cut is a
quantile of the learning rows' scores: the share of them that is labelled 0.

A score is reported as logistic((raw - cut) / scale): 0.5 stands for the cut.

Learning is bounded (``bound`` labelled rows, ``pairs`` pairs); scoring is a Spark
expression over statistics of the whole text. With no pair to learn from, all raw
scores are 0 and so every score is 0.5. Null and empty texts are scored like any
other; repeated rows get equal scores; a score at the cut counts as above; other columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .text_stats import FEATURES, labelled, with_stats


@dataclass(frozen=True)
class Ranking:
    features: tuple[str, ...]
    centre: tuple[float, ...]
    weight: tuple[float, ...]
    cut: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.centre)) @ np.array(self.weight)

    def score(self) -> Column:
        """0 to 1 from the feature columns."""
        raw = sum(((F.col(f) - F.lit(c)) * F.lit(w) for f, c, w in zip(self.features, self.centre, self.weight)), F.lit(0.0))
        z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (raw - F.lit(self.cut)) / F.lit(self.scale)))
        return 1 / (1 + F.exp(-z))


def preference_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Feature differences of all pairs, or of ``pairs`` pairs drawn at random."""
    if len(good) * len(bad) <= pairs:
        i, j = np.divmod(np.arange(len(good) * len(bad)), max(1, len(bad)))
    else:
        rng = np.random.default_rng(seed)
        i, j = rng.integers(0, len(good), pairs), rng.integers(0, len(bad), pairs)
    return good[i] - bad[j]


def fit(x: np.ndarray, y: np.ndarray, features: tuple[str, ...] = FEATURES, pairs: int = 200_000, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> Ranking:
    """Newton's method on the mean logistic loss of the pairs plus ``ridge`` times the squared weights."""
    if not (y == 1).any() or not (y == 0).any():
        return Ranking(features, (0.0,) * len(features), (0.0,) * len(features), 0.0, 1.0)
    centre, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - centre) / spread
    d = preference_pairs(z[y == 1], z[y == 0], pairs, seed)
    w = np.zeros(len(features))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + 2 * ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 2 * ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    raw = z @ w
    below = float((y == 0).mean())
    ordered, at = np.sort(raw), below * len(raw)
    k = min(max(int(round(at)), 1), len(raw) - 1)
    cut = float((ordered[k - 1] + ordered[k]) / 2)
    return Ranking(features, tuple(map(float, centre)), tuple(map(float, w / spread)), cut, float(max(raw.std() / 4, 1e-9)))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000, **how) -> Ranking:
    return fit(*labelled(docs, labels, label_col, may_learn, id_col, text_col, bound), **how)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, held: int = 1, **how) -> DataFrame:
    """Per row: id, held_out, score, predicted, and the statistics; learnt from labels outside the held-out fold."""
    part = fold(F.col(id_col), parts)
    ranking = learn(docs, labels, part != held, id_col=id_col, text_col=text_col, **how)
    scored = with_stats(docs, text_col, (id_col,)).withColumn("score", ranking.score())
    return scored.select(id_col, F.coalesce(part == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
