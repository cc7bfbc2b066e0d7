"""Operator 2: quality classifier by positive-unlabelled learning (non-negative risk).

Trusted positives are labelled good documents; the unlabelled set is a random
sample of the whole web text. A linear model over binned text statistics
minimises the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss. The class prior is estimated first: the smallest
ratio of unlabelled to positive mass over the upper score regions of a plain
positive-against-unlabelled fit, cross-fitted on two halves. The bias is set
so that all but ``POSITIVE_LOSS`` of the trusted positives reach ``THRESHOLD``.

Both fitting samples are bounded (``FIT_ROWS`` rows each, at random); every
text is scored whole, in one pass without a shuffle. Labels, language,
source and ids are no inputs of a score.

Null and empty texts have all statistics 0 and get a score like any text.
Without a positive label every score is 0.5. Repeated label rows count once
(the largest label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.llm.common import col, double, map_texts
from ratebook.llm.common import long as long_field
from ratebook.llm.textstats import FEATURES, measure

FIT_ROWS = 20_000
BINS = 24
STEPS = 400
THRESHOLD = 0.7
#: The share of trusted positives that may score below THRESHOLD.
POSITIVE_LOSS = 0.002


@dataclass
class PuModel:
    """Cut points per statistic, one weight per bin, and the estimated prior."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[_cells(x, self.cuts)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cells(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The index of each statistic's bin among all bins (missing statistics fall into the last)."""
    return np.stack([f * BINS + np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)


def _descend(cells_p: np.ndarray, cells_u: np.ndarray, width: int, prior: float, non_negative: bool,
             decay: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the (non-negative) PU risk; with ``non_negative`` off, on plain positive-against-unlabelled loss."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)

    def mean_grad(cells, d):
        g = np.bincount(cells.ravel(), weights=np.repeat(d, cells.shape[1]), minlength=width) / len(d)
        return np.append(g, d.mean())

    for step in range(1, STEPS + 1):
        gp, gu = w[cells_p].sum(axis=1) + w[-1], w[cells_u].sum(axis=1) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        if non_negative:
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            part = mean_grad(cells_u, su) - prior * mean_grad(cells_p, sp)
            grad = prior * mean_grad(cells_p, sp - 1) + part if rest >= 0 else -part
        else:
            grad = 0.5 * (mean_grad(cells_p, sp - 1) + mean_grad(cells_u, su))
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(cells_p: np.ndarray, cells_u: np.ndarray, width: int) -> float:
    """Share of positives among the unlabelled: least mass ratio over upper score regions, cross-fitted."""
    found = []
    for half in (0, 1):
        w, b = _descend(cells_p[half::2], cells_u[half::2], width, 0.5, non_negative=False)
        sp = np.sort(w[cells_p[1 - half::2]].sum(axis=1) + b)
        su = np.sort(w[cells_u[1 - half::2]].sum(axis=1) + b)
        if not len(sp) or not len(su):
            continue
        cuts = np.quantile(sp, np.linspace(0.0, 0.8, 41))
        p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
        u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
        slack = np.sqrt(1 / len(sp)) + np.sqrt(1 / len(su))
        found.append(np.min(u / np.maximum(p, 1e-9) + 0.25 * slack / np.maximum(p, 1e-9)))
    return float(np.clip(np.mean(found), 0.05, 0.98)) if found else 0.5


def train(x_pos: np.ndarray, x_unl: np.ndarray) -> PuModel | None:
    if not len(x_pos) or not len(x_unl):
        return None
    both = np.concatenate([x_pos, x_unl])
    cuts = [np.unique(np.quantile(both[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(both.shape[1])]
    width = BINS * both.shape[1]
    cells_p, cells_u = _cells(x_pos, cuts), _cells(x_unl, cuts)
    prior = estimate_prior(cells_p, cells_u, width)
    weights, _ = _descend(cells_p, cells_u, width, prior, non_negative=True)
    least = np.quantile(weights[cells_p].sum(axis=1), POSITIVE_LOSS)
    return PuModel(cuts, weights, float(np.log(THRESHOLD / (1 - THRESHOLD)) - least), prior)


def statistics(df: DataFrame, text_col: str) -> np.ndarray:
    """Statistics of a bounded set of texts, on the driver, in an order of their own values."""
    rows = map_texts(df, text_col, [], [long_field("n"), T.StructField("x", T.ArrayType(T.DoubleType()))],
                     lambda: lambda texts: [[0] * len(texts), [measure(t)[1] for t in texts]]).collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return x[np.lexsort(x.T)] if len(x) else x


def fit_pu(df: DataFrame, labels: DataFrame, learn: Column | None = None, text_col: str = "text",
           id_col: str = "doc_id", label_col: str = "quality", rows: int = FIT_ROWS) -> PuModel | None:
    """``learn``: which label rows may be used (a condition over ``labels``)."""
    usable = labels if learn is None else labels.where(learn)
    good = (usable.select(col(id_col).alias("__id"), col(label_col).alias("__label"))
            .where("__id is not null and __label is not null").groupBy("__id").agg(F.max("__label").alias("__label"))
            .where("__label > 0").select("__id"))
    docs = df.select(col(id_col).alias("__id"), col(text_col).alias("__text"))
    total, n_good = docs.count(), good.count()
    picked = good.sample(fraction=min(1.0, rows / max(n_good, 1)), seed=3)
    positives = docs.join(F.broadcast(picked), "__id", "left_semi")  # the sample's size is bounded
    unlabelled = docs.sample(fraction=min(1.0, rows / max(total, 1)), seed=5)
    return train(statistics(positives, "__text"), statistics(unlabelled, "__text"))


def pu_scores(df: DataFrame, model: PuModel | None, text_col: str = "text", keep: list[str] | None = None
              ) -> DataFrame:
    """``keep`` columns (default: all but the text) with score, the estimated chance of good quality."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def make():
        def score(texts):
            if model is None:
                return [[0.5] * len(texts)]
            x = np.array([measure(t)[1] for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            return [model.score(x).tolist()]
        return score

    return map_texts(df, text_col, keep, [double("score")], make)
