"""Operator 3: quality rules with a gradient-boosted verdict over document statistics.

Base rules reject a text with fewer than 50 words, or with more than half of
its words inside repeated 3-word windows. What passes goes to boosted trees
over the text's statistics, fitted on at most about ``FIT_ROWS`` labelled
documents and scored as numpy node arrays in the tasks. The score never
rises with symbols, repeated lines or repeated words (monotonic constraints).

Null and empty texts have no words and fail the base rules. Without labels
of both kinds every text that passes the base rules is kept. Repeated label
rows of a document count once (the largest label); null labels are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.llm.common import boolean, col, double, long, map_texts
from ratebook.llm.gbt import Forest, fit
from ratebook.llm.textstats import BASE, FEATURES, measure

FIT_ROWS = 20_000
MIN_WORDS = 50
KEEP_FROM = 0.5
#: The sign each constrained feature's effect must have.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}


def labelled_features(df: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str,
                      rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``rows`` labelled documents at most (a random sample of the labels)."""
    known = (labels.select(col(id_col).alias("__id"), col(label_col).cast("double").alias("__label"))
             .where("__id is not null and __label is not null").groupBy("__id").agg(F.max("__label").alias("__label")))
    share = min(1.0, rows / max(known.count(), 1))
    docs = df.select(col(id_col).alias("__id"), col(text_col).alias("__text"))
    picked = docs.join(F.broadcast(known.sample(fraction=share, seed=11)), "__id")  # the sample's size is bounded
    features = map_texts(picked, "__text", ["__label"], [T.StructField("x", T.ArrayType(T.DoubleType()))],
                         lambda: lambda texts: [[measure(t)[1] for t in texts]]).collect()
    x = np.array([r.x for r in features], dtype=np.float64).reshape(-1, len(FEATURES))
    return x, np.array([float(r["__label"] > 0) for r in features])


def fit_rules(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              label_col: str = "quality") -> Forest | None:
    """The verdict's trees, or None where the labels have not both kinds."""
    x, y = labelled_features(df, labels, text_col, id_col, label_col)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort((*x.T, y))  # the same fit whatever order the rows came in
    return fit(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def quality_rules(df: DataFrame, forest: Forest | None, text_col: str = "text", keep: list[str] | None = None
                  ) -> DataFrame:
    """``keep`` columns (default: all) with the base statistics, base_failed, score and kept."""
    keep = df.columns if keep is None else keep

    def make():
        def score(texts):
            measured = [measure(t) for t in texts]
            base = np.array([m[0] for m in measured], dtype=np.int64).reshape(-1, len(BASE))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
            if forest is None:
                p = np.ones(len(base))
            else:
                p = forest.probability(np.array([m[1] for m in measured]).reshape(-1, len(FEATURES)))
            return [*base.T.tolist(), failed.tolist(), p.tolist(), (~failed & (p >= KEEP_FROM)).tolist()]
        return score

    fields = [*map(long, BASE), boolean("base_failed"), double("rule_score"), boolean("kept")]
    return map_texts(df, text_col, keep, fields, make)
