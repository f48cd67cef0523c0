"""A quality classifier from positive and unlabelled texts.

Trusted positives are rows labelled 1; the unlabelled texts are drawn from the corpus itself, each text
once, whatever its label. The share of positives among the unlabelled (the class prior) is estimated from the scores of a plain discriminator: it is the least ratio of
unlabelled to positive texts above a score. Then the non-negative unbiased risk

    prior * R_positive(+1) + max(0, R_unlabelled(-1) - prior * R_positive(-1))

is minimised over linear scores of the whole text's form: where the second term falls below 0,
its gradient is followed upwards. Fitted on at most `bound` labelled rows and as many unlabelled
texts, applied to every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.features import Rows, adam, form_features, labelled_sample, score_column, sigmoid, text_sample
from siftmill.llm.shared import fresh

DIMS = 1 << 12
#: Labelled rows, and unlabelled texts, that a model is fitted on at most.
BOUND = 20_000


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores that are higher for positives: the
    least ratio of the two shares above a score. It errs downwards, which only makes scores of
    positives smaller; a prior above the true one would make the risk's second term vanish early."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    ratios = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def fit_pu(positive: Rows, unlabelled: Rows, dims: int, l2: float = 1e-5, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, prior). Without positives or unlabelled rows the weights are 0: every score is 0.5."""
    if not positive.n or not unlabelled.n:
        return np.zeros(dims), 0.5

    def tell(w: np.ndarray) -> np.ndarray:
        return (positive.back((sigmoid(positive.dot(w)) - 1) / positive.n, dims) + unlabelled.back(sigmoid(unlabelled.dot(w)) / unlabelled.n, dims)) / 2 + 1e-4 * w

    first = adam(tell, np.zeros(dims), 100, rate)
    prior = class_prior(positive.dot(first), unlabelled.dot(first))

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive.dot(w)), sigmoid(unlabelled.dot(w))
        # logistic losses: of +1 -log(p), of -1 -log(1 - p)
        rest = np.mean(np.logaddexp(0, unlabelled.dot(w))) - prior * np.mean(np.logaddexp(0, positive.dot(w)))
        down = unlabelled.back(u / unlabelled.n, dims) - prior * positive.back(p / positive.n, dims)
        if rest < 0:
            return -down + l2 * w
        return prior * positive.back((p - 1) / positive.n, dims) + down + l2 * w

    return adam(gradient, np.zeros(dims), steps, rate), prior


def quality_column(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = BOUND, dims: int = DIMS) -> Column:
    """The score of df's texts, of a model fitted now: see quality_scores."""
    rows, marks = labelled_sample(df, labels, id_col, text_col, label_col, bound, form_features, dims)
    weights, _ = fit_pu(rows.pick(marks == 1), text_sample(df, text_col, bound, form_features, dims), dims)
    return score_column(df.sparkSession, F.col(text_col), form_features, dims, weights, sigmoid)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """(id_col, score double, predicted int): a row for each row of df.

    labels: (id_col, label_col) with 1 for trusted positives; other labels aren't used. Rows with
    nulls don't count, and rows that repeat count once. score is from 0 to 1; predicted is 1
    from 0.5 on. Null and empty texts are scored as empty texts; without labels all score 0.5.
    """
    found = df.select(id_col, quality_column(df, labels, id_col, **more).alias("score"))
    return found.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of df that the classifier doesn't reject (score 0.5 or more), with df's columns. Repeated
    rows share their fate; see quality_scores for nulls and empty tables."""
    score, = fresh(df, "score")
    return df.withColumn(score, quality_column(df, labels, id_col, **more)).where(F.col(score) >= 0.5).select(*df.columns)
