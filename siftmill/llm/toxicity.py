"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - threshold_k), with one weight vector w for all thresholds and
thresholds in ascending order; x are the distinct words of the whole text, hashed. The expected
severity is the sum of P(grade > k) over the thresholds. The model is fitted on at most
`bound` labelled rows and applied to every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.features import Rows, adam, labelled_sample, score_column, sigmoid, word_features

DIMS = 1 << 18
#: Labelled rows that a model is fitted on at most.
BOUND = 20_000


@dataclass(frozen=True)
class OrdinalModel:
    """weights for words, and thresholds between grades in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.exceed(score).sum(axis=1)


def telling(rows: Rows, grades: np.ndarray, dims: int, least: float = 5.0) -> np.ndarray:
    """Which words' mean grade differs from all rows' by `least` standard errors or more. Most of a
    corpus's words are rare; without this their weights would learn single texts by heart."""
    n = np.bincount(rows.at, minlength=dims)
    total = np.bincount(rows.at, grades[rows.row], dims)
    score = np.abs(total - n * grades.mean()) / (grades.std() * np.sqrt(np.maximum(n, 1)))
    return score >= least


def fit_ordinal(rows: Rows, grades: np.ndarray, dims: int, l2: float = 3e-5, steps: int = 300, rate: float = 0.15) -> OrdinalModel:
    """The penalised maximum-likelihood fit over the telling words. Grades are 0 .. K-1; with no rows,
    or one grade only, the thresholds put all mass on the lowest grade found."""
    top = int(grades.max(initial=0))
    if rows.n == 0 or top == 0:
        return OrdinalModel(np.zeros(dims), np.full(max(top, 1), 50.0))
    rows = rows.only(telling(rows, grades, dims))
    shares = np.array([(grades > k).mean() for k in range(top)])
    first = -np.log((shares + 1e-3) / (1 - shares + 1e-3))
    # thresholds = first + cumulated steps of at least 0, which keeps them in order
    gaps = np.log(np.expm1(np.maximum(np.diff(first), 1e-3)))

    def parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:dims], p[dims] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(p[dims + 1 :])))])

    def gradient(p: np.ndarray) -> np.ndarray:
        w, t = parts(p)
        # P(grade = k) is a difference of neighbouring exceedances; 1 below the lowest, 0 above the top.
        s = sigmoid(rows.dot(w)[:, None] - t[None, :])
        full = np.hstack([np.ones((rows.n, 1)), s, np.zeros((rows.n, 1))])
        i = np.arange(rows.n)
        mass = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
        slope = np.hstack([np.zeros((rows.n, 1)), s * (1 - s), np.zeros((rows.n, 1))])
        up, down = slope[i, grades] / mass, slope[i, grades + 1] / mass
        each = -(up - down) / rows.n
        to = np.zeros(top + 2)
        np.add.at(to, grades, up / rows.n)
        np.add.at(to, grades + 1, -down / rows.n)
        g = to[1 : top + 1]
        tail = np.cumsum(g[::-1])[::-1]
        return np.concatenate([rows.back(each, dims) + l2 * w, [tail[0]], tail[1:] * sigmoid(p[dims + 1 :])])

    found = adam(gradient, np.concatenate([np.zeros(dims), [first[0]], gaps]), steps, rate)
    w, t = parts(found)
    return OrdinalModel(w, t)


def severity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", bound: int = BOUND, dims: int = DIMS) -> DataFrame:
    """(id_col, expected_severity double, grade int): a row for each row of df.

    labels: (id_col, grade_col) with grades 0, 1, ...; rows with nulls don't count, and of several
    grades for one id the highest does. grade is the number of thresholds exceeded with a
    probability over one half. Null and empty texts have no words and get the base rate's grade;
    without labels every severity is next to 0.
    """
    rows, grades = labelled_sample(df, labels, id_col, text_col, grade_col, bound, word_features, dims)
    model = fit_ordinal(rows, np.maximum(grades, 0), dims)
    thresholds = model.thresholds.tolist()
    score = score_column(df.sparkSession, F.col(text_col), word_features, dims, model.weights, lambda s: s)
    found = df.select(id_col, score.alias("score"))
    over = [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in thresholds]
    grade = sum(((F.col("score") > t).cast("int") for t in thresholds), F.lit(0))
    return found.select(id_col, sum(over, F.lit(0.0)).alias("expected_severity"), grade.alias("grade"))
