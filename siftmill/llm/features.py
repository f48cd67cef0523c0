"""Sparse features of texts for linear models, and the bounded sample that models are fitted on."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from math import log1p, sqrt
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def slot(feature: str, dims: int) -> int:
    """The place of a feature in a vector of dims."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % dims


def word_features(text: str, dims: int, cache: dict) -> dict[int, float]:
    """One for each distinct word of the whole text: lower case, without punctuation around it."""
    out, known = {}, cache.get
    for word in set(text.lower().split()):
        k = known(word)
        if k is None:
            k = _remember(cache, word, slot(word.strip(".,;:!?¡¿\"'()[]{}<>*#&%$|/\\-_"), dims))
        out[k] = 1.0
    return out


def shape(word: str) -> str:
    """A word's form: runs of letters, digits and repeated signs count once."""
    if word.isalpha():
        return _case(word)
    return _AGAIN.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub(lambda m: _case(m[0]), word)))


def _case(letters: str) -> str:
    return "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[0].isupper() else "a"


def form_features(text: str, dims: int, cache: dict) -> dict[int, float]:
    """Roots of the shares of word shapes in the whole text, and how much of it repeats; they don't depend on a
    text's language or length. A text without words has one feature of its own."""
    words = text.split()
    if not words:
        return {slot("no words", dims): 1.0}
    out: dict[int, float] = {}
    counts = Counter(words)
    known = cache.get
    for word, n in counts.items():
        k = known(word)
        if k is None:
            k = _remember(cache, word, slot("shape " + shape(word), dims))
        out[k] = out.get(k, 0) + n
    out = {k: sqrt(n / len(words)) for k, n in out.items()}  # so that rare shapes count too
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(eq, words, islice(words, 1, None))) / len(words)
    for name, value in (
        ("bias", 1.0), ("word again", again), ("line again", 1 - len(set(lines)) / len(lines)), ("distinct words", len(counts) / len(words)),
        ("most frequent", counts.most_common(1)[0][1] / len(words)), ("word length", sum(map(len, words)) / len(words) / 10), ("length", log1p(len(words)) / 10),
    ):
        k = slot("form " + name, dims)
        out[k] = out.get(k, 0.0) + value
    return out


def _remember(cache: dict, word: str, k: int) -> int:
    if len(cache) >= 200_000:
        cache.clear()
    cache[word] = k
    return k


class Rows:
    """Sparse rows: what numpy needs for products with and gradients of weights."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, values: np.ndarray):
        """sizes: entries of each row; at, values: the entries' places and values."""
        self.n, self.at, self.values = len(sizes), at, values
        self.row = np.repeat(np.arange(self.n, dtype="int32"), sizes)

    @classmethod
    def of(cls, rows: Iterable[dict[int, float]]) -> "Rows":
        rows = list(rows)
        sizes = np.array([len(r) for r in rows], "int64")
        total = int(sizes.sum())
        return cls(sizes, np.fromiter((k for r in rows for k in r), "int32", total), np.fromiter((v for r in rows for v in r.values()), "float32", total))

    def pick(self, rows: np.ndarray) -> "Rows":
        """The rows for which `rows` is True."""
        kept = rows[self.row]
        return Rows(np.bincount(self.row, minlength=self.n)[rows], self.at[kept], self.values[kept])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * weights[self.at], self.n)

    def only(self, slots: np.ndarray) -> "Rows":
        """The rows without the places where `slots` is False."""
        kept = slots[self.at]
        return Rows(np.bincount(self.row[kept], minlength=self.n), self.at[kept], self.values[kept])

    def back(self, each: np.ndarray, dims: int) -> np.ndarray:
        """The sum of the rows, each times its number."""
        return np.bincount(self.at, self.values * each[self.row], dims)


def _gathered(rows: DataFrame, id_kind: str, features: Callable, dims: int, bound: int) -> tuple[Rows, np.ndarray]:
    """Features and labels of rows (_id, _text, _label), which are few, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            found = [features(t or "", dims, cache) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))],
                ["id", "label", "at", "value"],
            )

    table = rows.select("_id", "_text", "_label").mapInArrow(run, f"id {id_kind}, label int, at array<int>, value array<float>").toArrow()
    ids = table["id"].to_pylist()
    table = table.take(pa.array(sorted(range(len(ids)), key=lambda i: ids[i])[:bound], pa.int64())).combine_chunks()
    sizes = table["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    at, values = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "value"))
    return Rows(sizes.astype("int64"), at.astype("int32"), values.astype("float32")), table["label"].to_numpy().astype("int64")


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int, features: Callable, dims: int) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most `bound` labelled rows, those whose ids' hashes are smallest (so
    the same rows in any order and partitioning). Of several rows of one id the least text counts.
    Only these rows' features reach the driver."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    return _gathered(rows, df.schema[id_col].dataType.simpleString(), features, dims, bound)


def text_sample(df: DataFrame, text_col: str, bound: int, features: Callable, dims: int) -> Rows:
    """Features of at most `bound` distinct texts of df, drawn by their hashes (so the same ones in any
    order and partitioning). A text counts once, however many copies it has; null ones don't."""
    texts = df.select(F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL").withColumn("_id", F.xxhash64("_text"))
    # The share of hashes that a sample of this size takes; a quarter more for the draw's chance.
    total = texts.count()
    if total > bound:
        top = (1 << 63) - 1
        texts = texts.where(F.col("_id").bitwiseAND(top) < int(top * min(1.0, 1.25 * bound / total)))
    rows = texts.dropDuplicates(["_id"]).withColumn("_label", F.lit(0))
    return _gathered(rows, "bigint", features, dims, bound)[0]


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Weights after `steps` steps down a gradient."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def score_column(spark: SparkSession, text: Column, features: Callable, dims: int, weights: np.ndarray, finish: Callable) -> Column:
    """A double for each row: finish of the whole text's product with the weights; a null text counts
    as an empty one. The weights travel once, as a broadcast variable of dims doubles."""
    held = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts in batches:
            rows = Rows.of(features(t or "", dims, cache) for t in texts)
            yield pd.Series(finish(rows.dot(held.value)), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text.cast("string"))
