"""Exact top-k inner products by aggregation without random access.

Every component is a list of the vectors, sorted by that component. A query reads each list in
turn, from the end that its own component favours, and keeps of each vector what it has met: its
lower bound takes the list's far end for components not met yet, its upper bound the entry that
the list was read to. A vector whose upper bound is below the k-th lower bound is out; when the
others are settled, reading goes on in the same lists for their missing components alone, until
their scores are whole. Nothing is looked up by vector, and no products of whole vectors are made.

Candidates are dealt into blocks of bounded size, and so are queries; a pair of blocks is one group's
work. Blocks come in waves, each WAVE times as many as all before: a query enters a wave with the
k-th score that it has, so a later block reads less and returns only what may still qualify. (Where
components say little of scores, as with dense random vectors, bounds meet late and lists are
read nearly to their ends; the work is that of all products then.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import stored

#: Vectors in a block of candidates, and of queries, at most; and what a wave grows by.
BLOCK, QUERIES, WAVE = 16384, 8192, 8
#: A query looks at its bounds when it has read this share of the lists, and each time it has doubled.
FIRST = 64


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a component that is
    null or not finite."""
    good = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """The sorted lists of a block's vectors, one for each component."""

    def __init__(self, vectors: np.ndarray):
        self.n = len(vectors)
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, 1)

    def best(self, query: np.ndarray, k: int, floor=None, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, entries read): every vector among the query's k best of the block, ties with
        the k-th included, but none below floor and none of the places in skip."""
        n, kind = self.n, query.dtype
        high, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weight = query[np.concatenate([high, low])]
        ends = np.concatenate([self.values[high, 0], self.values[low, -1]]) * weight  # what each list gives at least
        bound = np.full(n, ends.sum() if len(ends) else 0, kind)
        met = np.zeros((n, len(weight)), bool)
        open_ = np.ones(n, bool)
        if skip is not None:
            open_[skip] = False
        left, read, done = np.flatnonzero(open_), 0, 0
        settled = False
        while done < n and len(weight) and len(left):
            then = min(n, max(1, n // FIRST, 2 * done))
            place = np.concatenate([self.order[high, n - then : n - done], self.order[low, done:then]])
            given = np.concatenate([self.values[high, n - then : n - done], self.values[low, done:then]]) * weight[:, None]
            read += place.size
            reached = np.concatenate([given[: len(high), 0], given[len(high) :, -1]])
            more, of = (given - ends[:, None]).ravel(), np.repeat(np.arange(len(weight)), then - done)
            place = place.ravel()
            if settled or 4 * len(left) < n:
                here = open_[place]
                place, more, of = place[here], more[here], of[here]
            if kind == object:
                np.add.at(bound, place, more)
            else:
                bound += np.bincount(place, more, n)
            met[place, of] = True
            gap = reached - ends
            upper = bound[left] + gap.sum() - (met[left] @ gap if kind != object else np.array([gap[m].sum() for m in met[left]], object))
            least = np.partition(bound[left], len(left) - k)[len(left) - k] if len(left) > k else None
            least = floor if least is None or floor is not None and floor > least else least
            if least is not None:
                kept = upper >= least
                open_[left[~kept]] = False
                left = left[kept]
            settled = len(left) <= k
            if not len(left) or met[left].all():
                break
            done = then
        return left, bound[left], read


def best_of_block(queries: np.ndarray, vectors: np.ndarray, k: int, floors: list, skips: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vector row, score, entries read) of each query's k best vectors. Whole numbers, in
    doubles where sums of products stay below 2^53, else in Python's."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = "float64" if top < 1 << 52 else object
    lists = Lists(vectors.astype(kind))
    found, read = [], 0
    for i, query in enumerate(queries.astype(kind)):
        at, score, n = lists.best(query, k, floors[i], skips[i])
        found.append((np.full(len(at), i), at, score))
        read += n
    rows, at, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"),) * 3
    return rows, at, score, read


def first_of_ties(k: int, query: np.ndarray, at: np.ndarray, score: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each query's vectors the k best ones, the first of equals: so many leave a block at most, however many
    tie. Vectors come in the order that decides ties."""
    order = np.lexsort((at, -score, query))
    query, at, score = query[order], at[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[kept], at[kept], score[kept], read


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k highest integer inner products with the
    candidates (all of them, if there are fewer), never with its own row.

    Vectors are taken as floor(scale * x). Those that are null, or hold null or non-finite
    components, take no part, on either side; neither do null ids. Vectors meet those of their
    own length only. Ties go to the smaller id. Every row is a candidate, and every query row gets an
    answer, rows that repeat wholly too: such a query leaves out one of its copies, itself. Equal rows
    travel as one with their number. Either side may be empty.
    """
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.count("*").alias("copies"))
    all_rows, asked = stored(rows(candidates)), stored(rows(queries).withColumn("key", F.xxhash64("id", "v")))
    total, cores = all_rows.count(), candidates.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total // BLOCK), min(cores, total // 1024))
    parts = max(1, -(-asked.count() // QUERIES))
    dealt = all_rows.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("q", F.pmod("key", F.lit(parts)).cast("int"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"key": [], "query_id": [], "id": [], "copies": [], "score": []})
        c = c.take(np.argsort(c["id"].to_numpy(), kind="stable"))  # ties go to the smaller id; rows of one id answer alike
        a, b = (np.array(x["v"].tolist(), "int64").reshape(len(x), -1) for x in (q, c))
        ids, query_ids = c["id"].to_numpy(), q["id"].to_numpy()
        own = {i: n for n, i in enumerate(ids.tolist())} if len(set(ids.tolist())) == len(ids) else None
        copies, skips, selves = c["copies"].to_numpy(), [], []
        for i, v in zip(query_ids.tolist(), a):
            at = np.flatnonzero(ids == i) if own is None else np.array([own[i]] if i in own else [], "int64")
            at = at[(b[at] == v).all(axis=1)]
            selves.append(int(at[0]) if len(at) else -1)
            skips.append(at[copies[at] == 1])
        floors = [None if pd.isna(x) else int(x) for x in q["floor"]]
        i, j, score, _ = first_of_ties(k, *best_of_block(a, b, k, floors, skips))
        others = copies[j] - (np.array(selves, "int64")[i] == j)
        return pd.DataFrame({"key": q["key"].to_numpy()[i], "query_id": query_ids[i], "id": ids[j], "copies": others, "score": score.astype("int64")})

    best, first = None, Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "id")
    low = 0
    while low < blocks:
        high = min(blocks, max(cores, WAVE * low))
        floors = best.where(F.col("rank") == k).select("key", F.col("score").alias("floor")) if best else asked.select("key", F.lit(None).cast("long").alias("floor")).where("false")
        own = asked.join(floors, "key", "left").withColumn("c", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        sized = lambda df: df.withColumn("dims", F.size("v")).groupBy("q", "c", "dims")
        found = sized(own).cogroup(sized(dealt.where(F.col("c").between(low, high - 1)))).applyInPandas(meet, "key long, query_id long, id long, copies long, score long")
        found = found if best is None else found.union(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k))
        low = high
    each = lambda c: F.explode(F.sequence(F.lit(1).cast("long"), c))
    best = best.drop("rank").withColumn("copy", each(F.least("copies", F.lit(k).cast("long")))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    repeated = best.join(asked.select("key", F.col("copies").alias("times")), "key").withColumn("time", each(F.col("times")))
    return repeated.select("query_id", "rank", F.col("id").alias(id_col), "score")
