"""Column profiles: the literal fixtures, nulls, ties, empty and odd tables."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftmill.operators import columns as C


def by(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_kinds(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'a', 1, true, DATE'2024-01-01', array(1), repeat('x', 61)), ('a', 'b', 2, false, NULL, array(1), repeat('x', 61)), ('b', 'c', 3, NULL, NULL, NULL, repeat('x', 61)), ('b', 'c', 4, NULL, NULL, NULL, repeat('x', 61)) AS t(s, t, n, b, d, arr, `long.name`)")
    got = {c: r.bucket for c, r in by(C.column_kinds(df)).items()}
    assert got == {"s": "categorical", "t": "text", "n": "numeric", "b": "boolean", "d": "datetime", "arr": "categorical", "long.name": "text"}
    assert {r.bucket for r in C.column_kinds(spark.sql("SELECT CAST(NULL AS STRING) s FROM range(3)")).collect()} == {"categorical"}


def test_quality(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'x', map('a', 1)), (NULL, 'x', map('a', 1)), (1, 'x', map('a', 1)), (1, 'x', NULL) AS t(a, b, m)").withColumn("none", F.lit(None).cast("string"))
    assert {c: r.missing for c, r in by(C.missing_values(df)).items()} == {"a": 1, "b": 0, "m": 1, "none": 4}
    found = by(C.distinct_values(df))
    assert {c: r.n_unique for c, r in found.items()} == {"a": 2, "b": 1, "m": 2, "none": 1}
    assert [c for c, r in found.items() if r.is_constant] == ["b", "none"]
    assert tuple(C.duplicate_rows(df).first()) == (4, 1)
    assert tuple(C.duplicate_rows(df.where("false")).first()) == (0, 0)
    assert tuple(C.duplicate_rows(spark.range(600).select((F.col("id") % 590).alias("k"))).first()) == (600, 10)


def test_outliers_fixture(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 9), 100]], "v double")
    r = C.outliers(df).first()
    assert (r.q1, r.q3, r.lo, r.hi, r.outliers, r.share) == (3.0, 7.0, -3.0, 13.0, 1, 0.111)
    assert C.outliers(df.select(F.lit(1).alias("same"))).collect() == []
    assert C.outliers(df.where("false")).collect() == []
    assert C.outliers(df.select(F.lit("x").alias("s"))).collect() == []


def test_ranks_equal_a_sort(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice([None, 1.0, 1.0, float("nan"), rng.random() * 1000]), rng.randrange(50), rng.gauss(0, 1)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(7)
    got = {(r.column, r.name): r for r in C.order_statistics(df, ["a", "b", "c"], {"p0": 0.0, "q": 0.25, "m": 0.5, "p999": 0.999, "p1": 1.0}, accuracy=100).collect()}
    for i, name in enumerate("abc"):
        values = sorted(float(r[i]) for r in rows if r[i] is not None and not math.isnan(r[i]))
        for p, q in (("p0", 0.0), ("q", 0.25), ("m", 0.5), ("p999", 0.999), ("p1", 1.0)):
            at = (len(values) - 1) * q
            r = got[name, p]
            assert (r.n, r.low, r.high, r.nearest) == (len(values), values[math.floor(at)], values[math.ceil(at)], values[math.floor(at + 0.5)])


def test_numeric_stats(spark):
    values = [3.0, 1.0, None, 8.0]
    df = spark.createDataFrame([(v, 0, 5) for v in values], "v double, zero int, five int").withColumn("gone", F.lit(None).cast("int"))
    got = by(C.numeric_stats(df))
    own = [v for v in values if v is not None]
    assert (got["v"].median, got["v"].std) == (3.0, round(statistics.stdev(own), 4))
    assert got["zero"].cv == math.inf and got["gone"].cv == math.inf and got["five"].cv == 0.0
    assert [got[c].rank for c in ("zero", "gone", "v", "five")] == [1, 2, 3, 4]
    assert by(C.numeric_stats(df.where("v = 3")))["v"].cv == 0.0
    assert C.numeric_stats(df.select(F.lit("x").alias("s"))).collect() == []
    extremes = {r.kind: (r.column, r.value) for r in C.global_extremes(C.numeric_stats(df)).collect()}
    assert extremes == {"min": ("zero", 0.0), "max": ("v", 8.0)}


def test_correlation_fixture(spark):
    df = spark.createDataFrame([(1, 2, 3, 7), (2, 4, 2, 7), (3, 6, 1, 7)], "a int, b int, c int, same int")
    pairs = C.correlations(df)
    assert {(r.a, r.b): (r.value, r.sign) for r in pairs.collect()} == {("a", "b"): (1.0, "positive"), ("a", "c"): (-1.0, "negative"), ("b", "c"): (-1.0, "negative")}
    assert [r.b for r in C.strongest(pairs, "negative").orderBy("rank").collect()] == ["c", "c"]
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 1.0)], "a double, b double")
    assert C.correlations(holes, compatible=False).first().value == 1.0
    assert C.correlations(df.select("a")).collect() == []


@pytest.mark.parametrize(("values", "expected"), [("x" * 9 + "y", None), ("x" * 16 + "yyzz", 0.8), ("x" * 15 + "yyyzz", None)])
def test_imbalance_fixture(spark, values, expected):
    r = C.category_summary(spark.createDataFrame([(v,) for v in values], "s string"), ["s"]).first()
    assert (r.dominant_share if r.imbalanced else None) == expected


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None, None, None]], "s string")
    assert [(r.value, r["count"]) for r in C.category_values(df, ["s"]).orderBy("rank").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    spots = C.spotlights(df.union(spark.createDataFrame([("http://x",), ("@me",), ("y" * 41,), ("",), (" a ",)], "s string"))).orderBy("rank").collect()
    assert [(r.value, r["count"], r.uniques) for r in spots] == [("a", 2, 3), ("c", 2, 3), ("b", 1, 3)]


def test_ranks_of_small_groups(spark):
    """Every number of rows, for which the neighbouring rank may lie beyond what an approximate percentile brackets."""
    rng = random.Random(9)
    groups = {n: sorted(rng.randrange(1000) / 8 for _ in range(n)) for n in [*range(1, 30), 103, 10_003, 20_007]}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "g int, value double")
    got = {(r.g, r.name): r for r in C.ranked_values(df, ["g"], {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()}
    for n, vs in groups.items():
        for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            r, rank = got[n, name], (n - 1) * share
            assert (r.n, r.low, r.high, r.nearest) == (n, vs[math.floor(rank)], vs[math.ceil(rank)], vs[math.floor(rank + 0.5)])
