"""Facets of started streams: many batches give what the whole table gives, in any order and again after a failure."""

import collections
import hashlib
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftmill.operators import semantics as M
from siftmill.streaming import facets as W
from siftmill.streaming import profile as L

KIND = "id long, a double, b double, c double, name string, tag string, flag boolean, void string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    found = []
    for i in range(600):
        a = None if i % 7 == 0 else 1e6 + rng.gauss(0, 1)
        b = None if i % 5 == 0 else float("nan") if i % 11 == 0 else (a or 1e6) * -2 + rng.gauss(0, 1)
        found.append((i, a, b, 3.0, rng.choice(["x", "y", "z", None, "w" * 50]), f"t{int(rng.paretovariate(0.7)) % 90}", i % 2 == 0, None))
    return found


@pytest.fixture(scope="module")
def source(spark, rows, tmp_path_factory):
    """Nine files of different sizes, as a stream that takes one at a time."""
    folder = tmp_path_factory.mktemp("stream")
    cuts = [0, 10, 20, 150, 151, 300, 420, 421, 590, 600]
    for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[i:j], KIND).coalesce(1).write.parquet(f"file://{folder}/raw{n}")
        next((folder / f"raw{n}").glob("*.parquet")).rename(folder / f"f{n}.parquet")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/f*.parquet")


def run(stream, tmp_path, name, **facets):
    spark = stream.sparkSession
    W.facet_stream(stream, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-ck", facets).awaitTermination()
    return {f: W.parts(spark, f"file://{tmp_path}/{name}", f) for f in facets}


def test_streamed_correlations(spark, source, rows, tmp_path):
    moments = run(source, tmp_path, "pairs", pairs=W.co_moments)["pairs"]
    assert moments.select("batch").distinct().count() == 9
    got = {(r.a, r.b): (r.n, r.value) for r in W.merged_correlations(moments).collect()}
    for (i, x), (j, y) in itertools.combinations(enumerate(["id", "a", "b", "c"]), 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None and r[i] == r[i] and r[j] == r[j]]
        if y == "c":
            assert (x, y) not in got  # without spread
        else:
            assert got[x, y][0] == len(both) and math.isclose(got[x, y][1], statistics.correlation(*zip(*both)), abs_tol=1e-4)
    assert W.merged_correlations(moments.where("false")).collect() == []
    top = W.strongest_pairs(W.merged_correlations(moments)).where("sign = 'negative'").first()
    assert (top.a, top.b, top["rank"]) == ("a", "b", 1)
    again = W.merged_correlations(moments.repartition(3).orderBy(F.desc("batch"))).collect()
    assert {(r.a, r.b): (r.n, r.value) for r in again} == got


def test_streamed_values(spark, source, rows, tmp_path):
    found = run(source, tmp_path, "values", whole=lambda b: W.frequent_values(b, ["name", "tag", "void"]), few=lambda b: W.frequent_values(b, ["name", "tag"], cap=4))
    counts = {k: collections.Counter(r[at] for r in rows if r[at] is not None and len(r[at]) <= 40) for k, at in (("name", 4), ("tag", 5))}
    whole = W.merged_values(found["whole"])
    assert {(r.column, r.value): (r["count"], r.most, r.overflow) for r in whole.collect()} == {(k, v): (n, n, False) for k, c in counts.items() for v, n in c.items()}
    best = {(r.column, r["rank"]): (r.value, r["count"]) for r in W.top_values(whole).collect()}
    for k, c in counts.items():
        for place, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5], 1):
            assert best[k, place] == (v, n)
    few = W.merged_values(found["few"])
    for r in few.collect():
        assert r["count"] <= counts[r.column][r.value] <= r.most and r.overflow == (r.column == "tag")
    # The second pass settles what the parts left open.
    wanted = spark.createDataFrame(W.open_values(few, 3).collect(), "column string, value string")
    exact = run(source, tmp_path, "again", counts=lambda b: W.counts_of(b, wanted))["counts"]
    settled = {r.column for r in W.settled_columns(found["few"], few, 3).collect()}
    for r in W.top_values(few, exact, 3).where(F.col("column").isin(*settled)).collect():
        assert sorted(counts[r.column].items(), key=lambda x: (-x[1], x[0]))[r["rank"] - 1] == (r.value, r["count"])
    assert "name" in settled


def test_streamed_samples(spark, source, rows, tmp_path):
    placed = W.placed(source)
    found = run(placed, tmp_path, "samples", sample=lambda b: W.least_hashes(b, "id", 7), tail=lambda b: W.last_rows(b, "file", "row", k=7))
    drawn = sorted(range(600), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())[:7]
    assert [r.id for r in W.merged_sample(found["sample"], "id", 7).collect()] == drawn
    assert [r.id for r in W.last_rows(found["tail"], "file", "row", k=7).collect()] == list(range(599, 592, -1))
    assert W.merged_sample(found["sample"].where("false"), "id", 7).collect() == []


def test_streamed_outliers_by_two_passes(spark, source, rows, tmp_path):
    quartiles = run(source, tmp_path, "quartiles", quartiles=W.chunk_quartiles)["quartiles"]
    bounds = W.frozen_bounds(quartiles)
    held = {r.column: r for r in bounds.collect()}
    assert set(held) == {"id", "a", "b"} and held["id"].n == 600  # c has no range
    parts = {}
    for r in quartiles.collect():
        parts.setdefault(r.column, []).append(r)
    for name, r in held.items():
        assert r.q1 == sorted(p.q1 for p in parts[name])[len(parts[name]) // 2] and r.q3 == sorted(p.q3 for p in parts[name])[len(parts[name]) // 2]
    frozen = spark.createDataFrame(bounds.collect(), bounds.schema)
    outside = run(source, tmp_path, "outside", outside=lambda b: W.outside(b, frozen))["outside"]
    got = {r.column: r for r in W.merged_outliers(outside, frozen, None).collect()}
    for at, name in ((0, "id"), (1, "a"), (2, "b")):
        n = sum(not held[name].lo <= r[at] <= held[name].hi for r in rows if r[at] is not None and r[at] == r[at])
        assert (got[name].outliers if name in got else 0) == n
        assert name not in got or got[name].share == round(n / held[name].n, 4)
    none = W.outside(spark.createDataFrame(rows, KIND), frozen.where("false"))
    assert none.collect() == [] and W.merged_outliers(none, frozen).collect() == []


def test_streamed_kinds_and_variation(spark, source, tmp_path):
    found = run(source, tmp_path, "kinds", moments=L.partial_profile, values=lambda b: W.frequent_values(b, ["name", "tag", "void"]))
    profile, values = L.merged_profile(found["moments"]), W.merged_values(found["values"])
    kinds = {r.column: r.bucket for r in W.streamed_kinds(source.schema, profile, values).collect()}
    assert kinds == {"id": "numeric", "a": "numeric", "b": "numeric", "c": "numeric", "name": "categorical", "tag": "categorical", "flag": "boolean", "void": "categorical"}
    small = {r.column: r.bucket for r in W.streamed_kinds(source.schema, profile, values, cap=10).collect()}
    assert small["tag"] == "text" and small["name"] == "categorical"
    ranked = [r.column for r in W.by_variation(profile).orderBy("rank").collect()]
    assert ranked[0] == "id" and ranked[-1] == "c"


def test_a_batch_that_runs_again_replaces_its_part(spark, rows, tmp_path):
    """The callback of a batch may be called twice; the state holds it once."""
    df = spark.createDataFrame(rows[:50], KIND)
    state = f"file://{tmp_path}/state"
    for _ in range(2):
        W.frequent_values(df, ["tag"]).write.mode("overwrite").parquet(f"{state}/values/batch=0")
    merged = W.merged_values(W.parts(spark, state, "values"))
    assert merged.agg(F.sum("count")).first()[0] == 50


def test_names_of_streams(spark):
    names = lambda xs: spark.createDataFrame(list(enumerate(xs)), "position int, column string")
    bands = {r.column: r.band for r in M.streamed_bands(names(["user_id", "price", "colour", "total_code"])).collect()}
    assert bands == {"user_id": "low", "price": "high", "colour": "mid", "total_code": "low"}
    domain = lambda xs: tuple(M.streamed_domain(names(xs)).first())
    assert domain(["value", "sensor", "x"]) == ("iot_telemetry", 0.6, ["sensor", "value"]) and domain(["value", "order"])[0] == "business" and domain(["values"]) == ("general", 0.0, [])
