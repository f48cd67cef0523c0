"""Classifiers on held-out rows, URL verdicts, and top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from siftmill.llm import features, quality, topk, toxicity, urlfilter


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(3000):
        grade = int(rng.integers(0, 4))
        bad = rng.choice(20, size=2 * grade, replace=False) if grade else []
        rows.append(dict.fromkeys([*map(int, bad), *map(int, rng.integers(20, 400, 30))], 1.0))
        grades.append(grade)
    grades = np.array(grades)
    model = toxicity.fit_ordinal(features.Rows.of(rows[:2000]), grades[:2000], 512)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 3
    found = model.expected(features.Rows.of(rows[2000:]).dot(model.weights))
    assert np.corrcoef(found, grades[2000:])[0, 1] > 0.95
    assert (np.abs(found - grades[2000:]) < 0.6).mean() > 0.9


def test_severity_of_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = [f"w{rng.randrange(300)}" for _ in range(40)]
        grade = i % 3
        text[5 : 5 + grade] = ["vile", "Vicious!"][:grade]
        rows.append((i, " ".join(text), grade if i < 300 else None, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    extra = spark.createDataFrame([(900, None, None, "x"), (901, "", None, "x"), (None, "vile vicious", None, "x"), (902, "fine " * 60_000, None, "x")], df.schema)
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.severity(df.union(extra), labels).collect()}
    assert len(got) == 404
    assert np.mean([got[i].grade == i % 3 for i in range(300, 400)]) > 0.9
    assert got[None].expected_severity > 1.0 > got[902].expected_severity
    assert got[900].expected_severity == got[901].expected_severity
    bare = toxicity.severity(df, labels.where("false")).collect()
    assert len(bare) == 400 and max(r.expected_severity for r in bare) < 1e-6
    assert toxicity.severity(df.where("false"), labels).collect() == []


def brute_ordinal(rows, grades, dims, l2=3e-5, steps=2500, rate=2.0):
    """The same penalised likelihood, row by row in plain Python numbers, down the slope of finite differences' exact form."""
    top = max(grades)
    w, t = [0.0] * dims, [float(k) for k in range(top)]
    sig = lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    for _ in range(steps):
        gw, gt = [l2 * x for x in w], [0.0] * top
        for row, y in zip(rows, grades):
            s = sum(w[i] * v for i, v in row.items())
            upper, lower = (1.0 if y == 0 else sig(s - t[y - 1])), (0.0 if y == top else sig(s - t[y]))
            mass, up, down = max(upper - lower, 1e-12), upper * (1 - upper), lower * (1 - lower)
            for i, v in row.items():
                gw[i] -= (up - down) / mass * v / len(rows)
            if y > 0:
                gt[y - 1] += up / mass / len(rows)
            if y < top:
                gt[y] -= down / mass / len(rows)
        w, t = [a - rate * b for a, b in zip(w, gw)], [a - rate * b for a, b in zip(t, gt)]
    return w, t


def test_ordinal_fit_equals_a_plain_one():
    """Scores of a fit by hand on a small sample in which every word tells."""
    rng = random.Random(12)
    rows, grades = [], []
    for _ in range(300):
        y = rng.randrange(3)
        rows.append({0: 1.0} | ({1: 1.0} if rng.random() < (0.1, 0.5, 0.9)[y] else {}) | ({2: 1.0} if rng.random() < (0.8, 0.4, 0.1)[y] else {}))
        grades.append(y)
    all_rows = features.Rows.of(rows)
    told = toxicity.telling(all_rows, np.array(grades), 3)
    model = toxicity.fit_ordinal(all_rows, np.array(grades), 3, steps=3000, rate=0.05)
    w, t = brute_ordinal([{i: v for i, v in r.items() if told[i]} for r in rows], grades, 3)
    mine = model.expected(all_rows.dot(model.weights))
    theirs = [sum(1 / (1 + math.exp(-(sum(w[i] * v for i, v in r.items() if told[i]) - x))) for x in t) for r in rows]
    assert told[1] and told[2] and np.abs(mine - theirs).max() < 0.02


def test_models_of_repeated_rows(spark):
    """Rows that repeat each keep a row, and their score."""
    df = spark.createDataFrame([(i, f"word{i % 7} plain text number {i}" + " vile" * (i % 2)) for i in range(80)], "doc_id long, text string")
    labels = df.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic", "CAST((doc_id + 1) % 2 AS INT) AS quality")
    twice = df.union(df.where("doc_id < 10"))
    for found, score in ((toxicity.severity(twice, labels), "expected_severity"), (quality.quality_scores(twice, labels), "score")):
        rows = [(r.doc_id, r[score]) for r in found.collect()]
        assert len(rows) == 90 and len(set(rows)) == 80


def test_class_prior_and_risk():
    rng = np.random.default_rng(3)
    good = rng.normal(1.5, 0.7, 4000)
    bad = rng.normal(-1.5, 0.7, 2000)
    assert abs(quality.class_prior(good[:2000], np.concatenate([good[2000:], bad])) - 0.5) < 0.06
    as_rows = lambda x: features.Rows.of({0: float(v), 1: 1.0} for v in x)
    weights, prior = quality.fit_pu(as_rows(good[:2000]), as_rows(np.concatenate([good[2000:], bad])), 2)
    assert 0.4 < prior < 0.56
    assert (good * weights[0] + weights[1] > 0).mean() > 0.95 and (bad * weights[0] + weights[1] > 0).mean() < 0.06
    assert quality.fit_pu(as_rows([]), as_rows(bad), 2)[1] == 0.5


def test_quality_of_held_out_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(rng.randrange(20, 80))]
        good = i % 4 != 0
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words), int(good), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")
    labels = df.select("doc_id", "quality").where("doc_id < 400")
    extra = spark.createDataFrame([(900, None, None, "x"), (901, "", None, "x"), (None, "ban lar", None, "x"), (902, "tam " * 60_000, None, "x")], df.schema)
    got = {r.doc_id: r for r in quality.quality_scores(df.union(extra), labels).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in range(400, 600)]) > 0.97
    assert got[900].score == got[901].score
    kept = {r.doc_id for r in quality.keep_good(df, labels).collect()}
    assert kept == {i for i in range(600) if got[i].predicted}
    assert {r.score for r in quality.quality_scores(df, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(df.where("false"), labels).collect() == []


RULES = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/")]


def test_url_verdicts(spark):
    urls = {
        1: ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), 2: ("https://example.org", "example.org", "", None, "allow"),
        3: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), 4: ("x://m.com/de/1", "m.com", "/de/1", "com/de/", "block"),
        5: (None, "", "", None, "allow"), 6: ("no scheme", "", "", None, "allow"), 7: ("http://www.bad.net/p/?b=2&a=1&ref=z#t", "www.bad.net", "/p/", None, "block"),
        8: ("https://BAD.net/p?a=1&b=2", "bad.net", "/p", None, "block"), 9: ("https://bad.net/p?a=1", "bad.net", "/p", None, "allow"), 10: ("", "", "", None, "allow"),
        11: ("http://h.net\n/a", "h.net\n", "/a", None, "allow"), 12: ("http://a://b/c", "a:", "//b/c", None, "allow"), 13: ("http://xcom/fr/", "xcom", "/fr/", None, "allow"),
    }
    df = spark.createDataFrame([(i, u[0], "x") for i, u in urls.items()], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.net/p?b=2&a=1",), ("http://bad.net/p?b=2&a=1",), (None,), ("junk",)], "url string")
    got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_verdicts(df, listed, RULES).collect()}
    assert got == urls
    assert urlfilter.url_verdicts(df.union(df), listed.where("false"), RULES).where("listed").count() == 0
    assert urlfilter.url_verdicts(df.where("false"), listed, RULES).collect() == []


def test_no_listed_url_is_missed(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.net/', id) AS url")
    got = urlfilter.url_verdicts(df, df.where("page_id % 3 = 0").select("url"), [])
    assert got.where("(verdict = 'block') != (page_id % 3 = 0)").count() == 0


def brute_top(rows, queries, k):
    """rows: (id, vector), each a candidate but for the query's own row."""
    rows, out = list(rows), []
    for n, (q, own) in enumerate(rows):
        if q in queries:
            scores = sorted(((int(np.dot(own, v)), -i) for m, (i, v) in enumerate(rows) if m != n and len(v) == len(own)), reverse=True)[:k]
            out += [(q, r, -i, s) for r, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_top_k_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 24)  # 21 blocks: three waves
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(5)
    values = {i: (rng.normal(size=12) * spread).astype("float32").tolist() for i in range(400)}
    values |= {i + 400: values[i] for i in range(0, 90)} | {600: [1.0] * 5, 700: [0.5] * 5, 800: [0.0] * 12}
    bad = [(900, None), (1000, [None] * 12), (1100, [float("nan")] * 12), (1200, [float("inf")] * 12), (None, [0.0] * 12)]
    df = spark.createDataFrame([*values.items(), *bad, (5, values[5])], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS rank")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0"), k=7).collect()))
    whole = [(i, np.floor(np.array(v, "float64") * 1024).astype("int64")) for i, v in [*values.items(), (5, values[5])]]
    assert got == sorted(brute_top(whole, {i for i in values if i % 10 == 0}, 7))
    assert topk.top_k(df.where("false"), df).collect() == [] and topk.top_k(df, df.where("false")).collect() == []


def test_top_k_of_ids_that_repeat(spark):
    """Every row is a candidate but the query's own: rows of one id with other vectors, and copies of the query."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 2")).collect())
    assert got == [(2, 1, 1, 3 * 1024**2), (2, 2, 1, 3 * 1024**2), (2, 3, 1, 2 * 1024**2)]
    both = sorted((r.rank, r.vec_id, r.score // 1024**2) for r in topk.top_k(df, df.where("vec_id = 1")).collect())
    assert both == sorted([(1, 2, 2), (2, 1, 0), (3, 1, 0), *[(1, 2, 3), (2, 1, 1), (3, 1, 0)] * 2])
    few = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 2"), k=1).collect())
    assert few == [(2, 1, 1)]


def test_top_k_of_equal_scores(spark, monkeypatch):
    """Zero queries tie with everything: no more than k rows of each block leave a task."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [0.0] * 6 if i % 3 == 0 else rng.normal(size=6).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0"), k=4).collect()))
    whole = {i: np.floor(np.array(v) * 1024).astype("int64") for i, v in rows}
    assert got == sorted(brute_top(whole.items(), {i for i in whole if i % 10 == 0}, 4))
    zero, vectors = np.zeros((1, 6), "int64"), np.array(list(whole.values()))
    assert len(topk.first_of_ties(4, *topk.best_of_block(zero, vectors, 4, [None], [np.zeros(0, "int64")]))[0]) == 4


def exact(vectors, queries, k, floors):
    out = set()
    for i, q in enumerate(queries.tolist()):
        scores = [sum(a * b for a, b in zip(q, v)) for v in vectors.tolist()]
        least = max(sorted(scores)[-k], -(10**30) if floors[i] is None else floors[i])
        out |= {(i, j, s) for j, s in enumerate(scores) if s >= least}
    return out


@pytest.mark.parametrize("size", [1, 10**9, 10**17])
def test_lists_give_whole_scores(size):
    """Ties, zeros, floors; numbers beyond doubles too."""
    rng = np.random.default_rng(7)
    for n, dims in ((1, 3), (40, 5), (300, 8)):
        vectors, queries = (rng.integers(-3, 4, (m, dims)) * size for m in (n, 6))
        if size > 10**9:
            queries = queries // size
        queries[0] = 0
        floors = [None, None, 0, 5 * size, None, 10**18]
        i, j, s, _ = topk.best_of_block(queries, vectors, min(4, n), floors, [np.zeros(0, "int64")] * 6)
        assert set(zip(i.tolist(), j.tolist(), map(int, s))) == exact(vectors, queries, min(4, n), floors)


def test_reading_stops_early_where_bounds_allow():
    """Where a few vectors lead in all lists, a small part of these is read; a floor saves more."""
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.pareto(1.0, (5000, 1)) * rng.uniform(80, 120, (5000, 4))).astype("int64")
    queries = np.array([[5, 5, 5, 5], [1, 0, 0, 0]])
    none = [np.zeros(0, "int64")] * 2
    i, j, s, read = topk.best_of_block(queries, vectors, 5, [None, None], none)
    assert set(zip(i.tolist(), j.tolist(), map(int, s))) == exact(vectors, queries, 5, [None, None])
    assert read < 0.05 * (4 + 1) * 5000
    high = int(5 * vectors.sum(axis=1).max() + 1)
    assert topk.best_of_block(queries[:1], vectors, 5, [high], none)[3] <= 4 * 5000 // topk.FIRST
