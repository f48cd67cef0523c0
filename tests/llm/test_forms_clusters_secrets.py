"""Fill-in-the-middle, Yinyang clusters, secret scans and stored folders against brute force."""

import hashlib
import math
import random
import re
import threading

import numpy as np
import pytest

from siftmill.llm import fim, queries, secrets, shared, yinyang

DATA = "/root/testdata/sf0.001"
LINES = re.compile(r"[^\n]*\n|[^\n]+")


# Fill-in-the-middle


def plain_fim(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = LINES.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if four % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ranked_bits_and_lines():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab\n\n\ré😀x ") for _ in range(rng.randrange(40)))
        data, units = text.encode(), LINES.findall(text)
        starts, leads = fim.line_starts(data), fim.class_mask(data, fim._LEAD)
        assert starts.bit_count() == len(units)
        for k in range(len(units) + 2):
            at = fim.ranked_bit(starts, k, len(data))
            assert at == len("".join(units[:k]).encode()) and fim.chars_before(leads, at) == len("".join(units[:k]))


def test_rearranged_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "é", "\n", "\n\n", "<", "<P", "S>", "<M"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [
        (None, "one\ntwo\nthree", "x"), (None, None, "x"), (900, None, "x"), (901, "", "x"), (902, "has <S> mark\n", "x"), (903, "\n", "x"), (904, "\n\n\n", "x"),
        (905, "line é😀\n" * 60_000, "x"), (906, "x" * 300_000, "x"), (907, "same\nrow\n", "x"), (907, "same\nrow\n", "x"), (907, "other\n", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    made = fim.rearranged(df)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r)[:2] + tuple(r)[2:7] + (r.restored,) for r in fim.restored(made).collect()), key=str)
    assert got == sorted(((i, t, *plain_fim(i, t), t or "") for i, t, _ in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    part = {(r.doc_id, r.form) for r in fim.rearranged(df.where("doc_id < 120"), rate=40, spm=0).collect()}
    assert part == {(i, plain_fim(i, t, 40, 0)[1]) for i, t, _ in rows[:120]} and {f for _, f in part} == {"plain", "psm"}
    assert fim.restored(fim.rearranged(df.where("false"))).collect() == []


def test_marks_and_broken_outputs(spark):
    for bad in (("<P>", "<P>>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError, match="marks"):
            fim.Marks(*bad)
    broken = spark.createDataFrame([("<P>no suffix<M>", "psm")], "output string, form string")
    with pytest.raises(Exception, match="lacks a mark"):
        fim.restored(broken).collect()
    assert [r.restored for r in fim.restored(spark.createDataFrame([(None, "plain"), ("t", None)], "output string, form string")).collect()] == ["", "t"]


# Clusters


def plain_clusters(rows, k, rounds):
    taken = [(i, [math.floor(float(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 1024 < yinyang.LIMIT for x in v)]
    taken.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    if not taken:
        return []
    v = np.array([x for _, x in taken], "int64")
    c = v[:k].copy()
    for turn in range(rounds + 1):
        d = np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
        a = d.argmin(axis=1)
        for j in range(len(c)) if turn < rounds else ():
            if (a == j).any():
                c[j] = [int(x) // int((a == j).sum()) for x in v[a == j].sum(axis=0)]
    best = d.min(axis=1)
    return sorted(((taken[i][0], int(a[i]), int(best[i]), int(best[a == a[i]].sum()), int(best.sum()), c[a[i]].tolist()) for i in range(len(taken))), key=str)


@pytest.mark.parametrize("k,rounds,groups", [(8, 10, None), (8, 3, 8), (25, 12, 5), (3, 0, 1)])
def test_clusters_equal_the_plain_algorithm(spark, k, rounds, groups):
    """Blobs, ties on a coarse lattice, repeated rows and ids, and rows that take no part."""
    rng = np.random.default_rng(k)
    blobs = rng.normal(0, 1, (6, 64))[rng.integers(0, 6, 300)] + rng.normal(0, 0.2, (300, 64))
    lattice = rng.integers(-1, 2, (200, 64)) / 512
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([blobs, lattice]))]
    rows += rows[:40] + [(5, [0.0] * 64), (7, [0.25] * 64), (None, [1.0] * 64), (None, [60000.0] * 64)]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [None] + [0.0] * 63), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (7, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = yinyang.clusters(df, k=k, rounds=rounds, groups=groups).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows + odd, k, rounds)


def test_clusters_of_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    none = yinyang.clusters(spark.createDataFrame([], kind))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    same = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [0.5] * 64)], kind)
    assert [(r.cluster, r.distance, r.inertia) for r in yinyang.clusters(same).collect()] == [(0, 0, 0)] * 3


def test_bounds_save_most_distances():
    """The filters work: on separated blobs later rounds compute far fewer distances than rows times centroids."""
    rng = np.random.default_rng(4)
    heads = rng.integers(-4000, 4000, (16, 64))
    v = heads[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 64))
    centroids = heads + rng.integers(-200, 200, heads.shape)
    group = yinyang.grouped(centroids, 4)
    cluster, best, lower = yinyang.scanned(v, centroids, group)
    then = centroids + rng.integers(-20, 20, centroids.shape)
    found, _, _, cost = yinyang.moved(v, cluster, np.sqrt(best.astype("float64")), lower, then, centroids, group)
    assert (found == np.stack([yinyang.squared(v, c) for c in then], axis=1).argmin(axis=1)).all()
    assert cost < 0.2 * len(v) * len(centroids)


# Secrets


def plain_spans(text):
    base = []
    for kind, pattern, flags, group, least in (("assign", secrets.ASSIGN, re.A | re.I, 2, 8), ("access", secrets.ACCESS, re.A, 0, 16), ("hex", secrets.HEX, re.A, 0, 32)):
        base += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return base


def all_ways(value, known):
    """The least cost over every segmentation, each segment judged by itself."""
    low, best = value.lower(), [0.0] + [math.inf] * len(value)
    plain, keys = low.translate(secrets._SWAPS), low.translate(secrets._SHIFTED)
    key_at = {c: (2 * x + o, y) for y, (row, o) in enumerate(zip(secrets._ROWS, (0, 3, 4, 5))) for x, c in enumerate(row)}
    around = {(2, 0), (-2, 0), (1, 1), (-1, -1), (-1, 1), (1, -1)}

    def steps(i, j, way, cost):
        ways = [way(t) for t in range(i + 1, j)]
        if None in ways or not ways:
            return math.inf
        return cost + sum(secrets.KEEP if n and w == ways[n - 1] else secrets.TURN for n, w in enumerate(ways))

    def key_step(t):
        a, b = key_at.get(keys[t - 1]), key_at.get(keys[t])
        return (b[0] - a[0], b[1] - a[1]) if a and b and (b[0] - a[0], b[1] - a[1]) in around else None

    def run_step(t):
        a, b = value[t - 1], value[t]
        alike = a.isascii() and b.isascii() and (a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha())
        return ord(b) - ord(a) if alike and abs(ord(b) - ord(a)) == 1 else None

    for j in range(1, len(value) + 1):
        for i in range(j):
            costs = [secrets.brute(value[i])] if j == i + 1 else []
            if j - i >= 3:
                costs.append(secrets.SEGMENT + secrets.word_bits(value[i:j], low[i:j], plain[i:j], known))
            if secrets._DATE.fullmatch(value[i:j]):
                costs.append(secrets.SEGMENT + (secrets.YEAR if j - i == 4 else secrets.DATE))
            if any(all(value[t] == value[t - b] for t in range(i, j)) for b in range(1, min(secrets.COPIES, i) + 1)):
                costs.append(secrets.SEGMENT + secrets.BACK)
            if j - i >= 2:
                shifted = sum(0.5 for t in range(i, j) if value[t] != keys[t])
                costs.append(steps(i, j, key_step, secrets.SEGMENT + secrets.START + shifted))
                costs.append(steps(i, j, run_step, secrets.SEGMENT + secrets.START))
            best[j] = min([best[j], *(best[i] + c for c in costs)])
    return best[-1]


def test_guess_costs_equal_all_segmentations():
    rng = random.Random(3)
    known = secrets.ranked(secrets.WORDS)
    longest = max(map(len, known))
    parts = ["qwerty", "QweASD", "abcd", "4321", "2024-03-17", "17.03.1999", "1987", "password", "P@ssw0rd", "dragon", "aaaa", "xyxyxy", "!Q@W", "#", "é", "7", "Zk", "zxcv", "W1nter"]
    for _ in range(300):
        value = "".join(rng.choice(parts) if rng.random() < 0.7 else rng.choice("aB3$_") for _ in range(rng.randrange(1, 6)))
        assert math.isclose(secrets.guess_bits(value, known, longest), all_ways(value, known), abs_tol=1e-9), value
    cost = lambda v: secrets.guess_bits(v, known, longest)
    assert cost("password") < cost("P@ssw0rd") < cost("dragon1987qwerty") < secrets.LEAST_BITS < cost("vR7#qLz!0pTw")
    assert cost("ab" * 50_000) < 20


def test_scanned_texts(spark):
    rng = random.Random(5)
    parts = ["password: ", "TOKEN=", "api_key = '", "apikey\"  : \"", "secret", "=", " ", "é", "AKIA", "ABCDEF012345XYZ9", "deadbeef" * 4, "abc", "0123456789abcdef", "\n", "ſecret=", "toKen:", "hunter2hunter", "Key"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [
        (900, None, "x"), (901, "", "x"), (None, "token = abcdefgh1", "x"), (902, "word " * 50_000 + "token=abcdefgh", "x"), (903, "pwd => 'vR7#qLz!0pTw'", "x"), (903, "pwd => 'vR7#qLz!0pTw'", "x"),
        (904, "db: postgres://bob:Xk29!vbQr77z@host/db", "x"), (905, "password = summer2023 pwd: qwerty", "x"), (906, "😀 pwd: \"kT5&mW9!xR2^pL\" end", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = secrets.scanned(df).collect()
    assert len(got) == len(rows)
    for r in got:
        found = [(s.start, s.end, s.kind) for s in r.spans]
        assert found == sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert sorted(s for s in found if s[2] != "guess") == sorted(plain_spans(r.text or ""))
    by_id = {r.doc_id: [(s.kind, (r.text or "")[s.start : s.end]) for s in r.spans] for r in got}
    assert by_id[900] == by_id[901] == [] and by_id[None] == [("assign", "token = abcdefgh1")]
    assert by_id[903] == [("guess", "vR7#qLz!0pTw")] and by_id[904] == [("guess", "Xk29!vbQr77z")] and by_id[906] == [("guess", "kT5&mW9!xR2^pL")]
    assert by_id[905] == [("assign", "password = summer2023")]
    assert secrets.scanned(df.where("false")).collect() == []
    clean = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert clean[903] == "pwd => '[secret]'" and clean[906] == "😀 pwd: \"[secret]\" end" and clean[900] is None and clean[901] == ""
    assert secrets.redacted(df).columns == df.columns


def test_secret_query_digests(spark):
    rows = {r.doc_id: r for r in queries.op13_secrets(spark, DATA).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        base = sorted(plain_spans(text), key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert set(said.split(",")) - {""} <= set(rows[i].spans.split(","))


# Stored folders


def test_swept_blocks_own_their_folders(spark):
    """Another thread's tables, and an outer block's, outlive a block; an exception deletes as well."""
    ready, left, kept = threading.Event(), threading.Event(), {}

    def other():
        kept["table"] = shared.stored(spark.range(5))
        ready.set()
        left.wait(60)
        kept["rows"] = kept["table"].count()

    with shared.swept(spark):
        outer = shared.stored(spark.range(3))
        with pytest.raises(ZeroDivisionError), shared.swept(spark):
            thread = threading.Thread(target=other)
            thread.start()
            assert ready.wait(60)
            inner = shared.stored(spark.range(7))
            assert inner.count() == 7
            1 / 0
        left.set()
        thread.join()
        assert kept["rows"] == 5 and outer.count() == 3
        with pytest.raises(Exception):
            inner.count()
    assert kept["table"].count() == 5
    with pytest.raises(Exception):
        outer.count()
