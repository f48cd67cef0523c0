"""The numbered queries and the pipeline on the smallest tables, against oracles and brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from siftmill.llm import bpe, queries, toxicity
from tests.llm.test_text_dedup import brute_components, brute_fingerprint, brute_lines, brute_overlaps, brute_resemblance

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def library():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, tmp_path, name):
    queries.QUERIES[name](spark, DATA).write.parquet(f"file://{tmp_path}/q")
    duck.execute(f"CREATE OR REPLACE TABLE g AS SELECT * FROM '{tmp_path}/q/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE o AS {queries.ORACLE_SQL[name]}")
    names = sorted(r[0] for r in duck.execute("DESCRIBE g").fetchall())
    assert names == sorted(r[0] for r in duck.execute("DESCRIBE o").fetchall())
    cols = ", ".join(f'"{n}"' for n in names)
    assert duck.execute(f"(SELECT {cols} FROM g EXCEPT ALL SELECT {cols} FROM o) UNION ALL (SELECT {cols} FROM o EXCEPT ALL SELECT {cols} FROM g)").fetchall() == []


def test_op1_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, DATA).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    components = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", components[i]) for i in fps}


def test_op4_and_op9_equal_the_libraries(spark, texts):
    from tokenizers import Tokenizer

    own = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_byte_bpe(spark, DATA).collect()}
    for i, t in texts.items():
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, rows = 0, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_output(spark, DATA).collect()}
    for i in sorted(texts):
        ids = [*words.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert rows[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10_is_right_on_held_out_rows(spark, duck):
    rows = queries.op10_quality(spark, LARGER).collect()
    labels = dict(duck.execute(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and np.mean(judged) > 0.95


def test_op5_ranks_toxic_texts_first_on_held_out_rows(spark, duck):
    """Fitted on two thirds of the labels, measured on the others."""
    labels = dict(duck.execute(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet'").fetchall())
    docs, marks = (queries.table(spark, LARGER, n) for n in ("documents", "labels"))
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [r for r in toxicity.severity(docs, queries.learned(marks)).collect() if r.doc_id in held]
    toxic, clean = ([r.expected_severity for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.8


def test_op6_equals_brute_force_alignment(spark, duck, texts):
    """Every alignment of every document with every item, and hence passages that are contained whole."""
    got = {r.doc_id: r.n_items for r in queries.op6_decontamination(spark, DATA).collect()}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = {}
    for i, t in duck.execute("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall():
        items.setdefault(words(t), i)
    found = brute_overlaps({d: words(t) for d, t in texts.items()}, {i: t for t, i in items.items()})
    assert got == {d: sum(x == d for x, _ in found) for d, _ in found} and got
    assert {d for d, t in texts.items() if any(b in words(t) for b in items)} <= set(got)


def test_all_queries_of_the_subpackage_register():
    import __spark_entry__

    named = {n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()}
    assert len(named) == 13 and named == set(queries.QUERIES) and "pipeline" in __spark_entry__.queries()


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = queries_stored(stage(spark, docs, DATA))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        kept.append((before, after))
        if name == "line dedup":
            expected = {i: t for i, t in brute_lines(before, 50).items() if t.strip(" \n") or not (before[i] or "").strip(" \n")}
            assert after == expected
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "SimHash near-dedup":  # the stage's own contract: five words, a similarity of 0.8
            assert set(after) == set(brute_resemblance(before).values())
    assert [len(a) <= len(b) for b, a in kept] == [True] * 4 and kept[-1][1]
    last = {r.doc_id: r for r in pipeline.STAGES[4][1](spark, docs, DATA).collect()}
    own = library()
    assert {i: list(r.ids) for i, r in last.items()} == {i: own.encode_ordinary(t) for i, t in kept[-1][1].items()}
    assert all(r.decoded_sha256 == hashlib.sha256(kept[-1][1][i].encode()).hexdigest() for i, r in last.items())
    assert {r.doc_id for r in pipeline.run(spark, DATA).select("doc_id").collect()} == set(last)


def queries_stored(df):
    from siftmill.llm.shared import stored

    return stored(df)


def test_stages_stand_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, an empty table."""
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, "en", None, 0), (10**9 + 1, "", None, "s", None), (10**9 + 2, "x " * 60_000, "en", "s", 7)], base.schema)
    for docs in (base.limit(60).union(odd).union(odd), base.where("false")):
        for _, stage in pipeline.STAGES:
            docs = queries_stored(stage(spark, docs, DATA))
        docs.count()
