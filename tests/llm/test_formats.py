"""WARC, tokenizers, token archives: exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftmill.llm import bpe, grammar, warc

ODD = [
    None, "", " ", "  two  spaces ", "a\n b", "tab\tand\u00a0nbsp", "it's WE'LL 'S don't", "x" * 3000, "日本語 テキスト", "e\u0301 \u0301 x\u0301", "<|endoftext|> <|startoftext|>x", "\u2028line\x1csep\x85nel",
    "ÀÉß ÿ × ÷ ª º ² ½", "İstanbul ΣΑΣ ǅ", "12 3456 7.8", "__init__ a_b", "emoji 😀👩‍👩‍👧 ok", "\r\n\r\n", "word " * 2000, "trailing\n", "\u200bzero\u200b width", "ends with space ", "a  b\u3000c",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    alphabet = "abc de fg.,!?'\n\té É1 2_-"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(60)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, bucket int").repartition(3)


def test_byte_bpe_equals_the_library(spark, texts, monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK", 2000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = bpe.decode(bpe.encode(frame(spark, texts), path, public_tokenizers.PATTERN), path).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}
    both = bpe.round_trip(frame(spark, texts), path, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in both} == {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in rows}
    wrong = spark.sql("SELECT array(1, 60000) AS ids")
    with pytest.raises(Exception, match="isn't in the vocabulary"):
        bpe.decode(wrong, path).collect()


def test_byte_bpe_of_other_patterns_and_many_buckets(spark, texts, monkeypatch):
    """A pattern whose matches may hold spaces gets texts whole; buckets follow the size of the input."""
    import tiktoken

    monkeypatch.setattr(bpe, "BUCKET", 2000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for pattern in (r"\w+ \w+|\s+|\S+", public_tokenizers.PATTERN):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        rows = bpe.round_trip(frame(spark, texts), path, pattern).collect()
        assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert bpe.cuts_at_spaces(bpe.splitter(public_tokenizers.PATTERN)) and not bpe.cuts_at_spaces(bpe.splitter(r"\w+ \w+|\s+|\S+"))


def test_byte_bpe_rows_stay_in_proportion_to_blocks(spark, texts, monkeypatch):
    """However much text there is: no more rows a block than buckets, and no more words held than KEPT."""
    import tiktoken

    for name, value in (("BUCKET", 500), ("BUCKETS", 6), ("KEPT", 16)):
        monkeypatch.setattr(bpe, name, value)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    seen = []
    split = bpe.split_blocks
    monkeypatch.setattr(bpe, "split_blocks", lambda df, i, t, p, buckets: seen.append(split(df, i, t, p, buckets)) or seen[-1])
    rows = bpe.round_trip(frame(spark, texts), path, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    per = seen[0].groupBy("block").count().collect()
    assert len(per) == 3 and max(r["count"] for r in per) <= 7


def test_byte_bpe_of_null_ids_repeated_rows_and_no_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = bpe.encode(df, path, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1] and len({tuple(r.ids) for r in rows}) == 1
    assert bpe.encode(df.where("false"), path, public_tokenizers.PATTERN).collect() == []


def test_token_archive_equals_the_library(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    grammar.write_tokens(frame(spark, texts), f"file://{tmp_path}/a", path)
    rows = grammar.read_tokens(spark, f"file://{tmp_path}/a").collect()
    starts = np.cumsum([0, *map(len, expected)]).tolist()
    assert {r.doc_id: (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in rows} == {i: (starts[i], len(x), x) for i, x in enumerate(expected)}
    some = grammar.read_tokens(spark, f"file://{tmp_path}/a", [3, 17, 999]).collect()
    assert {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in some} == {i: (starts[i], expected[i]) for i in (3, 17)}
    assert spark.read.parquet(f"file://{tmp_path}/a").agg(F.sum(F.size("left"))).first()[0] > 0


def test_token_archive_of_many_parts_and_repeated_rows(spark, tmp_path, monkeypatch):
    """Files follow the bytes of text; rows that repeat each have their place."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(grammar, "PART", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i // 3, f"words of text number {i // 3} again and again " * 3) for i in range(300)]
    grammar.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/m", path)
    assert spark.read.parquet(f"file://{tmp_path}/m").select("part").distinct().count() > 10
    ids = [library.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in grammar.read_tokens(spark, f"file://{tmp_path}/m").collect())
    assert got == [(starts[k], i, len(ids[k]), ids[k]) for k, (i, _) in enumerate(rows)]


def test_token_archive_of_no_rows_and_null_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "a b"), (4, None), (2, "c"), (2, "d")], "doc_id long, text string")
    rows = grammar.round_trip(df, path).collect()
    assert sorted((r.start, r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0, 3), (3, 2, 2), (5, 2, 2), (7, 4, 1)]
    assert grammar.round_trip(df.where("false"), path).collect() == []


def brute_pairs(symbols, each):
    """Non-overlapping occurrences of the most frequent pair inside documents."""
    counts, at = {}, 0
    for k in each.tolist():
        before = None
        for i in range(at, at + k - 1):
            pair = (int(symbols[i]), int(symbols[i + 1]))
            if pair == before:  # the one before took this pair's left symbol
                before = None
                continue
            counts[pair] = counts.get(pair, 0) + 1
            before = pair if pair[0] == pair[1] else None
        at += k
    return max(counts.values(), default=0)


@pytest.mark.parametrize("base", [50, 60_000, 1 << 25])
def test_grammars_expand_to_what_they_were(base, monkeypatch):
    """Exact, and no pair is left that occurs LEAST times: random ids, repeats, runs of one id, passages."""
    monkeypatch.setattr(grammar, "LEAST", 3)
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 40, 300)
    cases = [rng.integers(0, 4, n) for n in (0, 1, 2, 50)] + [np.tile(rng.integers(0, 30, 100), 50), np.zeros(777, "int64"), np.concatenate([np.concatenate([passage, rng.integers(0, 40, 30)]) for _ in range(9)])]
    for ids in cases:
        n = len(ids)
        sizes = np.array([n // 3, 0, n - n // 3])
        symbols, each, left, right, lengths = grammar.compress(ids, sizes, base)
        ends = np.cumsum(each)
        parts = [grammar.expand(symbols[b - k : b], base, left, right, lengths).tolist() for b, k in zip(ends, each)]
        bounds = np.cumsum(sizes)
        assert parts == [ids[b - k : b].tolist() for b, k in zip(bounds, sizes)]
        assert [len(grammar.expand(np.array([base + i]), base, left, right, lengths)) for i in range(len(left))] == lengths.tolist()
        assert brute_pairs(symbols, each) < 3
        assert n < 5000 or len(symbols) < n / 20


def test_documents_longer_than_a_shard(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(grammar, "SHARD", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["short one", "word and more " * 900, None, "again " * 200]
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in grammar.round_trip(frame(spark, texts), path).collect()}
    library = Tokenizer.from_file(path)
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_other_tokenizer_files_get_texts_whole(tmp_path, texts):
    from tokenizers import Tokenizer

    import pyarrow as pa

    path = tmp_path / "other.json"
    held = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held.normalizer = None
    held.save(str(path))
    other = grammar.WordEncoder(str(path))
    assert other.whole and not grammar.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).whole
    assert [x.tolist() for x in other.encode(pa.array(texts), 1)] == [held.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_warc_round_trip(spark, tmp_path):
    same, hidden = "s" * 150, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1"
    pages = {1: "short", 2: same, 3: same, 4: None, 5: "", 6: hidden * 40, 7: "é" * 5000, 8: same, 9: "short", 10: "WARC/1.1\r\n\r\n", 11: hidden * 40, 12: "\r\n\r\n" * 100, 13: "WARC/1.1" * 60, 14: "ends\r\n\r\nWARC/1.1"}
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "z", 0) for i, h in pages.items()], "page_id long, url string, html string, data string, chunk_no int")
    path = f"file://{tmp_path}/w"
    warc.write_archive(df.repartition(2), path, size=64)
    chunks = warc.read_archive(spark, path)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 64
    got = {r.record_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.verified_records(chunks).collect()}
    first = {3: 2, 8: 2, 11: 6}
    data = {i: (h or "").encode() for i, h in pages.items()}
    assert got == {i: ("revisit" if i in first else "response", len(d), hashlib.sha256(d).hexdigest(), first.get(i)) for i, d in data.items()}
    whole = {}
    for r in sorted(chunks.where("record_type != 'revisit'").collect(), key=lambda r: (r.record_id, r.chunk_no)):
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.data)
    assert whole == {i: d for i, d in data.items() if i not in first}
    import gzip

    raw = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect()).decode()
    heads = [part.split("\r\n\r\n")[0] for part in raw.split("WARC/1.1\r\nWARC-Type: ")[1:] if "WARC-Record-ID" in part]
    named = {x.split("WARC-Record-ID: ")[1].split("\r\n")[0] for x in heads}
    refers = {x.split("WARC-Refers-To: ")[1].split("\r\n")[0] for x in heads if "WARC-Refers-To" in x}
    assert refers and refers <= named and all("\r\nWARC-Date: 20" in x for x in heads)


def test_warc_payloads_with_any_line_ends(spark):
    """Payloads that end in parts of a record's end, in files of many buffers."""
    ends = ["\r\n", "\n", "\r", "\r\n\r\n", "\r\n\r", "\r\n\r\nWARC/1.1\r\n", "end"]
    df = spark.range(20_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", f"concat(repeat(concat(id, '\\r\\n'), cast(id % 97 AS int)), element_at(array({', '.join(repr(e) for e in ends)}), cast(id % {len(ends)} AS int) + 1)) AS html")
    expected = df.selectExpr("page_id", "CAST(octet_length(html) AS LONG) AS payload_bytes", "sha2(html, 256) AS payload_digest")
    found = warc.round_trip(df.repartition(3), size=100).select("page_id", "payload_bytes", "payload_digest")
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


def test_warc_of_a_payload_of_many_chunks(spark):
    """A payload beyond the real chunk size, split and put together."""
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, repeat('long line\n', 200000) AS html UNION ALL SELECT 2L, 'v', 'short'")
    found = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(df).collect()}
    long = b"long line\n" * 200_000
    assert found == {1: (len(long), hashlib.sha256(long).hexdigest()), 2: (5, hashlib.sha256(b"short").hexdigest())}


def test_warc_of_repeated_rows_null_ids_and_no_rows(spark):
    long = "p" * 1000
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, "u", long), (2, "u", long)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(df, size=100).collect())
    assert got == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.round_trip(df.where("false")).collect() == []


def test_changed_archives_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "p" * 300)], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/w", size=100)
    chunks = warc.read_archive(spark, f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="other bytes than stated"):
        warc.verified_records(chunks.withColumn("data", F.expr("overlay(data PLACING X'00' FROM 1)"))).collect()
    for lost in (0, 1, 2):
        with pytest.raises(Exception, match="was due"):
            warc.verified_records(chunks.where(f"chunk_no != {lost}")).collect()
    with pytest.raises(Exception, match="was due"):
        warc.verified_records(chunks.union(chunks)).collect()
