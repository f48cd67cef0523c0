"""Byte-level BPE encoding and decoding with each distinct word encoded once.

Words are the matches of the tokenizer's pattern. Exploding the corpus into one row per word would
make many times its size, so positions stay packed: a block of documents becomes one row with the
sequence of its words' codes, and its distinct words, packed by hash bucket, are what is shuffled.
Each bucket encodes its distinct words once for all blocks and answers every block; the answers
join their block again, where ids are put together by position. Decoding looks ids up in the
table of tokens' bytes, which is as large as the vocabulary and no larger.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.pieces import coder, ragged, splitter

#: Characters of text that make up a block, and at most (but for one longer text) 1.25 times that.
BLOCK = 8_000_000
#: Bytes of text for each bucket of distinct words and for each part of a shuffle; buckets at most, as a block emits a
#: row for each bucket that its words fall into; and words whose ids a task keeps.
BUCKET, BUCKETS, KEPT = 64_000_000, 1024, 1 << 19
#: Texts on which cutting at single spaces is compared with a pattern's own matches before it is used.
PROBES = ("It's a cat, isn't it? 12 345 x", "tab\there and  two", " lead mid\n next\r\n a b ", "a1 b2c (d) #e -f _g", "Ünï çödé 日本 語 e\u0301 x", "I'M WE'll  'S ...! ?", "a \u00a0b c\u3000 d")
_BLOCKS = "block long, bucket int, data array<binary>, ids array<long>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 and number on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """A rank file as the executors use it: loaded once a process, from a path on every machine or
    from a file added to the job with SparkContext.addFile. Only workers that encode build the encoder."""

    loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        self.path = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        self.encoders: dict = {}

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encoder(self, pattern: str) -> Callable[[str], list[int]]:
        if pattern not in self.encoders:
            import tiktoken

            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(self.path), special_tokens={})
            self.encoders[pattern] = encoding.encode_ordinary
        return self.encoders[pattern]

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, flat): the bytes of each id; an id without a token has size -1."""
        ranks = read_ranks(self.path)
        by_id = dict(zip(ranks.values(), ranks))
        tokens = [by_id.get(k) for k in range(max(by_id, default=-1) + 1)]
        flat = np.frombuffer(b"".join(t or b"" for t in tokens), "u1")
        sizes = np.array([-1 if t is None else len(t) for t in tokens], "int64")
        return np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), sizes, flat

    def spelt(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another."""
        starts, sizes, flat = self.token_bytes
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
            raise ValueError("an id isn't in the vocabulary")
        return flat[ragged(starts[ids], sizes[ids])].tobytes()


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _restored(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack(words: list[bytes]) -> bytes:
    """Byte strings as one: their lengths, then themselves, compressed."""
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return _squeezed(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words))


def _unpack(data: bytes) -> list[bytes]:
    raw = _restored(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype="int64") + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers below 2^31: first how many bits each has, then by number of bits what follows the
    leading one, byte by byte. Frequent small numbers take few bits that way."""
    v = values.astype("int64") + 1
    bits = (np.frexp(v.astype("float64"))[1] - 1).astype("u1")
    parts = [bits.tobytes()]
    for k in range(1, int(bits.max(initial=0)) + 1):
        rest = v[bits == k] - (1 << k)
        parts += [(rest >> shift & 255).astype("u1").tobytes() for shift in range(0, k, 8)]
    return _squeezed(np.uint32(len(v)).tobytes() + b"".join(parts))


def _numbers_of(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_restored(data), "u1")
    n = int(raw[:4].view("<u4")[0])
    bits, at = raw[4 : 4 + n], 4 + n
    out = np.zeros(n, "int64")
    for k in range(1, int(bits.max(initial=0)) + 1):
        here = np.flatnonzero(bits == k)
        rest = np.full(len(here), (1 << k) - 1, "int64")
        for shift in range(0, k, 8):
            rest += raw[at : at + len(here)].astype("int64") << shift
            at += len(here)
        out[here] = rest
    return out


def split_blocks(df: DataFrame, id_col: str, text_col: str, pattern: str, buckets: int) -> DataFrame:
    """(block, bucket, data, ids) of df's texts: for each block of documents a row with bucket -1 (data: the
    codes of all words in order, each document's number of words, and the bucket of each code; ids:
    the documents) and a row for each bucket (data: its distinct words in the order of codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, task = splitter(pattern), TaskContext.get().partitionId()
        cut_up = cuts_at_spaces(matches)
        for n, (ids, texts) in enumerate(_gather(batches)):
            yield _block_rows((task << 32) + n, ids, texts, matches, buckets, cut_up)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCKS)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if held and held + len(text) > 1.25 * BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(k)
            texts.append(text)
            held += len(text)
            if held >= BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _odd(cut: str) -> bool:
    """Whether a cut has more white space beside a single space."""
    return not cut or cut[0].isspace() or cut[-1].isspace()


def cuts_at_spaces(matches: Callable) -> bool:
    """Whether a pattern lets a match begin at every single space between two other characters."""
    for text in PROBES:
        first, *parts = text.split(" ")
        if not (not first or first[-1].isspace() or any(map(_odd, parts))) and matches(text) != [w for p in (first, *(" " + x for x in parts)) for w in matches(p)]:
            return False
    return True


def _block_rows(block: int, ids: list, texts: list[str], matches: Callable, buckets: int, cut_up: bool) -> pa.RecordBatch:
    # With patterns like the usual ones, a single space between two other characters is always a
    # boundary between matches, so texts are cut there by str.split and the pattern sees each
    # distinct cut once, with its space. A text with more white space beside such a space goes to
    # the pattern whole, and so does every text where the pattern is of another kind.
    cuts, words = coder(), coder()
    docs: list[tuple] = []
    for text in texts:
        first, *parts = text.split(" ") if cut_up else [""]
        docs.append((first, np.fromiter(map(cuts.__getitem__, parts), "int32", len(parts))))
    sizes, flat, odd = np.zeros(len(cuts), "int32"), [], np.zeros(len(cuts), bool)
    for i, cut in enumerate(cuts):
        before = len(flat)
        flat += [words[w] for w in matches(" " + cut)]
        sizes[i] = len(flat) - before
        odd[i] = _odd(cut)
    del cuts
    flat, starts = np.array(flat, "int32"), np.cumsum(sizes, dtype="int64") - sizes
    found = []
    for i, (first, at) in enumerate(docs):
        if not cut_up or len(at) and (not first or first[-1].isspace() or odd[at].any()):
            found.append(np.fromiter((words[w] for w in matches(texts[i])), "int32"))
        else:
            found.append(np.concatenate([np.array([words[w] for w in matches(first)], "int32"), flat[ragged(starts[at], sizes[at])]]))
    del docs, flat
    codes = np.concatenate(found)
    # Frequent words get small codes, which compress well; words of one count are in order of spelling.
    # A bucket's words are listed in the order of their codes: each code's bucket tells where.
    spelt = [w.encode() for w in words]
    counts = np.bincount(codes, minlength=len(spelt)).tolist()
    order = sorted(range(len(spelt)), key=lambda i: (-counts[i], spelt[i]))
    place = np.empty(len(order), "int32")
    place[order] = np.arange(len(order))
    bucket = np.fromiter((zlib.crc32(spelt[i]) % buckets for i in order), "int64", len(order))
    out = [(block, -1, [_numbers(place[codes]), _numbers(np.fromiter(map(len, found), "int64", len(found))), _numbers(bucket)], ids)]
    by_bucket = np.argsort(bucket, kind="stable")
    begins = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1)).tolist()
    for low, high in zip(begins, [*begins[1:], len(by_bucket)]):
        out.append((block, int(bucket[by_bucket[low]]), [_pack([spelt[order[i]] for i in by_bucket[low:high].tolist()])], None))
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.binary())), pa.array(columns[3], pa.list_(pa.int64()))],
        ["block", "bucket", "data", "ids"],
    )


def encode_words(rows: DataFrame, path: str, pattern: str, parts: tuple[int, ...] = ()) -> DataFrame:
    """rows (block, bucket, data, ids) with the words of each bucket as their ids, in order. A bucket's
    rows come together, and each of their distinct words is encoded once (and again where a bucket has more
    than KEPT: memory stays bounded, whatever the words); the rows of documents (bucket -1), dealt by
    block, go through as they are."""
    most = KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Vocabulary.of(path).encoder(pattern)
        now, held = None, {}
        for batch in batches:
            for i, bucket in enumerate(batch.column(1).to_pylist()):
                if bucket < 0:
                    yield batch.slice(i, 1).select(["block", "bucket", "data", "ids"])
                    continue
                if bucket != now:
                    now, held = bucket, {}
                found = []
                for word in _unpack(batch.column(2)[i].as_py()[0]):
                    ids = held.get(word)
                    if ids is None:
                        if len(held) >= most:
                            held.clear()
                        ids = held[word] = tuple(encode(word.decode()))
                    found.append(ids)
                sizes = np.fromiter(map(len, found), "int64", len(found))
                flat = np.fromiter((k for ids in found for k in ids), "int64", int(sizes.sum()))
                answer = pa.array([[_numbers(sizes), _numbers(flat)]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([bucket], pa.int32()), answer, pa.array([None], pa.list_(pa.int64()))], ["block", "bucket", "data", "ids"])

    dealt = F.when(F.col("bucket") < 0, F.col("block")).otherwise(-1 - F.col("bucket").cast("long"))
    return rows.withColumn("dealt", dealt).repartition(*parts, "dealt").sortWithinPartitions("dealt").drop("dealt").mapInArrow(run, _BLOCKS)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id_col long, ids array<int>): the token ids of each whole text of df, a row for each row; without
    special tokens, which are ordinary text. A null or empty text has no ids. Rows with a null id
    keep it; repeated rows each keep a row.

    path: a rank file that every machine has, or that SparkContext.addFile has sent; buckets: into
    how many parts the distinct words of all texts are dealt: by default one for each BUCKET bytes of
    text (counted in a pass over their sizes), no fewer than the session's shuffle partitions, but BUCKETS
    at most, so that rows stay in proportion to the blocks. Blocks are put together in as many parts as
    the input's size asks for.
    """
    return _encoded(df, path, pattern, id_col, text_col, buckets, False)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id_col long, ids array<int>, decoded binary): encode's rows with the bytes that their ids decode
    to, looked up where the ids are put together, so that these needn't go to another worker."""
    return _encoded(df, path, pattern, id_col, text_col, buckets, True)


def _encoded(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, buckets: int | None, decoded: bool) -> DataFrame:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    asked = max(least, -(-size // BUCKET))
    buckets = buckets or min(asked, max(least, BUCKETS))
    # Without a number the session's partitions hold, which adaptive execution may put together.
    parts = (asked,) if asked > least else ()
    blocks = encode_words(split_blocks(df, id_col, text_col, pattern, buckets), path, pattern, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = Vocabulary.of(path).spelt if decoded else None
        held: list = []
        for batch in batches:
            for i, bucket in enumerate(batch.column(1).to_pylist()):
                data = [_numbers_of(x) for x in batch.column(2)[i].as_py()]
                if bucket < 0:
                    if held:
                        yield from _assembled(*held, spelt)
                    held = [data, batch.column(3)[i].as_py(), []]
                else:
                    held[2].append(data)
        if held:
            yield from _assembled(*held, spelt)

    dealt = blocks.repartition(*parts, "block").sortWithinPartitions("block", "bucket")
    schema = "id long, ids array<int>" + ", decoded binary" * decoded
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _assembled(packed: list, docs: list, answers: list, spelt: Callable | None) -> Iterator[pa.RecordBatch]:
    """Batches of (id, ids) of a block, put together by position; with spelt, and of the ids' bytes."""
    codes, words, bucket = packed
    # Answers come by bucket, and in a bucket by code; put them in the order of codes.
    order = np.empty(len(bucket), "int64")
    order[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    none = np.zeros(0, "int64")
    sizes = np.concatenate([a[0] for a in answers] or [none])
    flat = np.concatenate([a[1] for a in answers] or [none]).astype("int32")
    starts, at = (np.cumsum(sizes) - sizes)[order], 0
    sizes = sizes[order]
    for low in range(0, len(docs), 256):
        count = words[low : low + 256]
        own = codes[at : at + int(count.sum())]
        at += len(own)
        long = np.add.reduceat(np.append(sizes[own], 0), np.minimum(np.cumsum(count) - count, len(own))) * (count > 0)
        ends = np.concatenate([[0], np.cumsum(long)])
        values = flat[ragged(starts[own], sizes[own])]
        columns = [pa.array(docs[low : low + 256], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))]
        if spelt:
            columns.append(pa.array([spelt(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with the column decoded (binary): the bytes of the tokens in ids_col, one after another; null
    where ids_col is null. Each task joins ids with the table of token bytes by position in it.
    Raises for an id that isn't in the vocabulary."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelt = Vocabulary.of(path).spelt
        for lists in batches:
            yield pd.Series([None if ids is None else spelt(ids) for ids in lists], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("decoded", F.pandas_udf(run, "binary")(F.col(ids_col)))
