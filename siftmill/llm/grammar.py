"""Token ids in files, compressed by Re-Pair grammars with random access.

Documents are dealt by ranges of their ids and sorted, encoded, and gathered into shards of about
`SHARD` ids. In each shard, neighbouring ids that occur `LEAST` times or more are replaced by a
nonterminal again and again, until no such pair is left; pairs never reach over a document's end.
A shard is a row of the archive, a Parquet table:

    part, shard      its place in the order of ids, starting with part
    low_id, high_id  its least and largest document id
    doc_ids, doc_tokens, doc_symbols  each document, its ids and its symbols, in order
    n_tokens         all ids
    base             the first nonterminal
    left, right      what each nonterminal stands for (two symbols, smaller than itself)
    lengths          how many ids each nonterminal expands to
    symbols          the compressed sequence, little-endian, `width` bytes each

A document is read by skipping to its first symbol, as doc_symbols says, and expanding its own; the
lengths say where the parts of a nonterminal go, so nothing else has to be expanded for that.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.pieces import are_plain, coder, is_plain, ragged
from siftmill.llm.shared import checked_broadcast, shared_folder, stored

#: Ids that make up a shard; a longer document is a shard of its own.
SHARD = 1 << 20
#: Bytes of text for each file of an archive, and so for each task that writes one.
PART = 64_000_000
#: Occurrences that a pair must have: a rule takes the room of about four symbols.
LEAST = 12
#: Pieces of text that a worker remembers at most, and bytes of text that it encodes at a time.
REMEMBERED, PIECE = 800_000, 8_000_000

#: Texts on which a tokenizer's way with words is compared with the library's before it is used.
PROBES = ("The cat's 12 mats, WE'LL see!", "a\tb\nc  d ", "Ünï çödé ß ÿ", "x.y-z_0 (q) #1 @a $5", "e\u0301 日本 語", "don't 'stop' I'm", "<|endoftext|> a", "İ ǅ \u200b", "")

_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")


class WordEncoder:
    """A tokenizer file of the tokenizers library whose words end at white space, applied to each
    distinct piece between blanks once. Pieces of plain Latin characters are split by the file's own
    rule and go to its model; all others go through the library whole. For files that work otherwise
    (PROBES tell) all texts go through the library as they are."""

    loaded: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = iter(range(256, 512))
        self.characters = [chr(b) if b in kept else chr(next(moved)) for b in range(256)]
        self.forget()
        # A file with another way of its own (normaliser, splits, bytes) gets every text whole.
        self.whole = False
        own = [x.tolist() for x in self.encode(pa.array(PROBES), None)]
        self.whole = own != [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls.loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls.loaded[path] = cls(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        return cls.loaded[path]

    def forget(self) -> None:
        """Pieces and words are numbered as they come; the ids of each are a run of an array."""
        self.pieces, self.piece_sizes, self.piece_ids = coder(), np.zeros(0, "int64"), np.zeros(0, "int32")
        if len(getattr(self, "words", ())) > 2 * REMEMBERED or not hasattr(self, "words"):
            self.words, self.word_sizes, self.word_ids = coder(), np.zeros(0, "int64"), np.zeros(0, "int32")

    def _learn_words(self) -> None:
        """The ids of words that have a number but no ids yet; other pieces count as words of their own."""
        found = []
        tokenize = self.tokenizer.model.tokenize
        for word in islice(self.words, len(self.word_sizes), None):
            if word[0] == "\0":
                found.append(self.tokenizer.encode(word[1:], add_special_tokens=False).ids)
            else:
                spelt = word if word.isascii() else "".join(self.characters[b] for b in word.encode())
                found.append([t.id for t in tokenize(spelt)])
        self.word_sizes = np.concatenate([self.word_sizes, np.fromiter(map(len, found), "int64", len(found))])
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(found), "int32")])

    def _learn_pieces(self) -> None:
        """The ids of pieces that have a number but no ids yet: of all plain ones in one go."""
        new = list(islice(self.pieces, len(self.piece_sizes), None))
        joined = "\n".join(new)
        if are_plain(new, joined) and "<|" not in joined:
            plain = np.ones(len(new), bool)
        else:
            plain = np.array([is_plain(p) and "<|" not in p for p in new], bool)
            joined = "\n".join([p for p, good in zip(new, plain) if good])
        parts = _WORDS.findall(joined.lower())
        codes = np.fromiter(map(self.words.__getitem__, parts), "int64", len(parts))
        ends = np.flatnonzero(codes == self.words["\n"])
        sizes = np.zeros(len(new), "int64")
        if plain.any():
            bounds = np.concatenate([[-1], ends, [len(codes)]])
            sizes[plain] = np.diff(bounds) - 1
        # Other pieces are one "word" each, which the library gets whole; an empty one is none.
        sizes[[i for i, p in enumerate(new) if p and not plain[i]]] = 1
        inside = np.repeat(plain, sizes)
        words = np.zeros(len(inside), "int64")
        words[inside] = np.delete(codes, ends)
        words[~inside] = [self.words["\0" + p] for p, good in zip(new, plain) if p and not good]
        self._learn_words()
        each = self.word_sizes[words]
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))]
        ids = self.word_ids[ragged((np.cumsum(self.word_sizes) - self.word_sizes)[words], each)]
        self.piece_sizes = np.concatenate([self.piece_sizes, np.diff(ends)])
        self.piece_ids = np.concatenate([self.piece_ids, ids])

    def encode(self, texts: pa.Array, end: int | None) -> list[np.ndarray]:
        """The ids of each text, with `end` behind them; a null text is an empty one."""
        if self.whole:
            tail = [] if end is None else [end]
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids + tail, "int32") for t in texts.to_pylist()]
        if len(self.pieces) > REMEMBERED:
            self.forget()
        blank = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), "\t", " ")
        split = pc.split_pattern(blank, " ")
        counts = split.value_lengths().to_numpy().astype("int64")
        # Arrow numbers the batch's distinct pieces; only they are looked up here.
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self.pieces.__getitem__, distinct), "int32", len(distinct))[coded.indices.to_numpy()]
        gc.disable()  # new words are many small objects, none of them garbage
        try:
            self._learn_pieces()
        finally:
            gc.enable()
        sizes = self.piece_sizes[codes]
        ids = self.piece_ids[ragged((np.cumsum(self.piece_sizes) - self.piece_sizes)[codes], sizes)]
        bounds = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        tail = np.array([] if end is None else [end], "int32")
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def compress(ids: np.ndarray, sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, left, right, lengths): the Re-Pair grammar of documents' ids,
    which are below base; sizes: ids of each document. Nonterminals count up from base.

    A round counts all pairs and replaces every pair that is frequent enough, where two of them
    overlap the one that occurs more often. Rounds go on until no pair is left that can be replaced
    LEAST times. A pair's count only falls once it is known, so later rounds look at those pairs
    only that were frequent or that hold a symbol of the last round."""
    symbols = ids.astype("int32")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, number = [], [], base
    alive = ~last[:-1]
    while alive.any():
        at = np.flatnonzero(alive)
        # Along a run of one symbol every second place counts, from the left.
        same = at[symbols[at] == symbols[at + 1]]
        odd = same[~_alternate(same)]
        alive[odd] = False
        at = np.flatnonzero(alive) if len(odd) else at
        pairs, counts, places = _grouped(symbols, at, number)
        frequent = counts >= LEAST
        pairs, places, counts = pairs[frequent], places[np.repeat(frequent, counts)], counts[frequent]
        alive[:] = False
        alive[places] = True
        alive[odd] = alive[odd - 1]
        if not len(pairs):
            break
        # Each pair has a rank of its own, by its count. Ties are broken at random (always alike): of a
        # long passage that repeats, a third of the pairs go in each round then, else only one would.
        rank = np.empty(len(pairs), "int32")
        rank[np.lexsort((np.random.default_rng(len(pairs)).permutation(len(pairs)), counts))] = np.arange(1, len(pairs) + 1)
        weight = np.zeros(len(symbols) + 2, "int32")
        weight[places + 1] = np.repeat(rank, counts)
        chosen = np.flatnonzero((weight[1:-1] > weight[:-2]) & (weight[1:-1] > weight[2:]))
        won = weight[chosen + 1]
        # The pair of the highest rank wins all its places, so every round replaces one at least.
        good = np.bincount(won, minlength=len(pairs) + 1) >= LEAST
        chosen, won = chosen[good[won]], won[good[won]]
        which = np.empty(len(pairs) + 1, "int64")
        which[rank] = np.arange(len(pairs))
        new = which[np.flatnonzero(good)]
        left.append(pairs[new] >> 32)
        right.append(pairs[new] & 0xFFFFFFFF)
        symbols[chosen] = (number - 1 + np.cumsum(good))[won]
        number += len(new)
        last[chosen] |= last[chosen + 1]
        # Pairs that hold a new symbol are new; the others stay as they were.
        renewed = np.zeros(len(symbols), bool)
        renewed[chosen] = True
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        was = np.append(alive, False)[keep]
        symbols, last, renewed = symbols[keep], last[keep], renewed[keep]
        alive = (was[:-1] | renewed[:-1] | renewed[1:]) & ~last[:-1]
    ends = np.flatnonzero(last)
    each = np.zeros(len(sizes), "int64")
    each[sizes > 0] = np.diff(ends, prepend=-1)
    lengths, done = np.zeros(number - base, "int64"), 0
    for a, b in zip(left, right):  # a round's rules stand for symbols of earlier rounds
        lengths[done : done + len(a)] = sum(np.where(x >= base, lengths[np.maximum(x - base, 0)], 1) for x in (a, b))
        done += len(a)
    none = np.zeros(0, "int64")
    return symbols.astype("int64"), each, np.concatenate([none, *left]), np.concatenate([none, *right]), lengths


def _alternate(places: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places every second one, from the left."""
    begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return (np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))) % 2 == 0


def _grouped(symbols: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, places): the distinct pairs at places `at` of symbols below top, the left one in the
    upper 32 bits; how often each occurs; and the places, pair by pair."""
    bits, room = top.bit_length(), len(symbols).bit_length()
    if 2 * bits + room < 64:  # pair and place in one number: faster to sort
        ordered = np.sort((symbols[at].astype("int64") << bits | symbols[at + 1]) << room | at)
        places, keys = ordered & ((1 << room) - 1), ordered >> room
    else:
        keys = symbols[at].astype("int64") << bits | symbols[at + 1]
        order = np.argsort(keys, kind="stable")
        places, keys = at[order], keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    keys = keys[begins]
    return keys >> bits << 32 | keys & ((1 << bits) - 1), np.diff(np.append(begins, len(places))), places


def expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for. The rules' lengths say where each half of a nonterminal begins, so
    all nonterminals are opened at once, level by level, and only rules that occur are looked at."""
    size = lambda x: np.where(x >= base, lengths[np.maximum(x - base, 0)], 1) if len(lengths) else np.ones(len(x), "int64")
    count = size(symbols)
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), "int64")
    while len(symbols):
        high = symbols >= base
        out[place[~high]] = symbols[~high]
        rule, at = symbols[high] - base, place[high]
        symbols = np.concatenate([left[rule], right[rule]])
        place = np.concatenate([at, at + size(left[rule])])
    return out


_COLUMNS = "part int, shard int, low_id long, high_id long, doc_ids array<long>, doc_tokens array<int>, doc_symbols array<int>, n_tokens long, base int, left array<int>, right array<int>, lengths array<int>, width int, symbols binary"


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, parts: int | None = None) -> None:
    """Writes the ids of every whole text of df to an archive (see above) at path, in ascending order
    of id_col; a null or empty text has the id `end` only. Null ids come first; of rows with one id
    the order is their texts' hashes'. tokenizer: a file of the tokenizers library, on every machine
    or sent by SparkContext.addFile. parts: files at least; by default one for each PART bytes of text, counted in
    a pass over their sizes, and no fewer than the session's shuffle partitions."""
    if not parts:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        ids: list = []
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            # Runs of texts of about PIECE bytes, for bounded memory.
            place = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype="int64") // PIECE
            low = 0
            while low < len(names):
                high = int(np.searchsorted(place, place[low], "right"))
                for k, x in zip(names[low:high], encoder.encode(texts.slice(low, high - low), end)):
                    if found and held + len(x) > SHARD:
                        yield _shard(part, shard, ids, found, encoder.size)
                        ids, found, held, shard = [], [], 0, shard + 1
                    ids.append(k)
                    found.append(x)
                    held += len(x)
                low = high
        if found:
            yield _shard(part, shard, ids, found, encoder.size)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    dealt.mapInArrow(run, _COLUMNS).write.parquet(path)


def _shard(part: int, shard: int, ids: list, found: list[np.ndarray], base: int) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, found), "int64", len(found))
    symbols, each, left, right, lengths = compress(np.concatenate(found), sizes, base)
    top = int(symbols.max(initial=0))
    width = 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
    packed = symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :width].tobytes()
    known = [k for k in ids if k is not None]
    row = (part, shard, min(known, default=None), max(known, default=None), ids, sizes, each, int(sizes.sum()), base, left, right, lengths, width, packed)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in _COLUMNS.split(", ")])


def shard_starts(archive: DataFrame) -> DataFrame:
    """(part, shard, start): the ids of all shards before each. Parts are summed first, so that the
    one window over everything has a row for each part."""
    sizes = archive.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = totals.select("part", before(Window.orderBy("part")).alias("part_start"))
    inner = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("own"))
    return inner.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("own")).alias("start"))


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): every document of an archive, or those of a few ids: where
    its ids start among all, how many there are, and they themselves as little-endian unsigned
    32-bit integers. For a few ids only shards that may hold them are read, and only their
    documents' symbols are expanded."""
    archive = spark.read.parquet(path)
    starts = checked_broadcast(stored(shard_starts(archive)))
    wanted = None if ids is None else {*ids}
    if wanted is not None:
        near = [f"({k} BETWEEN low_id AND high_id)" for k in wanted]
        archive = archive.where(" OR ".join(near) or "false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _documents({n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}, wanted)

    found = archive.join(starts, ["part", "shard"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    return found


def _documents(row: dict, wanted: set | None) -> Iterator[pa.RecordBatch]:
    array = lambda name: row[name].values.to_numpy(zero_copy_only=False).astype("int64")
    base = row["base"].as_py()
    width = row["width"].as_py()
    packed = np.zeros((len(row["symbols"].as_buffer()) // width, 4), "u1")
    packed[:, :width] = np.frombuffer(row["symbols"].as_buffer(), "u1").reshape(-1, width)
    symbols = packed.view("<u4").ravel().astype("int64")
    rules = array("left"), array("right"), array("lengths")
    names, tokens, each = row["doc_ids"].as_py(), array("doc_tokens"), array("doc_symbols")
    starts, first = row["start"].as_py() + np.cumsum(tokens) - tokens, np.cumsum(each) - each
    chosen = [i for i, k in enumerate(names) if wanted is None or k in wanted]
    for low in range(0, len(chosen), 2048):
        part = np.array(chosen[low : low + 2048])
        raw = expand(symbols[ragged(first[part], each[part])], base, *rules).astype("<u4").tobytes()
        ends = 4 * np.cumsum(tokens[part])
        found = [raw[a:b] for a, b in zip((ends - 4 * tokens[part]).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in part.tolist()], pa.int64()), pa.array(starts[part], pa.int64()), pa.array(tokens[part], pa.int64()), pa.array(found, pa.binary())],
            ["doc_id", "start", "n_tokens", "ids"],
        )


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1) -> DataFrame:
    """df's documents written to an archive in the shared folder and read back: see write_tokens and
    read_tokens."""
    path = shared_folder(df.sparkSession) + "/tokens"
    write_tokens(df, path, tokenizer, id_col, text_col, end)
    return read_tokens(df.sparkSession, path)
