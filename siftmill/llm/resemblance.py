"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline's stage.

Texts link if their sets of shingles resemble by SHARE or more. op1's index of SimHash fingerprints
proposes pairs within its radius, without pairs inside groups; but texts at that similarity differ
in about ten of 64 bits, which no index of segments reaches. So the rest comes from prefixes: in
any one order of all shingles, two sets of sizes n and m that share the share asked for have a
shingle in common among the first n - ceil(SHARE * n) + 1 of each. That loses nothing. The order
puts shingles that a sample shows to be common last, so that rare ones make up the prefixes; the
sample decides the work only, not the result. Keys of one text only are dropped before anything is
joined by key, and so are those of two texts whose sizes and places don't allow the share.

Every pair proposed is checked on the whole sets. Texts that share a phrase by chance propose pairs
too, and these grow faster than the input; so the sets' bits come first. They are parities: a shingle
flips one bit of at least as many as the set has. Two sets differ by no fewer shingles than their
bits do, so a pair whose bits differ too much can't resemble enough, and whole sets travel for the
others only.

Large groups of near copies don't expand into pairs: the members of a prefix key stand in a row by
size, and each is compared with one neighbour. Between groups that are still apart, all pairs under
keys of at most LIGHT texts are tried. Under larger keys each text first looks at its neighbours in
a few orders and tries the one with the nearest fingerprint, which joins most of a group of near
copies. What is still apart is settled exactly: larger keys that share texts make up a family, and
every text outside of a family's largest group asks the whole family, in blocks of bounded size,
whom it resembles. Texts inside the largest group never ask: their links with each other join
nothing, and others ask for the rest. They ask twice: by keys and bits whom they may resemble, which
splits families into those that hang together by more than chance, then there by whole sets. So no
link is lost, and the work beyond the rows themselves is that of the texts left over, not of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.pieces import ragged
from siftmill.llm.shared import BROADCAST_ROWS, bloom_filter, bloom_pass, checked_broadcast, collected, connected_components, settled, settled_each, small_batches, stored, without
from siftmill.llm.simhash import BLOCK, fingerprint_links

WORDS, SEED = 5, 42
#: The least similarity, 4/5, in whole numbers.
SHARE = (4, 5)
#: One text in so many is in the sample of shingles; those that occur there once only count as rare.
SAMPLE = 8
#: Texts of a key whose pairs are all tried, and rounds in which those of larger keys look for others before the
#: rest is settled.
LIGHT, ROUNDS = 32, 2
#: Shingles (or keys and words of bits) of the asking and of the asked texts that meet in one task.
ASKING, ASKED = 1 << 18, 1 << 20


def shingles(text: bytes) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; a shorter text is one shingle."""
    import xxhash

    tokens = text.lower().split()  # on bytes, as in simhash
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= WORDS:
        return np.array([digest(b" ".join(tokens), SEED)] if tokens else [], "<u8")
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(WORDS))))
    return np.fromiter((digest(x, SEED) for x in grams), "<u8", len(tokens) - WORDS + 1)


def _fingerprint(hashes: np.ndarray) -> np.int64:
    ones = np.zeros(64, "int64")
    for start in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[start : start + BLOCK])
        ones += np.unpackbits(part.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]


def _bits(own: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles, 64 a long: as many longs, a power of two, as give each shingle a bit.
    The first half of them XOR the second are the parities of half as many."""
    count = 64 << max(0, len(own) - 1 >> 6).bit_length()
    flips = np.bincount((own & np.uint64(count - 1)).astype("int64"), minlength=count)
    return np.packbits((flips & 1).astype("uint8"), bitorder="little").view("<i8")


def _node(sets: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(sets.tobytes(), SEED) - (1 << 63)


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _common(texts: DataFrame) -> np.ndarray:
    """The shingles that occur in more than one of the sample's texts, most common last, as many as
    a broadcast may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(_bytes(t))).view("<i8"))], ["key"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = sample.select("text").mapInArrow(run, "key long").groupBy("key").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "key").limit(BROADCAST_ROWS).select("key").toArrow()
    return rows.column(0).to_numpy()[::-1].view("<u8")


def _sets(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, node, fp, size, bits, prefix): a row for each row of texts. node names the set of shingles."""
    order = np.argsort(common)
    known = texts.sparkSession.sparkContext.broadcast((common[order], order + 1))
    part, whole = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, places = known.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                hashes = shingles(_bytes(t))
                own = np.unique(hashes)
                rank = np.zeros(len(own), "int64")
                if len(listed) and len(own):
                    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
                    rank = np.where(listed[at] == own, places[at], 0)
                kept = len(own) - -(-part * len(own) // whole) + 1 if len(own) else 0
                rows.append((_node(own), _fingerprint(hashes), len(own), _bits(own), own[np.lexsort((own, rank))[:kept]].view("<i8")))
            nodes, fps, sizes, bits, prefixes = zip(*rows) if rows else ((), (), (), (), ())
            longs = (pa.array(x, pa.int64()) for x in (nodes, fps, sizes))
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (bits, prefixes))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *lists], ["id", "node", "fp", "size", "bits", "prefix"])

    return texts.mapInArrow(run, "id long, node long, fp long, size long, bits array<long>, prefix array<long>")


def _indexed(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node) of each row of texts; (node, id, fp, size, bits) of each set that has an id, the least; and
    (node, size, pos, key), the prefixes' rows under keys that other sets may have too. The whole prefixes stay no
    longer than this."""
    spark = texts.sparkSession

    def whole() -> tuple[DataFrame, DataFrame]:
        common = _common(texts)
        collected(spark)
        each = stored(_sets(texts, common))
        others = (F.any_value(c).alias(c) for c in ("fp", "size", "bits", "prefix"))
        return each.select("id", "node"), each.where("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), *others)

    own, reps = settled_each(spark, whole, 2)
    collected(spark)
    rows = reps.select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    again = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return own, reps.drop("prefix"), bloom_pass(rows, "key", bloom_filter(again, "key"))


def _sets_of(nodes: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, own): the whole sets of nodes (node), each once. Only the texts that stand for them are read for it."""
    need = stored(nodes.distinct().join(reps.select("node", "id"), "node"))
    bloom = bloom_filter(need.select(F.xxhash64("id").alias("item")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                own = np.unique(shingles(_bytes(t)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(own)], pa.int64()), pa.array([own.view("<i8")], pa.list_(pa.int64()))], ["node", "own"])

    may = bloom_pass(texts.withColumn("item", F.xxhash64("id")), "item", bloom).select("text")
    return may.mapInArrow(run, "node long, own array<long>").join(checked_broadcast(need.select("node")), "node", "left_semi").dropDuplicates(["node"])


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sizes and bits allow the share: all that resemble enough, and hardly any that
    share a few shingles only."""
    part, whole = SHARE
    side = lambda c: reps.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))

    def folded(c: str, other: str) -> F.Column:
        half = F.size(other)
        return F.when(F.size(c) > half, F.transform(F.slice(c, F.lit(1), half), lambda x, i: x.bitwiseXOR(F.element_at(c, i + half + 1)))).otherwise(F.col(c))

    apart = F.zip_with(folded("bits_a", "bits_b"), folded("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    total = F.col("size_a") + F.col("size_b")
    sizes = F.least("size_a", "size_b") * whole >= F.greatest("size_a", "size_b") * part
    bits = (total - F.aggregate(apart, F.lit(0), lambda s, x: s + x)) * (part + whole) >= total * (2 * part)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sizes).where(bits).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b), which are stored, those whose whole sets resemble enough. Only the sets of texts
    in pairs that their bits allow are made again, and each goes where its pairs are."""
    pairs = stored(_promising(pairs, reps))
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), texts, reps)
    # Not stored: one shuffle by node drops the duplicates and serves both joins.
    both = pairs.join(sets.toDF("a", "mine"), "a").join(sets.toDF("b", "theirs"), "b")
    part, whole = SHARE
    alike = F.size(F.array_intersect("mine", "theirs")) * (part + whole) >= (F.size("mine") + F.size("theirs")) * part
    return stored(both.where(alike).select("a", "b"))


def _possible(n: str, i: str, m: str, j: str) -> str:
    """SQL: sizes n and m allow the share, and so do the shingles from places i and j on, the key's. A
    pair's least common key is the first it shares, and there this holds."""
    part, whole = SHARE
    return f"{whole} * least({n}, {m}) >= {part} * greatest({n}, {m}) AND {part + whole} * least({n} - {i}, {m} - {j}) >= {part} * ({n} + {m})"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id), stored: a row for each row of df. component_id is the smallest id that
    links lead to, its own included; texts without words are all alike. Rows with a null id get
    their texts' component and name none. Repeated rows each keep a row; df may be empty."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def found() -> DataFrame:
        own, reps, near = settled_each(spark, lambda: _indexed(texts), 3)
        collected(spark)
        groups = settled(spark, lambda: _first_groups(texts, reps, near))
        collected(spark)
        heavy, rest = settled_each(spark, lambda: _shared(near, groups, reps), 2)
        for turn in range(ROUNDS):
            if turn:
                rest = settled(spark, lambda: _ordered(_beside(heavy, groups, turn)))
            links = settled(spark, lambda: _verified(rest, texts, reps))
            if not links.isEmpty():
                groups = settled(spark, lambda: _merged(groups, links))
            collected(spark)
        last = settled(spark, lambda: _left_over(heavy, groups, texts, reps))
        groups = settled(spark, lambda: _merged(groups, last))
        named = reps.select("node", "id").join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        least = named.groupBy("grp").agg(F.min("id").alias("component_id"))
        named = named.join(least, "grp").select("node", "component_id")
        return own.join(named, "node", "left").select(F.col("id").alias(id_col), "component_id")

    with small_batches(spark):
        return settled(spark, found)


def _first_groups(texts: DataFrame, reps: DataFrame, near: DataFrame) -> DataFrame:
    """(node, grp) of the texts that are linked by what the fingerprints propose, and by the neighbour of each
    text in the prefixes' keys."""
    # The fingerprints: each once in the index, and others of the same one beside it.
    firsts = stored(reps.groupBy("fp").agg(F.min("node").alias("rep")))
    same = reps.join(firsts, "fp").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    close = fingerprint_links(firsts).union(same)
    # The prefixes: texts that stand side by side under a key, in order of size; for each text that
    # which stands beside it most often.
    along = Window.partitionBy("key").orderBy("size", "node")
    before = {c: F.lag(c).over(along) for c in ("node", "size", "pos")}
    chain = near.select("node", "size", "pos", *(f.alias(f"{c}0") for c, f in before.items())).where(f"node0 IS NOT NULL AND {_possible('size', 'pos', 'size0', 'pos0')}")
    beside = chain.groupBy(F.col("node0").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = beside.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    found = _verified(stored(_ordered(close.unionByName(best))), texts, reps)
    return connected_components(found).withColumnRenamed("component", "grp")


def _families(heavy: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, grp, family, left): the texts under larger keys that several groups still share. Keys that share texts
    are of one family; left tells whether a text is outside of its family's largest group."""
    rows = heavy.select("node", "key").join(checked_broadcast(groups), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    mixed = stored(rows.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.min("node").alias("first")).where("low < high").select("key", "first"))
    held = stored(rows.join(checked_broadcast(mixed), "key").select("node", "grp", "first"))
    family = connected_components(held.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "family")
    return _with_left(stored(held.select("node", "grp").distinct().join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))))


def _with_left(nodes: DataFrame) -> DataFrame:
    """nodes (node, grp, family), stored, with left."""
    largest = nodes.groupBy("family", "grp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "grp")).alias("m")).select("family", F.col("m.grp").alias("main"))
    return nodes.join(checked_broadcast(stored(largest)), "family").select("node", "grp", "family", (F.col("grp") != F.col("main")).alias("left"))


def _left_over(heavy: DataFrame, groups: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links that join all groups which any link between texts under larger keys joins."""
    nodes = stored(_families(heavy, groups))
    keys = heavy.groupBy("node").agg(F.collect_list("key").alias("keys"))
    sets = stored(nodes.join(keys, "node").join(reps.select("node", "size", "bits"), "node"))
    may = stored(_meetings(sets, F.size("keys") + F.size("bits"), _may_resemble, "size", "bits", "keys"))
    # What links lead between is in one family still.
    family = connected_components(may).withColumnRenamed("component", "family")
    nodes = stored(_with_left(stored(nodes.select("node", "grp").join(family, "node"))))
    own = _sets_of(nodes.select("node"), texts, reps)
    sets = stored(own.join(nodes, "node").withColumn("size", F.size("own")))
    return _meetings(sets, F.col("size"), _asked, "own")


def _meetings(sets: DataFrame, weight: F.Column, ask, *columns: str) -> DataFrame:
    """(a, b) that ask finds between those of sets (node, grp, family, left, size, ...), stored, that are left and all
    of their family, in blocks of about ASKING and ASKED of weight."""
    # Sizes of texts that resemble enough differ by a quarter at most: by one band.
    sets = sets.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(float(np.log(SHARE[1] / SHARE[0])))).cast("int"))
    total = lambda c, most: F.ceil(F.sum(weight) / most).cast("int").alias(c)
    asked = stored(sets.groupBy("family", "band").agg(total("blocks", ASKED)))
    asking = stored(sets.where("left").groupBy("family").agg(total("parts", ASKING)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    theirs = sets.join(checked_broadcast(asked), ["family", "band"]).join(checked_broadcast(asking), "family")
    theirs = theirs.select("node", "grp", *columns, "family", "band", place("blocks").alias("block"), each("parts").alias("part"))
    mine = sets.where("left").join(checked_broadcast(asking), "family").select("node", "grp", *columns, "family", place("parts").alias("part"), F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"))
    mine = mine.join(checked_broadcast(asked), ["family", "band"]).select("node", "grp", *columns, "family", "band", "part", each("blocks").alias("block"))
    by = ["family", "band", "block", "part"]
    mine = mine.select(*(F.col(c).alias(c) for c in mine.columns))  # columns of its own: both sides come from one table
    return mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInPandas(ask, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pd.DataFrame:
    a, b = zip(*found) if found else ((), ())
    return pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})


def _may_resemble(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links that lead between all texts of different groups which share a key and whose sizes and bits allow
    the share; texts that others link already get none."""
    found: list[tuple[int, int]] = []
    if len(mine) and len(theirs):
        part, whole = SHARE
        held = np.array([len(x) for x in theirs["keys"]])
        key, row = np.concatenate(theirs["keys"].to_list()), np.repeat(np.arange(len(theirs)), held)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        nodes, groups, sizes = (theirs[c].to_numpy() for c in ("node", "grp", "size"))
        words = np.array([len(x) for x in theirs["bits"]])
        tables = {n: (np.stack(theirs["bits"].to_numpy()[words == n]), np.cumsum(words == n) - 1) for n in np.unique(words).tolist()}
        label = np.arange(len(theirs))
        for node, grp, size, bits, keys in zip(mine["node"].tolist(), mine["grp"].tolist(), mine["size"].tolist(), mine["bits"], mine["keys"]):
            low, high = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            near = np.unique(row[ragged(low, high - low)])
            near = near[(groups[near] != grp) & (whole * np.minimum(sizes[near], size) >= part * np.maximum(sizes[near], size))]
            alike = []
            for n, (table, at) in tables.items():
                if len(some := near[words[near] == n]):
                    both = table[at[some]]
                    own = np.asarray(bits)
                    # Sizes allow the share, so one side has twice the other's bits at most.
                    if len(own) > n:
                        own = own[:n] ^ own[n:]
                    elif len(own) < n:
                        both = both[:, : len(own)] ^ both[:, len(own) :]
                    apart, total = np.bitwise_count((both ^ own).view("uint64")).sum(axis=1, dtype="int64"), sizes[some] + size
                    alike.append(some[(total - apart) * (part + whole) >= total * (2 * part)])
            if alike and len(some := np.concatenate(alike)):
                known, first = np.unique(label[some], return_index=True)
                found += [(node, x) for x in nodes[some[first]].tolist()]
                label[np.isin(label, known)] = known[0]
    return _links(found)


def _asked(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of texts that resemble enough, but for links between groups that others join already."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    found: list[tuple[int, int]] = []
    if len(mine) and len(theirs):
        part, whole = SHARE
        sizes = np.array([len(x) for x in theirs["own"]])
        shingle, row = np.concatenate(theirs["own"].to_list()), np.repeat(np.arange(len(theirs)), sizes)
        order = np.argsort(shingle, kind="stable")
        shingle, row = shingle[order], row[order]
        nodes, groups = theirs["node"].to_numpy(), theirs["grp"].to_numpy()
        for node, grp, own in zip(mine["node"].tolist(), mine["grp"].tolist(), mine["own"]):
            low, high = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            shared = np.bincount(row[ragged(low, high - low)], minlength=len(theirs))
            for i in np.flatnonzero(shared * (part + whole) >= (sizes + len(own)) * part):
                x, y = find(grp), find(int(groups[i]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((node, int(nodes[i])))
    return _links(found)


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, grp): groups with those joined that links lead between."""
    grp = lambda c, n: groups.select(F.col("node").alias(c), F.col("grp").alias(n))
    edges = links.join(grp("a", "x"), "a", "left").join(grp("b", "y"), "b", "left")
    joined = stored(connected_components(edges.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))))
    known = groups.union(joined.join(groups.select("node"), "node", "left_anti").select("node", F.col("node").alias("grp")))
    return known.join(joined.withColumnRenamed("node", "grp"), "grp", "left").select("node", F.coalesce("component", "grp").alias("grp"))


def _held(near: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, size, grp, pos, key, n), stored: the prefixes' rows under keys that several groups share; without keys of
    two texts that can't resemble enough by what the key tells."""
    rows = near.join(checked_broadcast(groups), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    sides = F.min("size").alias("least"), F.max("size").alias("most"), F.min(F.col("size") - F.col("pos")).alias("ahead")
    mixed = rows.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n"), *sides)
    part, whole = SHARE
    two = f"{whole} * least >= {part} * most AND {part + whole} * ahead >= {part} * (least + most)"  # as _possible has it
    mixed = stored(mixed.where(f"low < high AND (n > 2 OR {two})").select("key", "n"))
    return stored(bloom_pass(rows, "key", bloom_filter(mixed, "key")).join(checked_broadcast(mixed), "key").select("node", "size", "grp", "pos", "key", "n"))


def _shared(near: DataFrame, groups: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, size, fp, pos, key) under larger keys, and the pairs (a, b) that are tried first."""
    held = _held(near, groups)
    heavy = stored(held.where(f"n > {LIGHT}").select("node", "size", "pos", "key").join(reps.select("node", "fp"), "node"))
    return heavy, _ordered(_light(held).union(_beside(heavy, groups, 0)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def _light(held: DataFrame) -> DataFrame:
    """(a, b): all pairs between different groups that share a key of at most LIGHT texts and may
    resemble enough."""
    light = held.where(f"n <= {LIGHT}")
    some = light.alias("x").join(light.alias("y"), "key").where(f"x.grp != y.grp AND (x.size < y.size OR x.size = y.size AND x.node < y.node) AND {_possible('x.size', 'x.pos', 'y.size', 'y.pos')}")
    return some.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _beside(heavy: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each text, of those of other groups that stand beside it under the larger keys, in an
    order that each turn deals anew, the one with the nearest fingerprint."""
    rows = heavy.join(checked_broadcast(groups), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    along = Window.partitionBy("key").orderBy(F.xxhash64("node", "key", F.lit(turn)))
    names = ("node", "size", "pos", "fp", "grp")
    beside = rows.select(*names, *(F.lag(c).over(along).alias(f"{c}0") for c in names))
    beside = beside.where(f"node0 IS NOT NULL AND grp != grp0 AND {_possible('size', 'pos', 'size0', 'pos0')}")
    both = F.array(F.struct(F.col("node").alias("a"), F.col("node0").alias("b")), F.struct(F.col("node0").alias("a"), F.col("node").alias("b")))
    each = beside.select(F.explode(both).alias("p"), F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))).alias("gap"))
    nearest = each.groupBy("p.a").agg(F.min(F.struct("gap", "p.b")).alias("m"))
    return nearest.select("a", F.col("m.b").alias("b"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df of which one stays for each component: that with the smallest id (rows that
    repeat this id stay too). Rows with a null id stay. All columns stay as they are."""
    found = near_duplicates(df, id_col, text_col)
    gone = stored(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return without(df, gone, id_col)
