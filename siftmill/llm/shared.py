"""What the operators of this subpackage share: the cluster's shared folder, checked broadcasts,
connected components and a blocked Bloom filter made of DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.scratch import collected, discard, scratch_path, settled, settled_each, swept  # noqa: F401

#: Rows of three longs at most that a checked broadcast may hold (about 25 MB).
BROADCAST_ROWS = 300_000

#: A new folder below spark.checkpoint.dir, which every executor sees.
shared_folder = scratch_path


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends here, a lost executor
    costs nothing, and later passes read only the columns they need."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about size bytes at most inside, whatever the number of their rows: a task's JVM and its
    Python worker each hold one or two. The session's setting returns on leaving."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(size, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch that whole texts travel in. Spark's own 64 MB, doubled while a batch grows and held on
#: both sides of each task's pipe, take hundreds of MB of an executor beside its heap.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH) -> None:
    """From now on the session's Arrow batches hold about size bytes at most, whatever the number of their rows. For
    results that run later than the call returns; see small_batches for work that ends inside it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, min(size, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if it holds no more than `rows` rows; a larger df is left to a
    shuffle join. Only for stored frames, as it counts them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names of new columns for df: the given ones, with underscores until nothing in df clashes."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stands still: every round works
    on edges only, by min-aggregations with partial sums, and by joins: with a broadcast side while
    the nodes are few enough, else of a kind that adaptive execution can split, so a star with
    millions of leaves is no single task's work. Self-loops and repeated edges do no harm; an empty
    input gives an empty result.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    mark = _mark(now)
    while mark[0]:
        small_side = F.broadcast if 2 * mark[0] <= BROADCAST_ROWS else lambda df: df
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(small_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_side(lowest), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(then)
        now = then
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and an order-free hash."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


# A blocked Bloom filter as a table: one row a block, 256 bits of it in four longs. An item sets one
# bit in each long of one block.

#: Entries that a block takes (about 0.3 % of other items pass then), and the least and most blocks:
#: up to 8 million entries pass at that rate, 33 million at 16 %; a broadcast of 20 MB of longs at most.
BLOOM_LOAD, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 10, 1 << 19


@dataclass(frozen=True)
class Bloom:
    """table: (block, word0 .. word3), at most `blocks` rows."""

    table: DataFrame
    blocks: int


def _bloom_bits(item: Column, blocks: int) -> list[Column]:
    second = F.xxhash64(item, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int"))
    return [F.shiftright(item, 20).bitwiseAND(blocks - 1).cast("int"), *map(bit, range(4))]


def bloom_filter(items: DataFrame, item: str) -> Bloom:
    """The filter of the long hashes in column `item` of a frame that is stored (it is counted): as many
    blocks as its entries ask for, a power of two."""
    wanted = -(-items.count() // BLOOM_LOAD)
    blocks = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << max(0, wanted - 1).bit_length()))
    names = ["block", "bit0", "bit1", "bit2", "bit3"]
    bits = items.select(*(c.alias(n) for c, n in zip(_bloom_bits(F.col(item), blocks), names)))
    return Bloom(stored(bits.groupBy("block").agg(*(F.bit_or(f"bit{i}").alias(f"word{i}") for i in range(4)))), blocks)


def bloom_split(df: DataFrame, item: str, bloom: Bloom) -> tuple[DataFrame, DataFrame]:
    """df's rows whose hash `item` may be listed, and those whose hash isn't for sure (a null one never
    is). Joins the filter's bounded table by broadcast, so df isn't shuffled."""
    names = fresh(df, "block", *(f"bit{i}" for i in range(4)), *(f"word{i}" for i in range(4)))
    block, bit, word = names[0], names[1:5], names[5:]
    bits = df.select("*", *(c.alias(n) for c, n in zip(_bloom_bits(F.col(item), bloom.blocks), [block, *bit])))
    own = F.broadcast(bloom.table.toDF(block, *word))
    held = [F.col(w).bitwiseAND(F.col(b)) != 0 for w, b in zip(word, bit)]
    listed = held[0] & held[1] & held[2] & held[3]
    never = bits.join(own, block, "left").where(~F.coalesce(listed, F.lit(False)))
    return bits.join(own, block).where(listed).select(*df.columns), never.select(*df.columns)


def bloom_pass(df: DataFrame, item: str, bloom: Bloom) -> DataFrame:
    """The rows of df whose hash `item` may be listed."""
    return bloom_split(df, item, bloom)[0]


def without(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows of df whose keys aren't among those of gone, which is stored; rows with a null key stay.

    No wide row is shuffled: what the filter doesn't know stays where it is, and of the rest only
    keys are compared exactly. The few keys that passed the filter by chance bring their rows back
    by a broadcast, or by a join if they are many."""
    item, = fresh(df, "item")
    known = F.when(~F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False)), F.xxhash64(*keys))
    bloom = bloom_filter(gone.select(F.xxhash64(*keys).alias("item")), "item")
    may, never = bloom_split(df.withColumn(item, known), item, bloom)
    spared = stored(may.select(*keys).distinct().join(gone.select(*keys), list(keys), "left_anti"))
    back = may.join(checked_broadcast(spared), list(keys), "left_semi").select(*df.columns)
    return never.select(*df.columns).union(back)
