"""Near-duplicate detection by SimHash and multi-index hashing.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints at 3 or fewer differing bits
link. Such a pair differs in at most one bit in the upper or in the lower 32 bits, so both halves
are indexed: each fingerprint enumerates the Hamming ball of radius one about each of its halves,
fetches the table's matches, and the whole distance is verified.

Groups of near copies never expand into pairs. First every fingerprint joins the points at
distance one or less of itself; fingerprints that meet at a point differ in two bits at most, so
a chain along each point (65 fingerprints at most) connects them. What is left for the index are
pairs between different groups: keys whose matches all belong to one group are dropped before
the join, and keys with very many pairs are resolved without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import checked_broadcast, connected_components, stored, without

#: Shingles hashed and counted at a time, so that a very long text needs little memory.
BLOCK = 1 << 16
#: Index keys with more pairs than this (members times members and probes) are resolved by meeting points.
HEAVY = 1 << 20


def text_fingerprint(text: bytes, words: int, seed: int) -> int:
    """The SimHash of UTF-8 bytes; 0 if there are no words."""
    import numpy as np
    import xxhash

    tokens = text.lower().split()  # on bytes: A-Z only, and white space is 20 and 09-0D
    digest = xxhash.xxh64_intdigest
    if not tokens:
        return 0
    if len(tokens) <= words:
        return digest(b" ".join(tokens), seed)
    total, ones = len(tokens) - words + 1, np.zeros(64, "int64")
    for start in range(0, total, BLOCK):
        part = tokens[start : start + BLOCK + words - 1]
        hashes = np.fromiter((digest(x, seed) for x in map(b" ".join, zip(*(part[i:] for i in range(words))))), "<u8", len(part) - words + 1)
        ones += np.unpackbits(hashes.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp long): a row for each row of df; a null or wordless text has fingerprint 0, a text
    of fewer than `words` words is one shingle. Other columns of df aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = (text_fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), words, seed) for t in texts)
            signed = [x - (1 << 64) if x >> 63 else x for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def _ball(value: str, bits: int) -> F.Column:
    """value and value with any one of its low bits flipped."""
    return F.expr(f"concat(array({value}), transform(sequence(0, {bits - 1}), i -> {value} ^ shiftleft(1L, i)))")


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at distance 3 or less.
    reps: (fp, rep), each fingerprint once, neither null, rep being unique too; it may be empty."""
    points = reps.select("rep", F.explode(_ball("fp", 64)).alias("point"))
    along = Window.partitionBy("point").orderBy("rep")
    close = stored(points.select("rep", F.lag("rep").over(along).alias("before")).where("before IS NOT NULL").select(F.col("rep").alias("a"), F.col("before").alias("b")).distinct())

    groups = connected_components(close)
    named = stored(reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "fp", F.coalesce("component", "rep").alias("grp")))
    # The key of a half: its 32 bits, with the half's number in bit 32.
    halves = F.expr("array(shiftrightunsigned(fp, 32), (fp & 4294967295L) | 4294967296L)")
    table = named.select("rep", "fp", "grp", F.explode(halves).alias("key"))
    # Of two halves that differ in one bit, one has that bit at 0: it alone enumerates it.
    flips = F.expr("transform(filter(sequence(0, 31), i -> (half & shiftleft(1L, i)) = 0), i -> half | shiftleft(1L, i))")
    probes = (
        table.select("rep", "fp", "grp", F.col("key").alias("half"))
        .select("rep", "fp", "grp", F.explode(flips).alias("key"))
    )
    members = table.select("key", "grp", F.lit(1).alias("own")).union(probes.select("key", "grp", F.lit(0)))
    mixed = stored(
        members.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.sum("own").alias("own"), F.count("*").alias("n"))
        .where("low < high AND own > 0").select("key", (F.col("own") * F.col("n")).alias("pairs"))
    )
    light, heavy = (checked_broadcast(mixed.where(w).select("key")) for w in (f"pairs <= {HEAVY}", f"pairs > {HEAVY}"))
    left = table.unionByName(probes)
    pairs = (
        left.join(light, "key").alias("x").join(table.join(light, "key").alias("y"), "key")
        .where("x.grp != y.grp AND bit_count(x.fp ^ y.fp) <= 3").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    return close.union(pairs).union(_heavy_links(table.join(heavy, "key"), probes.join(heavy, "key")))


def _heavy_links(table: DataFrame, probes: DataFrame) -> DataFrame:
    """The links of keys with very many matches, without pairs. The halves of members are equal (or,
    for probes, one bit apart), so the other half decides: it differs from some point by one bit
    on one side, and by two (probes: one) on the other. Who is within one bit of a point links
    with all others there; a point has 33 of those at most, so its first member stands for it."""
    other = F.expr("CASE WHEN key >= 4294967296L THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    two = F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> half ^ shiftleft(1L, i) ^ shiftleft(1L, j))))")
    own, theirs = table.withColumn("half", other), probes.withColumn("half", other)
    near = own.select("key", "rep", F.explode(_ball("half", 32)).alias("point"))
    far = own.select("key", "rep", F.explode(two).alias("point")).union(theirs.select("key", "rep", F.explode(_ball("half", 32)).alias("point")))
    first = near.groupBy("key", "point").agg(F.min("rep").alias("b"))
    return near.union(far).join(first, ["key", "point"]).where("rep != b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp long, component_id): a row for each row of df.

    component_id is the smallest id that links of 3 or fewer differing bits lead to, its own
    included. Exact copies share a fingerprint and are one node. Empty and null texts have
    fingerprint 0 and link like any other. Rows with a null id get their fingerprint's component
    and name none (null, if nobody else is in it). Repeated rows each keep a row.
    """
    own = stored(fingerprints(df, id_col, text_col, words, seed))
    reps = stored(own.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")))
    found = connected_components(fingerprint_links(reps))
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select(id_col, "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of df of which one stays for each component: that with the smallest id (rows that
    repeat this id stay too). Rows with a null id stay. All columns stay as they are."""
    found = near_duplicates(df, id_col, text_col, words, seed)
    gone = stored(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return without(df, gone, id_col)
