"""Benchmark decontamination by spaced seeds, all in DataFrame functions.

Tokens are the lower-cased runs of letters and digits. Three masks take six tokens each out of 7 or
11 in a row. Enumeration (tests/llm) shows that they leave a hash in common wherever the check
accepts: at every placement of the tokens that differ, in every window of 12 to 16 tokens of which
80 % agree. For other values of `window` and `share` nothing is guaranteed. Items of fewer than 12
tokens have a mask of all their tokens: they are found verbatim only, and those of fewer than 6
where they are a document's whole text.

Hashes of the benchmark's texts fill a Bloom filter of bounded size; hashes of the corpus that pass
it join the benchmark's exactly. Each hit names a diagonal (document, item, shift); around it the
two texts are compared token by token, and an overlap holds if of `window` aligned tokens (all of a
shorter item) a share of `share` agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import bloom_filter, bloom_pass, checked_broadcast, stored, without

#: The tokens that each mask takes, counted from its start.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 9, 10), (0, 1, 3, 7, 8, 10))
#: Tokens that an overlap compares at least, and of which a shorter item found inside a text consists.
LEAST, INSIDE = 12, 6


def tokens(text: Column) -> Column:
    """The lower-cased runs of letters and digits, in order; empty for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def seeds(df: DataFrame, ids: list[str], words: str, short: list[int]) -> DataFrame:
    """(*ids, at, seed): each mask's hash at each position of the array `words` where it fits. short: the
    sizes of items under LEAST tokens; each has a mask of its own. Hashes are made in rows of
    positions, not of tokens: a row holds a reference to its text's hashes while it is looked up."""
    hashes = df.select(*ids, F.transform(words, lambda t: F.xxhash64(t)).alias("_h")).where(F.size("_h") > 0)
    rows = hashes.select(*ids, "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)).alias("at"))
    token = lambda i: F.get("_h", F.col("at") + i)
    found = [F.when(token(m[-1]).isNotNull(), F.xxhash64(F.lit(n), *map(token, m))) for n, m in enumerate(MASKS)]
    for size in short:
        fits = token(size - 1).isNotNull() if size >= INSIDE else (F.col("at") == 0) & (F.size("_h") == size)
        found.append(F.when(fits, F.xxhash64(F.lit(-size), *map(token, range(size)))))
    return rows.select(*ids, "at", F.explode(F.array(*found)).alias("seed")).where("seed IS NOT NULL")


def overlaps(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = 16, share: float = 0.8,
) -> DataFrame:
    """(id_col, item_col, matched, compared): document and item pairs with a verified overlap, and the
    best one's tokens that agree and that were compared.

    An overlap compares 12 tokens at least, or all of a shorter item, which must agree. Null ids,
    null texts and items without tokens match nothing. Items with equal tokens are one item, the one
    with the smallest id. Rows of one id with different texts are compared separately and count
    together; rows that repeat wholly count once. Either table may be empty.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), tokens(F.col(item_text).cast("string")).alias("_words")).where("_item IS NOT NULL")
    items = stored(items.groupBy("_words").agg(F.min("_item").alias("_item")).where(F.size("_words") > 0).withColumn("_size", F.size("_words")))
    short = sorted(r._size for r in items.where(F.col("_size") < LEAST).select("_size").distinct().collect())  # at most 11 numbers
    known = seeds(items, ["_item"], "_words", short).join(items.select("_item", "_size"), "_item")
    # A short item is known by its own mask alone, a long one by the three.
    own = F.when(F.col("_size") >= LEAST, True)
    for size in short:
        own = own.when((F.col("_size") == size) & (F.col("at") == 0), True)
    known = stored(known.where(own).select("_item", "_size", F.col("at").alias("_item_at"), "seed").distinct())

    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_version"), text.alias("_text")).where("_doc IS NOT NULL AND _text IS NOT NULL")
    near = bloom_pass(seeds(docs.select("_doc", "_version", tokens(F.col("_text")).alias("_words")), ["_doc", "_version"], "_words", short), "seed", bloom_filter(known, "seed"))
    hits = near.join(checked_broadcast(known), "seed").select("_doc", "_version", "_item", (F.col("at") - F.col("_item_at")).alias("_shift"))
    hits = stored(hits.distinct().join(checked_broadcast(items.select("_item", "_size")), "_item"))

    # Of the documents, only those that have hits are shuffled to meet them, each once. A hit's part
    # of the document: at the item's place, cut where the document begins or ends.
    may = bloom_pass(docs.withColumn("_hash", F.xxhash64("_doc", "_version")), "_hash", bloom_filter(hits.select(F.xxhash64("_doc", "_version").alias("item")), "item"))
    texts = may.select("_doc", "_version", tokens(F.col("_text")).alias("_words")).dropDuplicates(["_doc", "_version"])
    part = F.slice("_words", F.greatest("_shift", F.lit(0)) + 1, F.col("_size") + F.least("_shift", F.lit(0)))
    each = hits.join(texts.hint("merge"), ["_doc", "_version"]).select("_doc", "_item", "_shift", part.alias("_part"))
    both = each.join(checked_broadcast(items), "_item")
    theirs = F.slice("_words", F.greatest(-F.col("_shift"), F.lit(0)) + 1, F.size("_part"))
    both = both.withColumn("_same", F.zip_with("_part", theirs, lambda a, b: (a == b).cast("int")))
    both = both.withColumn("compared", F.least(F.size("_same"), F.lit(window)))
    both = both.where((F.col("compared") >= LEAST) | (F.col("compared") == F.col("_size")))
    starts = F.sequence(F.lit(1), F.size("_same") - F.col("compared") + 1)
    agree = F.transform(starts, lambda i: F.aggregate(F.slice("_same", i, F.col("compared")), F.lit(0), lambda n, x: n + x))
    least = F.when(F.col("_size") < LEAST, F.col("_size")).otherwise(F.ceil(F.lit(share) * F.col("compared")))
    both = both.withColumn("matched", F.array_max(agree)).where(F.col("matched") >= least)
    best = both.groupBy("_doc", "_item").agg(F.max(F.struct(F.col("matched") / F.col("compared"), "matched", "compared")).alias("best"))
    return best.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), F.col("best.matched").cast("long").alias("matched"), F.col("best.compared").cast("long").alias("compared"))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """(id_col, n_items, first_item, matched, compared): a row for each document with an overlap, with
    its number of items, the smallest of them and that one's best window. No rows for an empty
    table; see overlaps for nulls and repeats."""
    found = overlaps(df, benchmark, id_col, **more)
    item = next(c for c in found.columns if c not in (id_col, "matched", "compared"))
    first = F.min(F.struct(F.col(item).alias("item"), "matched", "compared"))
    rows = found.groupBy(id_col).agg(F.count("*").alias("n_items"), first.alias("first"))
    return rows.select(id_col, "n_items", F.col("first.item").alias("first_item"), F.col("first.matched").alias("matched"), F.col("first.compared").alias("compared"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of df without an overlap; rows with a null id or text stay."""
    gone = stored(overlaps(df, benchmark, id_col, **more).select(id_col).distinct())
    return without(df, gone, id_col)
