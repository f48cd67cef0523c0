"""Reproducible samples: the first and the last rows by an order, and some chosen by hashed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.text import clip
from siftmill.operators.columns import quoted

PER_BUCKET, SEED, CELL_CHARS = 5, 42, 60


def first_rows(df: DataFrame, *order: str, n: int = PER_BUCKET) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, *order: str, n: int = PER_BUCKET) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def random_rows(df: DataFrame, key: str, n: int = PER_BUCKET, seed: int = SEED) -> DataFrame:
    """The n rows with the least md5 of key and seed: the same in any partitioning, and a top-k, not a sort."""
    return df.orderBy(F.md5(F.concat_ws("|", quoted(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def compact_rows(df: DataFrame, most: int = CELL_CHARS) -> DataFrame:
    """Rows with their strings cut to `most` characters and an ellipsis."""
    return df.select(*(clip(quoted(f.name), most).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in df.schema))


def representative_sample(df: DataFrame, key: str, n: int = PER_BUCKET, seed: int = SEED) -> DataFrame:
    """(bucket, row): first, random and last rows, compacted, as JSON."""
    row = F.to_json(F.struct("*"))
    buckets = {"first": first_rows(df, key, n=n), "random": random_rows(df, key, n, seed), "last": last_rows(df, key, n=n)}
    parts = [compact_rows(rows).select(F.lit(b).alias("bucket"), row.alias("row")) for b, rows in buckets.items()]
    return parts[0].union(parts[1]).union(parts[2])
