"""Profiles of streams: what a batch profile says, kept up to date as files arrive.

Each micro-batch is reduced to mergeable partial aggregates by column and written as its own
partition of a state table, so a batch that runs again after a failure replaces its own part. The
profile is one small aggregation over that table. Ranks come from KLL sketches, whose error is
known; counts, moments and extremes are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.operators.columns import numeric_columns, quoted

SKETCH = 400  # k of the sketches: ranks to about half a percent


def partial_profile(df: DataFrame, *by: str) -> DataFrame:
    """(column, numeric, rows, missing, low, high, total, squares, least, most, sketch): one batch's
    aggregates for each column; low and high are the least and the greatest value as text. by: columns
    that number the batches of a table, which aren't profiled themselves."""
    numeric = numeric_columns(df)
    each = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.name in numeric).alias("numeric"),
            quoted(f.name).cast("string").alias("text"), (quoted(f.name).cast("double") if f.name in numeric else F.lit(None).cast("double")).alias("value"),
        )
        for i, f in enumerate(df.schema) if f.name not in by and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.VariantType))
    ]
    rows = df.select(*by, F.explode(F.array(*each)).alias("r")).select(*by, "r.*")
    return rows.groupBy(*by, "position", "column", "numeric").agg(
        F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("missing"), F.min("text").alias("low"), F.max("text").alias("high"),
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.sum(F.length("text")).alias("chars"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"),
    )


def merged_profile(parts: DataFrame) -> DataFrame:
    """(position, column, rows, missing, chars, is_constant, min, max, mean, std, q1, median, q3): all batches'
    aggregates together. mean and std to 6 places; a column is constant if it has one value or none."""
    sums = parts.groupBy("position", "column", "numeric").agg(
        *(F.sum(c).alias(c) for c in ("rows", "missing", "total", "squares", "chars")), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.max((F.col("missing") > 0).cast("int")).alias("holes"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    n = F.col("rows") - F.col("missing")
    mean = F.try_divide("total", n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - F.col("total") * mean, n - 1)))
    constant = (F.col("low").eqNullSafe(F.col("high"))) & ((F.col("holes") == 0) | F.col("low").isNull())
    rank = lambda q: F.when(F.col("numeric") & (n > 0), F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return sums.select(
        "position", "column", "rows", "missing", "chars", constant.alias("is_constant"), F.col("least").alias("min"), F.col("most").alias("max"),
        F.round(mean, 6).alias("mean"), F.round(F.when(F.col("numeric"), F.coalesce(spread, F.lit(0.0))), 6).alias("std"), rank(0.25).alias("q1"), rank(0.5).alias("median"), rank(0.75).alias("q3"),
    )


def profile_stream(stream: DataFrame, state: str, checkpoint: str, once: bool = True):
    """Starts a query that keeps state, a Parquet folder, up to date; profile_so_far reads it. once: stop
    when what is there has been read."""

    def step(batch: DataFrame, number: int) -> None:
        partial_profile(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def profile_so_far(spark: SparkSession, state: str) -> DataFrame:
    return merged_profile(spark.read.option("basePath", state).parquet(f"{state}/batch=*"))


def duplicates_so_far(stream: DataFrame) -> DataFrame:
    """(hash, n): rows of a stream that are alike, as a streaming aggregation (update or complete mode)."""
    return stream.groupBy(F.xxhash64(F.struct(*(quoted(c) for c in stream.columns))).alias("hash")).agg(F.count("*").alias("n"))


def windowed_profile(events: DataFrame, time_col: str, value_col: str, key_col: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, key, n, mean, least, most): an extension of the reference's chunks to event time: tumbling
    windows with a watermark, so that state stays bounded."""
    grouped = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key"))
    sums = grouped.agg(F.count("*").alias("n"), F.avg(value_col).alias("mean"), F.min(value_col).alias("least"), F.max(value_col).alias("most"))
    return sums.select(F.col("w.start").alias("start"), "key", "n", "mean", "least", "most")
