"""Facets of a stream beyond single columns: correlations, frequent values, samples, outliers.

A facet turns a micro-batch into a few rows of partial state, which are written as that batch's own
part of a state table; a batch that runs again after a failure replaces its part. What a facet says
is one small aggregation over all parts, in whatever order they came. Where the state alone can't
settle a result (values outside of bounds that only the whole stream gives; counts of values that
some batch had to leave out), a second query reads the source again, with its own checkpoint,
against what the first one froze.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.operators import columns as C
from siftmill.operators.columns import numeric_columns, quoted

#: Values of a column that a batch's part holds, and the longest value that counts (fixed values).
CATEGORY_CAP, CATEGORY_CHARS = 500, 40
#: Pairs of columns that one aggregation takes.
PAIRS = 64
#: Limits of what is told (fixed values).
TOP_PAIRS, TOP_VALUES, TOP_NUMERIC, TOP_OUTLIERS = 5, 5, 10, 10

Facet = Callable[[DataFrame], DataFrame]


def facet_stream(stream: DataFrame, state: str, checkpoint: str, facets: dict[str, Facet], once: bool = True):
    """Starts a query that keeps {state}/{facet} up to date for each of the facets; parts reads them. once:
    stop when what is there has been read. A batch is read once, however many facets it has."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, facet in facets.items():
                facet(batch).write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def parts(spark: SparkSession, state: str, facet: str) -> DataFrame:
    """All batches' rows of a facet, with the column batch. A stream without any batch has no parts yet, and
    this raises."""
    return spark.read.option("basePath", f"{state}/{facet}").parquet(f"{state}/{facet}/batch=*")


# Correlations


def _number(name: str) -> Column:
    x = quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def co_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, position, n, mean_a, mean_b, var_a, var_b, cov): of each pair of numeric columns, over the rows where
    neither is null or NaN; the last three are sums of squares and products around the means."""
    names = columns if columns is not None else numeric_columns(df)
    pairs = list(combinations(range(len(names)), 2))
    kind = "a string, b string, position int, n long, mean_a double, mean_b double, var_a double, var_b double, cov double"

    def some(chunk: list[tuple[int, int]]) -> DataFrame:
        aggs = []
        for i, j in chunk:
            x, y = _number(names[i]), _number(names[j])
            own, other = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            n = F.count(own)
            aggs.append(F.struct(
                F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.lit(i * len(names) + j).alias("position"), n.alias("n"), F.avg(own).alias("mean_a"), F.avg(other).alias("mean_b"),
                (F.var_pop(own) * n).alias("var_a"), (F.var_pop(other) * n).alias("var_b"), (F.covar_pop(x, y) * n).alias("cov"),
            ))
        return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("r")).select("r.*").where("n > 0")

    found = [some(pairs[i : i + PAIRS]) for i in range(0, len(pairs), PAIRS)]
    return reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], kind)


def merged_correlations(moments: DataFrame) -> DataFrame:
    """(a, b, position, n, value): Pearson correlations of all batches together, to 4 places. Parts are moved to the
    common mean before they are added, so nothing cancels. Pairs with fewer than two rows or without
    spread are left out."""
    pair = Window.partitionBy("a", "b")  # a row a batch
    total = F.sum("n").over(pair)
    whole = lambda m: F.sum(F.col("n") * F.col(m)).over(pair) / total
    rows = moments.withColumns({"da": F.col("mean_a") - whole("mean_a"), "db": F.col("mean_b") - whole("mean_b")})
    sums = rows.groupBy("a", "b", "position").agg(
        F.sum("n").alias("n"), F.sum(F.col("var_a") + F.col("n") * F.col("da") * F.col("da")).alias("va"),
        F.sum(F.col("var_b") + F.col("n") * F.col("db") * F.col("db")).alias("vb"), F.sum(F.col("cov") + F.col("n") * F.col("da") * F.col("db")).alias("c"),
    )
    sums = sums.where("n > 1 AND va > 0 AND vb > 0")
    return sums.select("a", "b", "position", "n", F.round(F.col("c") / (F.sqrt("va") * F.sqrt("vb")), 4).alias("value"))


def strongest_pairs(pairs: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """(sign, a, b, value, rank): the k strongest pairs of each sign; ties in the order of columns."""
    signed = pairs.where("value != 0").withColumn("sign", F.when(F.col("value") > 0, "positive").otherwise("negative"))
    order = Window.partitionBy("sign").orderBy(F.desc(F.abs("value")), "position")
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("sign", "a", "b", "value", "rank")


# Frequent values


def frequent_values(df: DataFrame, columns: list[str], cap: int = CATEGORY_CAP, longest: int = CATEGORY_CHARS) -> DataFrame:
    """(column, value, n, floor): a batch's `cap` most frequent values of each column, null and values longer than
    `longest` left out. floor is the greatest count among values that the cap left out, 0 if there are
    none; it stands in each of the column's rows, and in one with a null value, whose n is the rows left out."""
    f = C.frequencies(df, columns).where(f"value IS NOT NULL AND length(value) <= {longest}")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = f.select("column", "value", "n", F.row_number().over(order).alias("rank")).where(F.col("rank") <= cap + 1)
    edge = top.where(F.col("rank") == cap + 1).select("column", F.col("n").alias("floor"))
    all_rows = f.groupBy("column").agg(F.sum("n").alias("all"))
    kept = top.where(F.col("rank") <= cap)
    rest = all_rows.join(kept.groupBy("column").agg(F.sum("n").alias("some")), "column").select("column", F.lit(None).cast("string").alias("value"), (F.col("all") - F.col("some")).alias("n"))
    return kept.select("column", "value", "n").union(rest).join(F.broadcast(edge), "column", "left").fillna(0, ["floor"])


def merged_values(found: DataFrame) -> DataFrame:
    """(column, value, count, most, overflow): a value occurs at least count times and at most `most` times: in each
    batch whose part lacks it, no more often than that batch's floor. overflow tells whether any batch
    left out values of the column; without it count and most are equal, and exact."""
    floors = found.where("value IS NULL").groupBy("column").agg(F.sum("floor").alias("all_floors"))
    sums = found.where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("n").alias("count"), F.sum("floor").alias("own"))
    both = sums.join(F.broadcast(floors), "column")
    return both.select("column", "value", "count", (F.col("count") + F.col("all_floors") - F.col("own")).alias("most"), (F.col("all_floors") > 0).alias("overflow"))


def open_values(merged: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(column, value): the values that may be among the k most frequent ones of columns that overflowed: those whose
    `most` reaches the k-th count. Whether a value that no batch kept can, settled_columns tells."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    bar = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("column", F.col("count").alias("bar"))
    return merged.where("overflow").join(F.broadcast(bar), "column", "left").where(F.col("most") >= F.coalesce("bar", F.lit(0))).select("column", "value")


def settled_columns(found: DataFrame, merged: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(column): those of which a value that no batch kept can't be among the k most frequent ones, as its count
    is at most the sum of all floors. For others the cap was too small; a larger one decides."""
    floors = found.where("value IS NULL").groupBy("column").agg(F.sum("floor").alias("floors"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    bar = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("column", F.col("count").alias("bar"))
    return floors.join(bar, "column", "left").where("floors = 0 OR bar > floors").select("column")


def counts_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(column, value, n): how often a batch has each of the wanted values (column, value), which are at most a few
    hundred a column: the second pass."""
    names = [r.column for r in wanted.select("column").distinct().collect() if r.column in df.columns]
    return C.frequencies(df, names).join(F.broadcast(wanted), ["column", "value"]).select("column", "value", "n")


def top_values(merged: DataFrame, recounted: DataFrame | None = None, k: int = TOP_VALUES) -> DataFrame:
    """(column, value, count, rank): the k most frequent values; ties by value. recounted (column, value, n): exact
    counts from a second pass, which take the place of lower bounds."""
    rows = merged.where("NOT overflow").select("column", "value", "count")
    if recounted is not None:
        rows = rows.union(recounted.groupBy("column", "value").agg(F.sum("n").alias("count")))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Samples


def _hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", quoted(key).cast("string"), F.lit(str(seed))))


def least_hashes(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k rows with the smallest hashes of key and seed, and the hash as the column draw: a sample that comes out
    the same however the rows are batched, and again after a failure."""
    return df.withColumn("draw", _hashed(key, seed)).orderBy("draw", quoted(key)).limit(k)


def merged_sample(found: DataFrame, key: str, k: int) -> DataFrame:
    return found.orderBy("draw", quoted(key)).limit(k).drop("draw", "batch")


def placed(stream: DataFrame) -> DataFrame:
    """A stream of Parquet files with each row's place: its file's path and its number in the file."""
    return stream.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def last_rows(df: DataFrame, *order: str, k: int = 5) -> DataFrame:
    """The last k rows of a batch, or of all batches' parts, in the order of these columns; batches may come in any
    order."""
    return df.orderBy(*(quoted(c).desc() for c in order)).limit(k)


# Outliers


def chunk_quartiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, q1, median, q3) of a batch's numeric columns: exact values of the nearest ranks, and the median."""
    names = columns if columns is not None else numeric_columns(df)
    found = C.order_statistics(df, names, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    pick = lambda name, c: F.max(F.when(F.col("name") == name, c)).alias(name)
    return found.groupBy("column", "n").agg(pick("q1", F.col("nearest")), pick("median", (F.col("low") + F.col("high")) / 2), pick("q3", F.col("nearest")))


def frozen_bounds(quartiles: DataFrame) -> DataFrame:
    """(column, n, q1, median, q3, lo, hi): the upper medians of the batches' quartiles, and one and a half ranges
    around them. Columns without a range are left out. One row a column."""
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))
    whole = quartiles.groupBy("column").agg(F.sum("n").alias("n"), *(upper(c).alias(c) for c in ("q1", "median", "q3"))).where("q1 != q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return whole.select("*", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))


def outside(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """(column, outliers): a batch's values strictly outside the bounds (a row a column): the second pass."""
    names = [r.column for r in bounds.select("column").collect() if r.column in df.columns]
    kind = "column string, outliers long"
    if not names:
        return df.sparkSession.createDataFrame([], kind)
    each = F.array(*(F.struct(F.lit(n).alias("column"), _number(n).alias("value")) for n in names))
    values = df.select(F.explode(each).alias("r")).select("r.*").where("value IS NOT NULL")
    return values.join(F.broadcast(bounds), "column").groupBy("column").agg(F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outliers"))


def merged_outliers(found: DataFrame, bounds: DataFrame, k: int | None = TOP_OUTLIERS) -> DataFrame:
    """(column, lo, hi, outliers, share, rank): the k columns with the most outliers (all that have some, if None);
    share, of the column's values, to 4 places; ties by name."""
    sums = found.groupBy("column").agg(F.sum("outliers").alias("outliers")).where("outliers > 0")
    rank = F.row_number().over(Window.orderBy(F.desc("outliers"), "column"))  # a row a column
    rows = sums.join(F.broadcast(bounds), "column").select("column", "lo", "hi", "outliers", F.round(F.col("outliers") / F.col("n"), 4).alias("share"), rank.alias("rank"))
    return rows if k is None else rows.where(F.col("rank") <= k)


# Kinds and order of columns


def streamed_kinds(schema: T.StructType, profile: DataFrame, values: DataFrame, cap: int = CATEGORY_CAP) -> DataFrame:
    """(position, column, bucket): what a batch profile would call each column, from the merged profile (with chars)
    and the merged frequent values: a string column is text if its values are longer than 60 characters
    on average, or if it has more values than the cap. Without any value it is categorical."""

    def bucket(kind: T.DataType) -> str:
        return "numeric" if isinstance(kind, T.NumericType) else "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "boolean" if isinstance(kind, T.BooleanType) else "string" if isinstance(kind, T.StringType) else "categorical"

    spark = profile.sparkSession
    names = spark.createDataFrame([(i, f.name, bucket(f.dataType)) for i, f in enumerate(schema)], "position int, column string, kind string")
    full = values.groupBy("column").agg((F.max("overflow") | (F.count("*") > cap)).alias("overflow"))
    held = F.col("rows") - F.col("missing")
    rows = names.join(F.broadcast(profile.select("column", "rows", "missing", "chars")), "column", "left").join(F.broadcast(full), "column", "left")
    text = (F.coalesce(F.try_divide("chars", held), F.lit(0)) > C.TEXT_LENGTH) | F.coalesce("overflow", F.lit(False))
    none = F.coalesce(held, F.lit(0)) == 0
    return rows.select("position", "column", F.when(none & F.col("rows").isNotNull(), "categorical").when(F.col("kind") != "string", F.col("kind")).when(text, "text").otherwise("categorical").alias("bucket"))


def by_variation(profile: DataFrame, k: int = TOP_NUMERIC) -> DataFrame:
    """(column, mean, std, cv, rank): the k numeric columns of a merged profile that vary most; cv is std / |mean|, 0
    where the mean is 0 or missing; of equals the greater mean in size comes first, then the earlier column. Columns with NaN are left out."""
    cv = F.when(F.col("mean").isNull() | (F.col("mean") == 0), F.lit(0.0)).otherwise(F.abs(F.col("std") / F.col("mean")))
    rows = profile.where("mean IS NOT NULL AND NOT isnan(mean)").select("position", "column", "mean", "std", cv.alias("cv"))
    order = Window.orderBy(F.desc("cv"), F.desc(F.abs("mean")), "position")  # a row a column
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("position")
