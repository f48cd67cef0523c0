"""Column profiles: kinds, quality, moments, ranks, correlations, outliers, categories.

Every facet is a DataFrame with a row for each column (or pair, or value). Moments come from one
aggregation over the table; whatever depends on single values comes from a frequency table,
(column, value, n), which partial aggregation keeps small before it is shuffled.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits and thresholds of the profile (fixed values).
TEXT_LENGTH, TEXT_SHARE, IMBALANCE = 60, 0.5, 0.8
TOP_NUMERIC, CORRELATED, TOP_PAIRS, TOP_CATEGORICAL, TOP_VALUES, TOP_OUTLIERS, TOP_MISSING, PREVIEW = 10, 40, 5, 8, 5, 8, 5, 15


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _comparable(df: DataFrame, name: str) -> Column:
    """A column that can be grouped by: maps and variants as JSON text."""
    kind = df.schema[name].dataType
    return F.to_json(quoted(name)) if isinstance(kind, (T.MapType, T.VariantType)) else quoted(name)


def _rows(df: DataFrame, names: list[str], **parts) -> DataFrame:
    """df's single row of aggregates `{name}{i}` as a row for each column i: (position, column, parts)."""
    each = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), *(F.col(f"{p}{i}").cast(kind).alias(p) for p, kind in parts.items()))
        for i, n in enumerate(names)
    ]
    kinds = ", ".join(f"{p} {kind}" for p, kind in parts.items())
    empty = F.from_json(F.lit("[]"), f"array<struct<position int, column string, {kinds}>>")
    return df.select(F.explode(F.array(*each) if each else empty).alias("r")).select("r.*")


# Frequencies


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, value string, n): how often each value of each column occurs, null included."""
    names = columns if columns is not None else df.columns
    each = [F.struct(F.lit(df.columns.index(n)).alias("position"), F.lit(n).alias("column"), _text(df, n).alias("value")) for n in names]
    if not each:
        return df.sparkSession.createDataFrame([], "position int, column string, value string, n long")
    # Partial sums over the columns' own values, before anything is shuffled.
    return df.select(F.explode(F.array(*each)).alias("r")).select("r.*").groupBy("position", "column", "value").agg(F.count("*").alias("n"))


def value_digests(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, digest, chars, n): frequencies by 128 bits of each value's hash and its length, null included
    (a null digest): what only counts or measures values needn't shuffle them, however long they are."""
    names = columns if columns is not None else df.columns
    each = [F.struct(F.lit(df.columns.index(n)).alias("position"), F.lit(n).alias("column"), _text(df, n).alias("value")) for n in names]
    if not each:
        return df.sparkSession.createDataFrame([], "position int, column string, digest struct<a: long, b: long>, chars int, n long")
    rows = df.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    digest = F.when(F.col("value").isNotNull(), F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b")))
    return rows.groupBy("position", "column", digest.alias("digest"), F.length("value").alias("chars")).agg(F.count("*").alias("n"))


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    return F.to_json(quoted(name)) if nested else F.hex(quoted(name)) if isinstance(kind, T.BinaryType) else quoted(name).cast("string")


# Kinds and quality


def column_kinds(df: DataFrame) -> DataFrame:
    """(position, column, bucket): numeric, datetime, boolean, text or categorical. A string column is
    text if its values are longer than 60 characters on average, or if more than half as many
    values as rows are distinct (null being one)."""
    fixed, strings = {}, []
    for i, f in enumerate(df.schema):
        kind = f.dataType
        if isinstance(kind, T.StringType):
            strings.append(f.name)
        else:
            fixed[i, f.name] = "numeric" if isinstance(kind, T.NumericType) else "datetime" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "boolean" if isinstance(kind, T.BooleanType) else "categorical"
    known = df.sparkSession.createDataFrame([(i, n, b) for (i, n), b in fixed.items()], "position int, column string, bucket string")
    f = value_digests(df, strings).groupBy("position", "column").agg(
        F.count("*").alias("distinct"), F.sum("n").alias("rows"),
        (F.sum(F.col("chars") * F.col("n")) / F.sum(F.when(F.col("chars").isNotNull(), F.col("n")))).alias("length"),
    )
    text = (F.coalesce("length", F.lit(0)) > TEXT_LENGTH) | (F.col("distinct") > TEXT_SHARE * F.col("rows"))
    return known.union(f.select("position", "column", F.when(text, "text").otherwise("categorical")))


def column_preview(kinds: DataFrame, most: int = PREVIEW) -> DataFrame:
    """(bucket, columns, listed): how many columns of each kind there are, and the first `most` names, the rest as a
    number."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"])
    rows = kinds.groupBy("bucket").agg(F.count("*").alias("columns"), names.alias("names"))
    more = F.when(F.col("columns") > most, F.array(F.format_string("... %d more", F.col("columns") - most))).otherwise(F.array().cast("array<string>"))
    return rows.select("bucket", "columns", F.concat(F.slice("names", 1, most), more).alias("listed"))


def missing_values(df: DataFrame) -> DataFrame:
    """(position, column, missing): nulls in each column."""
    counts = df.agg(*(F.count_if(quoted(n).isNull()).alias(f"missing{i}") for i, n in enumerate(df.columns)))
    return _rows(counts, df.columns, missing="long")


def distinct_values(df: DataFrame) -> DataFrame:
    """(position, column, n_unique, is_constant): distinct values, null being one. An empty table's
    columns have none and are constant."""
    found = value_digests(df).groupBy("position", "column").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, column string")
    n = F.coalesce("n", F.lit(0))
    return names.join(F.broadcast(found), ["position", "column"], "left").select("position", "column", n.alias("n_unique"), (n <= 1).alias("is_constant"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows): k equal rows count as k-1 duplicates; nulls equal each other."""
    groups = df.select(*(_comparable(df, n).alias(f"c{i}") for i, n in enumerate(df.columns))).groupBy(*(f"c{i}" for i in range(len(df.columns)))).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


# Ranks


def _valid(name: str) -> Column:
    """A column as doubles, without NaN."""
    x = quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def order_statistics(df: DataFrame, columns: list[str], shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(column, n, name, low, high, nearest) for each share: the values of the 0-based ranks that are
    (n-1) * share rounded down, up and to the nearest among the column's values that aren't null or NaN, exactly.
    The brackets are found at once, by a pass of their own."""
    return _bracketed(df, columns, shares, accuracy, ())[1]


def _bracketed(df: DataFrame, columns: list[str], shares: dict[str, float], accuracy: int, more: tuple[Column, ...]) -> tuple[Row, DataFrame]:
    """The first pass's row, with the aggregates `more`, and order_statistics.

    The first pass, over whole rows, brackets all columns' ranks by approximate percentiles, along with
    whatever else is asked of the table; the second counts what lies below the brackets. The third
    turns values into rows, but only those inside a bracket, which are few.
    """
    kind = "column string, n long, name string, low double, high double, nearest double"
    slack = 2 / accuracy
    cuts = [c for s in shares.values() for c in (max(0.0, s - slack), min(1.0, s + slack))]
    first = df.agg(*more, *(a for i, c in enumerate(columns) for a in (F.count(_valid(c)).alias(f"n{i}"), F.percentile_approx(_valid(c), cuts, accuracy).alias(f"cuts{i}"))), F.count(F.lit(1)).alias("_all")).first()
    places = []
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        for j, (name, share) in enumerate(shares.items()):
            # In a small column the neighbouring rank may lie beyond the bracket: all its values are looked at.
            low, high = first[f"cuts{i}"][2 * j : 2 * j + 2] if n >= accuracy else (-math.inf, math.inf)
            places.append((c, n, name, low, high, math.floor((n - 1) * share), math.ceil((n - 1) * share), math.floor((n - 1) * share + 0.5)))
    places = [p for p in places if p[1]]
    if not places:
        return first, df.sparkSession.createDataFrame([], kind)
    below = df.agg(*(F.count_if(_valid(c) < low).alias(f"b{k}") for k, (c, _, _, low, *_) in enumerate(places))).first()
    held = F.array(*(F.when(_valid(c).between(low, high), F.struct(F.lit(k).alias("k"), _valid(c).alias("value"))) for k, (c, _, _, low, high, *_) in enumerate(places)))
    inside = df.select(F.explode(F.array_compact(held)).alias("r")).groupBy("r.k", "r.value").agg(F.count("*").alias("m"))
    wanted = [(k, c, n, name, below[f"b{k}"], *ranks) for k, (c, n, name, _, _, *ranks) in enumerate(places)]
    table = df.sparkSession.createDataFrame(wanted, "k int, column string, n long, name string, below long, down long, up long, near long")
    end = F.sum("m").over(Window.partitionBy("k").orderBy("value"))
    rows = inside.withColumn("end", end).join(F.broadcast(table), "k")  # a row a column and share
    at = lambda r: F.max(F.when((F.col("below") + F.col("end") - F.col("m") <= F.col(r)) & (F.col(r) < F.col("below") + F.col("end")), F.col("value")))
    return first, rows.groupBy("column", "n", "name").agg(at("down").alias("low"), at("up").alias("high"), at("near").alias("nearest"))


def ranked_values(values: DataFrame, by: list[str], shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(*by, n, name, low, high, nearest) for each group of values (*by, value double, without nulls and NaN)
    and share: see order_statistics.

    Three passes without a sort of everything: approximate percentiles bracket each rank from both
    sides; one aggregation counts what lies below the bracket and how often each value in it
    occurs; a window over the few values in the bracket finds the rank. So no group, however
    large, is sorted or held by one task; brackets meet the values by a join that adaptive execution
    can split.
    """
    slack = 2 / accuracy
    cuts = [c for s in shares.values() for c in (max(0.0, s - slack), min(1.0, s + slack))]
    spans = values.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("value", cuts, accuracy).alias("cuts"))
    # In a small group the neighbouring rank may lie beyond the bracket: all its values are looked at.
    small = F.col("n") < accuracy
    cut = lambda i, end: F.when(small, F.lit(end)).otherwise(F.col("cuts")[i])
    each = [F.struct(F.lit(name).alias("name"), F.lit(s).alias("share"), cut(2 * i, float("-inf")).alias("from"), cut(2 * i + 1, float("inf")).alias("to")) for i, (name, s) in enumerate(shares.items())]
    spans = spans.select(*by, "n", F.explode(F.array(*each)).alias("s")).select(*by, "n", "s.*")
    near = values.join(spans, by).where("value <= to")
    counts = near.groupBy(*by, "n", "name", "share", F.when(F.col("value") >= F.col("from"), F.col("value")).alias("value")).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("value"))
    placed = counts.withColumn("end", F.sum("m").over(order)).withColumn("start", F.col("end") - F.col("m"))
    rank = (F.col("n") - 1) * F.col("share")
    holds = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("end")), F.col("value")))
    return placed.groupBy(*by, "n", "name").agg(holds(F.floor(rank)).alias("low"), holds(F.ceil(rank)).alias("high"), holds(F.floor(rank + 0.5)).alias("nearest"))


def nearest_quartiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, q1, q3): the values of rank floor((n-1) * q + 0.5)."""
    found = order_statistics(df, columns if columns is not None else numeric_columns(df), {"q1": 0.25, "q3": 0.75})
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("nearest"))).alias(name)
    return found.groupBy("column", "n").agg(pick("q1"), pick("q3"))


# Moments


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, min, max, mean, median, std, cv, rank) of each numeric column, to 4 places. cv
    is std / |mean| of the rounded values: infinite where the mean is 0 or missing, 0 without a
    std. rank orders by cv, the largest first, and by position."""
    names = columns if columns is not None else numeric_columns(df)
    value = lambda n: quoted(n).cast("double")
    moments = tuple(f(value(n)).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)))
    first, ranks = _bracketed(df, names, {"median": 0.5}, 10_000, moments)
    rows = df.sparkSession.createDataFrame([(i, n, *(first[f"{p}{i}"] for p in ("min", "max", "mean", "std"))) for i, n in enumerate(names)], "position int, column string, min double, max double, mean double, std double")
    middle = ranks.select("column", ((F.col("low") + F.col("high")) / 2).alias("median"))
    rows = rows.join(F.broadcast(middle), "column", "left")
    rows = rows.select("position", "column", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")))
    cv = F.when(F.col("mean").isNull() | (F.col("mean") == 0), F.lit(float("inf"))).when(F.col("std").isNull(), F.lit(0.0)).otherwise(F.col("std") / F.abs("mean"))
    return rows.withColumn("cv", cv).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cv"), "position")))


def most_varied(stats: DataFrame, k: int = CORRELATED) -> list[str]:
    """The names of the k columns that vary most, in their order: those whose pairs are looked at in wide tables."""
    return [r.column for r in stats.where(F.col("rank") <= k).orderBy("position").select("column").collect()]


def global_extremes(stats: DataFrame) -> DataFrame:
    """(kind, column, value): the least and the greatest value of all columns; the first column wins ties."""
    least = stats.where("min IS NOT NULL").orderBy("min", "position").limit(1).select(F.lit("min").alias("kind"), "column", F.col("min").alias("value"))
    most = stats.where("max IS NOT NULL").orderBy(F.desc("max"), "position").limit(1).select(F.lit("max").alias("kind"), "column", F.col("max").alias("value"))
    return least.union(most)


def correlations(df: DataFrame, columns: list[str] | None = None, compatible: bool = True) -> DataFrame:
    """(a, b, value, sign): Pearson correlation of each pair of numeric columns, to 3 places.

    compatible: from averages of each column and of the products, as separate averages skip different
    rows where there are nulls; else over the rows where neither is null. Pairs without a mean,
    with no spread, or whose products average 0 are left out.
    """
    names = columns if columns is not None else numeric_columns(df)
    value = lambda n: quoted(n).cast("double")
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, value double, sign string, position int")
    one = df.agg(
        *(f(value(n)).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop))),
        *(F.avg(value(names[i]) * value(names[j])).alias(f"p{i}_{j}") for i, j in pairs),
        *([] if compatible else [F.corr(value(names[i]), value(names[j])).alias(f"r{i}_{j}") for i, j in pairs]),
    )

    def pair(i: int, j: int) -> Column:
        product, spread = F.col(f"p{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}")
        r = F.try_divide(product - F.col(f"m{i}") * F.col(f"m{j}"), spread) if compatible else F.col(f"r{i}_{j}")
        good = (product != 0) & (F.col(f"s{i}") != 0) & (F.col(f"s{j}") != 0)
        return F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.when(good, F.round(r, 3)).alias("value"), F.lit(i * len(names) + j).alias("position"))

    rows = one.select(F.explode(F.array(*(pair(i, j) for i, j in pairs))).alias("r")).select("r.*").where("value IS NOT NULL AND NOT isnan(value)")
    return rows.select("a", "b", "value", F.when(F.col("value") >= 0, "positive").otherwise("negative").alias("sign"), "position")


def strongest(pairs: DataFrame, sign: str, k: int = TOP_PAIRS) -> DataFrame:
    """The k strongest pairs of a sign: (a, b, value, rank)."""
    order = Window.orderBy(F.desc("value") if sign == "positive" else F.asc("value"), "position")
    return pairs.where(F.col("sign") == sign).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "value", "rank")


# Outliers


def outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, q1, q3, lo, hi, outliers, share): values strictly outside 1.5 interquartile
    ranges; columns without values or without a range are left out."""
    names = columns if columns is not None else numeric_columns(df)
    bounds = nearest_quartiles(df, names).where("q3 != q1").withColumn("iqr", F.col("q3") - F.col("q1"))
    bounds = bounds.select("column", "n", "q1", "q3", (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"))
    each = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), quoted(n).cast("double").alias("value")) for i, n in enumerate(names)]
    if not each:
        return bounds.select(F.lit(0).alias("position"), "column", "q1", "q3", "lo", "hi", F.lit(0).cast("long").alias("outliers"), F.lit(0.0).alias("share"))
    values = df.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("value IS NOT NULL AND NOT isnan(value)")
    found = values.join(F.broadcast(bounds), "column").groupBy("position", "column", "n", "q1", "q3", "lo", "hi").agg(
        F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outliers")
    )
    return found.select("position", "column", "q1", "q3", "lo", "hi", "outliers", F.round(F.col("outliers") / F.col("n"), 3).alias("share"))


def top_outliers(found: DataFrame, k: int = TOP_OUTLIERS) -> DataFrame:
    """The columns with outliers, by share: (column, outliers, share, rank)."""
    order = Window.orderBy(F.desc("share"), "position")
    return found.where("outliers > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "outliers", "share", "rank")


# Categories


def category_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """(position, column, value, count, rank): the k most frequent values of each column, null left out;
    ties by value."""
    f = frequencies(df, columns).where("value IS NOT NULL")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("position", "column", "value", F.col("n").alias("count"), "rank")


def category_summary(df: DataFrame, columns: list[str], k: int = TOP_CATEGORICAL) -> DataFrame:
    """(column, unique, dominant_share, imbalanced, rank) of the k columns with the most values: the
    largest value's share of all that aren't null, and whether it is 0.8 or more of over 2 values."""
    f = frequencies(df, columns).where("value IS NOT NULL").groupBy("position", "column").agg(F.count("*").alias("unique"), (F.max("n") / F.sum("n")).alias("share"))
    order = Window.orderBy(F.desc("unique"), "position")
    top = f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("column", "unique", F.round("share", 4).alias("dominant_share"), ((F.col("unique") > 2) & (F.col("share") >= IMBALANCE)).alias("imbalanced"), "rank")


def spotlights(df: DataFrame, columns: list[str] | None = None, most: int = 15, k: int = TOP_VALUES, first: int = 5) -> DataFrame:
    """(position, column, uniques, value, count, rank): the k most frequent short values of the first few
    string columns that have at most 15 of them. Values of 1 to 40 characters count that aren't
    links or handles, without the blanks around them."""
    names = columns if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    f = frequencies(df, names).where("length(value) BETWEEN 1 AND 40 AND NOT startswith(value, 'http') AND NOT startswith(value, '@')")
    f = f.groupBy("position", "column", F.trim("value").alias("value")).agg(F.sum("n").alias("count"))
    few = f.groupBy("position", "column").agg(F.count("*").alias("uniques")).where(F.col("uniques") <= most)
    few = few.withColumn("place", F.row_number().over(Window.orderBy("position"))).where(F.col("place") <= first).drop("place")
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    rows = f.join(F.broadcast(few), ["position", "column"]).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("position", "column", "uniques", "value", "count", "rank")
