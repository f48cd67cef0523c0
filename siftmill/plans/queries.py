"""The catalogue of queries on the driver's tables, each with DuckDB SQL for the same result where SQL
can express it. A query runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import columns as C
from siftmill.operators import documents as D
from siftmill.operators import guard as G
from siftmill.operators import nested as N
from siftmill.operators import reports as E
from siftmill.operators import samples as S
from siftmill.operators import semantics as M
from siftmill.operators import replies as P
from siftmill.plans.steps import Steps
from siftmill.sources import payloads as Y
from siftmill.sources import router as R
from siftmill.sources import tables as B
from siftmill.streaming import facets as W
from siftmill.streaming import profile as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL for its result."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _long(source: str, names: list[str]) -> str:
    """SQL: (position, column, value) of numeric columns."""
    return " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS \"column\", CAST({n} AS DOUBLE) AS value FROM {source}" for i, n in enumerate(names))


def _stats(source: str, names: list[str]) -> str:
    return f"""
WITH v AS ({_long(source, names)}), s AS (
    SELECT position, "column", round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std
    FROM v GROUP BY position, "column"
), c AS (SELECT *, CASE WHEN mean IS NULL OR mean = 0 THEN CAST('inf' AS DOUBLE) WHEN std IS NULL THEN 0 ELSE std / abs(mean) END AS cv FROM s)
SELECT "column", min, max, mean, median, std, round(cv, 4) AS cv, CAST(row_number() OVER (ORDER BY cv DESC, position) AS INTEGER) AS rank FROM c
"""


def _shown_stats(df: DataFrame) -> DataFrame:
    return C.numeric_stats(df).withColumn("cv", F.round("cv", 4)).drop("position")


@query(_stats("lineitem", LINEITEM))
def profile_numeric_stats(spark, sf_dir):
    return _shown_stats(table(spark, sf_dir, "lineitem"))


@query(f"SELECT * FROM ({_stats('part', ['p_partkey', 'p_size', 'p_retailprice'])}) WHERE rank <= 10")
def profile_numeric_top_cv(spark, sf_dir):
    return _shown_stats(table(spark, sf_dir, "part")).where("rank <= 10")


@query(f"""
WITH v AS ({_long('orders', ORDERS)})
SELECT 'min' AS kind, arg_min("column", (round(value, 4), position)) AS "column", round(min(value), 4) AS value FROM v
UNION ALL SELECT 'max', arg_max("column", (round(value, 4), -position)), round(max(value), 4) FROM v
""")
def profile_global_extremes(spark, sf_dir):
    return C.global_extremes(C.numeric_stats(table(spark, sf_dir, "orders")))


def _kinds(source: str, fixed: dict[str, str], strings: list[str]) -> str:
    parts = [f"SELECT '{n}' AS \"column\", '{b}' AS bucket" for n, b in fixed.items()]
    parts += [f"SELECT '{n}', CASE WHEN avg(length({n})) > 60 OR count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) > 0.5 * count(*) THEN 'text' ELSE 'categorical' END FROM {source}" for n in strings]
    return " UNION ALL ".join(parts)


@query(_kinds("customer", {"c_custkey": "numeric", "c_nationkey": "numeric", "c_acctbal": "numeric"}, ["c_name", "c_mktsegment"]))
def profile_column_types(spark, sf_dir):
    return C.column_kinds(table(spark, sf_dir, "customer")).select("column", "bucket")


@query(_kinds("documents", {"doc_id": "numeric", "n_chars": "numeric"}, ["text", "lang", "source"]))
def profile_document_column_types(spark, sf_dir):
    return C.column_kinds(table(spark, sf_dir, "documents")).select("column", "bucket")


def _holes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", F.expr("nullif(l_discount, 0)").alias("l_discount"), F.expr("nullif(l_tax, 0)").alias("l_tax"), F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"), F.lit(None).cast("string").alias("empty"), F.lit(7).alias("seven"))


_HOLES = "SELECT l_orderkey, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag, CAST(NULL AS VARCHAR) AS empty, 7 AS seven FROM lineitem"
_HOLE_NAMES = ["l_orderkey", "l_discount", "l_tax", "l_returnflag", "empty", "seven"]


@query(f"WITH h AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST(count(*) - count({n}) AS BIGINT) AS missing FROM h" for n in _HOLE_NAMES))
def quality_missing(spark, sf_dir):
    return C.missing_values(_holes(spark, sf_dir)).select("column", "missing")


@query(f"WITH h AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS n_unique FROM h" for n in _HOLE_NAMES))
def quality_distinct(spark, sf_dir):
    return C.distinct_values(_holes(spark, sf_dir)).select("column", "n_unique")


@query(f"WITH h AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\" FROM h HAVING count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) <= 1" for n in _HOLE_NAMES))
def quality_constants(spark, sf_dir):
    return C.distinct_values(_holes(spark, sf_dir)).where("is_constant").select("column")


@query("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem)) AS duplicate_rows FROM lineitem")
def quality_duplicates(spark, sf_dir):
    return C.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


@query(f"""
WITH h AS ({_HOLES}), m AS ({" UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS \"column\", count(*) - count({n}) AS missing FROM h" for i, n in enumerate(_HOLE_NAMES))})
SELECT "column", missing, CAST(row_number() OVER (ORDER BY missing DESC, position) AS INTEGER) AS rank FROM m WHERE missing > 0 QUALIFY rank <= 5
""")
def quality_missing_top(spark, sf_dir):
    """What a digest lists of missing values."""
    found = C.missing_values(_holes(spark, sf_dir)).where("missing > 0")
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("missing"), "position"))).where(f"rank <= {C.TOP_MISSING}").select("column", "missing", "rank")


@query(f"SELECT * FROM (WITH h AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS n_unique FROM h" for n in _HOLE_NAMES) + ") WHERE n_unique > 1")
def quality_unique_counts(spark, sf_dir):
    return C.distinct_values(_holes(spark, sf_dir)).where("NOT is_constant").select("column", "n_unique")


@query("""
SELECT count(*) AS rows, count(*) - count(DISTINCT (event_type, user_id % 7, CASE WHEN user_id % 2 = 0 THEN 'even' END)) AS duplicate_rows FROM events
""")
def quality_duplicates_nested(spark, sf_dir):
    """Rows with lists, structs and maps."""
    odd = F.when(F.col("user_id") % 2 == 0, "even")
    return C.duplicate_rows(table(spark, sf_dir, "events").select(F.array("event_type", odd).alias("a"), F.struct(F.expr("user_id % 7").alias("x")).alias("s"), F.create_map(F.lit("k"), odd).alias("m")))


@query("""
SELECT 'numeric' AS bucket, 8 AS columns, 'l_orderkey, l_partkey, l_suppkey, ... 5 more' AS listed FROM lineitem HAVING count(*) > 0
UNION ALL SELECT bucket, count(*), CASE WHEN count(*) > 3 THEN array_to_string(list("column" ORDER BY position)[1:3], ', ') || ', ... ' || (count(*) - 3) || ' more' ELSE array_to_string(list("column" ORDER BY position), ', ') END FROM (
    SELECT 8 AS position, 'l_returnflag' AS "column", CASE WHEN avg(length(l_returnflag)) > 60 OR count(DISTINCT l_returnflag) > 0.5 * count(*) THEN 'text' ELSE 'categorical' END AS bucket FROM lineitem
    UNION ALL SELECT 9, 'l_linestatus', CASE WHEN avg(length(l_linestatus)) > 60 OR count(DISTINCT l_linestatus) > 0.5 * count(*) THEN 'text' ELSE 'categorical' END FROM lineitem
    UNION ALL SELECT 10, 'l_shipdate', 'datetime' FROM lineitem HAVING count(*) > 0
) GROUP BY bucket
""")
def column_preview(spark, sf_dir):
    return C.column_preview(C.column_kinds(table(spark, sf_dir, "lineitem")), 3).select("bucket", "columns", F.array_join("listed", ", ").alias("listed"))


def _pairs(source: str, names: list[str]) -> str:
    def pair(i: int, a: str, j: int, b: str) -> str:
        a, b, x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)", a, b
        return f"SELECT '{x}' AS a, '{y}' AS b, {i * len(names) + j} AS position, round((avg({a} * {b}) - avg({a}) * avg({b})) / (stddev_pop({a}) * stddev_pop({b})), 3) AS value FROM {source}"

    return " UNION ALL ".join(pair(i, a, j, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j)


_SIGNED = "SELECT a, b, value, CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS sign, position FROM ({})"


@query(f"SELECT a, b, value, sign FROM ({_SIGNED.format(_pairs('lineitem', LINEITEM))})")
def corr_pairs(spark, sf_dir):
    return C.correlations(table(spark, sf_dir, "lineitem")).select("a", "b", "value", "sign")


@query(f"SELECT a, b, value, CAST(row_number() OVER (ORDER BY value DESC, position) AS INTEGER) AS rank FROM ({_SIGNED.format(_pairs('lineitem', LINEITEM))}) WHERE sign = 'positive' QUALIFY rank <= 5")
def corr_top_positive(spark, sf_dir):
    return C.strongest(C.correlations(table(spark, sf_dir, "lineitem")), "positive")


@query(f"SELECT a, b, value, CAST(row_number() OVER (ORDER BY value, position) AS INTEGER) AS rank FROM ({_SIGNED.format(_pairs('lineitem', LINEITEM))}) WHERE sign = 'negative' QUALIFY rank <= 5")
def corr_top_negative(spark, sf_dir):
    return C.strongest(C.correlations(table(spark, sf_dir, "lineitem")), "negative")


@query(f"""
WITH s AS ({_stats('lineitem', LINEITEM)}), t AS (SELECT "column" FROM s WHERE rank <= 5), p AS ({_SIGNED.format(_pairs('lineitem', LINEITEM))})
SELECT a, b, value, sign FROM p WHERE a IN (SELECT "column" FROM t) AND b IN (SELECT "column" FROM t)
""")
def corr_pairs_capped(spark, sf_dir):
    """Pairs of the columns that vary most."""
    df = table(spark, sf_dir, "lineitem")
    return C.correlations(df, C.most_varied(C.numeric_stats(df), 5)).select("a", "b", "value", "sign")


def _quartiles(source: str, names: list[str]) -> str:
    return f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY "column") AS n FROM ({_long(source, names)}) WHERE value IS NOT NULL),
q AS (SELECT position, "column", n, max(CASE WHEN r = floor((n - 1) * 0.25 + 0.5) THEN value END) AS q1, max(CASE WHEN r = floor((n - 1) * 0.75 + 0.5) THEN value END) AS q3 FROM v GROUP BY position, "column", n)
"""


def _outliers(source: str, names: list[str]) -> str:
    return _quartiles(source, names) + """, o AS (
    SELECT position, "column", n, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE q1 != q3
), x AS (
    SELECT o.position, o."column", q1, q3, lo, hi, count(CASE WHEN value < lo OR value > hi THEN 1 END) AS outliers, round(count(CASE WHEN value < lo OR value > hi THEN 1 END) / o.n, 3) AS share
    FROM v JOIN o ON v."column" = o."column" GROUP BY ALL
)
"""


@query(_quartiles("lineitem", LINEITEM) + 'SELECT "column", n, q1, q3 FROM q')
def quartiles_nearest(spark, sf_dir):
    return C.nearest_quartiles(table(spark, sf_dir, "lineitem"))


_EVENTS = ["event_id", "user_id", "value"]


@query(_outliers("events", _EVENTS).replace("o.n, 3) AS share", "o.n, 3) AS share").replace("GROUP BY ALL", 'GROUP BY o.position, o."column", q1, q3, lo, hi, o.n') + 'SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lo, 4) AS lo, round(hi, 4) AS hi, outliers, share FROM x')
def outliers_iqr(spark, sf_dir):
    rounded = [F.round(c, 4).alias(c) for c in ("q1", "q3", "lo", "hi")]
    return C.outliers(table(spark, sf_dir, "events")).select("column", *rounded, "outliers", "share")


@query(_outliers("events", _EVENTS).replace("GROUP BY ALL", 'GROUP BY o.position, o."column", q1, q3, lo, hi, o.n') + 'SELECT "column", outliers, share, CAST(row_number() OVER (ORDER BY share DESC, position) AS INTEGER) AS rank FROM x WHERE outliers > 0 QUALIFY rank <= 8')
def outliers_top(spark, sf_dir):
    return C.top_outliers(C.outliers(table(spark, sf_dir, "events")))


@query(_outliers("lineitem", LINEITEM).replace("GROUP BY ALL", 'GROUP BY o.position, o."column", q1, q3, lo, hi, o.n') + "SELECT CAST(sum(outliers) AS BIGINT) AS outliers FROM x")
def outliers_total(spark, sf_dir):
    return C.outliers(table(spark, sf_dir, "lineitem")).agg(F.sum("outliers").alias("outliers"))


def _values(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {n} IS NOT NULL GROUP BY {n}" for i, n in enumerate(names))


_CATEGORIES = ["o_orderstatus", "o_orderpriority"]


@query(f'SELECT "column", value, n AS count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM ({_values("orders", _CATEGORIES)}) QUALIFY rank <= 5')
def category_top_values(spark, sf_dir):
    return C.category_values(table(spark, sf_dir, "orders"), _CATEGORIES).select("column", "value", "count", "rank")


def _summary(source: str, names: list[str]) -> str:
    return f"""
WITH f AS (SELECT position, "column", count(*) AS u, max(n) / sum(n) AS share FROM ({_values(source, names)}) GROUP BY position, "column")
SELECT "column", u AS unique, round(share, 4) AS dominant_share, u > 2 AND share >= 0.8 AS imbalanced, CAST(row_number() OVER (ORDER BY u DESC, position) AS INTEGER) AS rank FROM f QUALIFY rank <= 8
"""


@query(_summary("events", ["event_type"]))
def category_summary(spark, sf_dir):
    return C.category_summary(table(spark, sf_dir, "events"), ["event_type"])


_BANDED = "(SELECT CASE WHEN l_quantity <= 45 THEN 'usual' WHEN l_quantity < 48 THEN 'many' ELSE 'most' END AS band, l_returnflag FROM lineitem)"


@query(_summary(_BANDED, ["band", "l_returnflag"]))
def class_imbalance(spark, sf_dir):
    band = F.when(F.col("l_quantity") <= 45, "usual").when(F.col("l_quantity") < 48, "many").otherwise("most").alias("band")
    return C.category_summary(table(spark, sf_dir, "lineitem").select(band, "l_returnflag"), ["band", "l_returnflag"])


@query(f"""
WITH f AS (SELECT position, "column", trim(value, ' ') AS value, sum(n) AS count FROM ({_values("customer", ["c_name", "c_mktsegment"])}) WHERE length(value) BETWEEN 1 AND 40 AND value NOT LIKE 'http%' AND value NOT LIKE '@%' GROUP BY ALL),
u AS (SELECT "column", count(*) AS uniques FROM f GROUP BY "column" HAVING count(*) <= 15)
SELECT "column", uniques, value, CAST(count AS BIGINT) AS count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM f JOIN u USING ("column") QUALIFY rank <= 5
""")
def spotlights(spark, sf_dir):
    return C.spotlights(table(spark, sf_dir, "customer")).select("column", "uniques", "value", "count", "rank")


# Names

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _names(names: str) -> str:
    """SQL: (position, column) of a table's columns."""
    return f'(SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column" FROM (DESCRIBE {names}))'


_ALL_NAMES = "(" + " UNION ALL ".join(f"SELECT '{t}' AS source, * FROM {_names(t)}" for t in _TABLES) + ")"


def _by_table(spark, sf_dir, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the column names of each given table."""
    return reduce(DataFrame.union, (of(M.names_of(table(spark, sf_dir, t))).select(F.lit(t).alias("source"), "*") for t in _TABLES))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(\"column\"), {_quote(p)}) THEN {_quote(r)}" for p, r, _ in M.ROLES) + " ELSE 'unknown' END"
_PHRASE_SQL = "CASE role " + " ".join(f"WHEN {_quote(r)} THEN {_quote(c)}" for r, c in {r: c for _, r, c in reversed(M.ROLES)}.items()) + " ELSE 'Other detail' END"


@query(f"SELECT *, {_PHRASE_SQL} AS category FROM (SELECT source, position, \"column\", {_ROLE_SQL} AS role FROM {_ALL_NAMES})")
def semantics_roles(spark, sf_dir):
    return _by_table(spark, sf_dir, M.column_roles)


@query(f"SELECT source, {_PHRASE_SQL} AS category, min(position) AS position FROM (SELECT source, position, {_ROLE_SQL} AS role FROM {_ALL_NAMES}) GROUP BY ALL")
def semantics_categories(spark, sf_dir):
    return _by_table(spark, sf_dir, M.categories)


_SIGNALS = ", ".join(f"({i}, {_quote(d)}, {_quote(w)}, {t})" for i, (d, words) in enumerate(M.DOMAINS.items()) for t, w in enumerate(words))
_DOMAIN_SQL = f"""
WITH n AS {_ALL_NAMES}, w AS (SELECT DISTINCT source, position, "column", unnest(regexp_extract_all(lower("column"), '[a-z0-9]+')) AS token FROM n),
s AS (SELECT source, place, domain, count(*) AS score, list("column" || ' (→ ' || token || ')' ORDER BY position, t)[1:8] AS evidence FROM w JOIN (VALUES {_SIGNALS}) AS t(place, domain, token, t) USING (token) GROUP BY source, place, domain),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, place) = 1),
x AS (SELECT source, coalesce(score, 0) AS score, domain, coalesce(array_to_string(evidence, '; '), '') AS evidence FROM (SELECT DISTINCT source FROM n) LEFT JOIN b USING (source)),
d AS (SELECT source, CASE WHEN score >= 2 THEN domain ELSE 'Unknown' END AS label, score, CASE WHEN score >= 2 THEN round(least(0.97, 0.5 + 0.08 * score), 2) ELSE round(least(0.3, score / 4), 2) END AS confidence, evidence FROM x)
"""


@query(_DOMAIN_SQL + "SELECT source, label, score, CAST(confidence AS DOUBLE) AS confidence, evidence FROM d")
def domain_score(spark, sf_dir):
    found = _by_table(spark, sf_dir, M.domain)
    return found.select("source", "label", "score", F.col("confidence").cast("double").alias("confidence"), F.array_join("evidence", "; ").alias("evidence"))


_KIND_SQL = "CASE WHEN confidence >= 0.5 AND label != 'Unknown' THEN CASE label " + " ".join(f"WHEN {_quote(d)} THEN {_quote(k)}" for d, k in M.KINDS.items()) + """ ELSE label END
    WHEN list_contains(roles, 'person_name') AND (contains(lower(joined), 'dept') OR list_contains(roles, 'org')) THEN 'employee / workforce'
    WHEN list_contains(roles, 'money') AND list_contains(roles, 'org') THEN 'financial / accounting' WHEN list_contains(roles, 'location') AND list_contains(roles, 'person_name') THEN 'people / contact' ELSE 'general / tabular' END"""


@query(_DOMAIN_SQL + f"""
, r AS (SELECT source, list(role) AS roles, string_agg("column", ' ' ORDER BY position) AS joined, array_to_string(list(replace("column", '_', ' ') ORDER BY position)[1:8], ', ') AS covered
        FROM (SELECT *, {_ROLE_SQL} AS role FROM n) GROUP BY source),
k AS (SELECT source, label, covered, {_KIND_SQL} AS kind FROM r JOIN d USING (source))
SELECT source, kind, label, 'By the names of its columns (' || covered || ') it looks like ' || CASE WHEN regexp_matches(lower(kind), '^[aeiou]') THEN 'an ' ELSE 'a ' END || kind || ' table.' AS summary FROM k
""")
def semantics_kind(spark, sf_dir):
    return _by_table(spark, sf_dir, M.dataset_kind).select("source", "kind", "label", "summary")


_WAVES = " UNION ALL ".join(f"SELECT source, -1 AS position, '' AS \"column\", '{b}' AS band FROM {_ALL_NAMES} WHERE contains(lower(\"column\"), '{b}') GROUP BY source" for b in M.BANDS)
_ANY = lambda words: " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in words)


@query(f"SELECT source, position, \"column\", CASE WHEN {_ANY(M.LOW)} THEN 'low' WHEN {_ANY(M.HIGH)} THEN 'high' ELSE 'mid' END AS band FROM {_ALL_NAMES} UNION ALL {_WAVES}")
def frequency_bands(spark, sf_dir):
    """Bands of names: the brain waves that they mention, and how often a stream's columns are told to vary."""
    waves = _by_table(spark, sf_dir, M.frequency_bands).select("source", F.lit(-1).alias("position"), F.lit("").alias("column"), "band")
    return _by_table(spark, sf_dir, M.streamed_bands).union(waves)


_STREAM_WORDS = ", ".join(f"({i}, '{d}', {c}, '{w}')" for i, (d, (words, c)) in enumerate(M.STREAMED.items()) for w in words)


@query(f"""
WITH n AS {_ALL_NAMES}, b AS (
    SELECT source, label, CAST(confidence AS DOUBLE) AS confidence, string_agg("column", '; ' ORDER BY "column") AS evidence FROM n JOIN (VALUES {_STREAM_WORDS}) AS t(place, label, confidence, "column") USING ("column") GROUP BY source, place, label, confidence
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY place) = 1
) SELECT source, coalesce(label, 'general') AS label, coalesce(confidence, 0e0) AS confidence, coalesce(evidence, '') AS evidence FROM (SELECT DISTINCT source FROM n) LEFT JOIN b USING (source)
""")
def streamed_domain(spark, sf_dir):
    return _by_table(spark, sf_dir, M.streamed_domain).withColumn("evidence", F.array_join("evidence", "; "))


# Samples


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_first(spark, sf_dir):
    return S.first_rows(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def sample_last(spark, sf_dir):
    return S.last_rows(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 5")
def sample_random_seeded(spark, sf_dir):
    return S.random_rows(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS text, lang FROM documents ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 5")
def sample_compact(spark, sf_dir):
    return S.compact_rows(S.random_rows(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "text", "lang")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
b AS (
    SELECT 'first' AS bucket, * FROM (SELECT * FROM o ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT 'last', * FROM (SELECT * FROM o ORDER BY o_orderkey DESC LIMIT 5)
    UNION ALL SELECT 'random', * FROM (SELECT * FROM o ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 5)
)
SELECT bucket, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS row FROM b
""")
def sample_representative(spark, sf_dir):
    return S.representative_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


# Routing

_VOTES = r"""
WITH b AS (SELECT doc_id, list_filter(string_split_regex({text}, '\r\n|\r|\n'), lambda x: trim(x, ' ') != '') AS lines FROM {source}),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM b),
c AS (SELECT doc_id, i, d.place, d.delimiter, len(regexp_replace(line, '"(?:[^"]|"")*(?:"|$)', '', 'g')) - len(replace(regexp_replace(line, '"(?:[^"]|"")*(?:"|$)', '', 'g'), d.delimiter, '')) AS n
      FROM l CROSS JOIN (VALUES (0, chr(9)), (1, ';'), (2, '|'), (3, ',')) AS d(place, delimiter)),
h AS (SELECT doc_id, place, n AS header FROM c WHERE i = 1),
v AS (SELECT doc_id, place, delimiter, count(*) AS lines, count(CASE WHEN n > 0 THEN 1 END) AS with_any, max(header) AS header, count(CASE WHEN n = header THEN 1 END) / count(*) AS consistency FROM c JOIN h USING (doc_id, place) GROUP BY doc_id, place, delimiter),
w AS (SELECT * FROM v WHERE lines >= 2 AND header > 0 AND with_any >= 0.8 * lines AND consistency >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1)
"""
_DOCS = _VOTES.format(text="text", source="documents")


@query(_DOCS + "SELECT doc_id, delimiter, header + 1 AS columns, round(consistency, 4) AS consistency FROM w")
def delimiter_vote(spark, sf_dir):
    return R.delimiters(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("consistency", F.round("consistency", 4)).withColumn("columns", F.col("columns").cast("long"))


@query(_DOCS + r"""
SELECT doc_id, CASE WHEN starts_with(text, '%PDF-') THEN 'document' WHEN regexp_matches(ltrim(text, ' '), '^[\[{]') AND json_valid(text) THEN 'structured'
       WHEN regexp_matches(text, '(^|[\r\n])[ ]*#') THEN 'document' WHEN w.doc_id IS NOT NULL THEN 'tabular' ELSE 'document' END AS kind,
       CASE WHEN starts_with(text, '%PDF-') THEN 'pdf' WHEN regexp_matches(ltrim(text, ' '), '^[\[{]') AND json_valid(text) THEN 'json'
       WHEN regexp_matches(text, '(^|[\r\n])[ ]*#') THEN 'markdown' WHEN w.doc_id IS NOT NULL THEN CASE WHEN delimiter = chr(9) THEN 'tsv' ELSE 'csv' END ELSE 'plain-text' END AS format
FROM documents LEFT JOIN w USING (doc_id)
""")
def classify_text(spark, sf_dir):
    return R.classified_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kind", "format")


@query(_DOCS + r"""
, hh AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'tabular' WHEN 1 THEN 'structured' WHEN 2 THEN 'document' WHEN 3 THEN 'document' END AS hinted, CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'md' WHEN 3 THEN 'html' END AS tail FROM documents)
SELECT hh.doc_id, CASE WHEN starts_with(text, '%PDF-') THEN 'document' WHEN hinted IS NOT NULL THEN hinted WHEN regexp_matches(ltrim(text, ' '), '^[\[{]') AND json_valid(text) THEN 'structured'
       WHEN regexp_matches(text, '(^|[\r\n])[ ]*#') THEN 'document' WHEN w.doc_id IS NOT NULL THEN 'tabular' ELSE 'document' END AS kind,
       CASE WHEN starts_with(text, '%PDF-') THEN 'pdf' WHEN hinted IS NOT NULL THEN tail WHEN regexp_matches(ltrim(text, ' '), '^[\[{]') AND json_valid(text) THEN 'json'
       WHEN regexp_matches(text, '(^|[\r\n])[ ]*#') THEN 'markdown' WHEN w.doc_id IS NOT NULL THEN CASE WHEN delimiter = chr(9) THEN 'tsv' ELSE 'csv' END ELSE 'plain-text' END AS format
FROM hh LEFT JOIN w USING (doc_id)
""")
def classify_hinted(spark, sf_dir):
    """Texts with names, extensions, MIME types, unknown hints and none."""
    hints = F.element_at(F.array(*map(F.lit, ("files/Report.CSV", "application/json", "md", "a.b.html", "x.unknown"))), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("hint", F.when(F.col("doc_id") % 6 < 5, hints))
    return R.classified_texts(rows, "doc_id", "text", "hint").select("doc_id", "kind", "format")


@query("""SELECT event_id, len(regexp_replace(props, '"(?:[^"]|"")*(?:"|$)', '', 'g')) - len(replace(regexp_replace(props, '"(?:[^"]|"")*(?:"|$)', '', 'g'), ':', '')) AS colons FROM events""")
def quoted_delim_count(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.outside_quotes(F.col("props"), ":").cast("long").alias("colons"))


# Nested


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten_paths(spark, sf_dir):
    return N.flatten(table(spark, sf_dir, "events"), "event_id", "props")


_SHAPES = """'{"a":{"b":' || user_id || '},"t":["' || event_type || '","x"],"g":[[1,2],[3,4]],"e":[],"o":[{"k":' || event_id || '},{"k":null}],"w":[{},{},{},{},{}],"m":[1,null],"s":[1,2,3,4,5,6,7,8,9,10,11,12,13],"p":{"q":' || props || '}}'"""


@query("""
SELECT event_id, path, value FROM (
    SELECT event_id, 'a.b' AS path, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 't', event_type || ', x' FROM events
    UNION ALL SELECT event_id, 'g', '[grid 2x2]' FROM events UNION ALL SELECT event_id, 'e', NULL FROM events
    UNION ALL SELECT event_id, 'o[0].k', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'o[1].k', NULL FROM events
    UNION ALL SELECT event_id, 'w', '[nested array of 5 objects]' FROM events UNION ALL SELECT event_id, 'm', '[nested list of 2 items]' FROM events
    UNION ALL SELECT event_id, 's', '[list of 13 items]' FROM events UNION ALL SELECT event_id, 'p.q.k', json_extract_string(props, '$.k') FROM events
)
""")
def json_flatten_shapes(spark, sf_dir):
    """Objects in objects, lists of scalars, objects, lists and mixtures, markers."""
    return N.flatten(table(spark, sf_dir, "events").select("event_id", F.expr(_SHAPES).alias("j")), "event_id", "j")


def _turns(spark, sf_dir):
    """A report for each conversation, in parts of bounded size: a long one is no single row."""
    df = table(spark, sf_dir, "conversations")
    row = F.struct("turn", "role", F.length("text").alias("chars"))
    rows = F.collect_list(row)
    whole = F.to_json(F.struct(F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), rows.alias("turns"), F.transform(rows, lambda x: x["role"]).alias("roles")))
    return df.groupBy("conv_id", F.expr("pmod(xxhash64(turn, text), greatest(1, turn div 256))")).agg(whole.alias("json")).select("conv_id", "json")


@query("""
WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, role AS token, n AS count, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS INTEGER) AS rank FROM c
""")
def json_tokens(spark, sf_dir):
    return N.token_counts(_turns(spark, sf_dir), "conv_id", "json")


@query("""
SELECT conv_id, 'turns' AS section, 'table' AS kind, count(*) AS count, 3 AS columns, 0 AS tokens FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'roles', 'list', count(*), 0, 0 FROM conversations GROUP BY conv_id
""")
def report_digest_sections(spark, sf_dir):
    found = N.report_sections(N.report_rows(_turns(spark, sf_dir), "conv_id", "json"), "conv_id")
    return found.select("conv_id", "section", "kind", "count", F.col("columns").cast("int").alias("columns"), F.col("tokens").cast("int").alias("tokens"))


@query("""
WITH v AS (SELECT conv_id, 'chars' AS path, CAST(length(text) AS DOUBLE) AS x FROM conversations UNION ALL SELECT conv_id, 'turn', turn FROM conversations)
SELECT conv_id, 'turns' AS section, path, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(median(x), 4) AS median FROM v GROUP BY conv_id, path
""")
def report_digest_numbers(spark, sf_dir):
    found = E.section_numbers(N.report_rows(_turns(spark, sf_dir), "conv_id", "json"), "conv_id", most=None)
    return found.select("conv_id", "section", "path", "min", "max", "mean", "median")


def _accounts(spark, sf_dir):
    """A report for each customer that has orders, in parts of bounded size: account data, a table of orders, a list of their days."""
    orders = table(spark, sf_dir, "orders")
    parts = orders.groupBy("o_custkey").agg(F.expr("greatest(1, count(*) div 256)").alias("parts"))
    rows = F.collect_list(F.struct(
        F.col("o_orderstatus").alias("status"), F.expr("nullif(o_orderpriority, '1-URGENT')").alias("priority"), F.floor("o_totalprice").alias("price"),
        F.struct(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).alias("placed"),
    ))
    held = orders.join(parts, "o_custkey").groupBy("o_custkey", F.expr("pmod(xxhash64(o_orderkey), parts)").alias("part")).agg(rows.alias("orders"))
    name = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_acctbal")
    whole = F.struct(
        F.col("c_name").alias("company"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("account"),
        "orders", F.transform("orders", lambda x: x["status"]).alias("issues"),
    )
    return held.join(name, "o_custkey").select("o_custkey", F.to_json(whole).alias("json"))


_CELLS = """
WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (
    SELECT o_custkey, 'status' AS path, o_orderstatus AS value FROM o UNION ALL SELECT o_custkey, 'priority', nullif(o_orderpriority, '1-URGENT') FROM o
),
n AS (
    SELECT o_custkey, 'price' AS path, floor(o_totalprice) AS x FROM o UNION ALL SELECT o_custkey, 'placed.month', month(o_orderdate) FROM o UNION ALL SELECT o_custkey, 'placed.year', year(o_orderdate) FROM o
),
k AS (
    SELECT o_custkey, path, count(*) AS records, count(value) AS filled, count(DISTINCT value) AS uniq, count(DISTINCT value) + CASE WHEN count(value) < count(*) THEN 1 ELSE 0 END AS dist FROM v GROUP BY ALL
    UNION ALL SELECT o_custkey, path, count(*), count(x), count(DISTINCT x), count(DISTINCT x) FROM n GROUP BY ALL
)
"""


@query(_CELLS + """
SELECT o_custkey, 'orders' AS section, path, CASE WHEN path IN ('status', 'priority') THEN CASE WHEN dist > 0.5 * records THEN 'text' ELSE 'categorical' END ELSE 'numeric' END AS bucket, records, filled, dist AS "distinct"
FROM k WHERE filled > 0
""")
def report_section_columns(spark, sf_dir):
    return E.section_columns(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey")


@query(_CELLS + """
, w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY uniq DESC, path) AS place FROM k WHERE path IN ('status', 'priority') AND dist <= 0.5 * records AND filled > 0)
SELECT o_custkey, 'orders' AS section, path, any_value(uniq) AS "unique", CAST(any_value(place) AS INTEGER) AS place, value, count(*) AS count,
       CAST(row_number() OVER (PARTITION BY o_custkey, path ORDER BY count(*) DESC, value) AS INTEGER) AS rank
FROM v JOIN w USING (o_custkey, path) WHERE value IS NOT NULL AND place <= 5 GROUP BY o_custkey, path, value QUALIFY rank <= 5
""")
def report_section_categories(spark, sf_dir):
    return E.section_categories(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey")


@query(_CELLS + """
, s AS (SELECT o_custkey, path, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std FROM n GROUP BY ALL),
c AS (SELECT *, CASE WHEN mean = 0 THEN CAST('inf' AS DOUBLE) WHEN std IS NULL THEN 0 ELSE std / abs(mean) END AS cv FROM s)
SELECT o_custkey, 'orders' AS section, path, min, max, mean, median, std, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY cv DESC, path) AS INTEGER) AS rank FROM c
""")
def report_section_numbers(spark, sf_dir):
    return E.section_numbers(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey").drop("cv")


@query("""
SELECT conv_id, 'Report: talk ' || conv_id AS title, 'Known of it: title = talk ' || conv_id || '. It is made up of ' || count(*) || ' entries in roles, ' || count(*) || ' records in turns.' AS summary,
       CAST(count(*) AS VARCHAR) AS turns
FROM conversations GROUP BY conv_id
""")
def report_summary(spark, sf_dir):
    found = E.report_summaries(N.report_rows(_turns(spark, sf_dir), "conv_id", "json"), "conv_id")
    return found.select("conv_id", "title", F.col("executive_summary").alias("summary"), F.col("calculated_metrics")["count.turns"].alias("turns"))


@query(_CELLS + """
, t AS (SELECT o_custkey, o_orderstatus AS value, count(*) AS n FROM o GROUP BY ALL),
l AS (SELECT o_custkey, string_agg(value || ' ×' || n, ', ' ORDER BY n DESC, value) AS listed, sum(n) AS n FROM t GROUP BY o_custkey)
SELECT o_custkey, 'finding' AS part, 'issues' AS section, 'issues lists ' || listed || '.' AS text FROM l
UNION ALL SELECT o_custkey, 'recommendation', 'issues', 'Settle what issues names: ' || n || ' in all.' FROM l
""")
def report_findings(spark, sf_dir):
    """What reports say of their lists."""
    found = E.report_statements(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey")
    return found.where("section = 'issues'").select("o_custkey", "part", "section", "text")


_LADDER_SQL = "(VALUES " + ", ".join(f"({i}, {', '.join('NULL' if E.LADDER[f][i] is None else str(E.LADDER[f][i]) for f in ('fields', 'sections', 'columns', 'values', 'numeric', 'counts', 'section_fields'))})" for i in range(6)) + ") AS ladder(level, f, s, c, v, m, k, i)"
_PIECES = _CELLS + f"""
, w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY uniq DESC, path) AS place FROM k WHERE path IN ('status', 'priority') AND dist <= 0.5 * records AND filled > 0),
p AS (
    SELECT DISTINCT o_custkey, 'fields' AS facet, 0 AS section, unnest([1, 2, 3]) AS place, 0 AS rank, unnest(['account.balance: ' || c_acctbal, 'account.segment: ' || c_mktsegment, 'company: ' || c_name]) AS text FROM o
    UNION ALL SELECT o_custkey, 'sections', unnest([1, 2, 3]), 0, 0, unnest(['account: object of 1', 'issues: list of ' || count(*), 'orders: table of ' || count(*)]) FROM o GROUP BY o_custkey
    UNION ALL SELECT DISTINCT o_custkey, 'section_fields', 1, unnest([1, 2]), 0, unnest(['account.balance', 'account.segment']) FROM o
    UNION ALL SELECT o_custkey, 'counts', 2, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus), 0, 'issues: ' || o_orderstatus || ' ×' || count(*) FROM o GROUP BY o_custkey, o_orderstatus
    UNION ALL SELECT o_custkey, 'columns', 3, any_value(place), row_number() OVER (PARTITION BY o_custkey, path ORDER BY count(*) DESC, value), 'orders.' || path || ': ' || value || ' ×' || count(*)
              FROM v JOIN w USING (o_custkey, path) WHERE value IS NOT NULL GROUP BY o_custkey, path, value QUALIFY any_value(place) <= 5 AND row_number() OVER (PARTITION BY o_custkey, path ORDER BY count(*) DESC, value) <= 5
), z AS (
    SELECT o_custkey, level, count(*) AS pieces, CAST(sum(length(text)) AS BIGINT) AS chars FROM p, {_LADDER_SQL}
    WHERE (level = 0 OR section <= s) AND (level = 0 OR place <= CASE facet WHEN 'fields' THEN f WHEN 'section_fields' THEN i WHEN 'counts' THEN k WHEN 'columns' THEN c ELSE place END) AND (level = 0 OR facet != 'columns' OR rank <= v)
    GROUP BY o_custkey, level
), y AS (SELECT *, CAST(ceil(chars / 4.0) AS BIGINT) AS tokens FROM z)
"""


def _pieces(spark, sf_dir) -> DataFrame:
    """The pieces of accounts' digests whose texts hold no fractions, which engines write in different ways."""
    found = E.digest_pieces(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey")
    return found.where("facet NOT IN ('numeric', 'findings')")


@query(_PIECES + "SELECT o_custkey, level, pieces, chars, tokens FROM y")
def report_ladder_levels(spark, sf_dir):
    return E.digest_levels(_pieces(spark, sf_dir), "o_custkey")


@query(_PIECES + """
, b AS (SELECT o_custkey, coalesce(min(CASE WHEN tokens <= 60 THEN level END), 5) AS level FROM y GROUP BY o_custkey)
SELECT o_custkey, CAST(level AS INTEGER) AS level, tokens, pieces AS lines, chars FROM b JOIN y USING (o_custkey, level)
""")
def report_ladder_fit(spark, sf_dir):
    """The digests that fit 60 tokens, the first level that does, measured again on what they hold."""
    found = E.fitted_digests(_pieces(spark, sf_dir), "o_custkey", 60)
    lines = F.size(F.split("digest", "\n")).cast("long")
    return found.select("o_custkey", "level", "tokens", lines.alias("lines"), (F.length("digest") - lines + 1).cast("long").alias("chars"))


@query("""
SELECT o_custkey, 'issues' AS section, o_orderstatus AS value, count(*) AS count, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS INTEGER) AS rank
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, o_orderstatus QUALIFY rank <= 12
""")
def report_list_values(spark, sf_dir):
    found = N.report_values(N.report_rows(_accounts(spark, sf_dir), "o_custkey", "json"), "o_custkey")
    return found.where("kind = 'item'").select("o_custkey", "section", "value", "count", "rank")


@query("""
SELECT event_id, path, value FROM (
    SELECT event_id, 'a.b' AS path, CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 't', event_type || ', x' FROM events UNION ALL SELECT event_id, 'e', NULL FROM events
    UNION ALL SELECT event_id, 'o[0].k', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'o[1].k', NULL FROM events UNION ALL SELECT event_id, 'p.q.k', json_extract_string(props, '$.k') FROM events
)
""")
def report_cells_unmarked(spark, sf_dir):
    """Tables of reports without the markers of grids, long and mixed lists."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"rows":['), F.expr(_SHAPES), F.lit("]}")).alias("j"))
    return N.report_rows(rows, "event_id", "j").where("kind = 'cell'").select("event_id", "path", "value")


# Documents


@query(r"""
WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS bare FROM pages)
SELECT page_id, md5(regexp_replace(bare, '(?is)<[^>]+>', ' ', 'g')) AS text_md5 FROM t
""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


_LINES = r"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM documents),
r AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS raw FROM raw),
p AS (SELECT doc_id, i, CASE WHEN regexp_matches(raw, '(?i)^\s*(?:page\s*\d+(?:\s*of\s*\d+)?|\d+\s*/\s*\d+|\d+\s+of\s+\d+|\d{1,4})\s*$') THEN '' ELSE raw END AS raw FROM r),
d AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id),
l AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM p),
f AS (SELECT *, starts_with(line, '```') AS fence FROM l),
g AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code,
             coalesce(last_value(CASE WHEN NOT fence THEN line = '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS prev_blank FROM f),
h AS (SELECT *, regexp_matches(line, '^(#{1,6})\s+(.+)$') AND NOT fence AS marked,
             NOT fence AND NOT code AND NOT prev_blank AND length(line) BETWEEN 2 AND 90 AND NOT (suffix(line, '.') AND len(regexp_extract_all(line, '\S+')) > 6)
             AND (regexp_matches(line, '^(?:\d{1,3}[.)]\s+|\*|-|•\s)') OR (length(regexp_replace(line, '\P{L}', '', 'g')) > 0 AND length(regexp_replace(line, '\P{Lu}', '', 'g')) >= 0.8 * length(regexp_replace(line, '\P{L}', '', 'g')))) AS plain FROM g),
k AS (SELECT *, CASE WHEN marked THEN trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2), ' ') WHEN plain THEN line END AS heading, CASE WHEN marked THEN length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) WHEN plain THEN 3 END AS level FROM h),
m AS (SELECT *, i = min(CASE WHEN NOT fence AND (heading IS NOT NULL OR (line != '' AND i < 3)) THEN i END) OVER (PARTITION BY doc_id) AS title_here FROM k),
n AS (SELECT *, coalesce(title_here, false) AS is_title, heading IS NOT NULL AND NOT coalesce(title_here, false) AS is_section FROM m)
"""


@query(_LINES + "SELECT doc_id, i, fence, code, prev_blank, heading, level, is_title, is_section FROM n")
def doc_lines_flags(spark, sf_dir):
    docs = D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")
    return D.document_lines(docs).select("doc_id", F.col("i").cast("long").alias("i"), "fence", "code", "prev_blank", "heading", F.col("level").cast("long").alias("level"), "is_title", "is_section")


_SECTIONS = _LINES + """
, s AS (SELECT *, sum(CAST(is_section AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM n),
t AS (SELECT doc_id, max(CASE WHEN is_title THEN coalesce(heading, left(line, 120)) END) AS title FROM n GROUP BY doc_id),
x AS (
    SELECT doc_id, section, arg_min(heading, i) AS heading, arg_min(level, i) AS level, min(i) AS line, trim(string_agg(raw, chr(10) ORDER BY i), chr(10)) AS text FROM s WHERE section > 0 GROUP BY doc_id, section
    UNION ALL
    SELECT d.doc_id, 1, CASE WHEN title != '' THEN title ELSE 'Document' END, 1, 0, trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) FROM d JOIN t USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM s WHERE section > 0)
)
"""


@query(_SECTIONS + "SELECT doc_id, CAST(section AS BIGINT) AS section, heading, level, line, md5(text) AS text_md5 FROM x")
def doc_sections(spark, sf_dir):
    docs = D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")
    return D.document_sections(docs).select("doc_id", "section", "heading", F.col("level").cast("long").alias("level"), F.col("line").cast("long").alias("line"), F.md5("text").alias("text_md5"))


@query(_LINES + r"""
, c AS (SELECT doc_id, coalesce(max(CASE WHEN is_title THEN coalesce(heading, left(line, 120)) END), 'Untitled document') AS title, greatest(count(CASE WHEN is_section THEN 1 END), 1) AS sections,
        count(CASE WHEN NOT fence AND NOT code AND starts_with(line, '|') AND contains(substr(line, 2), '|') THEN 1 END) AS tables, count(CASE WHEN fence AND code THEN 1 END) AS blocks FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN title = '' THEN 'Untitled document' ELSE title END AS title, len(regexp_extract_all(d.text, '\S+')) AS word_count, length(d.text) AS char_count, sections AS section_count,
       len(list_filter(string_split_regex(d.text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10)) != '')) AS paragraph_count, tables AS table_count, blocks AS code_block_count, sections AS heading_count
FROM d JOIN c USING (doc_id)
""")
def doc_metrics(spark, sf_dir):
    return D.document_metrics(D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(_SECTIONS + r"SELECT doc_id, string_agg('- [' || level || '] ' || heading || ': ' || left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 120), chr(10) ORDER BY section) AS outline FROM x GROUP BY doc_id")
def doc_outline(spark, sf_dir):
    return D.document_outlines(D.document_sections(D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")))


@query(_SECTIONS + """
, b AS (SELECT doc_id, section, text, repeat('#', CAST(level AS INTEGER)) || ' ' || heading || chr(10) || text AS block FROM x WHERE section <= 40),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY doc_id ORDER BY section) AS used FROM b)
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN used <= 20000 THEN block END, chr(10) || chr(10) ORDER BY section), left(arg_min(text, section), 20000))) AS anchored_md5 FROM u GROUP BY doc_id
""")
def doc_anchored_text(spark, sf_dir):
    found = D.anchored_texts(D.document_sections(D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")))
    return found.select("doc_id", F.md5("anchored").alias("anchored_md5"))


@query("SELECT doc_id, length(text) > 12000 AS map_reduce FROM documents")
def doc_map_reduce_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.needs_map_reduce(F.col("text")).alias("map_reduce"))


@query(_SECTIONS + r"""
, pp AS (SELECT doc_id, section, heading, generate_subscripts(b, 1) AS p, trim(unnest(b), ' ' || chr(9) || chr(10)) AS para FROM (SELECT doc_id, section, heading, string_split_regex(text, '\n\s*\n') AS b FROM x)),
pw AS (SELECT *, regexp_extract_all(para, '\S+') AS listed FROM pp WHERE para != ''),
ps AS (SELECT doc_id, section, heading, p, unnest(CASE WHEN len(listed) <= 1000 THEN [0] ELSE range(0, len(listed), 800) END) AS s0, para, listed FROM pw),
pf AS (SELECT doc_id, heading, '## ' || heading || chr(10) || CASE WHEN len(listed) <= 1000 THEN para ELSE array_to_string(listed[s0 + 1:s0 + 800], ' ') END AS text, row_number() OVER (PARTITION BY doc_id ORDER BY section, p, s0) AS k FROM ps),
fr AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS words FROM pf),
ch AS (
    SELECT doc_id, k, 0 AS chunk, words, [heading] AS headings, text FROM fr WHERE k = 1
    UNION ALL
    SELECT f.doc_id, f.k, CASE WHEN c.words >= 500 AND c.words + f.words > 1000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.words >= 500 AND c.words + f.words > 1000 THEN f.words ELSE c.words + f.words END,
           CASE WHEN c.words >= 500 AND c.words + f.words > 1000 THEN [f.heading] WHEN list_contains(c.headings, f.heading) THEN c.headings ELSE list_append(c.headings, f.heading) END,
           CASE WHEN c.words >= 500 AND c.words + f.words > 1000 THEN f.text ELSE c.text || chr(10) || chr(10) || f.text END
    FROM ch c JOIN fr f ON f.doc_id = c.doc_id AND f.k = c.k + 1
)
SELECT doc_id, chunk, words, array_to_string(headings, ' | ') AS headings, md5(text) AS text_md5 FROM ch QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY k DESC) = 1
""")
def doc_chunks(spark, sf_dir):
    found = D.chunks(D.document_sections(D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")))
    return found.select("doc_id", "chunk", "words", F.array_join("headings", " | ").alias("headings"), F.md5("text").alias("text_md5"))


@query(_SECTIONS + r"""
, dc AS (SELECT doc_id, coalesce(max(CASE WHEN is_title THEN coalesce(heading, left(line, 120)) END), 'Untitled document') AS title, greatest(count(CASE WHEN is_section THEN 1 END), 1) AS sections FROM n GROUP BY doc_id),
dm AS (
    SELECT doc_id, CASE WHEN dc.title = '' THEN 'Untitled document' ELSE dc.title END AS title, len(regexp_extract_all(d.text, '\S+')) AS words, sections, len(list_filter(string_split_regex(d.text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10)) != '')) AS paragraphs
    FROM d JOIN dc USING (doc_id)
), db AS (SELECT doc_id, section, text, repeat('#', CAST(level AS INTEGER)) || ' ' || heading || chr(10) || text AS block FROM x WHERE section <= 40),
du AS (SELECT *, sum(length(block)) OVER (PARTITION BY doc_id ORDER BY section) AS used FROM db),
da AS (SELECT doc_id, trim(regexp_replace(coalesce(string_agg(CASE WHEN used <= 3000 THEN block END, chr(10) || chr(10) ORDER BY section), left(arg_min(text, section), 3000)), '\s+', ' ', 'g'), ' ') AS opening FROM du GROUP BY doc_id),
dl AS (SELECT doc_id, string_agg('- [' || level || '] ' || heading || ': ' || left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 120), chr(10) ORDER BY section) AS outline FROM x GROUP BY doc_id)
SELECT doc_id, dm.title, md5(dm.title || ': ' || words || ' words in ' || sections || ' section(s), ' || paragraphs || ' paragraph(s). ' || CASE WHEN length(opening) > 600 THEN left(opening, 600) || '…' ELSE opening END) AS overview_md5, md5(outline) AS outline_md5
FROM dm JOIN da USING (doc_id) JOIN dl USING (doc_id)
""")
def doc_digests(spark, sf_dir):
    found = D.deterministic_digests(D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "title", F.md5("overview").alias("overview_md5"), F.md5("outline").alias("outline_md5"))


# Budgets and claims


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return G.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _facets(spark, sf_dir):
    """Each language's sources by frequency, as the facets of a digest for each language."""
    df = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    values = df.selectExpr("lang", "'values' AS facet", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank", "repeat(concat(source, ': ', n, ' documents; '), 20) AS text")
    return values.union(values.selectExpr("lang", "'names' AS facet", "rank", "repeat(text, 2) AS text"))


_LEVELS = "(VALUES " + ", ".join(f"('{f}', {i}, {'NULL' if x is None else x})" for f, row in G.PROFILE_LADDER.items() for i, x in enumerate(row)) + ") AS levels(facet, level, most)"
_LADDER = f"""
WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
v AS (SELECT lang, 'values' AS facet, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank, repeat(source || ': ' || n || ' documents; ', 20) AS text FROM d),
f AS (SELECT * FROM v UNION ALL SELECT lang, 'names', rank, repeat(text, 2) FROM v),
s AS (SELECT lang, level, CAST(sum(CASE WHEN most IS NULL OR rank <= most THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM f JOIN {_LEVELS} USING (facet) GROUP BY lang, level),
z AS (SELECT lang, level, chars, CAST(ceil(chars / 4.0) AS BIGINT) AS tokens FROM s)
"""


@query(_LADDER + "SELECT * FROM z")
def budget_levels(spark, sf_dir):
    return G.ladder_sizes(_facets(spark, sf_dir), "lang")


@query(_LADDER + ", b AS (SELECT lang, coalesce(min(CASE WHEN tokens <= 1548 THEN level END), 5) AS level FROM z GROUP BY lang) SELECT lang, level, tokens FROM b JOIN z USING (lang, level)")
def ladder_fit(spark, sf_dir):
    return G.fitted_level(G.ladder_sizes(_facets(spark, sf_dir), "lang"), "lang", G.input_budget())


def _claims(source: str, keys: str, text: str) -> str:
    """SQL: (keys, pos, value, suffix) of a source's claims; what the pattern looks back at is a group of its own."""
    pattern = r"(^|[^\w.])(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(\s*(?:%|[kmb]|\b(?:million|billion|thousand)\b))?"
    each = f"unnest(list_zip(regexp_extract_all({text}, '{pattern}', 2, 'i'), regexp_extract_all({text}, '{pattern}', 3, 'i'))) AS c, generate_subscripts(regexp_extract_all({text}, '{pattern}', 2, 'i'), 1) - 1 AS pos"
    scale = "CASE upper(suffix) WHEN 'K' THEN 1e3 WHEN 'THOUSAND' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'MILLION' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'BILLION' THEN 1e9 ELSE 1e0 END"
    return f"""SELECT {keys}, pos, CAST(replace(n, ',', '') AS DOUBLE) * {scale} AS value, upper(suffix) AS suffix
    FROM (SELECT {keys}, pos, c[1] AS n, regexp_replace(coalesce(c[2], ''), '[\\s%]', '', 'g') AS suffix FROM (SELECT {keys}, {each} FROM {source}))"""


_VARIANTS = "list_distinct([x] || [round_even(x, 0), round_even(x, 1), round_even(x, 2), round_even(x, 3), round_even(x, 4)] || CASE WHEN x = floor(x) THEN [x / 1e3, x / 1e6, x / 1e9] ELSE [] END || CASE WHEN abs(x) > 0 AND abs(x) < 1 THEN [round_even(x * 100, 4), round_even(x * 100, 2), round_even(x * 100, 0)] ELSE [] END)"
_HOLDS = "CASE WHEN suffix = '' THEN abs(value - fact) <= 1e-3 ELSE abs(value - fact) <= 0.02 * abs(fact) END"


@query(_claims("documents", "doc_id", "text"))
def claims_extract(spark, sf_dir):
    return G.extracted_claims(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("pos", F.col("pos").cast("long"))


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.max("n_chars").alias("longest"), F.count_distinct("lang").alias("langs"), F.avg("n_chars").alias("mean")).selectExpr("stack(4, CAST(rows AS DOUBLE), CAST(longest AS DOUBLE), CAST(langs AS DOUBLE), CAST(mean AS DOUBLE)) AS value")


_FACTS = f"""
v AS (SELECT unnest([CAST(count(*) AS DOUBLE), CAST(max(n_chars) AS DOUBLE), CAST(count(DISTINCT lang) AS DOUBLE), avg(n_chars)]) AS x FROM documents),
f AS (SELECT DISTINCT unnest({_VARIANTS}) AS fact FROM v)
"""


@query(f"""
WITH s AS (
    SELECT unnest([count(*), max(l_linenumber), count(DISTINCT l_returnflag), round(avg(l_quantity), 6), round(avg(l_discount), 6), round(avg(l_tax), 6), round(avg(-l_discount), 6)]) AS x FROM lineitem
) SELECT DISTINCT unnest({_VARIANTS}) AS fact FROM s
""")
def facts_variants(spark, sf_dir):
    """Counts, averages, shares and negative ones."""
    mean = lambda c: F.round(F.avg(c), 6)
    facts = table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("a"), F.max("l_linenumber").alias("b"), F.count_distinct("l_returnflag").alias("c"), mean("l_quantity").alias("d"), mean("l_discount").alias("e"), mean("l_tax").alias("f"), mean(-F.col("l_discount")).alias("g"),
    )
    return G.variants(facts.selectExpr("stack(7, " + ", ".join(f"CAST({c} AS DOUBLE)" for c in "abcdefg") + ") AS value"))


@query(f"""
WITH {_FACTS}, c AS ({_claims("documents", "doc_id", "text")})
SELECT doc_id, pos, value, suffix, EXISTS (SELECT 1 FROM f WHERE {_HOLDS}) AS verified FROM c
""")
def guard_verify(spark, sf_dir):
    claims = G.extracted_claims(table(spark, sf_dir, "documents"), "doc_id", "text")
    return G.verified_claims(claims, G.variants(_facts(spark, sf_dir))).withColumn("pos", F.col("pos").cast("long"))


_SENTENCES = r"""SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL)"""


@query(f"""
WITH {_FACTS}, s AS ({_SENTENCES}), c AS ({_claims("s", "doc_id, sentence", "part")}),
k AS (SELECT doc_id, sentence, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good FROM (SELECT doc_id, sentence, EXISTS (SELECT 1 FROM f WHERE {_HOLDS}) AS good FROM c) GROUP BY ALL),
t AS (
    SELECT doc_id, coalesce(string_agg(CASE WHEN coalesce(n, 0) = coalesce(good, 0) THEN part END, ' ' ORDER BY sentence), '') AS text, CAST(coalesce(sum(n), 0) AS BIGINT) AS claims_found,
           CAST(coalesce(sum(good), 0) AS BIGINT) AS claims_verified, count(CASE WHEN n > good THEN 1 END) AS lost FROM s LEFT JOIN k USING (doc_id, sentence) GROUP BY doc_id
)
SELECT doc_id, md5(text) AS text_md5, claims_found, claims_verified,
       CASE WHEN claims_found = 0 THEN 'pass' WHEN claims_verified < 0.5 * claims_found OR (lost > 0 AND trim(text, ' ') = '') THEN 'fallback' ELSE 'guarded' END AS status FROM t
""")
def guard_sentences(spark, sf_dir):
    found = G.guarded_texts(table(spark, sf_dir, "documents"), G.variants(_facts(spark, sf_dir)), "doc_id", "text")
    return found.select("doc_id", F.md5("text").alias("text_md5"), "claims_found", "claims_verified", "status")


def _talk_facts(spark, sf_dir):
    values = N.parsed(_turns(spark, sf_dir), "conv_id", "json")
    return G.digest_facts(values, "conv_id")


_TALK_FACTS = """
v AS (SELECT conv_id, CAST(turn AS DOUBLE) AS x FROM conversations UNION SELECT conv_id, length(text) FROM conversations UNION SELECT conv_id, conv_id FROM conversations),
f AS (SELECT DISTINCT conv_id, unnest([x, x / 1e3, x / 1e6, x / 1e9]) AS fact FROM v)
"""


@query(f"WITH {_TALK_FACTS} SELECT * FROM f")
def digest_facts(spark, sf_dir):
    """What the report of each conversation allows to state: turns, lengths, and the number in its title."""
    return _talk_facts(spark, sf_dir)


@query(f"""
WITH {_TALK_FACTS}, t AS (SELECT conv_id, turn, 'Turn ' || turn || ' has ' || length(text) || ' signs in ' || len(string_split(text, ' ')) || ' parts.' AS said FROM conversations),
c AS ({_claims("t", "conv_id, turn", "said")}),
k AS (SELECT c.conv_id, turn, pos, max(CAST({_HOLDS} AS INTEGER)) AS good FROM c JOIN f ON c.conv_id = f.conv_id GROUP BY ALL)
SELECT conv_id, turn, count(*) AS claims_found, CAST(sum(good) AS BIGINT) AS claims_verified FROM k GROUP BY conv_id, turn
""")
def digest_claims(spark, sf_dir):
    """What is said of each turn, held against the facts of its own conversation's report."""
    said = F.format_string("Turn %d has %d signs in %d parts.", "turn", F.length("text"), F.size(F.split("text", " ")))
    found = G.extracted_claims(table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), said.alias("said")), "at", "said")
    checked = G.verified_claims(found.select("at.conv_id", "at.turn", "value", "suffix"), _talk_facts(spark, sf_dir), "conv_id")
    return checked.groupBy("conv_id", "turn").agg(F.count("*").alias("claims_found"), F.count_if("verified").alias("claims_verified"))


@query(f"""
WITH {_TALK_FACTS}, a AS (SELECT conv_id, count(*) AS n, max(length(text)) AS m, CAST(sum(length(text)) AS BIGINT) AS s FROM conversations GROUP BY conv_id),
p AS (
    SELECT conv_id, 0 AS part, 0 AS place, 'title' AS name, 'Talk ' || conv_id || ' of ' || n || ' turns' AS text FROM a
    UNION ALL SELECT conv_id, 1, 0, 'executive_summary', 'Its longest turn has ' || m || ' signs.' FROM a
    UNION ALL SELECT conv_id, 1, 1, 'executive_summary', 'All turns have ' || s || ' signs.' FROM a
    UNION ALL SELECT conv_id, 2, 0, 'key_findings', 'It has ' || n || ' turns' FROM a UNION ALL SELECT conv_id, 2, 1, 'key_findings', 'no number here' FROM a
    UNION ALL SELECT conv_id, 2, 2, 'key_findings', 'about ' || (m // 100) || 'K signs' FROM a
    UNION ALL SELECT conv_id, 4, 0, 'recommendations', 'Read turn ' || (n - 1) FROM a
    UNION ALL SELECT conv_id, 5, 0, 'calculated_metrics.longest', CAST(m AS VARCHAR) FROM a UNION ALL SELECT conv_id, 5, 1, 'calculated_metrics.total', CAST(s AS VARCHAR) FROM a
), c AS ({_claims("p", "conv_id, part, place", "text")}),
k AS (SELECT c.conv_id, part, place, pos, max(CAST({_HOLDS} AS INTEGER)) AS good FROM c JOIN f ON c.conv_id = f.conv_id GROUP BY ALL),
g AS (SELECT conv_id, part, place, name, text, count(pos) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good FROM p LEFT JOIN k USING (conv_id, part, place) GROUP BY ALL),
t AS (
    SELECT conv_id, CAST(sum(n) AS BIGINT) AS claims_found, CAST(sum(good) AS BIGINT) AS claims_verified, count(CASE WHEN n > good THEN 1 END) AS lost,
           max(CASE WHEN part = 0 THEN CASE WHEN n = good THEN text ELSE 'General summary' END END) AS title, coalesce(string_agg(CASE WHEN part = 1 AND n = good THEN text END, ' ' ORDER BY place), '') AS executive_summary,
           coalesce(string_agg(CASE WHEN part = 2 AND n = good THEN text END, ' | ' ORDER BY place), '') AS findings, coalesce(string_agg(CASE WHEN part = 4 AND n = good THEN text END, ' | ' ORDER BY place), '') AS advice,
           coalesce(string_agg(CASE WHEN part = 5 AND n = good THEN name END, ' | ' ORDER BY place), '') AS metrics,
           coalesce(string_agg(CASE WHEN n > good THEN name || ': ' || left(text, 80) END, ' | ' ORDER BY part, place), '') AS dropped
    FROM g GROUP BY conv_id
), z AS (SELECT *, claims_verified < 0.5 * claims_found OR (lost > 0 AND executive_summary = '') AS fell FROM t)
SELECT conv_id, CASE WHEN fell THEN 'Report: talk ' || conv_id ELSE title END AS title,
       CASE WHEN fell THEN 'Known of it: title = talk ' || conv_id || '. It is made up of ' || n || ' entries in roles, ' || n || ' records in turns.' ELSE executive_summary END AS executive_summary,
       CASE WHEN NOT fell THEN findings END AS findings, CASE WHEN NOT fell THEN advice END AS advice, CASE WHEN NOT fell THEN metrics END AS metrics, dropped,
       CASE WHEN fell THEN 'fallback' ELSE 'guarded' END AS status, claims_found, claims_verified
FROM z JOIN a USING (conv_id)
""")
def guard_summaries(spark, sf_dir):
    """A summary of each conversation, partly wrong, held against its own report, whose summary is the anchor."""
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m"), F.sum(F.length("text")).alias("s"))
    said = lambda form, *cols: F.format_string(form, *cols)
    summaries = talks.select(
        "conv_id", said("Talk %d of %d turns", "conv_id", "n").alias("title"), said("Its longest turn has %d signs. All turns have %d signs.", "m", "s").alias("executive_summary"),
        F.array(said("It has %d turns", "n"), F.lit("no number here"), said("about %dK signs", F.expr("m div 100"))).alias("key_findings"),
        F.create_map(F.lit("longest"), F.col("m").cast("string"), F.lit("total"), F.col("s").cast("string")).alias("calculated_metrics"),
        F.array().cast("array<string>").alias("anomalies_detected"), F.array(said("Read turn %d", F.col("n") - 1)).alias("recommendations"),
    )
    anchors = E.report_summaries(N.report_rows(_turns(spark, sf_dir), "conv_id", "json"), "conv_id")
    found = G.guarded_summaries(summaries, _talk_facts(spark, sf_dir), anchors, "conv_id")
    own = lambda c, name: F.when(F.col("status") != "fallback", F.array_join(c, " | ")).alias(name)
    metrics = F.transform(F.array_sort(F.map_keys("calculated_metrics")), lambda k: F.concat(F.lit("calculated_metrics."), k))
    return found.select("conv_id", "title", "executive_summary", own("key_findings", "findings"), own("recommendations", "advice"), own(metrics, "metrics"), F.array_join("dropped", " | ").alias("dropped"), "status", "claims_found", "claims_verified")


# Readers, streams, replies


@query(_stats("orders", ORDERS))
def csv_profile_roundtrip(spark, sf_dir):
    """orders as delimited text and back: the profile is that of the table."""
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(";", "o_orderkey", "o_custkey", "o_totalprice").alias("value"))
    read = B.read_delimited(spark, B.staged(lines), sep=";", schema="o_orderkey long, o_custkey long, o_totalprice double", header=False)
    return _shown_stats(read)


@query(_stats("events", ["event_id", "user_id", "value"]))
def ndjson_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    return _shown_stats(B.read_json_records(spark, B.staged(lines), "event_id long, user_id long, value double"))


@query("SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_header_inferred(spark, sf_dir):
    """orders as files with headers, blank cells and a column without a name, read by names and inferred types."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("nullif(o_orderstatus, 'O')").alias("o_orderstatus"), F.lit("x").alias(" "), "o_totalprice", "o_orderpriority")
    path = B.scratch_path(spark) + ".csv"
    rows.write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return B.read_table(spark, path)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def csv_lines_coerced(spark, sf_dir):
    """lineitem as lines in no order, the header among them; numbers are coerced where all cells are some."""
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", *names).alias("value")).union(spark.createDataFrame([("|".join(names),)], "value string"))
    return B.delimited_from_lines(lines.repartition(8), "|", "|".join(names)).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT event_id, user_id, value FROM events")
def json_wrapped_records(spark, sf_dir):
    """events as arrays of objects and as objects whose lists hold them, each text a hundred records."""
    rows = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 100").alias("id")).agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "value"))).alias("a"))
    texts = rows.select("id", F.when(F.col("id") % 2 == 0, F.col("a")).otherwise(F.concat(F.lit('{"records": '), "a", F.lit(', "more": []}'))).alias("j"))
    found = B.records_from_texts(texts, "id", "j")
    return found.select(F.from_json("record", "event_id long, user_id long, value double").alias("r")).select("r.*")


@query("""
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 4 < 2 THEN CAST(value AS DOUBLE) END AS amount, CASE event_id % 4 WHEN 0 THEN user_id END AS "by.user", CASE event_id % 4 WHEN 0 THEN event_type END AS "by.kind",
       CASE event_id % 4 WHEN 1 THEN event_type || ', x' END AS tags, CASE event_id % 4 WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN CAST(user_id AS VARCHAR) ELSE event_type END END AS mixed, NULL AS value FROM events WHERE event_id % 4 != 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN event_id % 8 = 3 THEN CAST(event_id AS VARCHAR) ELSE event_type END FROM events WHERE event_id % 4 = 3
""")
def payloads_merged(spark, sf_dir):
    """events as payloads of different shapes: nested objects, objects with lists, fields that change their type, numbers and bare text."""
    rows = table(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("double"))
    shape = F.col("event_id") % 4
    mixed = F.when(F.col("event_id") % 8 == 2, F.to_json(F.struct("event_id", F.col("user_id").alias("mixed")))).otherwise(F.to_json(F.struct("event_id", F.col("event_type").alias("mixed"))))
    payload = (
        F.when(shape == 0, F.to_json(F.struct("event_id", "amount", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("by"))))
        .when(shape == 1, F.to_json(F.array(F.struct("event_id", "amount", F.array("event_type", F.lit("x")).alias("tags"))))).when(shape == 2, mixed)
        .when(F.col("event_id") % 8 == 3, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    )
    return Y.merged_table(rows.select(payload.alias("payload")), "payload")


@query("""
SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' ELSE 'UTF-8' END AS encoding, md5(html) AS text_md5 FROM pages WHERE html IS NOT NULL
""")
def bytes_decoded(spark, sf_dir):
    """pages as base64 of bytes in four encodings, and back by their marks."""
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    marked = lambda mark, encoding: F.concat(F.unhex(F.lit(mark)), F.encode("html", encoding))
    way = F.col("page_id") % 4
    content = F.when(way == 0, F.encode("html", "UTF-8")).when(way == 1, marked("EFBBBF", "UTF-8")).when(way == 2, marked("FFFE", "UTF-16LE")).otherwise(marked("FEFF", "UTF-16BE"))
    held = Y.from_base64(F.base64(content))
    return rows.select("page_id", Y.encoding_of(held).alias("encoding"), F.md5(Y.text_of(held)).alias("text_md5"))


@query(" UNION ALL ".join(f"SELECT 'orders' AS frame, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus, o_totalprice, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders)" for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def steps_observed(spark, sf_dir):
    """What a digest's steps saw of orders, from the runs of the digest itself."""
    steps = Steps()
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("o_orderstatus"), "o_totalprice", F.expr("nullif(o_orderpriority, '1-URGENT')").alias("o_orderpriority"))
    with steps.step("moments") as watch:
        B.kept(watch("orders", df))
    return steps.table(spark).select("frame", "column", "rows", "missing")


@query("SELECT doc_id, replace(text, chr(13), '') AS text, lang FROM documents WHERE trim(replace(text, chr(13), ''), ' ' || chr(9) || chr(10)) != '' AND NOT contains(text, chr(92))")
def csv_quoted_lines(spark, sf_dir):
    """documents as delimited text with quoted line ends, between tabs, and back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), "lang").where(r"trim(BOTH ' \t\n' FROM text) != '' AND NOT contains(text, '\\')")
    path = B.scratch_path(spark) + ".csv"
    rows.write.csv(path, header=True, sep="\t", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = B.read_delimited(spark, path, sep="tab", schema="doc_id long, text string, lang string", multi_line=True)
    return read.select("doc_id", "text", "lang")


@query("""
SELECT event_id, 0 AS pos, CASE event_id % 3 WHEN 0 THEN '{"value":' || event_id || '}' WHEN 1 THEN '{"value":"' || event_type || '"}' ELSE '{"k":' || user_id || '}' END AS record FROM events
""")
def json_scalars_wrapped(spark, sf_dir):
    """Numbers, bare text and objects as records."""
    payload = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit('{"k":'), F.col("user_id").cast("string"), F.lit("}")))
    found = B.records_from_texts(table(spark, sf_dir, "events").select("event_id", payload.alias("j")), "event_id", "j")
    return found.select("event_id", "pos", F.replace("record", F.lit(" "), F.lit("")).alias("record"))


@query("""
SELECT conv_id, turn, role AS title, CAST(length(text) AS VARCHAR) AS executive_summary, role || ' | plain' AS key_findings, false AS strict FROM conversations
""")
def reply_unwrapped(spark, sf_dir):
    """Replies that repeat the schema they were asked to fill."""
    entry = lambda key, value: F.struct(value.alias(key), F.lit("string").alias("type"))
    findings = F.array(F.to_json(entry("content", F.col("role"))), F.lit("plain"))
    whole = F.to_json(F.struct(entry("title", F.col("role")).alias("title"), entry("value", F.length("text")).alias("executive_summary"), findings.alias("key_findings")))
    df = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), whole.alias("reply"))
    found = P.parsed_replies(df, "at", "reply")
    return found.select("at.conv_id", "at.turn", "title", "executive_summary", F.array_join("key_findings", " | ").alias("key_findings"), "strict")


_TERMS = ["the", "and", "License", "xy", "password", "que"]


@query(_SECTIONS + f"""
, hs AS (SELECT doc_id, list(heading ORDER BY section) AS headings, list(lower(heading) ORDER BY section) AS low FROM x GROUP BY doc_id),
ev AS (SELECT doc_id, headings, low, list_filter([lower(left(headings[1], 5)), 'no such heading', '', headings[-1] || ' and more'], lambda s: s != '' AND len(list_filter(low, lambda q: contains(q, lower(s)) OR contains(lower(s), q))) > 0) AS named FROM hs)
SELECT doc_id, array_to_string(named, ' | ') AS supported, len(list_filter(string_split(d.text, chr(10)), lambda l: regexp_matches(l, '[0-9]'))) AS with_digits,
       array_to_string(list_filter([{", ".join(map(_quote, _TERMS))}], lambda w: length(w) >= 3 AND contains(lower(d.text), lower(w))), ' | ') AS mentioned
FROM d JOIN ev USING (doc_id)
""")
def reply_evidence(spark, sf_dir):
    """Sections that a reply names against a document's headings; lines with numbers; terms that the document mentions."""
    docs = D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")
    headings = F.transform(F.array_sort(F.collect_list(F.struct("section", "heading"))), lambda s: s["heading"])
    heads = D.document_sections(docs).groupBy("doc_id").agg(headings.alias("headings"))
    named = F.array(F.lower(F.left(F.get("headings", F.lit(0)), F.lit(5))), F.lit("no such heading"), F.lit(""), F.concat(F.element_at("headings", -1), F.lit(" and more")))
    rows = docs.join(heads, "doc_id")
    return rows.select(
        "doc_id", F.array_join(P.supported(named, F.col("headings")), " | ").alias("supported"), F.size(P.with_digits(F.split("text", "\n"))).cast("long").alias("with_digits"),
        F.array_join(P.mentioned(F.array(*map(F.lit, _TERMS)), F.col("text")), " | ").alias("mentioned"),
    )


@query(_SECTIONS + """
, hs AS (SELECT doc_id, list(heading ORDER BY section) AS headings, list(lower(heading) ORDER BY section) AS low FROM x GROUP BY doc_id),
tt AS (SELECT doc_id, coalesce(max(CASE WHEN is_title THEN coalesce(heading, left(line, 120)) END), '') AS title FROM n GROUP BY doc_id),
ev AS (SELECT doc_id, CASE WHEN len(list_filter(low, lambda q: contains(q, lower(left(headings[1], 4))) OR contains(lower(left(headings[1], 4)), q))) > 0 AND left(headings[1], 4) != '' THEN 'first' ELSE '' END AS evidence FROM hs)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'digest' ELSE 'parsed' END AS status, CASE WHEN doc_id % 4 = 1 THEN 'Reply ' || doc_id WHEN title = '' THEN 'Untitled document' ELSE title END AS title,
       CASE doc_id % 4 WHEN 1 THEN 'plain words' WHEN 3 THEN 'nested words' END AS overview, CASE doc_id % 4 WHEN 2 THEN 'a | b' WHEN 3 THEN 'c' ELSE '' END AS key_findings,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE evidence END AS evidence, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'about 5' END AS important_numbers,
       CASE WHEN doc_id % 4 > 0 AND contains(lower(d.text), 'the') THEN 'The' ELSE '' END AS technologies
FROM d JOIN ev USING (doc_id) JOIN tt USING (doc_id)
""")
def reply_documents(spark, sf_dir):
    """Replies about documents: prose, and objects whose summary is a text, a list or an object, partly made up."""
    docs = D.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")
    heads = F.min_by("heading", "section")
    first = D.document_sections(docs).groupBy("doc_id").agg(heads.alias("heading"))
    evidence = F.array(*(F.struct(F.lit(f).alias("finding"), s.alias("source_section")) for f, s in (("first", F.left("heading", F.lit(4))), ("made up", F.lit("no such heading")), ("", F.col("heading")))))
    common = [evidence.alias("evidence"), F.array(F.lit("about 5"), F.lit("many")).alias("important_numbers"), F.array(F.lit("The"), F.lit("qqqq"), F.lit("a")).alias("technologies")]
    way = F.col("doc_id") % 4
    reply = (
        F.when(way == 0, "Nothing but prose.").when(way == 1, F.to_json(F.struct(F.concat(F.lit("Reply "), F.col("doc_id").cast("string")).alias("title"), F.lit("plain words").alias("summary"), *common)))
        .when(way == 2, F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("summary"), *common)))
        .otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.struct(F.lit("nested words").alias("overview"), F.array(F.lit("c")).alias("key_findings")).alias("summary"), *common)), F.lit("\n```")))
    )
    found = P.guarded_documents(first.select("doc_id", reply.alias("reply")), docs, "doc_id", "reply")
    listed = lambda c: F.array_join(c, " | ")
    return found.select(
        "doc_id", "status", "title", F.when(F.col("status") == "parsed", F.col("overview")).alias("overview"), listed("key_findings").alias("key_findings"),
        listed(F.transform("evidence", lambda e: e["finding"])).alias("evidence"), listed("important_numbers").alias("important_numbers"), listed("technologies").alias("technologies"),
    )


# Streams: each query starts one on a given table's files, and waits until it has read them all.


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A table's files as a stream. The table may be a file or a folder: a pattern stands for both."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "user_id", "event_type", F.expr("IF(value < 10, NULL, value)").alias("value"), F.lit(7).alias("seven"))


def _streamed(stream: DataFrame, **facets: W.Facet) -> Callable[[str], DataFrame]:
    """Runs a stream through its facets; the result gives a facet's parts."""
    spark = stream.sparkSession
    state = B.scratch_path(spark)
    W.facet_stream(stream, state, B.scratch_path(spark), facets).awaitTermination()
    return lambda facet: W.parts(spark, state, facet)


_EVENT_VALUES = """
e AS (SELECT event_id, user_id, event_type, CASE WHEN value < 10 THEN NULL ELSE value END AS value, 7 AS seven FROM events),
v AS (SELECT 0 AS position, 'event_id' AS "column", CAST(event_id AS DOUBLE) AS x FROM e UNION ALL SELECT 1, 'user_id', user_id FROM e UNION ALL SELECT 3, 'value', value FROM e UNION ALL SELECT 4, 'seven', seven FROM e)
"""


@query(f"""
WITH {_EVENT_VALUES}
SELECT "column", count(*) AS rows, count(*) - count(x) AS missing, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 4) AS std,
       true AS ranks_hold FROM v GROUP BY "column"
""")
def stream_incremental_profile(spark, sf_dir):
    """ranks_hold: whether the sketch's quartiles lie within 2 % of their ranks among the table's values."""
    parts = _streamed(_events(_stream(spark, sf_dir, "events")), moments=L.partial_profile)
    found = L.merged_profile(parts("moments")).where("mean IS NOT NULL")
    names = ["event_id", "user_id", "value", "seven"]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("x")) for n in names)))
    values = _events(table(spark, sf_dir, "events")).select(each.alias("r")).select("r.*").where("x IS NOT NULL")
    cuts = [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]
    ranks = values.join(F.broadcast(found.select("column", *(c for c, _ in cuts))), "column").groupBy("column").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("x") < F.col(c)).alias(f"{c}_0") for c, _ in cuts), *(F.count_if(F.col("x") <= F.col(c)).alias(f"{c}_1") for c, _ in cuts),
    )
    near = [(F.col(f"{c}_0") <= (share + 0.02) * F.col("n")) & (F.col(f"{c}_1") >= (share - 0.02) * F.col("n")) for c, share in cuts]
    ranks = ranks.select("column", (near[0] & near[1] & near[2]).alias("ranks_hold"))
    return found.join(F.broadcast(ranks), "column").select("column", "rows", "missing", "min", "max", "mean", F.round("std", 4).alias("std"), "ranks_hold")


@query(f"""
WITH {_EVENT_VALUES}, s AS (SELECT position, "column", round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std FROM v GROUP BY ALL),
c AS (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE abs(std / mean) END AS cv FROM s)
SELECT "column", round(cv, 4) AS cv, CAST(row_number() OVER (ORDER BY cv DESC, abs(mean) DESC, position) AS INTEGER) AS rank FROM c
""")
def stream_variation(spark, sf_dir):
    parts = _streamed(_events(_stream(spark, sf_dir, "events")), moments=L.partial_profile)
    return W.by_variation(L.merged_profile(parts("moments"))).select("column", F.round("cv", 4).alias("cv"), "rank")


@query("""
SELECT 'event_type' AS "column" FROM events HAVING count(DISTINCT event_type) <= 1 UNION ALL SELECT 'seven' FROM events HAVING count(*) >= 0
UNION ALL SELECT 'value' FROM events HAVING count(DISTINCT CASE WHEN value < 10 THEN NULL ELSE value END) <= 1 UNION ALL SELECT 'user_id' FROM events HAVING count(DISTINCT user_id) <= 1
""")
def stream_constant_cols(spark, sf_dir):
    parts = _streamed(_events(_stream(spark, sf_dir, "events")), moments=L.partial_profile)
    return L.merged_profile(parts("moments")).where("is_constant").select("column")


@query("SELECT count(*) - count(DISTINCT (event_type, user_id)) AS duplicate_rows FROM events")
def stream_dup_count(spark, sf_dir):
    """The state of a streaming aggregation, as its last batch wrote it."""
    path = B.scratch_path(spark)

    def last(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = L.duplicates_so_far(_stream(spark, sf_dir, "events").select("event_type", "user_id")).writeStream.outputMode("complete").foreachBatch(last)
    writer.option("checkpointLocation", B.scratch_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).agg((F.sum("n") - F.count("*")).alias("duplicate_rows"))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL
""")
def stream_windows(spark, sf_dir):
    """Hours of events by type, as a stream with a watermark leaves them."""
    path = B.scratch_path(spark)

    def last(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    found = L.windowed_profile(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type")
    found.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", B.scratch_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("mean", 6).alias("mean"), "least", "most")


_PAIRED = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _gaps(df: DataFrame) -> DataFrame:
    """lineitem with nulls in two columns, so that pairs have different rows."""
    return df.select("l_partkey", "l_quantity", "l_extendedprice", F.expr("nullif(l_discount, 0)").alias("l_discount"), F.expr("IF(l_quantity > 40, NULL, l_tax)").alias("l_tax"))


_GAPS = "g AS (SELECT l_partkey, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)"
_GAP_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {i * len(_PAIRED) + j} AS position, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, round(corr({a}, {b}), 4) AS value FROM g" for i, a in enumerate(_PAIRED) for j, b in enumerate(_PAIRED) if i < j
)


@query(f"WITH {_GAPS} SELECT a, b, n, value FROM ({_GAP_PAIRS})")
def stream_corr_pairs(spark, sf_dir):
    parts = _streamed(_gaps(_stream(spark, sf_dir, "lineitem")), pairs=W.co_moments)
    return W.merged_correlations(parts("pairs")).select("a", "b", "n", "value")


@query(f"""
WITH {_GAPS}, p AS ({_GAP_PAIRS}), s AS (SELECT *, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sign FROM p WHERE value != 0)
SELECT sign, a, b, value, CAST(row_number() OVER (PARTITION BY sign ORDER BY abs(value) DESC, position) AS INTEGER) AS rank FROM s QUALIFY rank <= 5
""")
def stream_corr_top(spark, sf_dir):
    parts = _streamed(_gaps(_stream(spark, sf_dir, "lineitem")), pairs=W.co_moments)
    return W.strongest_pairs(W.merged_correlations(parts("pairs")))


_FLAGS = ["l_returnflag", "l_linestatus"]


@query(f'SELECT "column", value, n AS count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM ({_values("lineitem", _FLAGS)}) WHERE length(value) <= 40 QUALIFY rank <= 5')
def stream_top_values(spark, sf_dir):
    parts = _streamed(_stream(spark, sf_dir, "lineitem"), values=lambda b: W.frequent_values(b, _FLAGS))
    return W.top_values(W.merged_values(parts("values")))


_OFTEN = "(SELECT CAST(user_id // 40 AS VARCHAR) AS circle, event_type FROM events)"


@query(f'SELECT "column", value, n AS count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM ({_values(_OFTEN, ["circle", "event_type"])}) QUALIFY rank <= 3')
def stream_top_values_recounted(spark, sf_dir):
    """A part holds too few values for one of the columns, so a second query counts what may be on top."""
    stream = _stream(spark, sf_dir, "events").select(F.expr("CAST(user_id div 40 AS STRING)").alias("circle"), "event_type")
    found = _streamed(stream, values=lambda b: W.frequent_values(b, ["circle", "event_type"], cap=8))("values")
    merged = W.merged_values(found)
    wanted = B.kept(W.open_values(merged, 3))
    again = _streamed(stream, counts=lambda b: W.counts_of(b, wanted))("counts")
    return W.top_values(merged, again, 3).join(W.settled_columns(found, merged, 3), "column", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 5")
def stream_sample(spark, sf_dir):
    """The sample of sample_random_seeded, kept while files arrive."""
    parts = _streamed(_stream(spark, sf_dir, "orders"), sample=lambda b: W.least_hashes(b, "o_orderkey", 5))
    return W.merged_sample(parts("sample"), "o_orderkey", 5).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER () AS n FROM orders) ORDER BY n DESC LIMIT 5")
def stream_tail(spark, sf_dir):
    """The last rows of orders as its files have them."""
    parts = _streamed(W.placed(_stream(spark, sf_dir, "orders")), tail=lambda b: W.last_rows(b, "file", "row"))
    return W.last_rows(parts("tail"), "file", "row").select("o_orderkey", "o_custkey")


@query(_outliers("events", _EVENTS).replace("GROUP BY ALL", 'GROUP BY o.position, o."column", q1, q3, lo, hi, o.n').replace("/ o.n, 3)", "/ o.n, 4)") + """
SELECT "column", round(lo, 4) AS lo, round(hi, 4) AS hi, outliers, share, CAST(row_number() OVER (ORDER BY outliers DESC, "column") AS INTEGER) AS rank FROM x WHERE outliers > 0 QUALIFY rank <= 10
""")
def stream_outliers(spark, sf_dir):
    """Bounds from a first pass, frozen; a second query counts what lies outside of them."""
    stream = _stream(spark, sf_dir, "events").select(*_EVENTS)
    bounds = B.kept(W.frozen_bounds(_streamed(stream, quartiles=W.chunk_quartiles)("quartiles")))
    found = _streamed(stream, outside=lambda b: W.outside(b, bounds))("outside")
    return W.merged_outliers(found, bounds).select("column", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "outliers", "share", "rank")


@query("""
SELECT 'conv_id' AS "column", 'numeric' AS bucket UNION ALL SELECT 'turn', 'numeric' UNION ALL
SELECT 'role', CASE WHEN avg(length(role)) > 60 OR count(DISTINCT role) > 500 THEN 'text' ELSE 'categorical' END FROM conversations UNION ALL
SELECT 'text', CASE WHEN avg(length(text)) > 60 OR count(DISTINCT CASE WHEN length(text) <= 40 THEN text END) > 500 THEN 'text' ELSE 'categorical' END FROM conversations
""")
def stream_kinds(spark, sf_dir):
    stream = _stream(spark, sf_dir, "conversations")
    parts = _streamed(stream, moments=L.partial_profile, values=lambda b: W.frequent_values(b, ["role", "text"]))
    return W.streamed_kinds(stream.schema, L.merged_profile(parts("moments")), W.merged_values(parts("values"))).select("column", "bucket")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'Data Summary' END AS title, CASE WHEN turn % 2 = 0 THEN left(text, 40) ELSE left(trim(text, ' '), 500) END AS executive_summary, turn % 2 = 0 AS strict FROM conversations
""")
def reply_parse(spark, sf_dir):
    """conversations as replies: every other turn wrapped as fenced JSON."""
    wrapped = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.col("role").alias("title"), F.left("text", F.lit(40)).alias("executive_summary"))), F.lit("\n```"))
    df = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.when(F.col("turn") % 2 == 0, wrapped).otherwise(F.col("text")).alias("reply"))
    return P.parsed_replies(df, "at", "reply").select("at.conv_id", "at.turn", "title", "executive_summary", "strict")
