"""One table out of payloads of different shapes, and texts out of bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.operators.nested import JOINED, SCALARS, _all, _entries, _parts, kind_of, shown
from siftmill.sources.scratch import kept

#: The column of what isn't a record (fixed value), and the columns that a table may have at most.
VALUE, MOST_COLUMNS = "value", 10_000


def records(payloads: DataFrame, json_col: str) -> DataFrame:
    """(v VARIANT): the records of JSON texts: an object is one, a list holds one in each entry; a scalar, and a text
    that doesn't parse, is the record {"value": it}. Null texts and JSON nulls have none."""
    text = F.col(json_col).cast("string")
    v = F.try_parse_json(text)
    rows = payloads.select(text.alias("text"), v.alias("v")).where("text IS NOT NULL")
    each = F.when(F.col("v").isNotNull() & (kind_of(F.col("v")) == "list"), _entries(F.col("v"))).otherwise(F.array("v"))
    rows = rows.select(F.when(F.col("v").isNull(), F.col("text")).alias("bare"), F.explode(each).alias("v"))
    kind = F.when(F.col("bare").isNull(), kind_of(F.col("v")))
    wrapped = F.parse_json(F.when(F.col("bare").isNotNull(), F.to_json(F.struct(F.col("bare").alias(VALUE)))).otherwise(F.to_json(F.struct(F.col("v").alias(VALUE)))))
    return rows.where(F.col("bare").isNotNull() | (kind != "null")).select(F.when(kind == "object", F.col("v")).otherwise(wrapped).alias("v"))


def _fields(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """The leaves of a merged schema by path; objects are opened, lists are leaves."""
    if isinstance(kind, T.StructType) and kind.fields:
        return [x for f in kind for x in _fields(f.dataType, (*path, f.name))]
    return [(path, kind)] if path else []


def merged_schema(found: DataFrame) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Path and type of each leaf of records (v), types widened until all records fit; VARIANT where none does."""
    ddl = found.agg(F.schema_of_variant_agg("v")).first()[0]
    spark_ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], ddl or "VOID")
    fields = _fields(T.DataType.fromDDL(spark_ddl))
    if len(fields) > MOST_COLUMNS:
        raise ValueError(f"{len(fields)} paths are too many for a table's columns")
    return fields


def _at(v: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        v = _parts(v)[name]
    return v


def _cell(x: Column, kind: T.DataType) -> Column:
    """A leaf as a cell of its column: numbers as longs or doubles, lists as in nested.flatten, what fits no type as
    text."""
    if isinstance(kind, (T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return F.try_variant_get(x, "$", kind.simpleString())
    if isinstance(kind, (T.NumericType,)):
        return F.try_variant_get(x, "$", "double")
    n, entries = F.size(_entries(x)), _entries(x)
    listed = (
        F.when(n == 0, None).when(_all(entries, *SCALARS) & (n <= JOINED), F.array_join(F.transform(entries, shown), ", "))
        .when(_all(entries, *SCALARS), F.format_string("[list of %d items]", n)).when(_all(entries, "object"), F.format_string("[nested array of %d objects]", n)).otherwise(F.format_string("[nested list of %d items]", n))
    )
    what = kind_of(x)
    return F.when(x.isNull() | (what == "null"), None).when(what == "list", listed).when(what == "object", F.to_json(x)).otherwise(shown(x))


def merged_table(payloads: DataFrame, json_col: str) -> DataFrame:
    """A table with a row for each record of the payloads, in no order, and a column for each path that any of them
    has: inner objects' fields as parent.child, each as the merged type of its values. Where records
    disagree beyond widening, the column is text. Payloads that hold no object give the one column `value`;
    without any record it has no rows. Paths that come out alike get numbers behind them."""
    found = kept(records(payloads, json_col))
    fields = merged_schema(found) or [((VALUE,), T.StringType())]
    names: list[str] = []
    for path, _ in fields:
        name, k = ".".join(path), 1
        while name.lower() in {n.lower() for n in names}:
            k += 1
            name = f"{'.'.join(path)}_{k}"
        names.append(name)
    return found.select(*(_cell(_at(F.col("v"), path), kind).alias(name) for (path, kind), name in zip(fields, names)))


# Bytes

#: Marks that begin texts, in hexadecimal, and the encodings that they tell (fixed values).
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def from_base64(encoded: Column) -> Column:
    """The bytes of a base64 text, blanks ignored; null if it isn't one."""
    return F.try_to_binary(F.regexp_replace(encoded, r"\s", ""), F.lit("base64"))


def encoding_of(content: Column) -> Column:
    """The encoding that a mark tells; else UTF-8 if the bytes are valid, else ISO-8859-1."""
    head = F.hex(F.substring(content, 1, 3))
    found = F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    for mark, name in reversed(MARKS):
        found = F.when(F.startswith(head, F.lit(mark)), name).otherwise(found)
    return F.when(content.isNotNull(), found)


def text_of(content: Column) -> Column:
    """The text of bytes, without the mark. An odd byte at the end of UTF-16, and halves of pairs, become the
    replacement character, as do bytes that a marked UTF-8 text can't hold."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 2147483647)
    found = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    for mark, name in reversed(MARKS):
        tail = rest(len(mark) // 2)
        text = F.make_valid_utf8(tail.cast("string")) if name == "UTF-8" else F.decode(tail, name)
        found = F.when(F.startswith(head, F.lit(mark)), text).otherwise(found)
    return found
