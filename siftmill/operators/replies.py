"""Replies of language models: JSON out of text, lenient defaults, evidence that must be in the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators import documents as D
from siftmill.operators.nested import SCALARS, kind_of, shown

#: A summary's fields, and what stands in for missing ones (fixed values).
SCHEMA = "title string, executive_summary string, key_findings array<string>, calculated_metrics map<string, string>, anomalies_detected array<string>, recommendations array<string>"
TITLE, SUMMARY_CHARS = "Data Summary", 500


def json_part(text: Column) -> Column:
    """From the first { to the last }, without code fences; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


#: Signs of a schema's entry in the place of a value, and where the value may stand then, in order (fixed values).
ECHOED, HOLDERS = ("type", "$ref"), ("value", "content", "title", "label", "default")


def unwrapped(value: Column) -> Column:
    """A value as text; of one that repeats the schema ({"title": "Sales", "type": "string"}) what it holds: the first
    scalar among HOLDERS, or all of it if there is none."""
    v = F.try_parse_json(F.when(F.startswith(F.ltrim(value), F.lit("{")), value))
    parts = F.try_variant_get(v, "$", "map<string,variant>")
    echoed = F.exists(F.array(*map(F.lit, ECHOED)), lambda k: F.coalesce(F.map_contains_key(parts, k), F.lit(False)))
    held = F.coalesce(*(F.when(kind_of(parts[k]).isin(*SCALARS), shown(parts[k])) for k in HOLDERS))
    return F.coalesce(F.when(echoed, held), value)


def parsed_replies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, strict, title, executive_summary, key_findings, calculated_metrics, anomalies_detected,
    recommendations): strict tells whether the reply held a JSON object with both title and summary;
    otherwise the title is `Data Summary` and the summary the text's first 500 characters. Values that repeat the
    schema are unwrapped, and make a reply not strict, as does any object in the place of a text."""
    part = json_part(F.col(text_col))
    good = F.expr("try_parse_json(_part)").isNotNull()
    rows = df.select(id_col, F.col(text_col).alias("_text"), part.alias("_part")).withColumn("_r", F.when(good, F.from_json("_part", SCHEMA)))
    none = lambda c: F.coalesce(F.transform(c, unwrapped), F.array().cast("array<string>")).alias(c.rsplit(".")[-1])
    bare = lambda c: F.col(c).isNotNull() & (kind_of(F.try_parse_json(F.when(F.col(c).rlike(r"^\s*[{\[]"), F.col(c)))) == "null")
    strict = F.coalesce(bare("_r.title") & bare("_r.executive_summary"), F.lit(False))
    return rows.select(
        id_col, strict.alias("strict"), F.coalesce(unwrapped(F.col("_r.title")), F.lit(TITLE)).alias("title"), F.coalesce(unwrapped(F.col("_r.executive_summary")), F.left(F.trim("_text"), F.lit(SUMMARY_CHARS)), F.lit("")).alias("executive_summary"),
        none("_r.key_findings"), F.coalesce("_r.calculated_metrics", F.create_map().cast("map<string,string>")).alias("calculated_metrics"), none("_r.anomalies_detected"), none("_r.recommendations"),
    )


def supported(sections: Column, headings: Column) -> Column:
    """The named sections that match a heading, either containing the other, whatever the case."""
    low = F.transform(headings, F.lower)
    return F.filter(sections, lambda s: (s != "") & F.exists(low, lambda h: F.contains(h, F.lower(s)) | F.contains(F.lower(s), h)))


def with_digits(items: Column) -> Column:
    """The items that hold a digit."""
    return F.filter(items, lambda x: x.rlike(r"\d"))


def mentioned(names: Column, text: Column) -> Column:
    """The names of 3 or more characters that the text mentions, whatever the case."""
    return F.filter(names, lambda n: (F.length(n) >= 3) & F.contains(F.lower(text), F.lower(n)))


# Replies about documents


def _texts(v: Column) -> Column:
    """The scalars of a list as texts; none of what isn't one."""
    entries = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(entries, lambda x: kind_of(x).isin(*SCALARS)), shown)


def guarded_documents(df: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, status, title, overview, key_findings, evidence, important_numbers, technologies): replies about cleaned
    documents (id_col, text), with what the documents don't bear out left out: evidence (finding and
    source_section) of sections that they don't have, important numbers without a digit, technologies that they
    don't mention. df may hold a reply or none for each document.

    status: parsed, if the reply holds a JSON object; its summary may be a text (the overview), a list (key
    findings) or an object with either. digest, if it doesn't: then the document's own digest is the overview.
    A title that is missing is the document's.
    """
    own = D.deterministic_digests(docs, id_col).select(id_col, F.col("title").alias("_title"), F.col("overview").alias("_overview"))
    heads = F.transform(F.array_sort(F.collect_list(F.struct("section", "heading"))), lambda x: x["heading"])
    headings = D.document_sections(docs, id_col).groupBy(id_col).agg(heads.alias("_headings"))
    v = F.try_parse_json(json_part(F.col(text_col)))
    replies = df.select(id_col, F.when(kind_of(v) == "object", v).alias("_v"))
    rows = docs.select(id_col, F.col("text").alias("_text")).join(replies, id_col, "left").join(own, id_col).join(headings, id_col)
    parts = F.coalesce(F.try_variant_get("_v", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = rows.withColumn("_parts", parts).withColumn("_summary", F.col("_parts")["summary"])
    kind, inner = kind_of(F.col("_summary")), F.try_variant_get("_summary", "$", "map<string,variant>")
    text = lambda x: F.when(kind_of(x) == "text", shown(x))
    overview = F.when(kind == "text", shown(F.col("_summary"))).when(kind == "object", text(inner["overview"]))
    found = F.when(kind == "list", _texts(F.col("_summary"))).when(kind == "object", _texts(inner["key_findings"]))
    said = F.transform(F.coalesce(F.try_variant_get(F.col("_parts")["evidence"], "$", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.struct(
        text(F.try_variant_get(e, "$.finding", "variant")).alias("finding"), text(F.try_variant_get(e, "$.source_section", "variant")).alias("source_section"),
    ))
    borne = F.filter(said, lambda e: (F.coalesce(e["finding"], F.lit("")) != "") & F.exists(F.col("_headings"), lambda h: (F.coalesce(e["source_section"], F.lit("")) != "") & (F.contains(F.lower(h), F.lower(e["source_section"])) | F.contains(F.lower(e["source_section"]), F.lower(h)))))
    bad = F.col("_v").isNull()
    return rows.select(
        id_col, F.when(bad, "digest").otherwise("parsed").alias("status"), F.coalesce(text(F.col("_parts")["title"]), F.col("_title")).alias("title"),
        F.when(bad, F.col("_overview")).otherwise(overview).alias("overview"), F.coalesce(found, F.array().cast("array<string>")).alias("key_findings"), borne.alias("evidence"),
        with_digits(_texts(F.col("_parts")["important_numbers"])).alias("important_numbers"), mentioned(_texts(F.col("_parts")["technologies"]), F.col("_text")).alias("technologies"),
    )
