"""Which kind of content a blob is: structured, tabular or document. Native expressions over a frame of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import outside_quotes
from siftmill.sources.payloads import text_of

#: Extensions and the kinds they stand for (fixed values).
KINDS = {
    "csv": "tabular", "tsv": "tabular", "tab": "tabular", "xlsx": "tabular", "xls": "tabular", "json": "structured", "jsonl": "structured",
    "txt": "document", "text": "document", "md": "document", "markdown": "document", "html": "document", "htm": "document", "rst": "document", "log": "document", "pdf": "document",
}
#: Delimiters in the order of their vote (fixed values).
DELIMITERS = ("\t", ";", "|", ",")
NAMES = {"\t": "tsv"}


def kind_of_hint(hint: Column) -> Column:
    """The kind that a file name, extension or MIME type stands for; null if none."""
    tail = F.substring_index(F.substring_index(F.lower(hint), "/", -1), ".", -1)
    found = F.lit(None).cast("string")
    for extension, kind in KINDS.items():
        found = F.when(tail == extension, kind).otherwise(found)
    return found


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")


def votes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, place, delimiter, lines, with_any, header, consistency): how the lines of each text vote for
    each delimiter: how many have one, how many the first line has, and the share of lines with as many."""
    lines = df.select(id_col, F.posexplode(filled_lines(F.col(text_col))).alias("i", "line"))
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), outside_quotes(F.col("line"), d).alias("n")) for i, d in enumerate(DELIMITERS)))
    counts = lines.select(id_col, "i", F.explode(each).alias("v")).select(id_col, "i", "v.*")
    per = counts.groupBy(id_col, "place", "delimiter").agg(F.count("*").alias("lines"), F.count_if(F.col("n") > 0).alias("with_any"), F.max(F.when(F.col("i") == 0, F.col("n"))).alias("header"), F.collect_list("n").alias("ns"))
    same = F.size(F.filter("ns", lambda n: n == F.col("header")))
    return per.select(id_col, "place", "delimiter", "lines", "with_any", "header", (same / F.col("lines")).alias("consistency"))


def delimiters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, delimiter, columns, consistency): the first delimiter that 80 % of at least two lines hold
    and that 70 % hold as often as the first line does; texts without one are left out."""
    good = votes(df, id_col, text_col).where("lines >= 2 AND header > 0 AND with_any >= 0.8 * lines AND consistency >= 0.7")
    first = good.groupBy(id_col).agg(F.min(F.struct("place", "delimiter", "header", "consistency")).alias("f"))
    return first.select(id_col, F.col("f.delimiter").alias("delimiter"), (F.col("f.header") + 1).alias("columns"), F.col("f.consistency").alias("consistency"))


def classified_texts(df: DataFrame, id_col: str, text_col: str, hint_col: str | None = None) -> DataFrame:
    """(id_col, kind, format, confidence, reason): a row for each text. In order: the PDF mark, a known
    hint, JSON, a line that starts with #, a delimiter, else prose."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "^﻿+", "")
    hint = F.col(hint_col) if hint_col else F.lit(None).cast("string")
    rows = df.select(id_col, text.alias("text"), kind_of_hint(hint).alias("hinted"), F.substring_index(F.substring_index(F.lower(hint), "/", -1), ".", -1).alias("tail"))
    table = delimiters(rows, id_col, "text")
    rows = rows.join(table, id_col, "left")
    is_json = F.ltrim("text").rlike(r"^[\[{]") & F.expr("try_parse_json(text)").isNotNull()
    marked = F.exists(F.split("text", r"\r\n|\r|\n"), lambda x: F.startswith(F.ltrim(x), F.lit("#")))
    pick = lambda pdf, hinted, json, marks, cells, prose: F.when(F.startswith("text", F.lit("%PDF-")), pdf).when(F.col("hinted").isNotNull(), hinted).when(is_json, json).when(marked, marks).when(F.col("delimiter").isNotNull(), cells).otherwise(prose)
    lit = F.lit
    name = F.when(F.col("delimiter") == "\t", "tsv").otherwise("csv")
    return rows.select(
        id_col,
        pick(lit("document"), F.col("hinted"), lit("structured"), lit("document"), lit("tabular"), lit("document")).alias("kind"),
        pick(lit("pdf"), F.col("tail"), lit("json"), lit("markdown"), name, lit("plain-text")).alias("format"),
        pick(lit(1.0), lit(0.9), lit(1.0), lit(0.95), F.round("consistency", 4), lit(0.7)).alias("confidence"),
        pick(lit("PDF header"), lit("source type"), lit("parses as JSON"), lit("markdown marks"), F.format_string("%d-column delimiter table", "columns"), lit("no table or markup")).alias("reason"),
    )


def classified_files(files: DataFrame) -> DataFrame:
    """(path, kind, format, text): a binaryFile frame's contents: PDF and workbooks by their first bytes,
    else text by its byte-order mark (UTF-8, UTF-16), as UTF-8 or, where that fails, Latin-1."""
    head = F.hex(F.substring("content", 1, 8))
    is_pdf, is_book = F.startswith(head, F.lit("255044462D")), F.startswith(head, F.lit("504B0304")) | (head == "D0CF11E0A1B11AE1") | F.lower("path").rlike(r"\.xlsx?$")
    shape = F.when(is_pdf, "pdf").when(is_book, "excel")
    return files.select("path", F.when(is_pdf, "document").when(is_book, "tabular").alias("kind"), shape.alias("format"), F.when(shape.isNull(), text_of(F.col("content"))).alias("text"))
