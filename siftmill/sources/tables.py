"""Readers: delimited text, JSON records, workbooks, PDF text. All of them read whole folders in parallel."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.sources.scratch import kept, scratch_path

#: Marks of a header's delimiter, in order; a comma if there is none (fixed values).
HEADER_DELIMITERS = ("\t", ";", "|")


def header_delimiter(line: str) -> str:
    return next((d for d in HEADER_DELIMITERS if d in line), ",")


def read_delimited(spark: SparkSession, path: str, sep: str = "auto", schema: str | None = None, multi_line: bool = False, header: bool = True) -> DataFrame:
    """A table with a header (or, without one, with a schema); blank cells are null, columns without a name
    in the header go, names lose outer blanks. sep: a delimiter, `tab`, or `auto`, which looks at the
    first line. Without a schema, types are inferred in a pass of its own."""
    first = spark.read.text(path).where("trim(value) != ''").limit(1).first() if sep == "auto" or header else None
    sep = header_delimiter(first.value if first else "") if sep == "auto" else "\t" if sep == "tab" else sep
    options = {"header": header, "sep": sep, "multiLine": multi_line, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    reader = spark.read.options(**options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return named(df, cells_of(first.value, sep)) if header and first else named(df)


def staged(lines: DataFrame) -> str:
    """Lines as text files where every executor finds them."""
    path = scratch_path(lines.sparkSession)
    lines.write.text(path)
    return path


def cells_of(line: str, sep: str) -> list[str]:
    """The cells of one line of delimited text."""
    return next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), [])


def delimited_from_lines(lines: DataFrame, sep: str, header: str, inferred: bool = True, column: str = "value", headers: int = 1) -> DataFrame:
    """A table from a frame of lines in any order and partitioning: header is the line with the names, which
    stands in it `headers` times (once for each file that has one); a line like it beyond these is data.
    Blank lines go. Cells are text (null if blank), or where inferred long or double if all of a
    column's are."""
    names = cells_of(header, sep)
    fields = [f"c{i}" for i in range(len(names))]
    like = F.trim(column) == header.strip()
    again = lines.where(like).agg(F.count("*").alias("n"), F.min(column).alias(column)).where(f"n > {headers}")
    rows = lines.select(column).where((F.trim(column) != "") & ~like).union(again.select(F.explode(F.array_repeat(column, (F.col("n") - headers).cast("int")))))
    cells = F.from_csv(column, ", ".join(f"{c} string" for c in fields), {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    df = rows.select(cells.alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in fields))
    kept = [(c, n.strip()) for c, n in zip(fields, names) if n.strip()]
    df = df.select(*(c for c, _ in kept))
    return (coerced(df) if inferred else df).toDF(*(n for _, n in kept))


def named(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Without columns that have no name, names without outer blanks. header: the names as they were read; a
    reader may have given blank ones a name of its own."""
    given = df.columns if header is None or len(header) != len(df.columns) else header
    kept = [(n, g.strip()) for n, g in zip(df.columns, given) if g.strip()]
    names = [n.strip() for n, _ in kept]
    return df.select(*(F.col("`" + n.replace("`", "``") + "`") for n, _ in kept)).toDF(*names)


def read_json_records(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """Records from JSON files. lines: each line is a record, and files are split. Otherwise each file is
    one text (of any layout) that must fit in memory: an array of records, an object whose lists hold
    them, or one record; see records_from_texts. Without a schema one is inferred in a pass of its own."""
    reader = spark.read.schema(schema) if schema else spark.read
    if lines:
        return reader.json(path)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    texts = kept(records_from_texts(files, "file", "value").select("record"))
    if schema:
        return texts.select(F.from_json("record", schema).alias("r")).select("r.*")
    path = scratch_path(spark)
    texts.select(F.col("record").alias("value")).write.text(path)  # a record a line
    return spark.read.json(path)


#: Ends of names and how they are read (fixed values).
READERS = {".csv": "delimited", ".tsv": "delimited", ".txt": "delimited", ".json": "json", ".jsonl": "lines", ".ndjson": "lines", ".xlsx": "workbook", ".xlsm": "workbook"}


def read_table(spark: SparkSession, path: str, **more) -> DataFrame:
    """A table from a file or folder by the end of its name: delimited text, JSON, JSON lines or a workbook.
    Other ends raise."""
    tail = re.search(r"\.[a-z]+$", path.rstrip("/").lower().removesuffix(".gz"))
    kind = READERS.get(tail[0] if tail else "")
    if kind is None:
        raise ValueError(f"no reader for {path}")
    if kind == "workbook":
        return workbook_table(read_workbooks(spark, path))
    return read_delimited(spark, path, **more) if kind == "delimited" else read_json_records(spark, path, lines=kind == "lines", **more)


def records_from_texts(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, pos, record): the objects of JSON texts as JSON: of an array its objects; of an object
    the objects of its lists, if there are any, else itself; of lines one each. A scalar is the
    record {"value": scalar}, and so is a text that doesn't parse."""
    import json

    def objects(text: str | None) -> list[dict]:
        text = (text or "").strip()
        if not text:
            return []
        try:
            found = json.loads(text)
        except ValueError:
            rows = []
            for line in text.splitlines():
                try:
                    x = json.loads(line) if line.strip() else []
                except ValueError:
                    return [{"value": text}]
                rows += x if isinstance(x, list) else [x]
            return [x if isinstance(x, dict) else {"value": x} for x in rows]
        if isinstance(found, dict):
            inner = [x for v in found.values() if isinstance(v, list) for x in v if isinstance(x, dict)]
            return inner if inner and all(isinstance(v, list) for v in found.values()) else [found]
        return [x if isinstance(x, dict) else {"value": x} for x in found] if isinstance(found, list) else [{"value": found}]

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, json.dumps(x)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(objects(t))]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["id", "pos", "record"])

    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).cast("string").alias("json"))
    return rows.mapInArrow(run, f"id {kind}, pos int, record string").withColumnRenamed("id", id_col)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(data: bytes) -> list[list[str | None]]:
    """The rows of the first sheet of an .xlsx file that has any."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for sheet in sheets:
            rows = []
            for row in ElementTree.fromstring(book.read(sheet)).iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for cell in row.findall("m:c", _NS):
                    letters = re.match(r"[A-Z]+", cell.get("r", ""))
                    at = len(cells)
                    if letters:
                        at = 0
                        for c in letters[0]:
                            at = 26 * at + ord(c) - 64
                        at -= 1
                    cells += [None] * (at - len(cells))
                    value, kind = cell.find("m:v", _NS), cell.get("t", "n")
                    inline = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                    text = inline if kind == "inlineStr" else None if value is None else value.text
                    cells.append(shared[int(text)] if kind == "s" and text is not None else {"0": "false", "1": "true"}.get(text, text) if kind == "b" else text)
                rows.append(cells)
            if any(any(c not in (None, "") for c in r) for r in rows):
                return rows
    return []


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells map<string, string>): the rows of the first filled sheet of each .xlsx file, by the
    names in its first row; blank-named columns go, and blank cells are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, *rows = _cells(data) or [[]]
                at = [(i, n.strip()) for i, n in enumerate(head) if n and n.strip()]
                cells = [[(n, r[i] if i < len(r) and r[i] != "" else None) for i, n in at] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(cells, pa.map_(pa.string(), pa.string()))], ["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row int, cells map<string, string>")


def workbook_table(rows: DataFrame) -> DataFrame:
    """read_workbooks' rows as a table: columns by name, whole numbers as long, others as double, else string."""
    cells = rows.select(F.explode("cells"))
    kinds = cells.groupBy("key").agg(F.every(F.expr("value IS NULL OR try_cast(value AS bigint) IS NOT NULL")).alias("whole"), F.every(F.expr("value IS NULL OR try_cast(value AS double) IS NOT NULL")).alias("number"))
    names = kinds.orderBy("key").collect()  # a row for each column name
    cast = lambda k: "bigint" if k.whole else "double" if k.number else "string"
    return rows.select(*(F.expr(f"try_cast(cells['{k.key.replace(chr(39), chr(92) + chr(39))}'] AS {cast(k)})").alias(k.key) for k in names))


def read_pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): pages joined by blank lines. Needs the optional package pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pypdf

        for batch in batches:
            texts = ["\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(d)).pages).strip() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def coerced(df: DataFrame) -> DataFrame:
    """String columns as numbers where every value is one: long, else double; blanks are null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    q = lambda n: "`" + n.replace("`", "``") + "`"
    blank = lambda n: f"nullif(trim({q(n)}), '')"
    pattern = {"bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"}
    tests = [F.expr(f"every({blank(n)} IS NULL OR ({blank(n)} RLIKE '{p}' AND try_cast({blank(n)} AS {k}) IS NOT NULL))").alias(f"{k}{i}") for i, n in enumerate(texts) for k, p in pattern.items()]
    found = df.agg(*tests, *(F.count(F.expr(blank(n))).alias(f"n{i}") for i, n in enumerate(texts))).first()
    kinds = {n: "bigint" if found[f"bigint{i}"] else "double" if found[f"double{i}"] else "string" for i, n in enumerate(texts) if found[f"n{i}"]}
    return df.select(*(F.expr(f"CAST({blank(n)} AS {kinds[n]})").alias(n) if kinds.get(n, "string") != "string" else F.expr(blank(n)).alias(n) if n in texts else F.expr(q(n)) for n in df.columns))
