"""Readers, streams, digests, jobs, and the driver's contract with all its oracles."""

import json
import math
import os
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
from siftmill.plans import digest as P
from siftmill.plans import queries as plans
from siftmill.sources import tables as R
from siftmill.streaming import profile as L

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;  name ;;v\n1;x;;2.5\n2;;9;\n")
    df = R.read_delimited(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["id", "name", "v"] and [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", 2.5), (2, None, None)]
    assert [R.header_delimiter(x) for x in ("a\tb;c", "a;b|c", "a|b", "a,b", "")] == ["\t", ";", "|", ",", ","]
    (tmp_path / "b.csv").write_text("_c1,_c0,\n1,2,\n")  # names that look generated stay
    assert R.read_table(spark, f"file://{tmp_path}/b.csv").columns == ["_c1", "_c0"]
    with pytest.raises(ValueError, match="no reader"):
        R.read_table(spark, "file:///tmp/x.bin")


def test_delimited_lines_in_any_partitioning(spark):
    rows = [f'{i}|"x | {i}"||{i / 2}' for i in range(1000)]
    lines = spark.createDataFrame([(x,) for x in ["a| b ||c", *rows, "", "  "]], "value string").repartition(4)
    df = R.delimited_from_lines(lines, "|", "a| b ||c")
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert sorted(map(tuple, df.collect())) == [(i, f"x | {i}", i / 2) for i in range(1000)]
    assert R.delimited_from_lines(lines.where("false"), "|", "a|b").columns == ["a", "b"]
    # A line like the header beyond the headers that there are is data.
    twice = spark.createDataFrame([("a|b",), ("a|b",), (" a|b",), ("1|x",)], "value string").repartition(3)
    rows = lambda n: sorted(map(tuple, R.delimited_from_lines(twice, "|", "a|b", headers=n).collect()))
    assert rows(3) == [(1, "x")] and rows(2) == [("1", "x"), ("a", "b")] and rows(1) == [("1", "x"), ("a", "b"), ("a", "b")]


def test_coercion(spark):
    df = spark.createDataFrame([("1", "1.5", "x", " ", "12d"), (" 2 ", "1e3", "1", "", "3"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    got = R.coerced(df)
    assert [t for _, t in got.dtypes] == ["bigint", "double", "string", "string", "string"]
    assert [tuple(r) for r in got.collect()] == [(1, 1.5, "x", None, "12d"), (2, 1000.0, "1", None, "3"), (None,) * 5]


def test_json_records(spark, tmp_path):
    texts = ['[{"a":1}, 2]', '{"x":[{"a":1}],"y":[{"a":2}]}', '{"a":1,"b":[{"c":1}]}', '{"a":1}\n{"a":2}\n', "5", "not json", "", None]
    rows = R.records_from_texts(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append(json.loads(r.record))
    assert got == {0: [{"a": 1}, {"value": 2}], 1: [{"a": 1}, {"a": 2}], 2: [{"a": 1, "b": [{"c": 1}]}], 3: [{"a": 1}, {"a": 2}], 4: [{"value": 5}], 5: [{"value": "not json"}]}
    (tmp_path / "r.jsonl").write_text('{"a":1}\n{"a":2,"b":"x"}\n')
    assert R.read_json_records(spark, f"file://{tmp_path}/r.jsonl").count() == 2
    (tmp_path / "p.json").write_text('[\n  {"a": 1,\n   "b": "x"},\n  {"a": 2}\n]')
    (tmp_path / "w.json").write_text('{"r": [{"a": 3}],\n "s": [{"a": 4}]}')
    got = [sorted(map(tuple, R.read_table(spark, f"file://{tmp_path}/{n}.json").select("a").collect())) for n in "pw"]
    assert got == [[(1,), (2,)], [(3,), (4,)]]
    assert sorted(map(tuple, R.read_json_records(spark, f"file://{tmp_path}/p.json", "a long, b string", lines=False).collect()), key=str) == [(1, "x"), (2, None)]


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t> name </t></si><si><t>x</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>w</t></is></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c><c r="D2"><v>1.5</v></c></row><row><c r="A3"><v>8</v></c></row></sheetData></worksheet>')
    df = R.workbook_table(R.read_workbooks(spark, f"file://{tmp_path}/b.xlsx"))
    assert sorted(tuple(r) for r in df.select("id", "name", "w").collect()) == [(7, "x", 1.5), (8, None, None)]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "w": "double"}


def test_pdf_needs_its_package(spark):
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pypdf"):
            R.read_pdf_texts(spark, "file:///tmp")


def test_streamed_profile(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "user_id", "event_type", "IF(value < 10, NULL, value) AS value", "7 AS same")
    events.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    L.profile_stream(stream, f"file://{tmp_path}/state", f"file://{tmp_path}/ck").awaitTermination()
    got = {r.column: r for r in L.profile_so_far(spark, f"file://{tmp_path}/state").collect()}
    values = sorted(r.value for r in events.where("value IS NOT NULL").collect())
    v, n = got["value"], len(values)
    assert (v.rows, v.missing, v.min, v.max) == (events.count(), events.count() - n, values[0], values[-1])
    assert math.isclose(v.mean, sum(values) / n, rel_tol=1e-6)
    assert abs(sum(x < v.median for x in values) / n - 0.5) < 0.03
    assert got["same"].is_constant and not got["value"].is_constant and got["event_type"].q1 is None
    query = L.duplicates_so_far(stream.select("event_type", "same")).writeStream.outputMode("complete").format("memory").queryName("dups").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck2").start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) - count(*) FROM dups").first()[0] == events.count() - events.select("event_type").distinct().count()
    timed = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"file://{tmp_path}/none*")
    assert L.windowed_profile(timed, "ts", "value", "event_type").isStreaming


def test_digest_of_a_table(spark):
    found = P.digest(spark.read.parquet(f"{DATA}/customer.parquet"), "c_custkey")
    profile, summary = found["profile"], found["summary"]
    assert profile["dataset"] == {"rows": 150, "columns": 5, "duplicate_rows": 0}
    assert profile["data_types"] == {"numeric": 3, "categorical": 1, "text": 1, "datetime": 0, "boolean": 0}
    assert summary["title"].endswith("table of 150 rows by 5 columns") and "3 numeric, 1 text, 1 categorical" in summary["executive_summary"]
    assert "None of its 150 rows repeats" in summary["executive_summary"] and any("c_acctbal (mean" in x for x in summary["key_findings"])
    assert len(profile["sample"]) == 15 and summary["calculated_metrics"]["row_count"] == 150
    empty = P.digest(spark.createDataFrame([], "a int, b string"))
    assert empty["profile"]["dataset"]["rows"] == 0


def test_jobs(spark):
    jobs = P.Jobs(spark)
    ids = [jobs.submit(lambda: spark.range(10).count()), jobs.submit(lambda: 1 / 0)]
    jobs.pool.shutdown(wait=True)
    assert [jobs.get(i).status for i in ids] == ["done", "failed"] and jobs.get(ids[0]).result == 10
    assert jobs.counts() == {"done": 1, "failed": 1} and jobs.get("none") is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_oracle(spark, duck, tmp_path, name):
    plans.QUERIES[name](spark, DATA).write.parquet(f"file://{tmp_path}/q")
    duck.execute(f"CREATE OR REPLACE TABLE g AS SELECT * FROM '{tmp_path}/q/*.parquet'")
    if name not in plans.ORACLES:
        assert duck.execute("SELECT count(*) FROM g").fetchone()[0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TABLE o AS {plans.ORACLES[name]}")
    names = sorted(r[0] for r in duck.execute("DESCRIBE g").fetchall())
    assert names == sorted(r[0] for r in duck.execute("DESCRIBE o").fetchall())
    cols = ", ".join(f'"{n}"' for n in names)
    assert duck.execute(f"(SELECT {cols} FROM g EXCEPT ALL SELECT {cols} FROM o) UNION ALL (SELECT {cols} FROM o EXCEPT ALL SELECT {cols} FROM g)").fetchall() == []
