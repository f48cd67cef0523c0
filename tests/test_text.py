"""Documents, routing, nested JSON, claims: literal fixtures and brute force."""

import json
import math
import random
import re
import statistics

from pyspark.sql import functions as F

from siftmill.functions import claims as K
from siftmill.functions import text as T
from siftmill.functions.numbers import round_binary
from siftmill.operators import documents as D
from siftmill.operators import guard as G
from siftmill.operators import nested as N
from siftmill.operators import replies as P
from siftmill.operators import reports as E
from siftmill.operators import samples as S
from siftmill.operators import semantics as M
from siftmill.plans.steps import Steps
from siftmill.sources import payloads as Y
from siftmill.sources import router as R


def docs(spark, texts):
    return D.cleaned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_structure_fixtures(spark):
    fenced = "# T\n\n## A\nx y\n```\n# in code\n```\n| a | b |"
    plain = "Hello world\nINTRO\nPage 3"
    df = docs(spark, [fenced, plain, "", "just one line", None, "﻿x\r\ny\rz"])
    got = {r.doc_id: r for r in D.document_metrics(df).collect()}
    assert (got[0].title, got[0].section_count, got[0].code_block_count, got[0].table_count) == ("T", 2, 1, 1)
    assert (got[1].title, got[1].section_count, got[1].word_count) == ("Hello world", 1, 3)
    assert (got[2].title, got[2].word_count, got[2].paragraph_count, got[2].section_count) == ("Untitled document", 0, 0, 1)
    assert got[5].char_count == 5 and 4 not in got
    sections = {(r.doc_id, r.section): r for r in D.document_sections(df).collect()}
    assert [sections[0, i].heading for i in (1, 2)] == ["A", "in code"]
    assert (sections[1, 1].heading, sections[1, 1].level, sections[1, 1].text) == ("INTRO", 3, "INTRO")
    assert (sections[2, 1].heading, sections[3, 1].heading, sections[3, 1].level) == ("Document", "just one line", 1)


def brute_structure(text):
    """(title, [(heading, level, line)]) by a walk over the lines."""
    lines = ["" if re.match(T.PAGE_MARKER, x) else x for x in text.split("\n")]
    code, blank, title, found = False, True, None, []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if line.startswith("```"):
            code = not code
            continue
        head = re.match(T.HEADING, line)
        letters = [c for c in line if c.isalpha()]
        looks = 2 <= len(line) <= 90 and not (line.endswith(".") and len(line.split()) > 6) and (re.match(T.LIST_HEAD, line) or letters and sum(c.isupper() for c in letters) >= 0.8 * len(letters))
        here = (head[2].strip(), len(head[1])) if head else (line, 3) if not code and not blank and looks else None
        if title is None and (here or line and i < 3):
            title = here[0] if here else line[:120]
        elif here:
            found.append((*here, i))
        blank = line == ""
    return title, found


def test_structure_equals_a_walk(spark):
    rng = random.Random(1)
    pool = ["", "  ", "```", "# Head", "## Sub  ", "INTRO", "1. list", "- item", "• dot", "| a | b |", "plain words here", "Page 2 of 9", "12", "A long UPPER line. " * 8, "x.", "#nohead", "ONE TWO THREE FOUR FIVE SIX SEVEN."]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    df = docs(spark, texts)
    titles = {r.doc_id: r.title for r in D.document_titles(D.document_lines(df)).collect()}
    got: dict = {}
    for r in D.document_lines(df).where("is_section").orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.level, r.i))
    for i, text in enumerate(texts):
        assert (titles[i], got.get(i, [])) == brute_structure(text), text


def test_chunk_fixture(spark):
    para = lambda n: " ".join(["w"] * n)
    sections = spark.createDataFrame([(1, i + 1, "H", para(n)) for i, n in enumerate((398, 298, 498, 98))], "doc_id long, section long, heading string, text string")
    assert [r.words for r in D.chunks(sections).orderBy("chunk").collect()] == [700, 600]
    assert D.chunks(sections.where("false")).collect() == []
    long = spark.createDataFrame([(1, 1, "H", para(2500))], sections.schema)
    assert [r.words for r in D.fragments(long).orderBy("at").collect()] == [802, 802, 802, 102]
    rows = D.chunks(long).orderBy("chunk").collect()
    assert [(r.chunk, r.words) for r in rows] == [(0, 802), (1, 802), (2, 904)] and rows[0].headings == ["H"]


def test_anchored_text_and_outline(spark):
    sections = spark.createDataFrame([(1, 1, "A", 2, "A\n x  y "), (1, 2, "B", 3, "B" * 30), (2, 1, "C", 1, "c" * 99)], "doc_id long, section long, heading string, level int, text string")
    got = {r.doc_id: r.anchored for r in D.anchored_texts(sections, most=20).collect()}
    assert got == {1: "## A\nA\n x  y ", 2: "c" * 20}
    assert {r.doc_id: r.outline for r in D.document_outlines(sections).collect()}[1] == "- [2] A: A x y\n- [3] B: " + "B" * 30


def test_text_functions(spark):
    assert one(spark, '<p>a</p><STYLE>x{}</style><script>var t="</p>";</script>b', T.strip_html) == " a   b"
    assert one(spark, "a < b", T.strip_html) == "a < b"
    assert [one(spark, "x" * n, T.token_estimate) for n in (0, 1, 4, 5)] == [0, 1, 1, 2] and one(spark, None, T.token_estimate) == 0
    assert one(spark, '"a,b",c,"d""e,f"', lambda c: T.outside_quotes(c, ",")) == 2
    assert one(spark, 'a,"b,c', lambda c: T.outside_quotes(c, ",")) == 1
    assert one(spark, "x" * 61, lambda c: T.clip(c, 60)) == "x" * 60 + "…"


def test_routing(spark):
    texts = ["a;b\n1;2\n3;4", '{"a": 1}', "[broken\nx", "%PDF-1.4 x", "plain words", "# head\na,b\n1,2", "﻿[1, 2]", None, "", "a\tb\n1\t2", "a,b\n1,2\n\n3,4,5\n6,7\n8,9"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(50, "a,b", "report.MD"), (51, "x", "text/csv"), (52, "x", "auto")], "doc_id long, text string, hint string")
    got = {r.doc_id: r for r in R.classified_texts(df, "doc_id", "text", "hint").collect()}
    assert (got[0].kind, got[0].format, got[0].confidence, got[0].reason) == ("tabular", "csv", 1.0, "2-column delimiter table")
    assert [got[i].format for i in range(1, 11)] == ["json", "plain-text", "pdf", "plain-text", "markdown", "json", "plain-text", "plain-text", "tsv", "csv"]
    assert (got[50].kind, got[50].format, got[51].kind, got[52].format) == ("document", "md", "tabular", "plain-text")


def test_file_contents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.bin").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "c.txt").write_bytes("﻿é".encode())
    (tmp_path / "d.txt").write_bytes(b"\xe9")
    got = {r.path[-5:]: (r.kind, r.format, r.text) for r in R.classified_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.bin": ("document", "pdf", None), "b.bin": ("tabular", "excel", None), "c.txt": (None, None, "é"), "d.txt": (None, None, "é")}


def test_flatten_fixtures(spark):
    texts = [
        '{"a":{"b":1},"t":["x","y"],"g":[[1,2],[3,4]],"e":[],"o":[{"k":1}],"m":[1,null]}',
        json.dumps({"o": [{"k": i} for i in range(5)], "s": list(range(13)), "b": True, "f": 1.5, "n": None, "mixed": [True, 1.0], "deep": {"x": {"y": [{"z": [{"w": 2}]}]}}}), "[1]", "broken{", None,
    ]
    rows = N.flatten(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").collect()
    got = {(r.id, r.path): r.value for r in rows}
    assert {p: v for (i, p), v in got.items() if i == 0} == {"a.b": "1", "t": "x, y", "g": "[grid 2x2]", "e": None, "o[0].k": "1", "m": "[nested list of 2 items]"}
    assert {p: v for (i, p), v in got.items() if i == 1} == {"o": "[nested array of 5 objects]", "s": "[list of 13 items]", "b": "True", "f": "1.5", "n": None, "mixed": "True, 1.0", "deep.x.y[0].z[0].w": "2"}
    assert {i for i, _ in got} == {0, 1}


def test_numbers_are_written_as_the_reference_writes_them(spark):
    numbers = ["-0.0", "-0.00", "0.0", "-0.05", "10000000.0", "-12345678.9", "123456789012.25", "1e15", "1.5e16", "0.0001", "0.00012345", "9.5e-05", "1e-9", "-0.0e0", "1e300", "7"]
    texts = [f'{{"n":{x}, "l":[{x},1]}}' for x in numbers]
    texts += ['{"s":"-0.0","t":"a\\\\","u":-0.0,"v":"\\":-0.0, ","w":[-0.0,0.0]}', '{"u":-0.0x}']
    got = {(r.id, r.path): r.value for r in N.flatten(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").collect()}
    for i, x in enumerate(numbers):
        assert (got[i, "n"], got[i, "l"]) == (str(json.loads(x)), f"{json.loads(x)}, 1"), x
    n = len(numbers)
    assert {p: v for (i, p), v in got.items() if i >= n} == {"s": "-0.0", "t": "a\\", "u": "-0.0", "v": '":-0.0, ', "w": "-0.0, 0.0"}


def test_ladders_of_accounts_with_negative_zero_equal_their_sql(spark, tmp_path):
    import duckdb

    from siftmill.plans import queries as plans

    con = duckdb.connect()
    for name, sql in {
        "customer": "SELECT i AS c_custkey, 'C' || i AS c_name, 'M' AS c_mktsegment, CAST(x AS DOUBLE) AS c_acctbal FROM (VALUES (1, '-0.0'), (2, '0.0'), (3, '-7.25'), (4, '12345678.5')) AS t(i, x)",
        "orders": "SELECT i AS o_orderkey, 1 + i % 4 AS o_custkey, 'F' AS o_orderstatus, 10.5 + i AS o_totalprice, TIMESTAMP '2020-01-02' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM range(12) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("report_ladder_levels", "report_ladder_fit"):
        found = plans.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({plans.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_levels_store_values_of_opened_containers_only(spark, monkeypatch):
    levels, kept = [], N.kept
    monkeypatch.setattr(N, "kept", lambda df: levels.append(kept(df)) or levels[-1])
    texts = ['{"a":{"b":1},"t":["x"],"s":[1,2,3,4,5,6,7,8,9,10,11,12,13],"w":[{},{},{},{},{}],"f":1.0,"z":[0.5,null,{}],"q":{}}', '[{"b":1}]', "7", "null"]
    monkeypatch.setattr(N, "settled", lambda spark, make, rows=0: make())
    rows = N.flatten(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j")
    assert {(r.path, r.value) for r in rows.collect()} == {("a.b", "1"), ("t", "x"), ("s", "[list of 13 items]"), ("w", "[nested array of 5 objects]"), ("f", "1.0"), ("z", "[nested list of 3 items]")}
    assert [(df.count(), df.where("v IS NOT NULL").count()) for df in levels] == [(7, 2), (1, 0)]


def test_medians_of_sections_by_one_aggregation(spark, monkeypatch):
    draw, tables = random.Random(5), {}
    for i, n in enumerate([*range(1, 40), 99, 100, 999, 1000, 2498, 2499, 2500, 2501, 6000]):
        tables[i] = [draw.choice((draw.randrange(20), draw.uniform(-1e3, 1e3))) for _ in range(n)]
    frame = spark.createDataFrame([(i, p, float(x)) for i, xs in tables.items() for p, x in enumerate(xs)], "id long, p long, x double").repartition(7)
    cells = frame.selectExpr("id", "'t' AS section", "'cell' AS kind", "p AS record", "'x' AS path", "CAST(x AS STRING) AS value", "x AS numeric")
    heads = spark.createDataFrame([(i, "t", "table", len(xs), None, None, None) for i, xs in tables.items()], "id long, section string, kind string, record long, path string, value string, numeric double")
    ranked, asked = E.C.ranked_values, []
    monkeypatch.setattr(E.C, "ranked_values", lambda values, *a, **k: asked.append(values) or ranked(values, *a, **k))
    got = {r.id: r.median for r in E.section_numbers(heads.union(cells), "id").collect()}
    assert set(got) == set(tables)
    for i, xs in tables.items():
        assert abs(got[i] - statistics.median(xs)) <= 5.1e-5, len(xs)
    assert {r.id for v in asked for r in v.select("id").distinct().collect()} == {i for i, xs in tables.items() if len(xs) >= 2500}


def test_token_fixture(spark):
    texts = ['[["BUY","W",1],["SELL","W"],["BUY"]]', '{"a": ["x", "y", "x"], "b": [1, 2]}', '[{"a": ["p"]}, {"a": ["q"]}, {"a": ["r"]}, {"a": ["s"]}]', None, json.dumps(["y" * 41])]
    rows = N.token_counts(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").collect()
    got = {(r.id, r.token): r["count"] for r in rows}
    assert got == {(0, "BUY"): 2, (0, "SELL"): 1, (1, "x"): 2, (1, "y"): 1, (2, "p"): 1, (2, "q"): 1, (2, "r"): 1}


def test_reports(spark):
    report = {"title": "Q1", "info": {"description": "All is well.", "tags": ["a", "b"]}, "issues": ["i1", "i1", "i2"], "items": [{"s": "open", "n": 1}, {"s": "done", "n": 4}, {"s": "open", "n": 7, "g": [[1]]}], "conf": {"steps": 5, "deep": {}}}
    df = spark.createDataFrame([(1, json.dumps(report)), (2, "{}"), (3, "[]")], "id long, j string")
    rows = N.report_rows(df, "id", "j")
    sections = {r.section: (r.kind, r["count"], r.columns) for r in N.report_sections(rows, "id").collect()}
    assert sections == {"info": ("object", 1, 0), "issues": ("list", 3, 0), "items": ("table", 3, 2), "conf": ("object", 1, 0)}
    values = {(r.section, r.path, r.value): r["count"] for r in N.report_values(rows, "id").collect()}
    assert values[("issues", None, "i1")] == 2 and values[("items", "s", "open")] == 2
    n = E.section_numbers(rows, "id").first()
    assert (n.path, n.min, n.max, n.mean, n.median) == ("n", 1.0, 7.0, 4.0, 4.0)
    words = E.report_summaries(rows, "id").first()
    assert words.title == "Report: Q1" and words.executive_summary == "All is well. It is made up of 1 object in conf, 1 object in info, 3 entries in issues, 3 records in items."
    assert words.key_findings == ["issues lists i1 ×2, i2 ×1.", "items measures n from 1.0 to 7.0 around 4.0."]
    assert words.recommendations == ["Settle what issues names: 3 in all."] and words.calculated_metrics["columns.items"] == "2" and words.fields == 4
    reports = df.where(N.is_nested_report(F.try_parse_json("j"))).collect()
    assert [r.id for r in reports] == [1]


def test_rules_for_names_are_not_asked_of_cells(spark):
    """A filter by what names mean stays above the names: pushed down, it would hold all rules against each cell."""
    report = {"issues": ["x"], "items": [{"email": "a", "s": "b"}, {"email": "b", "s": "b"}], "more": [{"email": "c", "salary": 1}]}
    rows = N.report_rows(spark.createDataFrame([(1, json.dumps(report)), (2, json.dumps(report))], "id long, j string"), "id", "j")
    found = E.report_statements(rows, "id").where("section IN ('items', 'more')")
    assert "(employee|worker" not in found._jdf.queryExecution().optimizedPlan().toString()
    said = sorted((r.id, r.text) for r in found.where("text LIKE '% holds %'").collect())
    wanted = ["items holds email as contact / email details.", "more holds email as contact / email details, salary as salary / compensation."]
    assert said == [(i, t) for i in (1, 2) for t in wanted]


def test_profiles_of_report_sections(spark):
    """Several reports at once: caps, ties, absent and null cells, empty reports and none."""
    rng = random.Random(6)
    reports = {}
    for i in range(12):
        items = [{**{f"c{c}": rng.choice(["a", "b", None]) for c in range(7)}, **{f"n{c}": rng.randrange(50) * (c + 1) for c in range(8)}, "long": "x" * 70, "one": f"u{k}"} for k in range(rng.randrange(4, 30))]
        for item in items[::3]:
            item.pop("c1"), item.pop("n1")
        reports[i] = {"items": items, "plain": rng.randrange(9)}
    rows = [(i, json.dumps(r)) for i, r in reports.items()] + [(50, "{}"), (51, None), (52, "[1]"), (53, '{"items": []}')]
    cells = N.report_rows(spark.createDataFrame(rows, "id long, j string").repartition(3), "id", "j")
    columns = {(r.id, r.path): r for r in E.section_columns(cells, "id").collect()}
    numbers = {(r.id, r.path): r for r in E.section_numbers(cells, "id", most=None).collect()}
    top = {(r.id, r.path): r["rank"] for r in E.section_numbers(cells, "id").collect()}
    found = {}
    for r in E.section_categories(cells, "id").collect():
        found.setdefault((r.id, r.path), []).append((r["rank"], r.value, r["count"]))
    for i, report in reports.items():
        items = report["items"]
        for name in ("c0", "c1", "n0", "n1", "long", "one"):
            values = [x.get(name) for x in items]
            held = [v for v in values if v is not None]
            got = columns[i, name]
            assert (got.records, got.filled, got.distinct) == (len(items), len(held), len(set(values)))
            if name[0] == "n":
                n = numbers[i, name]
                assert (n.min, n.max, n.median) == (min(held), max(held), statistics.median(held)) and math.isclose(n.mean, statistics.mean(held), abs_tol=1e-4)
            assert got.bucket == ("numeric" if name[0] == "n" else "text" if name == "long" or len(set(values)) > len(items) / 2 else "categorical")
        assert sorted(r for (j, _), r in top.items() if j == i) == list(range(1, 7))
        wanted = sorted((p for (j, p), c in columns.items() if j == i and c.bucket == "categorical" and c.filled), key=lambda p: (-len({x.get(p) for x in items} - {None}), p))[:5]
        assert sorted(p for j, p in found if j == i) == sorted(wanted)
        for p in wanted:
            counts = sorted(((v, sum(x.get(p) == v for x in items)) for v in {x.get(p) for x in items} - {None}), key=lambda c: (-c[1], c[0]))
            assert sorted(found[i, p]) == [(k + 1, v, n) for k, (v, n) in enumerate(counts)]
    assert {i for i, _ in columns} == set(reports)
    empty = N.report_rows(spark.createDataFrame([], "id long, j string"), "id", "j")
    assert E.section_columns(empty, "id").collect() == E.section_categories(empty, "id").collect() == E.section_numbers(empty, "id").collect() == E.report_summaries(empty, "id").collect() == []


def test_files_of_report_rows_are_bounded(spark, monkeypatch):
    """What a task reads of the rows, and gathers in memory, doesn't grow with the table."""
    monkeypatch.setattr(N, "FILE_ROWS", 20, raising=False)
    report = json.dumps({"items": [{"s": "open", "n": k} for k in range(90)]})
    rows = N.report_rows(spark.createDataFrame([(1, report)], "id long, j string"), "id", "j")
    assert max(r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()) <= 20
    assert rows.where("kind = 'cell'").count() == 180


def test_one_table_of_mixed_payloads(spark):
    texts = ['{"a":1,"b":{"c d":2.5,"e":[1,2]},"x.y":true}', '{"a":"t","b":{"c d":3},"z":null}', "12", '{"m":[{"q":1}],"value":3,"`b`":1}', "nope", None, '[{"a":7},5,null]', '{"x":{"y":2}}', '{"b":{"e":[]}}', "null", '[]', json.dumps({"b": {"e": list(range(13))}})]
    df = spark.createDataFrame([(t, "kept out") for t in texts], "j string, a string").repartition(3)
    table = Y.merged_table(df, "j")
    kinds = dict(table.dtypes)
    assert (kinds["a"], kinds["b.c d"], kinds["b.e"], kinds["value"], kinds["`b`"], kinds["z"]) == ("string", "double", "string", "string", "bigint", "string")
    assert {kinds["x.y"], kinds["x.y_2"]} == {"bigint", "boolean"}
    rows = [r.asDict() for r in table.collect()]
    assert len(rows) == 10 and sorted(r["a"] for r in rows if r["a"]) == ["1", "7", "t"] and sorted(r["value"] for r in rows if r["value"]) == ["12", "3", "5", "nope"]
    assert sorted(r["b.e"] for r in rows if r["b.e"]) == ["1, 2", "[list of 13 items]"] and [r["m"] for r in rows if r["m"]] == ["[nested array of 1 objects]"]
    assert Y.merged_table(df.where("j IN ('12', 'nope')"), "j").columns == ["value"]
    assert Y.merged_table(df.where("false"), "j").collect() == [] and Y.merged_table(df.where("false"), "j").columns == ["value"]


def test_texts_of_bytes(spark):
    texts = ["plain", "é ü", "日本 😀", "", "\ufeff twice"]
    rows = [(i, mark + t.encode(encoding), t, name) for i, t in enumerate(texts) for mark, encoding, name in ((b"\xef\xbb\xbf", "utf-8", "UTF-8"), (b"\xff\xfe", "utf-16-le", "UTF-16LE"), (b"\xfe\xff", "utf-16-be", "UTF-16BE"))]
    rows += [(9, "naïve café".encode("latin-1"), "naïve café", "ISO-8859-1"), (10, "naïve".encode(), "naïve", "UTF-8"), (11, b"", "", "UTF-8"), (12, None, None, None)]
    df = spark.createDataFrame(rows, "id int, content binary, text string, name string")
    for r in df.select("text", "name", Y.text_of(F.col("content")).alias("t"), Y.encoding_of(F.col("content")).alias("e"), Y.from_base64(F.base64("content")).alias("back"), "content").collect():
        assert (r.t, r.e) == (r.text, r.name) and r.back == r.content
    assert one(spark, "aGk =\n", lambda c: Y.text_of(Y.from_base64(c))) == "hi" and one(spark, "no base64!", Y.from_base64) is None


def test_steps_see_what_runs(spark):
    steps, df = Steps(), spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, b string")
    with steps.step("one") as watch:
        assert watch("df", df).where("a > 1").count() == 2
        watch("never used", df)
        assert watch("none", df.where("false")).count() == 0
    try:
        with steps.step("two"):
            raise KeyError("x")
    except KeyError:
        pass
    with steps.step("three"):
        pass
    rows = steps.table(spark).collect()
    assert {(r.label, r.frame, r.column, r.rows, r.missing) for r in rows if r.frame == "df"} == {("one", "df", "a", 3, 0), ("one", "df", "b", 3, 2)}
    assert "never used" not in {r.frame for r in rows} and [(r.label, r.failed) for r in rows if r.label != "one"] == [("two", True), ("three", False)]
    assert all(r.milliseconds >= 0 for r in rows)


def test_echoed_schemas_are_unwrapped(spark):
    cases = {
        '{"title": "Sales", "type": "string"}': "Sales", '{"$ref": "x", "label": "L", "title": "T"}': "T", '{"type": "t", "value": 5, "title": "no"}': "5", '{"type": "t", "value": {"a": 1}, "default": "D"}': "D",
        '{"type": "only"}': '{"type": "only"}', '{"title": "kept"}': '{"title": "kept"}', "plain {type}": "plain {type}", "{broken": "{broken", None: None,
    }
    for value, expected in cases.items():
        assert one(spark, value, P.unwrapped) == expected, value
    replies = ['{"title": {"title": "A", "type": "string"}, "executive_summary": "s", "key_findings": [{"type": "x", "value": "f"}, "g"]}', '{"title": "A", "executive_summary": "s"}', '{"title": ["A"], "executive_summary": "s"}', "no json"]
    got = {r.id: r for r in P.parsed_replies(spark.createDataFrame(list(enumerate(replies)), "id long, t string"), "id", "t").collect()}
    assert [got[i].strict for i in range(4)] == [False, True, False, False] and (got[0].title, got[0].key_findings) == ("A", ["f", "g"]) and got[3].title == "Data Summary"


def test_replies_about_documents(spark):
    df = docs(spark, ["# Plan\nUse Spark 4.\n\n## Risks\nNone.", "just words", "", "more words"])
    replies = {
        0: json.dumps({"title": None, "summary": {"overview": 5, "key_findings": ["k", {"no": 1}, 7]}, "evidence": [{"finding": "f", "source_section": "risk"}, {"finding": "g", "source_section": "Budget"}, {"finding": None, "source_section": "Plan"}, "text", {}],
                       "important_numbers": ["4 nodes", "none", 12], "technologies": ["spark", "Kafka", "S4"]}),
        1: "no object", 2: '{"summary": null}',
    }
    got = {r.doc_id: r for r in P.guarded_documents(spark.createDataFrame(list(replies.items()), "doc_id long, reply string"), df, "doc_id", "reply").collect()}
    assert [got[i].status for i in range(4)] == ["parsed", "digest", "parsed", "digest"]
    one_ = got[0]
    assert (one_.title, one_.overview, one_.key_findings, one_.important_numbers, one_.technologies) == ("Plan", None, ["k", "7"], ["4 nodes", "12"], ["spark"])
    assert [(e.finding, e.source_section) for e in one_.evidence] == [("f", "risk")]
    assert got[1].overview.startswith("just words: 2 words") and got[2].overview is None and got[3].evidence == []
    assert P.guarded_documents(spark.createDataFrame([], "doc_id long, reply string"), df.where("false"), "doc_id", "reply").collect() == []


def test_claim_fixture(spark):
    text = "up 1,234.5 and 60% of 5 men, 2 million v1.2, 7 thousand, 2024-01-05, 3 bananas"
    got = [(c.value, c.suffix) for c in one(spark, text, K.claims)]
    assert got == [(1234.5, ""), (60.0, ""), (5e6, "M"), (2e6, "M"), (7000.0, "THOUSAND"), (2024.0, ""), (1.0, ""), (5.0, ""), (3e9, "B")]
    assert one(spark, "no numbers", K.claims) == [] and one(spark, None, K.claims) is None
    variants = spark.sql("SELECT 0.84D AS f").select(K.fact_variants(F.col("f")).alias("v")).first().v
    assert {0.84, 0.8, 1.0, 84.0} <= set(variants)
    assert spark.sql("SELECT double('nan') AS f").select(K.fact_variants(F.col("f")).alias("v")).first().v == []


def test_verification_equals_a_product(spark):
    rng = random.Random(2)
    facts = [0.0, 5.0, -3.25, 1e6, 123456.0, 0.001, 999.9995, -1e9] + [rng.uniform(-50, 50) for _ in range(40)]
    claims = [(i, rng.choice(facts) + rng.choice([0, 0.0009, -0.0011, 0.002, 5]) if s == "" else rng.choice(facts) * rng.choice([1, 1.019, 0.981, 1.03]), s) for i, s in enumerate(rng.choices(["", "K", "MILLION"], k=400))]
    df = spark.createDataFrame(claims, "id long, value double, suffix string")
    got = {r.id: r.verified for r in G.verified_claims(df, spark.createDataFrame([(f,) for f in facts], "fact double")).collect()}
    assert got == {i: any(abs(v - f) <= (0.02 * abs(f) if s else 1e-3) for f in facts) for i, v, s in claims}
    assert not any(r.verified for r in G.verified_claims(df, spark.createDataFrame([], "fact double")).collect())


def test_verification_reads_its_facts_once(spark):
    """Facts may come from a whole table."""
    found = spark.createDataFrame([(1, 2.0, ""), (2, 9.0, "")], "id long, value double, suffix string")
    checked = G.verified_claims(found, spark.range(5).selectExpr("CAST(id AS DOUBLE) AS fact"))
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r.id: r.verified for r in checked.collect()} == {1: True, 2: False}


def test_digests_of_reports_by_level(spark):
    """Every limit of the ladder, held against a plain count of pieces; digests keep to their budget."""
    report = {f"s{i}": [{"c1": rng_value % 2 and "a" or "b", "c2": f"v{rng_value % 3}", "n": rng_value, "m": rng_value * 2} for rng_value in range(9)] for i in range(8)}
    report |= {f"f{i:02}": f"value {i}" for i in range(25)} | {"title": "T", "name": "N", "description": "D" * 300, "l": [f"i{k % 10}" for k in range(40)], "o": {f"k{k:02}": k for k in range(12)}}
    rows = N.report_rows(spark.createDataFrame([(1, json.dumps(report)), (2, '{"title": "only"}')], "id long, j string"), "id", "j")
    pieces = E.digest_pieces(rows, "id")
    held = [tuple(r) for r in pieces.collect()]
    got = {(r.id, r.level): (r.pieces, r.chars, r.tokens) for r in E.digest_levels(pieces, "id").collect()}
    for i in (1, 2):
        for level in range(6):
            cap = {k: v[level] if v[level] is not None else 10**9 for k, v in E.LADDER.items()}
            left = []
            for _, facet, section, place, rank, text in (p for p in held if p[0] == i):
                limit = {"sections": 10**9, "summary_chars": 10**9}.get(facet, cap.get(facet))
                if section <= cap["sections"] and place <= limit and (facet != "columns" or rank <= cap["values"]):
                    left.append(text[: cap["summary_chars"]] if facet == "summary_chars" else text)
            left = [x for x in left if x]
            assert got[i, level] == (len(left), sum(map(len, left)), -(-sum(map(len, left)) // 4))
    order = [p[5].split(":")[0] for p in sorted((p for p in held if p[0] == 1 and p[1] == "fields"), key=lambda p: p[3])]
    assert order[:4] == ["title", "description", "name", "f00"]
    for budget in (10_000, 200, 60, 1):
        for r in E.fitted_digests(pieces, "id", budget).collect():
            first = next((level for level in range(6) if got[r.id, level][2] <= budget), 5)
            assert (r.level, r.tokens) == (first, got[r.id, first][2]) and len(r.digest.replace("\n", "")) == got[r.id, first][1]
    assert E.digest_levels(pieces.where("false"), "id").collect() == []


def test_rounding_by_the_binary_value(spark):
    rng = random.Random(8)
    xs = [2.675, 1.005, 0.5, 1.5, 2.5, -2.5, 4.35, 0.285, 1e-9, 0.00005, 0.00015, 1e15 + 0.3, 9007199254740993.0, 1e22, 0.0, 6e14 + 0.125, 0.99995, 1023.9999999999999, None, float("inf"), float("nan")]
    xs += [round(rng.uniform(-1000, 1000), rng.randrange(1, 6)) for _ in range(500)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 17) for _ in range(500)]
    xs += [(rng.randrange(10**6) + 0.5) / 10 ** rng.randrange(5) for _ in range(500)] + [2.0**e * f for e in range(-20, 60) for f in (1, 1 - 2**-53)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_binary(F.col("x"), 0, 1, 2, 3, 4).alias("r")).collect()
    for r in rows:
        if r.x is None or not math.isfinite(r.x):
            assert all(v == r.x or v != v for v in r.r)
        else:
            assert r.r == [round(r.x, d) for d in range(5)], r.x


def test_facts_of_digests_and_their_claims(spark):
    texts = {1: '{"rows": 1500, "share": 0.25, "x": [{"y": "12 of 30k"}, true, null, [7, [2.675]]]}', 2: '{"a": "none", "b": {}}', 3: '{"n": 2}', 4: None, 5: "broken{"}
    values = N.parsed(spark.createDataFrame(list(texts.items()), "id long, j string"), "id", "j")
    facts = G.digest_facts(values, "id")
    held = {}
    for r in facts.collect():
        held.setdefault(r.id, set()).add(r.fact)
    assert held.keys() == {1, 3} and {1500.0, 1.5, 0.25, 25.0, 12.0, 30000.0, 30.0, 7.0, 2.67, 2.675} <= held[1] and held[3] == {2.0, 2e-3, 2e-6, 2e-9} and 1.0 not in held[1]
    claims = spark.createDataFrame([(1, 12.0, ""), (3, 12.0, ""), (3, 2.0, ""), (3, 2.0, ""), (1, 1510.0, "K"), (3, 1510.0, "K"), (None, 2.0, ""), (9, 2.0, "")], "id long, value double, suffix string")
    got = [(r.id, r.value, r.verified) for r in G.verified_claims(claims, facts, "id").collect()]
    assert sorted(got, key=str) == sorted([(1, 12.0, True), (3, 12.0, False), (3, 2.0, True), (3, 2.0, True), (1, 1510.0, True), (3, 1510.0, False), (None, 2.0, False), (9, 2.0, False)], key=str)
    assert G.digest_facts(values.where("false"), "id").collect() == []


def test_guarded_summaries(spark):
    kind = "id long, title string, executive_summary string, key_findings array<string>, calculated_metrics map<string, string>, anomalies_detected array<string>, recommendations array<string>"
    summaries = spark.createDataFrame([
        (1, "Report of 1,500", "It has 1.5K rows. It has 99 rows. Fine!", ["a 25% share", "b 77", None], {"rows": "1500", "bad": "3.3", "note": "n/a"}, None, ["do 7"]),
        (2, "T 5", "x 5", ["y 6"], {}, [], []), (3, "All 9 wrong", "It is 8.", ["2 ok"], {}, [], []), (4, "No numbers", "none", ["x"], {"k": "v"}, [], []),
        (5, "Wrong 8 here", "A 2 and a 2. Also 2.", ["x" * 90 + " 9", "2"], {}, ["9"] * 12, ["2", "2", "2", "2", "2", "2", "2", "2", "2", "2"]), (6, None, None, None, None, None, None), (None, "T 1", "x 1", [], {}, [], []),
        (7, "Two 2", "Only 9.", ["2"], {}, [], []),
    ], kind)
    facts = spark.createDataFrame([(1, 1500.0), (1, 1.5), (1, 25.0), (1, 7.0), (3, 2.0), (4, 1.0), (5, 2.0), (6, 1.0), (7, 2.0)], "id long, fact double")
    anchors = spark.createDataFrame([(3, "Anchor", "A", ["f"], {"m": "1"}, [], ["r"])], kind)
    got = {r.id: r for r in G.guarded_summaries(summaries, facts, anchors, "id").collect()}
    assert len(got) == 8 and {i: r.status for i, r in got.items()} == {1: "guarded", 2: "skipped", 3: "fallback", 4: "pass", 5: "guarded", 6: "pass", 7: "fallback", None: "skipped"}
    one = got[1]
    assert (one.title, one.executive_summary, one.key_findings, one.calculated_metrics, one.recommendations) == ("Report of 1,500", "It has 1.5K rows. Fine!", ["a 25% share"], {"rows": "1500", "note": "n/a"}, ["do 7"])
    assert (one.claims_found, one.claims_verified, one.claims_dropped) == (8, 5, 3)
    assert one.dropped == ["executive_summary: It has 99 rows.", "key_findings: b 77", "calculated_metrics.bad: 3.3"]
    assert (got[2].title, got[2].executive_summary, got[2].key_findings, got[2].dropped) == ("T 5", "x 5", ["y 6"], [])
    assert (got[3].title, got[3].executive_summary, got[3].key_findings, got[3].calculated_metrics, got[3].recommendations) == ("Anchor", "A", ["f"], {"m": "1"}, ["r"])
    assert got[4].calculated_metrics == {"k": "v"} and got[4].key_findings == ["x"]
    assert got[5].title == "General summary" and got[5].key_findings == ["2"] and got[5].anomalies_detected == [] and len(got[5].dropped) == 8
    assert got[5].dropped[:3] == ["title: Wrong 8 here", "key_findings: " + "x" * 80, "anomalies_detected: 9"]
    assert (got[7].title, got[7].key_findings) == (None, None)  # no anchor for it
    assert G.guarded_summaries(summaries.where("false"), facts, anchors, "id").collect() == []
    assert {r.status for r in G.guarded_summaries(summaries, facts.where("false"), anchors, "id").collect()} == {"skipped"}


def test_guarded_texts(spark):
    facts = G.variants(spark.createDataFrame([(1500.0,), (0.25,)], "value double"))
    texts = {1: "We saw 1.5K rows. A share of 25%. And 77 ghosts!", 2: "No numbers here.", 3: "Only 99 lies. And 98 more.", 4: "It is 1500. Or 2."}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r for r in G.guarded_texts(df, facts, "id", "text").collect()}
    assert (got[1].text, got[1].status, got[1].claims_found, got[1].claims_verified) == ("We saw 1.5K rows. A share of 25%.", "guarded", 3, 2)
    assert (got[2].status, got[3].status, got[3].text, got[4].status) == ("pass", "fallback", "", "guarded")
    assert {r.status for r in G.guarded_texts(df, facts.where("false"), "id", "text").collect()} == {"skipped"}
    items = G.guarded_items(df, facts, "id").collect()
    assert {r.id: r.kept for r in items} == {1: False, 2: True, 3: False, 4: False}


def test_ladder(spark):
    rows = [(1, "values", r, "x" * 100) for r in range(1, 9)] + [(1, "other", 1, "y" * 40)]
    sizes = G.ladder_sizes(spark.createDataFrame(rows, "id long, facet string, rank int, text string"), "id")
    assert {r.level: r.chars for r in sizes.collect()} == {0: 840, 1: 440, 2: 340, 3: 240, 4: 140, 5: 140}
    assert G.fitted_level(sizes, "id", 90).first().level == 2
    assert G.fitted_level(sizes, "id", 1).first().level == 5
    assert (G.input_budget(), G.input_budget(10)) == (1548, 256)


def test_semantics(spark):
    names = lambda xs: spark.createDataFrame(list(enumerate(xs)), "position int, column string")
    kind = lambda xs: M.dataset_kind(names(xs)).first().kind
    assert kind(["employee", "dept"]) == "employee / workforce" and kind(["x", "y"]) == "general / tabular"
    assert kind(["salary_x", "company"]) == "financial / accounting" and kind(["full_name", "city"]) == "people / contact"
    assert kind(["device", "sensor", "voltage"]) == "IoT / device telemetry"
    weak = M.domain(names(["sensor_a"])).first()
    assert (weak.label, float(weak.confidence), weak.evidence) == ("Unknown", 0.25, ["sensor_a (→ sensor)"])
    none = M.domain(names(["zzz"])).first()
    assert (none.label, none.score, none.evidence) == ("Unknown", 0, [])
    assert {r.column: r.role for r in M.column_roles(names(["first_name", "Email", "weird"])).collect()} == {"first_name": "person_name", "Email": "contact", "weird": "unknown"}


def test_samples(spark):
    df = spark.range(100).selectExpr("id AS k", "repeat('z', 70) AS s")
    assert [r.k for r in S.first_rows(df, "k").collect()] == [0, 1, 2, 3, 4]
    assert [r.k for r in S.last_rows(df, "k").collect()] == [99, 98, 97, 96, 95]
    assert S.random_rows(df.repartition(5), "k").collect() == S.random_rows(df, "k").collect()
    sample = S.representative_sample(df.limit(3), "k").collect()
    assert len(sample) == 9 and all("…" in r.row for r in sample)


def test_replies(spark):
    texts = ['x ```json\n{"title": "T", "executive_summary": "S", "key_findings": ["a", "b"], "calculated_metrics": {"n": 1}}\n``` y', '{"title": "only"}', "no JSON " * 100, "{broken", None, ""]
    rows = {r.id: r for r in P.parsed_replies(spark.createDataFrame(list(enumerate(texts)), "id long, reply string"), "id", "reply").collect()}
    assert (rows[0].strict, rows[0].title, rows[0].key_findings, rows[0].calculated_metrics, rows[0].recommendations) == (True, "T", ["a", "b"], {"n": "1"}, [])
    assert (rows[1].strict, rows[1].title) == (False, "only") and len(rows[2].executive_summary) == 500
    assert [rows[i].title for i in (2, 3, 4, 5)] == ["Data Summary"] * 4 and rows[4].executive_summary == ""


def test_evidence(spark):
    df = spark.sql("SELECT array('intro', 'Methods', 'zzz', '') AS s, array('Introduction', 'METHOD') AS h, array('5 users', 'many') AS n, array('Spark', 'R', 'Hive') AS t, 'we use spark and r' AS x")
    r = df.select(P.supported(F.col("s"), F.col("h")).alias("s"), P.with_digits(F.col("n")).alias("n"), P.mentioned(F.col("t"), F.col("x")).alias("t")).first()
    assert (r.s, r.n, r.t) == (["intro", "Methods"], ["5 users"], ["Spark"])
