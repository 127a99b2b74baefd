"""Files and databases: round trips, number text, upserts over JDBC (an embedded database), tasks that time out."""

import http.server
import json
import threading
import time
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.document import from_text
from millrace.plans.runner import Runner, StageFailed
from millrace.sources import files, jdbc


def document(stages: list[dict], connections: dict | None = None):
    return from_text(json.dumps({"pipeline": stages} | ({"connections": connections} if connections else {})), name="x.json")


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 0.1, 0.1, "a,b"), (2, 1e20, 1e20, 'q"q'), (3, 5.0, -0.0, "l\nm"), (4, float("nan"), 2.5, ""), (5, float("inf"), None, "é"), (6, None, 1.0, None), (7, 1e-7, 1 / 3, "x")], "id long, d double, f float, s string")


def test_csv_text_of_numbers_and_fields(spark, numbers, tmp_path):
    path = str(tmp_path / "n.csv")
    assert files.write_csv(numbers.orderBy("id").coalesce(1), path) == 7
    lines = open(path, encoding="utf-8").read()
    assert lines == 'id,d,f,s\n1,0.10000000000000001,0.100000001,"a,b"\n2,1e+20,1.00000002e+20,"q""q"\n3,5,-0,"l\nm"\n4,nan,2.5,\n5,inf,,é\n6,,1,\n7,9.9999999999999995e-08,0.333333343,x\n'


def test_csv_round_trip(spark, tmp_path):
    path, df = str(tmp_path / "r.csv"), spark.createDataFrame([(1, 0.1, "a;b"), (2, 1 / 3, "ü"), (-3, 1e300, 'x"\ny')], "id long, d double, s string")
    files.write_csv(df, path, ";", True, "1252")
    got = files.read_csv(spark, path, [{"name": "id", "type": "int64"}, {"name": "d", "type": "float64"}, {"name": "s"}], ";", True, "1252")
    assert sorted(got.collect()) == sorted(df.collect())
    assert [r.s for r in files.read_csv(spark, path, [{"name": "a"}, {"name": "d"}, {"name": "s"}], ";", False, "1252").collect()][0] == "s"
    with pytest.raises(Exception, match="malformed row"):
        files.read_csv(spark, path, [{"name": "id"}, {"name": "s"}], ";", True, "1252").collect()
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        files.read_csv(spark, path, [{"name": "id", "type": "int64"}, {"name": "d", "type": "int64"}, {"name": "s"}], ";", True, "1252").collect()


@pytest.mark.parametrize("form", ["ndjson", "array"])
def test_json_round_trip(spark, numbers, tmp_path, form):
    path = str(tmp_path / "n.json")
    assert files.write_json(numbers.orderBy("id").coalesce(1), path, form) == 7
    text = open(path, encoding="utf-8").read()
    assert '{"id":1,"d":0.10000000000000001,"f":0.100000001,"s":"a,b"}' in text and '{"id":4,"d":null,"f":2.5,"s":""}' in text
    assert [json.loads(x)["id"] for x in text.splitlines()] == list(range(1, 8)) if form == "ndjson" else [x["id"] for x in json.loads(text)] == list(range(1, 8))
    got = {r.id: r for r in files.read_json(spark, path, ["id", "d", "s", "gone"], form).collect()}
    assert got["1"].d == "0.10000000000000001" and got["3"].d == "5" and got["2"].d == "1e+20" and got["5"].d is None and got["2"].s == 'q"q' and got["6"].s is None and got["1"].gone is None


def test_json_cells(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": true, "b": {"x": [1, 2]}, "c": 9007199254740993}\n\n{"a": null, "b": "t"}\n')
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "c.json"), ["a", "b", "c"]).collect()] == [("true", '{"x":[1,2]}', "9007199254740992"), (None, "t", None)]


def test_xlsx_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", 2.5), (2, None, -1.0), (3, "<x>", 0.1)], "id long, s string, d double")
    files.write_xlsx(df.orderBy("id").coalesce(1), str(tmp_path / "x.xlsx"), "one", True)
    got = files.read_xlsx(spark, str(tmp_path / "x.xlsx"), None, "one", True).collect()
    assert [r["s"] or None for r in got] == ["a & b", None, "<x>"] and [float(r["d"]) for r in got] == [2.5, -1.0, 0.1]
    steps = [{"id": "g", "type": "gen_strings", "row_count": 5}, {"id": "w", "type": "parquet.write", "from": "g", "path": str(tmp_path / "p")}]
    Runner(spark, document([{"id": "s", "type": "dataflow", "steps": steps}])).run()
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("rows", [0, 4, 5, 6, 11])
def test_xlsx_goes_on_in_further_worksheets(spark, tmp_path, monkeypatch, rows, header):
    assert files.SHEET_ROWS == 1048576
    monkeypatch.setattr(files, "SHEET_ROWS", 5)
    path, name = str(tmp_path / "g.xlsx"), "it's <a> sheet of 31 letter (2)"
    assert files.write_xlsx(spark.range(rows).selectExpr("id", "if(id % 2 = 0, 'id', null) AS s").coalesce(1), path, name, header) == rows
    want = [(str(i), "id" if i % 2 == 0 else None) for i in range(rows)]
    for sheet in (None, name):
        assert [tuple(r) for r in files.read_xlsx(spark, path, None if header else ["id", "s"], sheet, header).collect()] == want
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml"))[0]]
        lines = [z.read(f"xl/worksheets/sheet{i + 1}.xml").count(b"<row ") for i in range(len(names))]
    assert len(set(names)) == len(names) and max(map(len, names)) <= 31 and max(lines) <= 5 and sum(lines) == rows + header * len(names)
    if len(names) > 1:
        assert [r["id"] for r in files.read_xlsx(spark, path, ["id", "s"], names[1], header).collect()] == [str(i) for i in range(5 - header, min(rows, 10 - 2 * header))]


def test_xlsx_goes_on_before_a_file_of_the_archive_is_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 2000)
    assert files.write_xlsx(spark.range(50), str(tmp_path / "z.xlsx")) == 50
    assert sorted(int(r["id"]) for r in files.read_xlsx(spark, str(tmp_path / "z.xlsx")).collect()) == list(range(50))


def test_xlsx_other_sheets_stay_apart(spark, tmp_path):
    sheet = '<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>{v}</v></c></row></sheetData></worksheet>'
    ns = files._NS
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns["m"]}"><si><t>id</t></si><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns["m"]}" xmlns:r="{ns["r"]}"><sheets><sheet name="S" sheetId="1" r:id="x"/><sheet name="S (2)" sheetId="2" r:id="y"/></sheets><definedNames><definedName name="other" localSheetId="1">S!$1:$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns["p"]}"><Relationship Id="x" Target="worksheets/1.xml"/><Relationship Id="y" Target="/xl/worksheets/2.xml"/></Relationships>')
        for i in (1, 2):
            z.writestr(f"xl/worksheets/{i}.xml", sheet.format(m=ns["m"], v=i))
    assert [[r["id"] for r in files.read_xlsx(spark, str(tmp_path / "o.xlsx"), None, s).collect()] for s in (None, "S", "S (2)")] == [["a"], ["a"], ["bc"]]
    with pytest.raises(Exception, match="no sheet"):
        files.read_xlsx(spark, str(tmp_path / "o.xlsx"), None, "T")


def test_xml_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><row k='1'><n>one</n></row><x><row k='2'/></x></r>")
    got = files.read_xml(spark, str(tmp_path / "a.xml"), "//row", {"k": "@k", "n": "n"}).collect()
    assert sorted(tuple(r) for r in got) == [("1", "one"), ("2", None)]


def test_sinks_write_to_urls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    files.write_csv(df, f"file://{tmp_path}/deep/u.csv")
    files.write_json(df, f"file://{tmp_path}/deep/u.json")
    files.write_xlsx(df, f"file://{tmp_path}/deep/u.xlsx")
    assert (tmp_path / "deep" / "u.csv").read_text() == "id,s\n1,a\n" and files.read_xlsx(spark, f"file://{tmp_path}/deep/u.xlsx").count() == 1
    with pytest.raises(Exception, match="(?i)divide"):
        files.write_csv(df.selectExpr("id / (id - 1) AS x"), f"file://{tmp_path}/deep/no.csv")
    assert not (tmp_path / "deep" / "no.csv").exists()


def test_code_pages():
    assert [files.charset(c) for c in (65001, "1252", "932", "latin1")] == ["UTF-8", "windows-1252", "Shift_JIS", "latin1"]


# ---- databases

URL = "jdbc:derby:memory:millrace;create=true"


@pytest.fixture
def table(spark):
    name = f"T{time.time_ns()}"
    jdbc.execute(spark, URL, [f'CREATE TABLE "{name}" ("id" BIGINT, "grp" VARCHAR(9), "v" BIGINT, "w" BIGINT DEFAULT 7)', f'CREATE UNIQUE INDEX "I{name}" ON "{name}" ("id", "grp")', f"INSERT INTO \"{name}\" VALUES (1, 'a', 10, 1), (2, 'a', 20, 1), (3, 'b', NULL, 1)"])
    return name


def stored(spark, name):
    return sorted(((r["id"], r["grp"], r["v"], r["w"]) for r in spark.read.format("jdbc").option("url", URL).option("dbtable", f'"{name}"').load().collect()), key=str)


@pytest.mark.parametrize("mode", ["update", "update_if_changed", "ignore"])
def test_jdbc_upsert(spark, table, mode):
    rows = spark.createDataFrame([(1, "a", 11, 1), (1, "a", 12, 2), (3, "b", 30, 1), (2, "a", 20, 1), (4, "c", 40, 1), (None, "c", 50, 1), (None, "c", 51, 2)], "id long, grp string, v long, n long").repartition(3)
    connections = {"d": {"type": "derby", "dsn": URL}}
    stage = {"id": "s", "type": "dataflow", "steps": [{"id": "w", "type": "postgres.upsert", "from": "x", "connection": "d", "table": table, "key": ["id", "grp"], "on_conflict": mode, "columns": ["id", "grp", "v"], "order_by": ["n"]}]}
    jdbc.upsert(rows.where("id is not null"), URL, table, ["id", "grp"], mode, ["n"], ["id", "grp", "v"])
    want = [(1, "a", 10 if mode == "ignore" else 12, 1), (2, "a", 20, 1), (3, "b", None if mode == "ignore" else 30, 1), (4, "c", 40, 7)]
    assert stored(spark, table) == sorted(want, key=str)
    runner = Runner(spark, document([{"id": "q", "type": "shell", "argv": ["true"]}], connections))
    runner._sink("db.upsert", stage["steps"][0], rows.where("id = 4").withColumn("v", F.lit(41).cast("long")))
    assert (4, "c", 40 if mode == "ignore" else 41, 7) in stored(spark, table)
    left = [r[0] for r in spark.read.format("jdbc").option("url", URL).option("query", "SELECT TABLENAME FROM SYS.SYSTABLES").load().collect()]
    assert not [x for x in left if "__stage_" in x]


def test_jdbc_upsert_error_leaves_the_table(spark, table):
    before = stored(spark, table)
    with pytest.raises(Exception, match="(?i)duplicate"):
        jdbc.upsert(spark.createDataFrame([(9, "z", 1), (1, "a", 5)], "id long, grp string, v long"), URL, table, ["id", "grp"], "error")
    assert stored(spark, table) == before


def test_one_a_key_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 7)], "k long, v long")
    assert sorted(map(str, R.one_a_key(rows, ["k"], False, ["v"]).collect())) == sorted(map(str, rows.where("v <> 5").collect()))
    assert R.one_a_key(rows, ["k"], True, ["v"]).where("v = 6").count() == 0


def test_exec_in_one_transaction(spark, table):
    runner = Runner(spark, document([{"id": "q", "type": "shell", "argv": ["true"]}], {"d": {"type": "derby", "dsn": URL}}))
    rows = spark.createDataFrame([(1, 100), (2, 200)], "id long, v long")
    step = {"id": "e", "type": "postgres.exec", "connection": "d", "sql": f'UPDATE "{table}" SET "v" = $1 WHERE "id" = $2', "parameters": ["v", "id"]}
    assert runner._exec(step, rows).count() == 2
    assert [x[2] for x in stored(spark, table)] == [100, 200, None]
    with pytest.raises(Exception, match="(?i)duplicate"):
        runner._exec(step | {"sql": f'INSERT INTO "{table}" ("v", "id", "grp") VALUES ($1, $2, \'a\')'}, spark.createDataFrame([(8, 8), (9, 1)], "id long, v long").select(F.col("v").alias("id"), F.col("id").alias("v")))
    assert len(stored(spark, table)) == 3


def test_merge_statements():
    pg = jdbc.merge_sql("jdbc:postgresql://h/d", "s.t", "s.x", ["k", "a"], ["k"], "update_if_changed")
    assert pg == 'INSERT INTO "s"."t" AS t ("k", "a") SELECT "k", "a" FROM "s"."x" ON CONFLICT ("k") DO UPDATE SET "a" = EXCLUDED."a" WHERE (t."a") IS DISTINCT FROM (EXCLUDED."a")'
    assert jdbc.merge_sql("jdbc:postgresql://h/d", "t", "x", ["k"], ["k"], "update").endswith("DO NOTHING")
    ms = jdbc.merge_sql("jdbc:sqlserver://h", "dbo.t", "dbo.x", ["k", "a]"], ["k"], "update")
    assert ms == "MERGE INTO [dbo].[t] AS t USING [dbo].[x] AS s ON t.[k] = s.[k] WHEN MATCHED THEN UPDATE SET [a]]] = s.[a]]] WHEN NOT MATCHED THEN INSERT ([k], [a]]]) VALUES (s.[k], s.[a]]]);"


# ---- lookups, strings, tasks


def test_lookup_checks_only_reference_rows_that_are_asked_for(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id long, s string")
    ref = spark.createDataFrame([(1, "one"), (5, "a"), (5, "b")], "k long, v string")
    assert [(r.id, r.name) for r in R.lookup(df, ref, {"id": "k"}, {"name": "v"}, "drop").collect()] == [(1, "one")]
    whole = spark.range(1, 3)
    assert R.lookup(whole, ref, {"id": "k"}, {"name": "v"}, "drop").count() == 1  # a key that is never null
    with pytest.raises(Exception, match="more than one match"):
        R.lookup(spark.createDataFrame([(5,)], "id long"), ref, {"id": "k"}, {"name": "v"}, "drop").collect()


def typed(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return R.map_select(df, [{"name": "o", "lang": "ssisexpr", "expr": expr}], Runner(spark, document([{"id": "q", "type": "shell", "argv": ["true"]}])).scope).select(F.hex("o").alias("h"), "o").first()


def test_strings_cut_inside_a_character(spark):
    assert bytes.fromhex(typed(spark, "SUBSTRING(s, 2, 2)", s="aéb").h) == "aéb".encode()[1:3]
    assert bytes.fromhex(typed(spark, "LEFT(s, 2)", s="aéb").h) == b"a\xc3"
    assert bytes.fromhex(typed(spark, "RIGHT(s, 2)", s="aéb").h) == b"\xa9b"


def test_findstring_takes_the_needle_literally(spark):
    for s, f, k, want in (("a\\Eb\\Ec", "\\E", 2, 5), ("x.y", ".", 1, 2), ("aéé", "é", 2, 4), ("abc", "\\", 1, 0), ("\\Q\\E\\Q", "\\Q", 2, 5)):
        assert typed(spark, f"FINDSTRING(s, f, {k})", s=s, f=f).o == want


def test_bytes_of_bad_hex_fail(spark):
    assert bytes(typed(spark, "(DT_BYTES,9)s", s="0aFF").o) == b"\x0a\xff"
    for bad in ("0g", "abc"):
        with pytest.raises(Exception, match="hex"):
            typed(spark, "(DT_BYTES,9)s", s=bad)


def test_a_shell_that_takes_too_long_is_stopped(spark, tmp_path):
    began, mark = time.time(), tmp_path / "mark"
    with pytest.raises(StageFailed, match="longer than"):
        Runner(spark, document([{"id": "s", "type": "shell", "argv": ["sh", "-c", f"sleep 3; touch {mark}"], "timeout": "500ms"}])).run()
    assert time.time() - began < 2.5
    time.sleep(3)
    assert not mark.exists()


def test_post_without_a_body_is_a_post(spark, tmp_path):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.command, self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"ok")

        do_GET = do_POST

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    stages = [{"id": "a", "type": "http.post", "url": url, "save_to": str(tmp_path / "got")}, {"id": "b", "type": "http.post", "url": url, "body_json": {"x": 1}, "after": ["a"]}, {"id": "c", "type": "http.get", "url": url, "after": ["b"]}]
    Runner(spark, document(stages)).run()
    server.shutdown()
    assert seen == [("POST", b""), ("POST", b'{"x": 1}'), ("GET", b"")] and (tmp_path / "got").read_bytes() == b"ok"


@pytest.mark.parametrize(("expect", "fine"), [({"n": {"min": 0}, "row": "all"}, True), ({"n": {"max": 3}, "row": "all"}, False), ({"n": {"between": [0, 4]}, "row": "all"}, True), ({"n": 0}, True), ({"m": {"not_null": True}, "row": "all"}, False)])
def test_expectations_of_all_rows(spark, expect, fine):
    stage = {"id": "s", "type": "sql.execute", "connection": "c", "sql": "SELECT id AS n, nullif(id, 2) AS m FROM range(5) ORDER BY id", "expect": expect}
    runner = Runner(spark, document([stage], {"c": {"type": "spark"}}))
    if fine:
        runner.run()
    else:
        with pytest.raises(StageFailed, match="expect"):
            runner.run()


# ---- row scripts, own components


SCRIPT = """
-- the usual clean-up
local total = row.a + row.b      -- a "local"
if row.s == nil or row.s == "-- none" then
  row.s = "none"; row.extra = 1
elseif total > 10 then
  row.s = row.s:upper() .. "!"
  total = 10
else
  row["s"] = row.s .. total
end
row.a = total
if row.extra then row.b = nil end
return row
"""


def row_script(a, b, s):
    """What the script does, in plain Python."""
    total, extra = a + b, None
    if s is None or s == "-- none":
        s, extra = "none", 1
    elif total > 10:
        s, total = s.upper() + "!", 10
    else:
        s = s + str(total)
    return total, None if extra else b, s


def test_row_scripts(spark):
    data = [(1, 2, "x"), (9, 9, "big"), (1, 1, None), (3, 4, "-- none"), (5, 5, "edge")]
    df = spark.createDataFrame(data, "a long, b int, s string")
    runner = Runner(spark, document([{"id": "q", "type": "shell", "argv": ["true"]}]))
    got = runner._step("python.map", {"script": SCRIPT}, [df])
    assert got.dtypes == df.dtypes and [tuple(r) for r in got.collect()] == [row_script(*r) for r in data]
    for bad in ("for i = 1, 2 do end", "row.a = {}", "row.a = 'text'", "if row.a == 1 then row.a = 2", "return 5", "x = 1", "row.a = 1 end"):
        with pytest.raises(Exception, match="."):
            runner._step("python.map", {"script": bad}, [df])
    with pytest.raises(Exception, match="integer representation"):
        runner._step("python.map", {"script": "row.a = row.a / 2"}, [df]).collect()


def test_row_script_in_a_document(spark):
    steps = [{"id": "a", "type": "gen_int64", "row_count": 4}, {"id": "m", "type": "lua.map", "from": "a", "script": "row.id = row.id * row.id"}]
    doc = document([{"id": "s", "type": "dataflow", "steps": [*steps, {"id": "n", "type": "count_rows", "from": "m", "expect": 4}]}])
    assert [r.id for r in Runner(spark, doc).frames(steps)["m"].collect()] == [0, 1, 4, 9]
    with pytest.raises(Exception, match="either function or script"):
        document([{"id": "s", "type": "dataflow", "steps": [steps[0], {"id": "m", "type": "lua.map", "from": "a"}]}])


def test_own_components(spark):
    from millrace.plans import document as d

    @d.component("test.tripled", required=["column"])
    def tripled(runner, step, inputs):
        return inputs[0].withColumn(step["column"], F.col(step["column"]) * 3)

    seen = []

    @d.component("test.keep", "sink")
    def keep(runner, step, df):
        seen.extend(r[0] for r in df.collect())

    try:
        steps = [{"id": "a", "type": "gen_int64", "row_count": 3}, {"id": "t", "type": "test.tripled", "from": "a", "column": "id"}, {"id": "k", "type": "test.keep", "from": "t"}]
        Runner(spark, document([{"id": "s", "type": "dataflow", "steps": steps}])).run()
        assert seen == [0, 3, 6]
        with pytest.raises(d.DocumentError, match="missing column"):
            document([{"id": "s", "type": "dataflow", "steps": [steps[0], {"id": "t", "type": "test.tripled", "from": "a"}]}])
        with pytest.raises(ValueError, match="there already"):
            d.component("test.keep", "sink")(keep)
    finally:
        for name in ("test.tripled", "test.keep"):
            d.COMPONENTS.pop(name), d.HANDLERS.pop(name), d.SINKS.discard(name)


def test_partitioned_read(spark, table):
    df = files.read_jdbc(spark, {"type": "derby", "dsn": URL}, f'SELECT "id", "v" FROM "{table}"', partition={"column": "id", "lower": 1, "upper": 3, "parts": 3})
    assert df.rdd.getNumPartitions() > 1 and sorted(r.id for r in df.collect()) == [1, 2, 3]
