"""The typed language and the script subset, value by value."""

import datetime
import decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions.engines import Scope, compile_expression
from millrace.functions.typed import ExpressionError, compile_typed


@pytest.fixture(scope="module")
def batch(spark):
    return spark.range(3).select("id", F.concat(F.lit("row_"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("bigint").alias("nul"), F.lit("2026-05-11").cast("date").alias("d"), F.expr("timestamp_ntz'2026-05-11 10:20:30.5'").alias("t"))


D = decimal.Decimal
CASES = [
    ("[id] * 10 + 1", 21), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7.0 / 2", 3.5), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ('UPPER([name]) + "_" + (DT_WSTR,10)[id]', "ROW_2_2"), ('[id] > 0 ? [name] : "default"', "row_2"),
    ("SUBSTRING([name], 1, LEN([name]) - 1)", "row_"), ("(DT_I8)[id] + 1", 3), ("ISNULL(nul)", True), ("nul + 1", None), ("REPLACENULL(nul, 9)", 9), ('nul > 1 ? "a" : "b"', None), ("nul > 1 || TRUE", True), ("nul > 1 && FALSE", False), ("!(1 == 2)", True), ("6 & 3", 2), ("6 | 3", 7), ("6 ^ 3", 5), ("~5", -6),
    ('LEN("café")', 5), ('LEFT("hello", 2)', "he"), ('RIGHT("hello", 9)', "hello"), ('LEFT("x", 0 - 1)', ""), ('TRIM("\\t a \\n")', "a"), ('LTRIM("  a ")', "a "), ('RTRIM("  a ")', "  a"), ('LOWER("ÄB")', "Äb"), ('REVERSE("abc")', "cba"), ('REPLACE("aaa", "a", "b")', "bbb"), ('REPLACE("aaa", "", "b")', "aaa"),
    ('FINDSTRING("abcabc", "c", 2)', 6), ('FINDSTRING("éa", "a", 1)', 3), ('FINDSTRING("abc", "z", 1)', 0), ('FINDSTRING("abc", "", 1)', 0), ('TOKEN("a,b;;c", ",;", 3)', "c"), ('TOKEN("a", ",", 2)', ""), ('TOKENCOUNT("a,b;;c", ",;")', 3), ("HEX(255)", "FF"), ('CODEPOINT("€")', 8364),
    ("ABS(0 - 3)", 3), ("POWER(2, 3)", 8.0), ("SQUARE(3)", 9.0), ("ROUND(2.5, 0)", 3.0), ("ROUND(0 - 2.5, 0)", -3.0), ("CEILING(1.2)", 2.0), ("FLOOR(0 - 1.2)", -2.0), ("SIGN(0 - 4)", -1), ("(DT_WSTR,9)0.1", "0.1"), ("(DT_WSTR,9)1234567.0", "1.23457e+06"), ("(DT_WSTR,9)100000.0", "100000"), ("(DT_WSTR,9)TRUE", "True"), ("(DT_WSTR,20)d", "2026-05-11"), ("(DT_WSTR,30)t", "2026-05-11 10:20:30.500000"),
    ("(DT_I4)3.9", 3), ("(DT_I4)(0 - 3.9)", -3), ('(DT_I4)" 12"', 12), ("(DT_BOOL)2", True), ('(DT_DBDATE)"2026-02-03"', datetime.date(2026, 2, 3)), ('(DT_DBTIMESTAMP)"2026-02-03T04:05:06Z"', datetime.datetime(2026, 2, 3, 4, 5, 6)), ("(DT_DBDATE)t", datetime.date(2026, 5, 11)), ('(DT_NUMERIC,10,2)"1.23"', D("1.23")), ("(DT_NUMERIC,10,1)(DT_NUMERIC,10,2)1.29", D("1.2")),
    ("YEAR(d)", 2026), ('DATEPART("dw", d)', 2), ('DATEPART("week", d)', 19), ('DATEPART("hour", t)', 10), ('DATEADD("month", 1, (DT_DBDATE)"2026-01-31")', datetime.date(2026, 2, 28)), ('DATEADD("day", 7, d)', datetime.date(2026, 5, 18)), ('DATEADD("hour", 2, t)', datetime.datetime(2026, 5, 11, 12, 20, 30, 500000)),
    ('DATEDIFF("month", (DT_DBDATE)"2026-01-31", (DT_DBDATE)"2026-02-01")', 1), ('DATEDIFF("year", (DT_DBDATE)"2025-12-31", (DT_DBDATE)"2026-01-01")', 0), ('DATEDIFF("day", (DT_DBDATE)"2026-01-01", d)', 130), ("@[User::who]", "me"), ("NULL(DT_I4)", None), ("d == (DT_DBTIMESTAMP)\"2026-05-11 00:00:00\"", True),
]


@pytest.mark.parametrize(("expr", "want"), CASES, ids=[c[0] for c in CASES])
def test_value(batch, expr, want):
    col, _ = compile_typed(expr, batch.schema, {"who": "me"})
    assert batch.where("id = 2").select(col.alias("x")).first()[0] == want


@pytest.mark.parametrize("expr", ["1 +", "nope + 1", 'name == 1', '"a" + 1', "FOO(1)", "LEN(1)", "1 << 2", "@[User::zz]", 'DATEADD("weekday", 1, d)', "(DT_NUMERIC,10)1", 'DATEPART("hour", d)', "name ? 1 : 2", "!1", "LEN()"])
def test_rejected(batch, expr):
    with pytest.raises(ExpressionError):
        compile_typed(expr, batch.schema)


@pytest.mark.parametrize("expr", ["1 / (id - id)", '(DT_I4)"12x"', "(DT_UI1)(id + 300)", "SUBSTRING(name, 0, 1)", 'CODEPOINT("")', "HEX(0 - 1 - id)", "9223372036854775807 + id + 1", '(DT_NUMERIC,10,1)"1.29"'])
def test_raises(batch, expr):
    col, _ = compile_typed(expr, batch.schema)
    with pytest.raises(PySparkException):
        batch.select(col.alias("x")).collect()


def test_guarded_right_side(batch):
    col, _ = compile_typed("id > 5 && 1 / (id - id) > 0", batch.schema)
    assert [r[0] for r in batch.select(col.alias("x")).collect()] == [False] * 3


SCRIPT = [
    ("row.id + 1", "l", 3), ("row.id / 4", "g", 0.5), ("row.id // 4", "l", 0), ("-7 % 3", "l", 2), ("-7 // 2", "l", -4), ("row.nul == nil", "b", True), ("row.nul == nil and 'none' or 'some'", "u", "none"), ("row.id == 2 and 'two' or 'other'", "u", "two"), ("not row.nul", "b", True), ("0 and 'yes' or 'no'", "u", "yes"),
    ("row.name .. '!'", "u", "row_2!"), ("#row.name", "l", 5), ("row['name']:upper()", "u", "ROW_2"), ("string.sub(row.name, 1, 3)", "u", "row"), ("string.sub(row.name, -1)", "u", "2"), ("string.rep('ab', 2)", "u", "abab"), ("math.max(row.id, 7)", "l", 7), ("math.floor(2.5)", "l", 2), ("tostring(row.id)", "u", "2"), ("row.missing == nil", "b", True), ("params.p", "u", "v"), ("row.nul ~= row.id", "b", True),
]


@pytest.mark.parametrize(("expr", "kind", "want"), SCRIPT, ids=[c[0] for c in SCRIPT])
def test_script(batch, expr, kind, want):
    from millrace.functions.engines import TYPES

    col = compile_expression(expr, batch.schema, Scope({"p": "v"}), to=TYPES[kind], predicate=False) if kind != "b" else compile_expression(expr, batch.schema, Scope({"p": "v"}), predicate=True)
    assert batch.where("id = 2").select(col.alias("x")).first()[0] == want


@pytest.mark.parametrize("expr", ["if row.id then 1 end", "os.time()", "id > 1", "string.format('%d', 1)", "return 1"])
def test_script_rejected(batch, expr):
    with pytest.raises(ExpressionError):
        compile_expression(expr, batch.schema, Scope())


@pytest.mark.parametrize(("expr", "want"), [
    ('(DT_R8)"1.234,56"', 1234.56), ('(DT_R8)" -1234,5"', -1234.5), ('(DT_I4)"1.234.567"', 1234567), ('(DT_R8)",5"', 0.5), ('(DT_R8)"1,5e2"', 150.0), ('(DT_NUMERIC,10,2)"1.23"', D("1.23")), ("(DT_R8)NULL(DT_WSTR)", None), ("1.5 + 1", 2.5),
])
def test_locale_of_numbers(batch, expr, want):
    col, _ = compile_typed(expr, batch.schema, {"$Package::LocaleID": "de_DE.UTF-8"})
    assert batch.limit(1).select(col.alias("x")).first()[0] == want


def test_locale_rejects(batch):
    for bad in ("1.23", "1.2345,0", "1,5,0", "1.234x", ""):
        col, _ = compile_typed(f'(DT_R8)"{bad}"', batch.schema, {"$Package::LocaleID": "de_DE"})
        with pytest.raises(PySparkException):
            batch.select(col).collect()
    for unknown in ("1031", "xx_XX", "German"):
        with pytest.raises(ExpressionError, match="locale"):
            compile_typed("1", batch.schema, {"$Package::LocaleID": unknown})
    for name, text in (("fr_FR.UTF-8", "1\u202f234,5"), ("fr_FR.UTF-8", "1\u00a0234,5"), ("en_US", "1,234.5"), ("de_CH", "1\u2019234.5"), ("C", "1234.5")):
        col, _ = compile_typed(f'(DT_R8)"{text}"', batch.schema, {"$Package::LocaleID": name})
        assert batch.limit(1).select(col).first()[0] == 1234.5


def test_integers_wrap_when_asked(batch):
    top = 2**63 - 1
    cases = [(f"{top} + 1", -(2**63)), (f"0 - {top} - 2", top), (f"{top} * {top}", 1), (f"-(0 - {top} - 1)", -(2**63)), ("7 * 6", 42), ("nul + 1", None), (f"({top} + 1) * ({top} + 1)", 0), (f"({top} + 1) * -1", -(2**63))]
    cols = [compile_typed(e, batch.schema, {"$Package::IntegerOverflow": "wrap"})[0].alias(f"x{i}") for i, (e, _) in enumerate(cases)]
    assert list(batch.limit(1).select(*cols).first()) == [w for _, w in cases]
    with pytest.raises(PySparkException):
        batch.select(compile_typed(f"{top} + id", batch.schema)[0]).collect()
    with pytest.raises(ExpressionError):
        compile_typed("1", batch.schema, {"$Package::IntegerOverflow": "saturate"})


def test_python_expressions(batch):
    make = lambda e, to=None, predicate=False: compile_expression({"lang": "python", "expr": e}, batch.schema, Scope(), to=to, predicate=predicate)
    got = batch.select(make("row.id * 2 + 1", "bigint").alias("a"), make("row.name.str.upper()").alias("b"), make("7", "bigint").alias("c"), make("row['nul'].fillna(4)", "bigint").alias("d"), make("np.where(row.id > 0, 'x', None)").alias("e")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "ROW_0", 7, 4, None), (3, "ROW_1", 7, 4, "x"), (5, "ROW_2", 7, 4, "x")]
    assert [r.id for r in batch.where(make("row.id % 2 == 0", predicate=True)).orderBy("id").collect()] == [0, 2]
    assert batch.limit(0).select(make("row.id", "bigint").alias("a")).collect() == []
    for bad in ("row.", "row.nope", "row", "len(row)", "x = 1"):
        with pytest.raises(ExpressionError):
            make(bad)
