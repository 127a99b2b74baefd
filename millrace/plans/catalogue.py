"""Registered queries of the pipeline operators, each with its SQL. Most are data flows as a document would declare them."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.document import from_text
from millrace.plans.runner import Runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def steps_frame(spark: SparkSession, steps: list[dict], out: str, parameters: dict[str, str] | None = None) -> DataFrame:
    """The port `out` of data flow steps."""
    text = json.dumps({"parameters": {k: {"type": "string", "default": v} for k, v in (parameters or {}).items()}, "pipeline": [{"id": "s", "type": "shell", "argv": []}]})
    return Runner(spark, from_text(text, name="x.json")).frames(steps)[out]


def read(sf_dir: str, table: str, id_: str | None = None, columns: list[str] | None = None) -> dict:
    return {"id": id_ or table, "type": "parquet.read", "path": f"{sf_dir}/{table}.parquet"} | ({"columns": columns} if columns else {})


def flow(name: str, sql: str | None, steps: Callable[[str], list[dict]], out: str | None = None, parameters: dict[str, str] | None = None) -> None:
    """Registers the last step (or `out`) of a data flow."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = steps(sf_dir)
        return steps_frame(spark, s, out or s[-1]["id"], parameters)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def typed(expr: str, kind: str | None = None) -> dict:
    return {"lang": "ssisexpr", "expr": expr} | ({"type": kind} if kind else {})


def exprs(name: str, table: str, keep: list[str], add: dict[str, str], sql: dict[str, str]) -> None:
    """Registers expressions of the typed language over a table, next to what SQL makes of them."""
    flow(name, f"SELECT {', '.join(keep)}, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {table}", lambda d: [read(d, table), {"id": "out", "type": "map", "from": table, "select": [*keep, *({"name": k, **typed(v)} for k, v in add.items())]}])


# ---- projections, filters, routing
flow("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS sum_qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS sum_cents, count(*) AS n_lines, max(l_shipdate) AS last_ship
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""", lambda d: [
    read(d, "lineitem"),
    {"id": "old", "type": "filter", "from": "lineitem", "where": {"lang": "sql", "expr": "l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'"}},
    {"id": "m", "type": "map", "from": "old", "select": ["l_returnflag", "l_linestatus", "l_shipdate", {"name": "qty", **typed("(DT_I8)l_quantity")}, {"name": "cents", **typed("(DT_I8)ROUND(l_extendedprice * 100, 0)")}]},
    {"id": "out", "type": "aggregate", "from": "m", "group_by": ["l_returnflag", "l_linestatus"], "compute": {"sum_qty": {"agg": "sum", "over": "qty"}, "sum_cents": {"agg": "sum", "over": "cents"}, "n_lines": {"agg": "count"}, "last_ship": {"agg": "max", "over": "l_shipdate"}}},
])
flow("filter", "SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'", lambda d: [read(d, "lineitem"), {"id": "out", "type": "filter", "from": "lineitem", "where": typed('[l_quantity] > 25 && [l_returnflag] == "R"')}])
flow("filter_script", "SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 1", lambda d: [read(d, "orders"), {"id": "out", "type": "filter", "from": "orders", "where": "row.o_orderstatus == 'F' or row.o_custkey == 1"}])
flow("filter_literal", "SELECT * FROM nation WHERE false", lambda d: [read(d, "nation"), {"id": "out", "type": "filter", "from": "nation", "where": {"lang": "literal", "value": "false"}}])
flow("filter_literal_all", "SELECT * FROM nation WHERE true", lambda d: [read(d, "nation"), {"id": "out", "type": "filter", "from": "nation", "where": {"lang": "literal", "value": "true"}}])
flow("map_add", "SELECT *, n_nationkey * 10 + 1 AS code, upper(n_name) || '_' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation", lambda d: [
    read(d, "nation"), {"id": "out", "type": "map", "from": "nation", "add": {"code": typed("[n_nationkey] * 10 + 1", "l"), "tag": typed('UPPER([n_name]) + "_" + (DT_WSTR,10)[n_regionkey]')}}])
flow("map_select", "SELECT r_name AS region, r_regionkey, r_name AS again, 7::BIGINT AS seven FROM region", lambda d: [
    read(d, "region"), {"id": "out", "type": "map", "from": "region", "select": [{"name": "region", "from": "r_name"}, "r_regionkey", {"name": "again", "from": "r_name"}, {"name": "seven", "value": 7, "type": "l"}]}])
flow("map_script", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side, CAST(c_custkey % 7 AS BIGINT) AS bucket, lower(c_name) AS low FROM customer", lambda d: [
    read(d, "customer"), {"id": "out", "type": "map", "from": "customer", "select": ["c_custkey", {"name": "side", "lang": "lua", "expr": "row.c_acctbal > 0 and 'credit' or 'debit'"}, {"name": "bucket", "lang": "lua", "expr": "row.c_custkey % 7", "type": "l"}, {"name": "low", "lang": "lua", "expr": "string.lower(row.c_name)"}]}])
flow("audit", "SELECT *, 42::BIGINT AS run_id, 1.5::DOUBLE AS rate, 'h1' AS host FROM region", lambda d: [read(d, "region"), {"id": "out", "type": "audit", "from": "region", "columns": {"run_id": 42, "rate": 1.5, "host": "h1"}}])
_CASES = [{"name": "big", "where": typed("[l_quantity] > 40")}, {"name": "mid", "where": typed("[l_quantity] > 20")}]
for _port, _cond in (("big", "l_quantity > 40"), ("mid", "l_quantity > 20 AND NOT l_quantity > 40"), ("rest", "NOT l_quantity > 20")):
    flow(f"split_{_port}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_cond}", lambda d: [read(d, "lineitem", columns=["l_orderkey", "l_linenumber", "l_quantity"]), {"id": "s", "type": "split", "from": "lineitem", "cases": _CASES, "default": "rest"}], f"s:{_port}")
flow("multicast", "SELECT * FROM region UNION ALL SELECT * FROM region", lambda d: [read(d, "region"), {"id": "m", "type": "multicast", "from": "region", "taps": ["a", "b"]}, {"id": "out", "type": "union", "from": ["m:a", "m:b"]}])
flow("limit_after_sort", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100", lambda d: [
    read(d, "lineitem", columns=["l_orderkey", "l_linenumber"]), {"id": "s", "type": "sort", "from": "lineitem", "by": ["l_orderkey", "l_linenumber"]}, {"id": "out", "type": "limit", "from": "s", "n": 100}])
flow("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda d: [
    read(d, "orders", columns=["o_orderkey", "o_totalprice"]), {"id": "s", "type": "sort", "from": "orders", "by": [{"col": "o_totalprice", "dir": "desc"}, "o_orderkey"]}, {"id": "out", "type": "limit", "from": "s", "n": 10}])
flow("sort", "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders", lambda d: [
    read(d, "orders", columns=["o_orderkey", "o_orderdate", "o_orderpriority"]), {"id": "out", "type": "sort", "from": "orders", "by": [{"col": "o_orderpriority", "dir": "desc"}, "o_orderdate", "o_orderkey"]}])
flow("union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", lambda d: [
    read(d, "nation"), read(d, "region"), {"id": "a", "type": "map", "from": "nation", "select": [{"name": "name", "from": "n_name"}]}, {"id": "b", "type": "map", "from": "region", "select": [{"name": "name", "from": "r_name"}]}, {"id": "out", "type": "union", "from": ["a", "b"]}])
flow("distinct_all", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", lambda d: [read(d, "lineitem", columns=["l_returnflag", "l_linestatus"]), {"id": "out", "type": "distinct", "from": "lineitem"}])
flow("distinct_keys", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1", lambda d: [
    read(d, "orders", columns=["o_custkey", "o_orderkey", "o_orderdate"]), {"id": "out", "type": "distinct", "from": "orders", "keys": ["o_custkey"], "order_by": ["o_orderdate", "o_orderkey"]}])
_WIDE = [{"name": c, **typed(f"(DT_R8){c}")} for c in ("l_quantity", "l_discount", "l_tax")]
flow("unpivot", " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS measure, {c} AS amount FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")), lambda d: [
    read(d, "lineitem"), {"id": "m", "type": "map", "from": "lineitem", "select": ["l_orderkey", "l_linenumber", *_WIDE]}, {"id": "out", "type": "unpivot", "from": "m", "id_cols": ["l_orderkey", "l_linenumber"], "value_cols": ["l_quantity", "l_discount", "l_tax"], "name_col": "measure", "value_col": "amount"}])
flow("pivot", """SELECT l_orderkey, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (WHERE l_returnflag = 'A') AS "A", arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (WHERE l_returnflag = 'N') AS "N", arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY l_orderkey""", lambda d: [
    read(d, "lineitem"), {"id": "out", "type": "pivot", "from": "lineitem", "id_cols": ["l_orderkey"], "name_col": "l_returnflag", "value_col": "l_partkey", "pivot_keys": ["A", "N", "R"], "order_by": ["l_linenumber", "l_partkey"]}])

# ---- joins and lookups
for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    flow(f"join_{_kind}", f"SELECT * FROM (SELECT c_custkey, c_name FROM customer) {_sql} (SELECT o_orderkey, o_custkey FROM orders) ON c_custkey = o_custkey", lambda d, k=_kind: [
        read(d, "customer", columns=["c_custkey", "c_name"]), read(d, "orders", columns=["o_orderkey", "o_custkey"]), {"id": "out", "type": "join", "from": ["customer", "orders"], "on": {"c_custkey": "o_custkey"}, "kind": k}])
# over all rows, with misses on both sides: doubled customer keys run past the last customer, and odd customers of orders have no partner
for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    flow(f"join_{_kind}_whole", f"SELECT * FROM (SELECT c_custkey, c_name, c_custkey * 2 AS twice FROM customer) {_sql} (SELECT o_orderkey, o_custkey FROM orders) ON twice = o_custkey", lambda d, k=_kind: [
        read(d, "customer", columns=["c_custkey", "c_name"]), read(d, "orders", columns=["o_orderkey", "o_custkey"]), {"id": "c", "type": "map", "from": "customer", "add": {"twice": typed("[c_custkey] * 2", "l")}},
        {"id": "out", "type": "join", "from": ["c", "orders"], "on": {"twice": "o_custkey"}, "kind": k}])
flow("join_multi_key", "SELECT l_orderkey, l_linenumber, s_name, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey", lambda d: [
    read(d, "lineitem", columns=["l_orderkey", "l_linenumber", "l_suppkey"]), read(d, "orders", columns=["o_orderkey", "o_custkey"]), read(d, "customer", columns=["c_custkey", "c_name", "c_nationkey"]), read(d, "supplier", columns=["s_suppkey", "s_name", "s_nationkey"]),
    {"id": "a", "type": "join", "from": ["lineitem", "orders"], "on": {"l_orderkey": "o_orderkey"}}, {"id": "b", "type": "join", "from": ["a", "customer"], "on": {"o_custkey": "c_custkey"}}, {"id": "j", "type": "join", "from": ["b", "supplier"], "on": {"l_suppkey": "s_suppkey", "c_nationkey": "s_nationkey"}},
    {"id": "out", "type": "map", "from": "j", "select": ["l_orderkey", "l_linenumber", "s_name", "c_name"]}])


def _lookup(name: str, on_miss: str, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
        ref = spark.read.parquet(f"{d}/customer.parquet")
        return R.lookup(orders, ref if on_miss == "error" else ref.where("c_custkey % 3 <> 0"), {"o_custkey": "c_custkey"}, {"name": "c_name", "segment": "c_mktsegment"}, on_miss)

    QUERIES[name], ORACLE_SQL[name] = query, sql


_lookup("lookup_error", "error", "SELECT o_orderkey, o_custkey, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
_lookup("lookup_null", "null", "SELECT o_orderkey, o_custkey, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
_lookup("lookup_drop", "drop", "SELECT o_orderkey, o_custkey, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")

# ---- aggregation
_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"]


def agg(name: str, group: list[str], compute: dict[str, dict], sql: str, order_by: list[str] | None = None) -> None:
    cols = ", ".join([*group, sql])
    flow(name, f"SELECT {cols} FROM lineitem" + (" GROUP BY ALL" if group else ""), lambda d: [read(d, "lineitem", columns=_LI), {"id": "out", "type": "aggregate", "from": "lineitem", "group_by": group, "compute": compute} | ({"order_by": order_by} if order_by else {})])


agg("agg_count", ["l_returnflag"], {"n": {"agg": "count"}}, "count(*) AS n")
agg("agg_sum", ["l_suppkey"], {"total": {"agg": "sum", "over": "l_partkey"}}, "CAST(sum(l_partkey) AS BIGINT) AS total")
agg("agg_min_max", ["l_orderkey"], {"low": {"agg": "min", "over": "l_partkey"}, "high": {"agg": "max", "over": "l_shipdate"}}, "min(l_partkey) AS low, max(l_shipdate) AS high")
agg("agg_avg", ["l_returnflag"], {"mean": {"agg": "avg", "over": "l_linenumber"}}, "avg(l_linenumber) AS mean")
agg("agg_count_distinct", ["l_returnflag"], {"n": {"agg": "count_distinct", "over": "l_partkey"}}, "count(DISTINCT l_partkey) AS n")
agg("agg_first_last", ["l_orderkey"], {"a": {"agg": "first", "over": "l_partkey"}, "z": {"agg": "last", "over": "l_partkey"}}, "arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS a, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS z", ["l_linenumber", "l_partkey"])
agg("agg_global", [], {"n": {"agg": "count"}, "high": {"agg": "max", "over": "l_partkey"}}, "count(*) AS n, max(l_partkey) AS high")

# ---- expressions
exprs("expr_string", "part", ["p_partkey"], {
    "len": "LEN(p_name)", "sub": "SUBSTRING(p_type, 2, 5)", "lft": "LEFT(p_type, 4)", "rgt": "RIGHT(p_type, 3)", "up": "UPPER(p_type)", "low": "LOWER(p_type)", "rep": 'REPLACE(p_type, "E", "ee")',
    "rev": "REVERSE(p_brand)", "trimmed": 'TRIM("  " + p_brand + " ")', "find": 'FINDSTRING(p_type, "A", 1)', "tok": 'TOKEN(p_type, " ", 2)', "tokens": 'TOKENCOUNT(p_type, " ")', "hexed": "HEX(p_partkey)", "code": "CODEPOINT(p_type)",
}, {
    "len": "CAST(strlen(p_name) AS BIGINT)", "sub": "substr(p_type, 2, 5)", "lft": "substr(p_type, 1, 4)", "rgt": "right(p_type, 3)", "up": "upper(p_type)", "low": "lower(p_type)", "rep": "replace(p_type, 'E', 'ee')",
    "rev": "reverse(p_brand)", "trimmed": "p_brand", "find": "CAST(instr(p_type, 'A') AS BIGINT)", "tok": "coalesce(list_filter(string_split(p_type, ' '), lambda x: x <> '')[2], '')", "tokens": "CAST(len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS BIGINT)", "hexed": "hex(p_partkey)", "code": "CAST(unicode(p_type) AS BIGINT)",
})
exprs("expr_math", "customer", ["c_custkey"], {
    "a": "ABS(0 - c_custkey)", "sq": "SQUARE(c_custkey)", "root": "SQRT(c_custkey)", "pw": "POWER(c_custkey, 2)", "up": "CEILING(c_acctbal)", "down": "FLOOR(c_acctbal)", "sgn": "SIGN(c_acctbal)", "rnd": "ROUND(c_acctbal / 7, 2)", "q": "c_custkey / 7", "r": "c_custkey % 7",
}, {
    "a": "c_custkey", "sq": "CAST(c_custkey AS DOUBLE) * c_custkey", "root": "sqrt(c_custkey)", "pw": "pow(c_custkey, 2)", "up": "ceil(c_acctbal)", "down": "floor(c_acctbal)", "sgn": "CAST(sign(c_acctbal) AS BIGINT)", "rnd": "sign(c_acctbal) * floor(abs(c_acctbal / 7 * 100.0) + 0.5) / 100.0", "q": "c_custkey // 7", "r": "c_custkey % 7",
})
exprs("expr_date", "orders", ["o_orderkey"], {
    "y": "YEAR(o_orderdate)", "m": "MONTH(o_orderdate)", "d": "DAY(o_orderdate)", "q": 'DATEPART("quarter", o_orderdate)', "doy": 'DATEPART("dy", o_orderdate)', "wd": 'DATEPART("dw", o_orderdate)', "wk": 'DATEPART("week", o_orderdate)',
    "plus": 'DATEADD("month", 1, (DT_DBDATE)o_orderdate)', "due": 'DATEADD("day", 7, o_orderdate)', "months": 'DATEDIFF("month", (DT_DBDATE)"1992-01-31", o_orderdate)', "years": 'DATEDIFF("year", (DT_DBDATE)"1992-11-30", o_orderdate)', "weeks": 'DATEDIFF("week", (DT_DBDATE)"1992-01-01", o_orderdate)',
}, {
    "y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "q": "quarter(o_orderdate)", "doy": "dayofyear(o_orderdate)", "wd": "dayofweek(o_orderdate) + 1", "wk": "(dayofyear(o_orderdate) + 6) // 7",
    "plus": "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)", "due": "o_orderdate + INTERVAL 7 DAY", "months": "(year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1", "years": "CAST(trunc(((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 11) / 12.0) AS BIGINT)", "weeks": "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 7",
})
flow("expr_locale", "SELECT c_custkey, c_custkey * 1000 AS whole, round(c_acctbal, 2) AS amount FROM customer", lambda d: [
    read(d, "customer"), {"id": "t", "type": "map", "from": "customer", "select": ["c_custkey", *({"name": n, "lang": "sql", "expr": f"translate(format_number({x}), ',.', '.,')"} for n, x in (("w", "c_custkey * 1000, 0"), ("a", "c_acctbal, 2")))]},
    {"id": "out", "type": "map", "from": "t", "select": ["c_custkey", {"name": "whole", **typed("(DT_I8)w")}, {"name": "amount", **typed("(DT_R8)a")}]}], parameters={"$Package::LocaleID": "de_DE.UTF-8"})
_WRAP = lambda x: f"CAST((({x}) % 18446744073709551616 + 27670116110564327424) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"
flow("expr_wrap", f"SELECT o_orderkey, {_WRAP('o_orderkey::HUGEINT * 9223372036854775807 + o_custkey')} AS up, {_WRAP('-(o_orderkey::HUGEINT) * 9223372036854775807 - o_custkey')} AS down FROM orders", lambda d: [
    read(d, "orders"), {"id": "out", "type": "map", "from": "orders", "select": ["o_orderkey", {"name": "up", **typed("o_orderkey * 9223372036854775807 + o_custkey")}, {"name": "down", **typed("-o_orderkey * 9223372036854775807 - o_custkey")}]}], parameters={"$Package::IntegerOverflow": "wrap"})
flow("expr_python", "SELECT c_custkey, abs(c_acctbal) * 2 AS twice, upper(c_name) AS loud FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'", lambda d: [
    read(d, "customer"), {"id": "f", "type": "filter", "from": "customer", "where": {"lang": "python", "expr": "(row.c_acctbal > 0) & (row['c_mktsegment'] != 'BUILDING')"}},
    {"id": "out", "type": "map", "from": "f", "select": ["c_custkey", {"name": "twice", "lang": "python", "expr": "row.c_acctbal.abs() * 2", "type": "g"}, {"name": "loud", "lang": "python", "expr": "row.c_name.str.upper()"}]}])
_NULLED = "NULLIF(o_custkey % 3, 0)"
flow("expr_null_3vl", f"""SELECT o_orderkey, {_NULLED} IS NULL AS missing, coalesce({_NULLED}, -1) AS filled, ({_NULLED} > 1 AND o_orderkey > 10) AS both, ({_NULLED} > 1 OR o_orderkey > 10) AS either, NOT ({_NULLED} > 1) AS neg FROM orders""", lambda d: [
    read(d, "orders"), {"id": "n", "type": "map", "from": "orders", "select": ["o_orderkey", {"name": "k", "lang": "sql", "expr": "nullif(o_custkey % 3, 0)"}]},
    {"id": "out", "type": "map", "from": "n", "select": ["o_orderkey", *({"name": k, **typed(v)} for k, v in {"missing": "ISNULL(k)", "filled": "REPLACENULL(k, 0 - 1)", "both": "k > 1 && o_orderkey > 10", "either": "k > 1 || o_orderkey > 10", "neg": "!(k > 1)"}.items())]}])
flow("expr_ternary_null", f"SELECT o_orderkey, CASE WHEN {_NULLED} IS NULL THEN NULL WHEN {_NULLED} > 1 THEN 'two' ELSE 'one' END AS word FROM orders", lambda d: [
    read(d, "orders"), {"id": "n", "type": "map", "from": "orders", "select": ["o_orderkey", {"name": "k", "lang": "sql", "expr": "nullif(o_custkey % 3, 0)"}]}, {"id": "out", "type": "map", "from": "n", "select": ["o_orderkey", {"name": "word", **typed('k > 1 ? "two" : "one"')}]}])
exprs("expr_cast", "lineitem", ["l_orderkey", "l_linenumber"], {"i": "(DT_I4)l_extendedprice", "s": "(DT_WSTR,20)l_partkey", "b": "(DT_BOOL)(l_linenumber - 1)", "t": '(DT_WSTR,5)(l_linenumber > 3)', "day": "(DT_DBDATE)l_shipdate", "back": "(DT_I8)((DT_WSTR,20)l_partkey)", "n": "(DT_NUMERIC,18,2)l_linenumber"},
      {"i": "CAST(trunc(l_extendedprice) AS BIGINT)", "s": "CAST(l_partkey AS VARCHAR)", "b": "l_linenumber <> 1", "t": "CASE WHEN l_linenumber > 3 THEN 'True' ELSE 'False' END", "day": "CAST(l_shipdate AS DATE)", "back": "l_partkey", "n": "CAST(l_linenumber AS DECIMAL(38,2))"})
exprs("expr_decimal", "lineitem", ["l_orderkey", "l_linenumber"], {"total": "(DT_WSTR,40)((DT_NUMERIC,18,2)l_linenumber + (DT_NUMERIC,18,3)2)", "prod": "(DT_WSTR,40)((DT_NUMERIC,18,2)l_linenumber * (DT_NUMERIC,18,1)3)", "quot": "(DT_R8)((DT_NUMERIC,18,2)l_linenumber / (DT_NUMERIC,18,0)8)"},
      {"total": "CAST(CAST(l_linenumber + 2 AS DECIMAL(18,3)) AS VARCHAR)", "prod": "CAST(CAST(l_linenumber * 3 AS DECIMAL(18,3)) AS VARCHAR)", "quot": "l_linenumber / 8.0::DOUBLE"})
exprs("expr_bitwise", "lineitem", ["l_orderkey", "l_linenumber"], {"a": "l_orderkey & 12", "o": "l_orderkey | 3", "x": "l_orderkey ^ 5", "n": "~l_orderkey"}, {"a": "l_orderkey & 12", "o": "l_orderkey | 3", "x": "xor(l_orderkey, 5::BIGINT)", "n": "-l_orderkey - 1"})
exprs("expr_float", "lineitem", ["l_orderkey", "l_linenumber"], {"inf": "l_quantity / (l_discount * 0)  > 1.0", "safe": "l_quantity / 4.0", "rest": "l_quantity % 4.0"}, {"inf": "true", "safe": "l_quantity / 4.0", "rest": "fmod(l_quantity, 4.0)"})

# ---- writes as DataFrames
_TARGET = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0"
_INCOMING = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '*' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0"


def _upsert(mode: str, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
        target = c.where("c_custkey % 2 = 0")
        new = c.where("c_custkey % 5 <> 0" if mode != "error" else "c_custkey % 2 = 1").withColumn("c_name", F.expr("if(c_custkey % 3 = 0, concat(upper(c_name), '*'), c_name)"))
        return R.upsert(target, new, ["c_custkey"], mode)

    QUERIES[f"upsert_{mode}"], ORACLE_SQL[f"upsert_{mode}"] = query, sql


_MERGED = f"SELECT coalesce(n.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN t.c_name ELSE n.c_name END AS c_name, coalesce(n.c_acctbal, t.c_acctbal) AS c_acctbal FROM ({_TARGET}) t FULL JOIN ({_INCOMING}) n ON t.c_custkey = n.c_custkey"
_upsert("update", _MERGED)
_upsert("update_if_changed", _MERGED)
_upsert("ignore", f"SELECT * FROM ({_TARGET}) UNION ALL SELECT * FROM ({_INCOMING}) WHERE c_custkey % 2 <> 0")
_upsert("error", f"{_TARGET} UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '*' ELSE c_name END, c_acctbal FROM customer WHERE c_custkey % 2 = 1")


def _scd2_classify(spark: SparkSession, d: str) -> DataFrame:
    """Staging against the current dimension: NEW, CHANGED or UNCHANGED, as the usual recipe does in the script language."""
    return steps_frame(spark, [
        read(d, "customer", "stage", ["c_custkey", "c_name", "c_mktsegment"]), read(d, "customer", "dim0", ["c_custkey", "c_name", "c_mktsegment"]),
        {"id": "dim1", "type": "filter", "from": "dim0", "where": "row.c_custkey % 4 ~= 0"},
        {"id": "dim", "type": "map", "from": "dim1", "select": [{"name": "dim_id", "from": "c_custkey"}, {"name": "dim_name", "lang": "lua", "expr": "row.c_custkey % 5 == 0 and row.c_name .. '!' or row.c_name"}, {"name": "dim_segment", "from": "c_mktsegment"}]},
        {"id": "j", "type": "join", "kind": "left", "from": ["stage", "dim"], "on": {"c_custkey": "dim_id"}},
        {"id": "out", "type": "map", "from": "j", "select": ["c_custkey", {"name": "scd_status", "lang": "lua", "expr": "row.dim_id == nil and 'NEW' or (row.c_name ~= row.dim_name or row.c_mktsegment ~= row.dim_segment) and 'CHANGED' or 'UNCHANGED'"}]},
    ], "out")


QUERIES["scd2_classify"] = _scd2_classify
ORACLE_SQL["scd2_classify"] = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS scd_status FROM customer"


def _scd2_apply(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    dim = c.where("c_custkey % 4 <> 0").select("c_custkey", F.expr("if(c_custkey % 5 = 0, concat(c_name, '!'), c_name)").alias("c_name"), "c_mktsegment", F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("valid_from"), F.expr("cast(null as timestamp_ntz)").alias("valid_to"), F.lit(True).alias("is_current"))
    return R.scd2(dim, c, "c_custkey", ["c_name", "c_mktsegment"], F.expr("timestamp_ntz'2024-06-01 00:00:00'"))


QUERIES["scd2_apply"] = _scd2_apply
ORACLE_SQL["scd2_apply"] = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_mktsegment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS valid_to, c_custkey % 5 <> 0 AS is_current FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '2024-06-01', NULL, true FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 = 0"""

flow("star_fact", """SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS sk_date, o_custkey AS sk_customer, l_partkey AS sk_product, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_sold, count(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""", lambda d: [
    read(d, "lineitem", columns=["l_orderkey", "l_partkey", "l_quantity"]), read(d, "orders", columns=["o_orderkey", "o_custkey", "o_orderdate"]), {"id": "j", "type": "join", "from": ["lineitem", "orders"], "on": {"l_orderkey": "o_orderkey"}},
    {"id": "m", "type": "map", "from": "j", "select": [{"name": "sk_date", **typed("YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate)")}, {"name": "sk_customer", "from": "o_custkey"}, {"name": "sk_product", "from": "l_partkey"}, {"name": "units", **typed("(DT_I8)l_quantity")}]},
    {"id": "out", "type": "aggregate", "from": "m", "group_by": ["sk_date", "sk_customer", "sk_product"], "compute": {"units_sold": {"agg": "sum", "over": "units"}, "line_count": {"agg": "count"}}}])
flow("orders_by_month", """SELECT o_orderkey, month(o_orderdate) AS order_month, year(o_orderdate) AS order_year, o_orderdate + INTERVAL 7 DAY AS due_date, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') > 30 AS is_overdue, upper(o_orderpriority) AS priority FROM orders WHERE year(o_orderdate) = 1997""", lambda d: [
    read(d, "orders"), {"id": "e", "type": "map", "from": "orders", "select": ["o_orderkey", *({"name": k, **typed(v)} for k, v in {"order_month": "MONTH(o_orderdate)", "order_year": "YEAR(o_orderdate)", "due_date": 'DATEADD("day", 7, o_orderdate)', "is_overdue": '(DT_BOOL)(DATEDIFF("day", o_orderdate, (DT_DBDATE)"1998-12-31") > 30)', "priority": "UPPER(o_orderpriority)"}.items())]},
    {"id": "out", "type": "filter", "from": "e", "where": typed("order_year == 1997")}])
flow("clean_orders", """SELECT o_orderkey, trim(o_orderpriority) AS priority, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_orderstatus <> 'P'""", lambda d: [
    read(d, "orders"), {"id": "t", "type": "map", "from": "orders", "select": ["o_orderkey", "o_orderstatus", "o_totalprice", {"name": "priority", **typed("TRIM(o_orderpriority)")}]}, {"id": "f", "type": "filter", "from": "t", "where": typed('o_totalprice > 0 && o_orderstatus != "P"')},
    {"id": "out", "type": "map", "from": "f", "select": ["o_orderkey", "priority", "o_totalprice"]}])


def _moving(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"))
    return R.moving_average(e, "cents", ["o_orderkey"], 3, "mean", ["o_custkey"]).select("o_custkey", "o_orderkey", "mean")


QUERIES["script_moving_avg"] = _moving
ORACLE_SQL["script_moving_avg"] = "SELECT o_custkey, o_orderkey, mean FROM (SELECT o_custkey, o_orderkey, avg(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS mean, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE r >= 3"
flow("gen_int64", "SELECT CAST(range AS BIGINT) AS id FROM range(5, 1005)", lambda d: [{"id": "out", "type": "gen_int64", "row_count": 1000, "start": 5}])
flow("gen_strings", "SELECT CAST(range AS BIGINT) AS id, 'row_' || range AS name FROM range(1000)", lambda d: [{"id": "out", "type": "gen_strings", "row_count": 1000}])


# ---- files: each table is written by a sink and read back by a source
def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; a local one only where Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/millrace-files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="millrace-files-")


def _round_trip(name: str, table: str, sql: str, prepare: str, there: Callable[[str], dict], back: Callable[[str], dict], cast: list[str]) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = f"{_folder(spark)}/{table}"
        steps = [read(d, table), {"id": "w", "type": "multicast", "from": table, "taps": ["rows"]}]
        rows = steps_frame(spark, steps, "w:rows").selectExpr(*prepare.split("; "))
        sink = there(path)
        Runner(spark, from_text('{"pipeline": [{"id": "s", "type": "shell", "argv": []}]}', name="x.json"))._sink(sink["type"], {"id": "sink"} | sink, rows)
        return steps_frame(spark, [{"id": "r"} | back(path)], "r").selectExpr(*cast)

    query.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = query, sql


_CSV = [{"name": "c_custkey", "type": "int64"}, {"name": "c_name"}, {"name": "c_acctbal", "type": "float64"}, {"name": "note"}]
_round_trip("csv_round_trip", "customer", """SELECT c_custkey, c_name, c_acctbal, 'a "' || c_mktsegment || '", ' || chr(10) || 'é' AS note FROM customer""",
            """c_custkey; c_name; c_acctbal; concat('a "', c_mktsegment, '", \n', 'é') AS note""", lambda p: {"type": "csv.write", "path": p}, lambda p: {"type": "csv.read", "path": p, "schema": {"columns": _CSV}}, ["c_custkey", "c_name", "c_acctbal", "note"])  # fmt: skip
_round_trip("csv_code_page", "customer", "SELECT c_custkey, 'ü;' || c_name AS name FROM customer", "c_custkey; concat('ü;', c_name) AS name",
            lambda p: {"type": "csv.write", "path": p, "delimiter": ";", "encoding": "1252"}, lambda p: {"type": "csv.read", "path": p, "delimiter": ";", "encoding": "1252", "schema": {"columns": [{"name": "c_custkey", "type": "int64"}, {"name": "name"}]}}, ["c_custkey", "name"])
for _form in ("ndjson", "array"):
    _round_trip(f"json_round_trip_{_form}", "supplier", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'q\"' || s_name END AS note, CAST(s_suppkey AS DOUBLE) / 8 AS eighth FROM supplier",
                """s_suppkey; s_name; if(s_suppkey % 3 > 0, concat('q"', s_name), null) AS note; s_suppkey / 8D AS eighth""", lambda p, f=_form: {"type": "json.write", "path": p, "format": f}, lambda p, f=_form: {"type": "json.read", "path": p, "format": f, "columns": ["s_suppkey", "s_name", "note", "eighth"]},
                ["s_suppkey", "s_name", "note", "cast(eighth AS double) AS eighth"])
_round_trip("xlsx_round_trip", "part", "SELECT p_partkey, p_name || ' <&>' AS p_name, p_size + 0.5 AS size FROM (SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part)", "p_partkey; concat(p_name, ' <&>') AS p_name; cast(p_size AS double) + 0.5D AS size",
            lambda p: {"type": "xlsx.write", "path": f"{p}.xlsx"}, lambda p: {"type": "xlsx.read", "path": f"{p}.xlsx"}, ["cast(p_partkey AS bigint) AS p_partkey", "p_name", "cast(size AS double) AS size"])
_round_trip("parquet_round_trip", "orders", "SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders", "o_orderkey; o_orderdate; o_totalprice; o_orderstatus",
            lambda p: {"type": "parquet.write", "path": p, "partition_by": ["o_orderstatus"]}, lambda p: {"type": "parquet.read", "path": p}, ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])


def _xml_rows(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/nation"
    n = spark.read.parquet(f"{d}/nation.parquet")
    body = n.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<row k="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), F.col("n_name"), F.lit("</name></row>")))), "").alias("b"))
    body.select(F.concat(F.lit("<r>"), "b", F.lit("</r>"))).coalesce(1).write.text(path)
    return steps_frame(spark, [{"id": "x", "type": "xml.read", "path": path, "row_xpath": "//row", "columns": {"k": "@k", "name": "name"}}], "x")


QUERIES["xml_rows"], ORACLE_SQL["xml_rows"] = _xml_rows, "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation"
