"""Small data flows that end in a row count, and documents that must be rejected."""

import json

import pytest
from pyspark.errors import PySparkException

from millrace.functions.typed import ExpressionError
from millrace.operators.relational import OperatorError
from millrace.plans.document import DocumentError, bind, from_text, order
from millrace.plans.runner import Runner, StageFailed


def ints(n, start=0, id_="a", column="id"):
    return {"id": id_, "type": "x.gen_int64", "row_count": n, "start": start, "column": column}


def strings(n, id_="a"):
    return {"id": id_, "type": "x.gen_strings", "row_count": n}


def doc(steps, **top):
    return from_text(json.dumps({"name": "t", "pipeline": [{"id": "s", "type": "dataflow", "steps": steps}], **top}), name="t.json")


def count(spark, steps, expect, last=None, **kw):
    steps = [*steps, {"id": "end", "type": "count_rows", "from": last or steps[-1]["id"], "expect": expect}]
    return Runner(spark, doc(steps), **kw).run()


def rows(spark, steps, out=None):
    return [tuple(r) for r in Runner(spark, doc([*steps, {"id": "end", "type": "count_rows", "from": out or steps[-1]["id"]}])).frames(steps)[out or steps[-1]["id"]].collect()]


def step(type_, /, **kw):
    return {"id": kw.pop("id", "b"), "type": type_, "from": kw.pop("frm", "a"), **kw}


@pytest.mark.parametrize(
    ("source", "where", "n"),
    [
        (ints(10), "row.id > 5", 4),
        (ints(3), {"lang": "literal", "value": "true"}, 3),
        (ints(3), {"lang": "literal", "value": "false"}, 0),
        (strings(4), "row.id == 1 or row.name == 'row_3'", 2),
        (strings(4), {"lang": "ssisexpr", "expr": '[id] > 1 && [name] != "row_2"'}, 1),
        (strings(4), {"lang": "sql", "expr": "id % 2 = 0"}, 2),
    ],
)
def test_filter(spark, source, where, n):
    count(spark, [source, step("filter", where=where)], n)


def test_map_select_repeats_a_column(spark):
    assert rows(spark, [ints(2), step("map", select=["id", {"name": "id_alias", "from": "id"}])]) == [(0, 0), (1, 1)]


def test_sort_desc(spark):
    assert [r[0] for r in rows(spark, [ints(4), step("sort", by=[{"col": "id", "dir": "desc"}])])] == [3, 2, 1, 0]


@pytest.mark.parametrize(("kind", "left", "right", "n"), [("inner", (5, 0), (3, 0), 3), ("left", (4, 0), (3, 2), 4), ("outer", (4, 0), (3, 2), 5), ("right", (4, 0), (3, 2), 3)])
def test_join(spark, kind, left, right, n):
    count(spark, [ints(*left), ints(*right, id_="r", column="rid"), {"id": "j", "type": "join", "from": ["a", "r"], "on": {"id": "rid"}, "kind": kind}], n)


def test_distinct_and_union(spark):
    count(spark, [ints(5), ints(5, id_="c"), {"id": "u", "type": "union", "from": ["a", "c"]}, step("distinct", frm="u", id="d")], 5)
    count(spark, [strings(3), strings(3, "c"), {"id": "u", "type": "union", "from": ["a", "c"]}, step("distinct", frm="u", id="d", keys=["id"])], 3)


@pytest.mark.parametrize(("n", "limit", "expect"), [(10, 3, 3), (4, 100, 4)])
def test_limit(spark, n, limit, expect):
    count(spark, [ints(n), step("limit", n=limit)], expect)


@pytest.mark.parametrize(("first", "second", "expect"), [("row.id > 3", "row.id < 2", (2, 2, 2)), ("row.id < 3", "row.id < 2", (3, 0, 3))])
def test_split(spark, first, second, expect):
    steps = [ints(6), step("conditional_split", cases=[{"name": "x", "where": first}, {"name": "y", "where": second}], default="z")]
    for port, n in zip("xyz", expect, strict=True):
        count(spark, steps, n, f"b:{port}")


def test_multicast_feeds_two_sinks(spark):
    steps = [ints(3), step("multicast", taps=["x", "y"]), {"id": "e1", "type": "count_rows", "from": "b:x", "expect": 3}, {"id": "e2", "type": "count_rows", "from": "b:y", "expect": 3}]
    assert ("e2", "3 rows") in Runner(spark, doc(steps)).run()


def test_audit(spark):
    assert rows(spark, [ints(1), step("audit", columns={"run": 7, "rate": 0.5, "host": "h"})]) == [(0, 7, 0.5, "h")]


def test_aggregate(spark):
    keyed = [ints(6), step("map", add={"k": {"lang": "ssisexpr", "expr": "id % 2"}})]
    got = rows(spark, [*keyed, step("aggregate", id="g", frm="b", group_by=["k"], compute={"n": {"agg": "count"}, "s": {"agg": "sum", "over": "id"}})])
    assert sorted(got) == [(0, 3, 6), (1, 3, 9)]
    got = rows(spark, [ints(5, 10), step("aggregate", group_by=[], compute={"lo": {"agg": "min", "over": "id"}, "hi": {"agg": "max", "over": "id"}})])
    assert got == [(10, 14)]


def test_pivot_and_unpivot(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("region,month,amount\nnorth,feb,200\nnorth,mar,300\nsouth,jan,400\nsouth,feb,500\n")
    cols = [{"name": "region", "type": "utf8"}, {"name": "month", "type": "utf8"}, {"name": "amount", "type": "int64"}]
    src = {"id": "a", "type": "csv.read", "path": str(p), "schema": {"columns": cols}}
    pv = step("pivot", id_cols=["region"], name_col="month", value_col="amount", pivot_keys=["jan", "feb", "mar"], order_by=["amount"])
    assert sorted(rows(spark, [src, pv])) == [("north", None, 200, 300), ("south", 400, 500, None)]
    up = step("unpivot", frm="b", id="c", id_cols=["region"], value_cols=["jan", "feb", "mar"], name_col="month", value_col="amount")
    assert len(rows(spark, [src, pv, up])) == 6


def test_lookup_policies(spark):
    spark.range(3).selectExpr("id", "concat('c', id) color").createOrReplaceTempView("dim_color")
    conns = {"wh": {"type": "spark"}}
    for miss, n in (("null", 5), ("drop", 3)):
        steps = [ints(5), step("postgres.lookup", connection="wh", table="dim_color", match={"id": "id"}, select={"color": "color"}, on_miss=miss), {"id": "end", "type": "count_rows", "from": "b", "expect": n}]
        Runner(spark, doc(steps, connections=conns)).run()
    steps = [ints(5), step("lookup", connection="wh", table="dim_color", match={"id": "id"}, select={"color": "color"}), {"id": "end", "type": "count_rows", "from": "b"}]
    with pytest.raises(StageFailed, match="no match"):
        Runner(spark, doc(steps, connections=conns)).run()
    spark.range(3).selectExpr("id % 2 id", "'x' color").createOrReplaceTempView("dim_color")
    with pytest.raises(StageFailed, match="more than one match"):
        Runner(spark, doc([ints(1), *steps[1:]], connections=conns)).run()


@pytest.mark.parametrize(
    ("steps", "needle"),
    [
        ([ints(1), step("join", on={"id": "id"}, frm=["a", "a"], kind="cross")], "unknown kind"),
        ([ints(1), step("aggregate", group_by=["nope"], compute={"n": {"agg": "count"}})], "unknown column"),
        ([ints(1), step("aggregate", group_by=["id"], compute={"n": {"agg": "median", "over": "id"}})], "unknown agg"),
        ([ints(1), step("limit", n=0)], "positive"),
        ([ints(1), step("sort", by=["zz"])], "unknown column"),
        ([ints(1), strings(1, "c"), {"id": "u", "type": "union", "from": ["a", "c"]}], "other columns"),
        ([ints(1), strings(1, "c"), {"id": "j", "type": "join", "from": ["a", "c"], "on": {"id": "name"}}], "appear twice"),
        ([ints(1), step("map", add={"id": {"value": 1}})], "appear twice"),
    ],
)
def test_bad_arguments(spark, steps, needle):
    with pytest.raises((OperatorError, ExpressionError), match=needle):
        rows(spark, steps)


@pytest.mark.parametrize(
    ("raw", "needle"),
    [
        ({"name": "x"}, "no pipeline"),
        ({"pipeline": [{"id": "a", "type": "shell", "argv": [], "after": ["zz"]}]}, "after unknown stage"),
        ({"pipeline": [{"id": "a", "type": "shell", "argv": [], "after": ["a"]}]}, "after itself"),
        ({"pipeline": [{"id": "a", "type": "shell", "argv": []}, {"id": "a", "type": "shell", "argv": []}]}, "duplicate stage id"),
        ({"pipeline": [{"id": "a", "type": "shell", "argv": [], "after": ["b"]}, {"id": "b", "type": "shell", "argv": [], "after": ["a"]}]}, "stage cycle"),
        ({"pipeline": [{"id": "a", "type": "dataflow", "steps": []}]}, "no steps"),
        ({"pipeline": [{"id": "a", "type": "dataflow", "steps": [{"id": "x", "type": "filter", "from": "y", "where": "true"}, {"id": "y", "type": "limit", "from": "x", "n": 1}]}]}, "step cycle"),
        ({"pipeline": [{"id": "a", "type": "dataflow", "steps": [ints(1), {"id": "b", "type": "limit", "from": "zz", "n": 1}]}]}, "from unknown step"),
        ({"pipeline": [{"id": "a", "type": "dataflow", "steps": [{"id": "b"}]}]}, "needs id and type"),
        ({"pipeline": [], "connections": {"c": {"type": "postgres"}}}, "no dsn"),
        ({"pipeline": [], "connections": {"c": {"type": "postgres", "dsn": "postgres://u:pw@h/db"}}}, "password"),
        ({"pipeline": [], "parameters": {"p": {}}}, "no type"),
        ({"pipeline": [], "parameters": {"p": {"type": "string", "required": True, "default": "x"}}}, "exclude each other"),
        ({"pipeline": [], "include": ["missing.yml"]}, "include not found"),
        ({"pipeline": [], "surprise": 2}, "unknown field"),
        ({"pipeline": [{"id": "a", "type": "dataflow", "steps": [ints(1), step("limit", n=1, extra=2)]}]}, "unknown field"),
    ],
)
def test_bad_documents(raw, needle):
    with pytest.raises(DocumentError, match=needle):
        from_text(json.dumps(raw), name="t.json")


def test_yaml_keeps_on_and_version_mark():
    d = from_text("mark: 1\nname: x\npipeline:\n  - id: s\n    type: dataflow\n    steps:\n      - {id: a, type: gen_int64, row_count: 1}\n      - {id: b, type: gen_int64, row_count: 1, column: r}\n      - {id: j, type: join, from: [a, b], on: {id: r}}\n")
    assert d.stages[0]["steps"][2]["on"] == {"id": "r"}


def test_control_flow(spark, tmp_path):
    out = tmp_path / "x"
    stages = [
        {"id": "last", "type": "file.delete", "path": f"{out}-c", "after": ["loop"]},
        {"id": "loop", "type": "foreach", "over": ["b", "c"], "as": "v", "body": [{"id": "touch", "type": "shell", "argv": ["touch", f"{out}-${{vars.v}}"]}]},
        {"id": "never", "type": "shell", "argv": ["false"], "condition": "no"},
        {"id": "bad", "type": "shell", "argv": ["false"], "on_failure": "continue"},
        {"id": "again", "type": "python.task", "function": "flaky", "on_failure": "retry", "retries": 2},
        {"id": "sql", "type": "sql.execute", "connection": "w", "sql": "SELECT 3 AS n", "expect": {"n": {"min": 3, "max": 3}}},
        {"id": "set", "type": "var.set", "name": "k", "connection": "w", "sql": "SELECT 5"},
    ]
    tries = []

    def flaky(runner):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    r = Runner(spark, from_text(json.dumps({"pipeline": stages, "connections": {"w": {"type": "spark"}}}), name="t.json"), functions={"flaky": flaky})
    log = dict(r.run())
    assert log["never"] == "skipped" and log["bad"] == "failed" and log["again"] == "done" and len(tries) == 3
    assert r.scope.vars == {"k": "5"} and (tmp_path / "x-b").exists() and not (tmp_path / "x-c").exists()


def test_parameters():
    d = from_text(json.dumps({"pipeline": [], "parameters": {"n": {"type": "int64", "default": "30"}, "p": {"type": "string", "required": True}}}), name="t.json")
    assert bind(d, {"p": "x"}) == {"n": "30", "p": "x"}
    with pytest.raises(DocumentError, match="required"):
        bind(d, {})
    with pytest.raises(DocumentError, match="undeclared"):
        bind(d, {"p": "x", "zz": "1"})
    with pytest.raises(DocumentError, match="is no int64"):
        bind(d, {"p": "x", "n": "abc"})


def test_order_is_by_declaration():
    assert order({"c": ["a"], "a": [], "b": []}) == ["a", "c", "b"]


def test_script_steps_and_error_port(spark):
    import pandas as pd

    def double(batches):
        for b in batches:
            yield b.assign(id=b.id * 2)

    def check(pdf):
        return pd.DataFrame({"id": pdf.id, "why": [None if i < 2 else "big" for i in pdf.id]})

    r = Runner(spark, doc([ints(3), step("python.map", function="double"), {"id": "end", "type": "count_rows", "from": "b"}]), functions={"double": double, "check": check})
    assert sorted(x[0] for x in r.frames([ints(3), step("python.map", function="double")])["b"].collect()) == [0, 2, 4]
    ports = r.frames([ints(4), step("python.script", function="check", output_schema="id long, why string", group_by=["id"], error_out="why")])
    assert ports["b:out"].count() == 2 and ports["b:error_out"].count() == 2


def test_failing_count_fails_the_stage(spark):
    with pytest.raises(StageFailed, match="expected 4 rows"):
        count(spark, [ints(3)], 4)
    with pytest.raises((StageFailed, PySparkException)):
        count(spark, [ints(3), step("map", add={"x": {"lang": "ssisexpr", "expr": "1 / (id - id)"}}), step("filter", id="c", frm="b", where={"lang": "sql", "expr": "x > 0"})], 3)


@pytest.mark.parametrize("kind", ["inner", "left", "right", "outer"])
def test_registered_whole_joins(spark, kind):
    from millrace.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    keys = [2 * r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    orders = [r.o_custkey for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    hits, alone, lost = sum(k in keys for k in orders), sum(k not in orders for k in keys), sum(k not in keys for k in orders)
    assert hits and alone and lost
    want = hits + (alone if kind in ("left", "outer") else 0) + (lost if kind in ("right", "outer") else 0)
    assert QUERIES[f"join_{kind}_whole"](spark, d).count() == want


@pytest.mark.parametrize("mode", ["update", "update_if_changed", "ignore", "error"])
def test_upsert_by_hand(spark, mode):
    from millrace.operators import relational as R

    old = [(1, "a", 10, "x"), (2, "b", None, "y"), (None, "n", 1, "z")]
    new = [(1, "A", 1), (1, "B", 2), (2, "b", 3), (3, "c", 1), (None, "m", 1), (None, "m", 1)] if mode != "error" else [(3, "c", 1), (None, "m", 1), (None, "m", 1)]
    target, incoming = spark.createDataFrame(old, "k long, s string, v long, extra string"), spark.createDataFrame(new, "k long, s string, n long").repartition(3)
    got = [tuple(r) for r in R.upsert(target, incoming, ["k"], mode, ["n"], ["k", "s"]).collect()]
    table = {r[0]: r for r in old if r[0] is not None}
    for k, s, _ in sorted((r for r in new if r[0] is not None), key=lambda r: r[2]):
        if k not in table:
            table[k] = (k, s, None, None)
        elif mode != "ignore":
            table[k] = (k, s, *table[k][2:])
    want = [*table.values(), old[2], (None, "m", None, None), (None, "m", None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    if mode == "error":
        for bad in ([(1, "a", 1)], [(5, "a", 1), (5, "b", 2)]):
            with pytest.raises(Exception, match="upsert: key"):
                R.upsert(target, spark.createDataFrame(bad, "k long, s string, n long"), ["k"], mode, ["n"], ["k", "s"]).collect()
