"""Runs pipeline documents: stages in order on the driver, each data flow as one lazy plan a sink."""

from __future__ import annotations

import functools
import glob
import importlib
import json
import os
import re
import shutil
import signal
import smtplib
import subprocess
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from email.message import EmailMessage
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.engines import Scope, compile_expression
from millrace.functions.script import compile_row_script
from millrace.operators import relational as R
from millrace.plans.document import HANDLERS, SINKS, Document, bind, canonical, component, order, sources_of, substituted
from millrace.sources import files, jdbc


class StageFailed(RuntimeError):
    pass


class Runner:
    """functions: Python callables that python.map, python.script and python.task may name."""

    def __init__(self, spark: SparkSession, doc: Document, params: dict[str, str] | None = None, functions: dict[str, Callable] | None = None):
        self.spark, self.doc, self.functions = spark, doc, functions or {}
        self.scope = Scope(bind(doc, params or {}), {})
        self.log: list[tuple[str, str]] = []

    # ---- control flow ------------------------------------------------------------------------------------------

    def run(self) -> list[tuple[str, str]]:
        """Runs all stages; returns (stage, done | skipped | failed)."""
        self._stages(self.doc.stages)
        return self.log

    def _stages(self, stages: list[dict]) -> None:
        by = {s["id"]: s for s in stages}
        for k in order({s["id"]: s.get("after") or [] for s in stages}):
            s = by[k]
            if "condition" in s and not self._condition(s["condition"]):
                self.log.append((k, "skipped"))
                continue
            tries = 1 + int(s.get("retries", 0)) if s.get("on_failure") == "retry" else 1
            waits = [_seconds(w) for w in str(s.get("retry_backoff", "0s")).split(",")]
            for t in range(tries):
                try:
                    self._timed(s)
                    self.log.append((k, "done"))
                    break
                except Exception as e:
                    if t + 1 < tries:
                        time.sleep(waits[min(t, len(waits) - 1)])
                        continue
                    self.log.append((k, "failed"))
                    if s.get("on_failure") == "continue":
                        break
                    raise StageFailed(f"stage {k}: {e}") from e

    def _timed(self, stage: dict) -> None:
        if "timeout" not in stage:
            return self._task(stage)
        group = f"stage-{stage['id']}-{time.time_ns()}"

        def work() -> None:
            self.spark.sparkContext.setJobGroup(group, stage["id"], interruptOnCancel=True)
            self._task(stage)

        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(work).result(_seconds(stage["timeout"]))
        except (TimeoutError, subprocess.TimeoutExpired):
            self.spark.sparkContext.cancelJobGroup(group)
            raise StageFailed(f"took longer than {stage['timeout']}") from None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _condition(self, cond: Any) -> bool:
        if isinstance(cond, dict):
            row = self.spark.range(1)
            got = row.select(compile_expression(substituted(cond, self.scope.params, self.scope.vars), row.drop("id").schema, self.scope, predicate=True)).first()
            return bool(got[0])
        text = str(substituted(cond, self.scope.params, self.scope.vars))
        if text in ("true", "True", "TRUE", "yes", "YES", "1"):
            return True
        if text in ("false", "False", "FALSE", "no", "NO", "0", ""):
            return False
        raise R.OperatorError(f"condition {text!r} is neither true nor false")

    def _task(self, stage: dict) -> None:
        kind = canonical(stage["type"])
        if kind == "foreach":
            return self._foreach(stage)
        s = substituted(stage, self.scope.params, self.scope.vars)
        if kind == "dataflow":
            return self._dataflow(s["steps"])
        getattr(self, "_" + kind.replace(".", "_"))(s)

    def _foreach(self, stage: dict) -> None:
        head = substituted({k: v for k, v in stage.items() if k != "body"}, self.scope.params, self.scope.vars)
        if "over" in head:
            values = [str(v) for v in head["over"]]
        elif "over_glob" in head:
            values = sorted(glob.glob(head["over_glob"]))
        else:
            values = ["" if r[0] is None else str(r[0]) for r in files.read_jdbc(self.spark, self._connection(head), head["over_query"]).toLocalIterator()]
        had, old = head["as"] in self.scope.vars, self.scope.vars.get(head["as"])
        try:
            for v in values:
                self.scope.vars[head["as"]] = v
                self._stages(stage["body"])
        finally:
            if had:
                self.scope.vars[head["as"]] = old
            else:
                self.scope.vars.pop(head["as"], None)

    def _connection(self, x: dict) -> dict:
        return substituted(self.doc.connections[x["connection"]], self.scope.params, self.scope.vars)

    # ---- tasks -------------------------------------------------------------------------------------------------

    def _sql_execute(self, s: dict) -> None:
        sql = s.get("sql")
        if sql is None:
            with open(os.path.join(self.doc.base, s["file"]), encoding="utf-8") as f:
                sql = f.read()
        conn = self._connection(s)
        if conn.get("type") != "spark":
            return self._jdbc_statement(conn, sql)
        got = self.spark.sql(sql, args=s.get("params") or None)
        if "expect" in s:
            expect = dict(s["expect"])
            every = expect.pop("row", None) == "all"
            if not (rows := got.take(1)):
                raise R.OperatorError("expect: the query returned no rows")
            if every:  # a row that breaks one of them, if there is any
                for col, want in expect.items():
                    rows += got.filter(~F.coalesce(_expectation(F.col(f"`{col}`"), want), F.lit(False))).take(1)
            for row in rows:
                for col, want in expect.items():
                    if not _expected(row[col], want):
                        raise R.OperatorError(f"expect: {col} is {row[col]!r}, wanted {want!r}")

    def _jdbc_statement(self, conn: dict, sql: str) -> None:
        jdbc.execute(self.spark, files.jdbc_url(conn), [sql])

    def _var_set(self, s: dict) -> None:
        if "value" in s:
            self.scope.vars[s["name"]] = str(s["value"])
            return
        row = files.read_jdbc(self.spark, self._connection(s), s["sql"]).first()
        if row is None or row[0] is None:
            self.scope.vars.pop(s["name"], None)
        else:
            self.scope.vars[s["name"]] = str(row[0])

    def _shell(self, s: dict) -> None:
        work = subprocess.Popen([str(a) for a in s["argv"]], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True)
        try:
            _, said = work.communicate(timeout=_seconds(s["timeout"]) if "timeout" in s else None)
        except subprocess.TimeoutExpired:
            os.killpg(work.pid, signal.SIGKILL)  # what it has started too
            work.wait()
            raise
        if work.returncode:
            raise R.OperatorError(f"shell: exit code {work.returncode}: {said.strip()[-500:]}")

    def _file_copy(self, s: dict) -> None:
        shutil.copyfile(s["src"], s["dst"])

    def _file_move(self, s: dict) -> None:
        shutil.move(s["src"], s["dst"])

    def _file_delete(self, s: dict) -> None:
        os.remove(s["path"])

    def _http(self, s: dict) -> None:
        body = s.get("body")
        headers = dict(s.get("headers") or {})
        if "body_json" in s:
            body, headers["Content-Type"] = json.dumps(s["body_json"]), "application/json"
        if "body_file" in s:
            with open(s["body_file"], "rb") as f:
                body = f.read()
        data = body.encode() if isinstance(body, str) else body
        req = urllib.request.Request(s["url"], data=data, headers=headers, method=s.get("method") or {"http.get": "GET", "http.post": "POST"}.get(canonical(s["type"]), "GET" if data is None else "POST"))
        with urllib.request.urlopen(req, timeout=min(_seconds(s.get("timeout", "60s")), 3600)) as r:
            got = r.read()
        if "save_to" in s:
            with open(s["save_to"], "wb") as f:
                f.write(got)

    _http_get = _http_post = _http

    def _smtp_send(self, s: dict) -> None:
        m = EmailMessage()
        m["From"], m["To"], m["Subject"] = s["from"], s["to"] if isinstance(s["to"], str) else ", ".join(s["to"]), s["subject"]
        if s.get("cc"):
            m["Cc"] = s["cc"] if isinstance(s["cc"], str) else ", ".join(s["cc"])
        m.set_content(s.get("body", ""))
        with smtplib.SMTP(s["host"], int(s.get("port", 25)), timeout=60) as server:
            if s.get("username"):
                server.starttls()
                server.login(s["username"], s.get("password", ""))
            server.send_message(m)

    def _python_task(self, s: dict) -> None:
        self._function(s["function"])(self)

    def _function(self, name: str) -> Callable:
        if name in self.functions:
            return self.functions[name]
        module, _, attr = name.rpartition(".")
        if not module:
            raise R.OperatorError(f"unknown function {name}")
        return getattr(importlib.import_module(module), attr)

    # ---- data flow ---------------------------------------------------------------------------------------------

    def frames(self, steps: list[dict]) -> dict[str, DataFrame]:
        """The DataFrame of each port of the steps (name or name:port), sinks left out. Runs nothing."""
        by = {s["id"]: s for s in steps}
        ports: dict[str, DataFrame] = {}
        for k in order({s["id"]: [r.split(":")[0] for r in sources_of(s)] for s in steps}):
            s, kind = by[k], canonical(by[k]["type"])
            if kind in SINKS:
                continue
            got = self._step(kind, s, [ports[r] for r in sources_of(s)])
            if isinstance(got, dict):
                ports |= {f"{k}:{p}": d for p, d in got.items()}
            else:
                ports[k] = got
        return ports

    def _dataflow(self, steps: list[dict]) -> None:
        used = [r for s in steps for r in sources_of(s)]
        shared = {s["id"] for s in steps if canonical(s["type"]) in ("split", "multicast") and sum(r.split(":")[0] == s["id"] for r in used) > 1}
        fed = {r.split(":")[0] for s in steps if s["id"] in shared for r in sources_of(s)}
        held: list[DataFrame] = []
        original = self._step

        def step(kind: str, s: dict, inputs: list[DataFrame]) -> Any:
            out = original(kind, s, inputs)
            if s["id"] in fed and isinstance(out, DataFrame) and sum(canonical(x["type"]) in SINKS for x in steps) > 1:
                out = out.persist()
                held.append(out)
            return out

        self._step = step  # what several sinks read through a split is computed once
        try:
            ports = self.frames(steps)
            for s in steps:
                if canonical(s["type"]) in SINKS:
                    self._sink(canonical(s["type"]), s, ports[sources_of(s)[0]])
        finally:
            self._step = original
            for d in held:
                d.unpersist()

    def _path(self, p: str) -> str:
        return p if re.match(r"^(/|\w+:)", p) else os.path.join(os.path.abspath(self.doc.base), p)

    def _step(self, kind: str, s: dict, i: list[DataFrame]) -> Any:
        if kind not in HANDLERS:
            raise R.OperatorError(f"unknown component {kind}")
        return HANDLERS[kind](self, s, i)

    def _script(self, s: dict, df: DataFrame) -> Any:
        """A generator over pandas batches; by key if group_by is given (that scales), else in one ordered stream."""
        f, schema = self._function(s["function"]), s["output_schema"]
        if s.get("group_by"):
            by = s.get("order_by") or []
            out = df.groupBy(*s["group_by"]).applyInPandas(lambda pdf: f(pdf.sort_values(by) if by else pdf), schema)
        else:
            out = (df.orderBy(*s["order_by"]) if s.get("order_by") else df).coalesce(1).mapInPandas(f, schema)
        if not s.get("error_out"):
            return out
        return {"out": out.filter(F.col(s["error_out"]).isNull()).drop(s["error_out"]), "error_out": out.filter(F.col(s["error_out"]).isNotNull())}

    def _exec(self, s: dict, df: DataFrame) -> DataFrame:
        """A statement for each row, all in one transaction while the flow is put together, and the rows on. On JDBC connections only; on the catalog use upsert or scd2."""
        conn = self._connection(s)
        if conn.get("type") == "spark":
            raise R.OperatorError("exec: the catalog has no row statements; use upsert or scd2")
        sql, names = re.sub(r"\$\d+", "?", s["sql"]), s.get("parameters") or []
        jdbc.execute_rows(self.spark, files.jdbc_url(conn), sql, df.select(*names).toLocalIterator())
        return df

    def _table(self, s: dict) -> DataFrame:
        conn = self._connection(s)
        return self.spark.table(s["table"]) if conn.get("type") == "spark" else self.spark.read.format("jdbc").option("url", files.jdbc_url(conn)).option("dbtable", jdbc.quoted(s["table"], files.jdbc_url(conn))).load()

    def _sink(self, kind: str, s: dict, df: DataFrame) -> None:
        HANDLERS[kind](self, s, df)

    def _count(self, s: dict, df: DataFrame) -> None:
        n = df.count()
        self.log.append((s["id"], f"{n} rows"))
        if "expect" in s and n != int(s["expect"]):
            raise R.OperatorError(f"count_rows: expected {s['expect']} rows, got {n}")

    def _python_map(self, s: dict, df: DataFrame) -> DataFrame:
        if "script" in s:
            return df.select(*compile_row_script(s["script"], df.schema, self.scope.params))
        return df.mapInPandas(self._function(s["function"]), df.schema)

    def _store(self, kind: str, s: dict, df: DataFrame) -> None:
        conn = self._connection(s)
        if kind == "db.append":
            rows = df.select(*s["columns"]) if s.get("columns") else df
            if conn.get("type") == "spark":
                rows.write.mode("overwrite" if s.get("truncate") else "append").saveAsTable(s["table"])
            else:
                jdbc.append(rows, files.jdbc_url(conn), s["table"], int(s.get("batch_size", 10000)), bool(s.get("truncate")))
            return
        if conn.get("type") != "spark":
            if kind == "scd2":
                raise R.OperatorError("scd2 writes to catalog tables only")
            return jdbc.upsert(df, files.jdbc_url(conn), s["table"], s["key"], s.get("on_conflict", "update"), s.get("order_by", ()), s.get("columns"), int(s.get("batch_size", 10000)))
        old = self.spark.table(s["table"])
        if kind == "db.upsert":
            new = R.upsert(old, df, s["key"], s.get("on_conflict", "update"), s.get("order_by", ()), s.get("columns"))
        else:
            new = R.scd2(old, df, s["key"], s["tracked"], F.lit(s["batch"]).cast("timestamp"))
        side = f"{s['table']}__next"
        new.write.mode("overwrite").saveAsTable(side)  # the old table is read meanwhile
        self.spark.table(side).write.mode("overwrite").insertInto(s["table"], overwrite=True)
        self.spark.sql(f"DROP TABLE {side}")


def _seconds(text: str) -> float:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)?\s*", str(text))
    if not m:
        raise R.OperatorError(f"{text!r} is no duration")
    return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600, None: 1}[m[2]]


def _expected(value: Any, want: Any) -> bool:
    if not isinstance(want, dict):
        return value == want
    checks = {"min": lambda w: value is not None and value >= w, "max": lambda w: value is not None and value <= w, "between": lambda w: value is not None and w[0] <= value <= w[1], "not_null": lambda w: (value is not None) == bool(w), "one_of": lambda w: value in w}
    return all(checks[k](w) for k, w in want.items())


def _expectation(c: Column, want: Any) -> Column:
    """What _expected says, as a column."""
    if not isinstance(want, dict):
        return c.isNull() if want is None else c == F.lit(want)
    made = {"min": lambda w: c >= F.lit(w), "max": lambda w: c <= F.lit(w), "between": lambda w: c.between(F.lit(w[0]), F.lit(w[1])), "not_null": lambda w: c.isNotNull() == F.lit(bool(w)), "one_of": lambda w: c.isin(w)}
    return functools.reduce(lambda a, b: a & b, (made[k](w) for k, w in want.items()), F.lit(True))


def _parquet(r: Runner, s: dict, _: list[DataFrame]) -> DataFrame:
    df = r.spark.read.parquet(r._path(s["path"]))
    return df.select(*s["columns"]) if s.get("columns") else df


#: The components that are there from the start.
for _name, _made in {
    "csv.read": lambda r, s, i: files.read_csv(r.spark, r._path(s["path"]), (s.get("schema") or {}).get("columns"), s.get("delimiter", ","), s.get("header", True), s.get("encoding", "utf-8"), s.get("multiline", True)),
    "json.read": lambda r, s, i: files.read_json(r.spark, r._path(s["path"]), s["columns"], s.get("format", "ndjson")),
    "xml.read": lambda r, s, i: files.read_xml(r.spark, r._path(s["path"]), s["row_xpath"], s["columns"]),
    "xlsx.read": lambda r, s, i: files.read_xlsx(r.spark, r._path(s["path"]), s.get("columns"), s.get("sheet"), s.get("header", True)),
    "parquet.read": _parquet,
    "gen_int64": lambda r, s, i: files.generate_ints(r.spark, int(s["row_count"]), int(s.get("start", 0)), s.get("column", "id")),
    "gen_strings": lambda r, s, i: files.generate_strings(r.spark, int(s["row_count"]), s.get("prefix", "row_"), s.get("id_column", "id"), s.get("name_column", "name")),
    "db.read": lambda r, s, i: files.read_jdbc(r.spark, r._connection(s), s["query"], int(s.get("batch_size", 1024)), s.get("partition")),
    "filter": lambda r, s, i: R.filter_rows(i[0], s["where"], r.scope),
    "map": lambda r, s, i: R.map_add(i[0], s["add"], r.scope) if "add" in s else R.map_select(i[0], s["select"], r.scope),
    "audit": lambda r, s, i: R.audit(i[0], s["columns"]),
    "split": lambda r, s, i: R.split_rows(i[0], s["cases"], s.get("default"), r.scope),
    "multicast": lambda r, s, i: R.multicast(i[0], s["taps"]),
    "limit": lambda r, s, i: R.limit_rows(i[0], s["n"]),
    "sort": lambda r, s, i: R.sort(i[0], s["by"]),
    "union": lambda r, s, i: R.union(i),
    "unpivot": lambda r, s, i: R.unpivot(i[0], s["id_cols"], s["value_cols"], s["name_col"], s["value_col"]),
    "pivot": lambda r, s, i: R.pivot(i[0], s["id_cols"], s["name_col"], s["value_col"], s["pivot_keys"], s.get("order_by", ())),
    "join": lambda r, s, i: R.join(i[0], i[1], s["on"], s.get("kind", "inner")),
    "lookup": lambda r, s, i: R.lookup(i[0], r._table(s), s["match"], s["select"], s.get("on_miss", "error")),
    "aggregate": lambda r, s, i: R.aggregate(i[0], s.get("group_by") or [], s["compute"], s.get("order_by", ())),
    "distinct": lambda r, s, i: R.distinct(i[0], s.get("keys") or s.get("by"), s.get("order_by", ())),
    "python.map": lambda r, s, i: r._python_map(s, i[0]),
    "python.script": lambda r, s, i: r._script(s, i[0]),
    "db.exec": lambda r, s, i: r._exec(s, i[0]),
    "count_rows": lambda r, s, df: r._count(s, df),
    "csv.write": lambda r, s, df: files.write_csv(df, r._path(s["path"]), s.get("delimiter", ","), s.get("header", True), s.get("encoding", "utf-8")),
    "json.write": lambda r, s, df: files.write_json(df, r._path(s["path"]), s.get("format", "ndjson")),
    "xlsx.write": lambda r, s, df: files.write_xlsx(df, r._path(s["path"]), s.get("sheet", "Sheet1"), s.get("header", True)),
    "parquet.write": lambda r, s, df: df.write.mode(s.get("mode", "overwrite")).partitionBy(*s.get("partition_by", [])).parquet(r._path(s["path"])),
    "db.append": lambda r, s, df: r._store("db.append", s, df),
    "db.upsert": lambda r, s, df: r._store("db.upsert", s, df),
    "scd2": lambda r, s, df: r._store("scd2", s, df),
}.items():
    component(_name)(_made)
