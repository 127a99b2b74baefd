"""Pipeline documents: loading with includes, parameters, substitution and validation that reports every problem."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from millrace.sources.files import load_json_or_yaml


class DocumentError(ValueError):
    """The document is not valid; .problems lists everything found."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class Document:
    name: str
    stages: list[dict]
    connections: dict[str, dict] = field(default_factory=dict)
    parameters: dict[str, dict] = field(default_factory=dict)
    base: str = "."


TOP = {"name", "description", "connections", "parameters", "pipeline", "include"}
STAGE = {"id", "type", "after", "on_failure", "retries", "retry_backoff", "timeout", "condition", "description"}
STEP = {"id", "type", "from", "description"}
#: Fields of each component besides those of every step; required ones in upper case first.
COMPONENTS: dict[str, tuple[set[str], set[str]]] = {
    "csv.read": ({"path"}, {"delimiter", "header", "batch_size", "encoding", "schema", "multiline"}), "json.read": ({"path", "columns"}, {"format"}), "xml.read": ({"path", "row_xpath", "columns"}, set()), "xlsx.read": ({"path"}, {"sheet", "header", "columns"}),
    "parquet.read": ({"path"}, {"columns"}), "gen_int64": ({"row_count"}, {"start", "column", "batch_size"}), "gen_strings": ({"row_count"}, {"prefix", "id_column", "name_column", "batch_size"}), "db.read": ({"connection", "query"}, {"batch_size", "partition"}),
    "csv.write": ({"path"}, {"delimiter", "header", "encoding"}), "json.write": ({"path"}, {"format"}), "xlsx.write": ({"path"}, {"sheet", "header"}), "parquet.write": ({"path"}, {"mode", "partition_by"}), "count_rows": (set(), {"expect"}),
    "db.upsert": ({"connection", "table", "key"}, {"on_conflict", "columns", "batch_size", "order_by"}), "db.append": ({"connection", "table"}, {"columns", "truncate", "batch_size", "mode"}), "db.exec": ({"connection", "sql"}, {"parameters"}),
    "filter": ({"where"}, set()), "map": (set(), {"add", "select"}), "audit": ({"columns"}, set()), "split": ({"cases"}, {"default"}), "multicast": ({"taps"}, set()), "limit": ({"n"}, set()), "sort": ({"by"}, set()), "union": (set(), set()),
    "unpivot": ({"id_cols", "value_cols", "name_col", "value_col"}, set()), "pivot": ({"id_cols", "name_col", "value_col", "pivot_keys"}, {"order_by"}), "join": ({"on"}, {"kind", "left", "right"}), "lookup": ({"connection", "table", "match", "select"}, {"on_miss"}),
    "aggregate": ({"compute"}, {"group_by", "order_by"}), "distinct": (set(), {"keys", "by", "order_by"}), "python.map": (set(), {"function", "script"}), "python.script": ({"function", "output_schema"}, {"group_by", "order_by", "error_out"}), "scd2": ({"connection", "table", "key", "tracked", "batch"}, set()),
}
TASKS: dict[str, tuple[set[str], set[str]]] = {
    "dataflow": ({"steps"}, set()), "foreach": ({"as", "body"}, {"over", "over_glob", "over_query", "connection"}), "sql.execute": ({"connection"}, {"sql", "file", "params", "expect"}), "var.set": ({"name"}, {"value", "connection", "sql"}),
    "shell": ({"argv"}, {"stdout", "stderr"}), "file.copy": ({"src", "dst"}, set()), "file.move": ({"src", "dst"}, set()), "file.delete": ({"path"}, set()), "http.get": ({"url"}, {"save_to", "headers"}),
    "http.post": ({"url"}, {"save_to", "headers", "body", "body_file", "body_json"}), "http": ({"url"}, {"method", "save_to", "headers", "body", "body_file", "body_json"}), "smtp.send": ({"host", "from", "to", "subject"}, {"port", "body", "cc", "username", "password"}), "python.task": ({"function"}, set()),
}
SOURCES = {"csv.read", "json.read", "xml.read", "xlsx.read", "parquet.read", "gen_int64", "gen_strings", "db.read"}
SINKS = {"csv.write", "json.write", "xlsx.write", "parquet.write", "count_rows", "db.upsert", "db.append", "scd2"}
SPLITS = {"split", "multicast"}
#: What runs each component: step handlers take (runner, step, inputs) and give a DataFrame, or a dict of them by port; sinks take (runner, step, frame).
HANDLERS: dict[str, Callable] = {}
_DB = {"read": "db.read", "query": "db.read", "upsert": "db.upsert", "copy": "db.append", "bulkinsert": "db.append", "lookup": "lookup", "exec": "db.exec"}
_ALIASES = {"conditional_split": "split", "lua.map": "python.map", "lua.script": "python.script", "lua.task": "python.task"}
_SUBST = re.compile(r"\$\{(\w+)\.([\w.-]+)\}")


def component(name: str, kind: str = "transform", required: Iterable[str] = (), optional: Iterable[str] = ()) -> Callable:
    """Registers a component under a type name, with the fields that a document may give it. kind: source, transform or sink."""
    if kind not in ("source", "transform", "sink"):
        raise ValueError(f"{kind!r} is no kind of component")

    def register(f: Callable) -> Callable:
        if name in HANDLERS:
            raise ValueError(f"component {name} is there already")
        COMPONENTS.setdefault(name, (set(required), set(optional)))
        {"source": SOURCES, "sink": SINKS}.get(kind, set()).add(name)
        HANDLERS[name] = f
        return f

    return register


def canonical(kind: str) -> str:
    """The component or task behind a type name: databases share theirs, and a namespace before a generator or counter is optional."""
    if kind in COMPONENTS or kind in TASKS:
        return kind
    if kind in _ALIASES:
        return _ALIASES[kind]
    space, _, rest = kind.partition(".")
    if space in ("postgres", "mssql", "jdbc", "spark") and rest in _DB:
        return _DB[rest]
    return rest if rest in ("gen_int64", "gen_strings", "count_rows") else kind


def load(path: str, _seen: tuple[str, ...] = (), _done: dict[str, Any] | None = None) -> Document:
    """Reads a document and what it includes. Raises DocumentError with all problems."""
    doc, problems = _read(os.path.abspath(path), (), {})
    problems += validate(doc)
    if problems:
        raise DocumentError(problems)
    return doc


def from_text(text: str, base: str = ".", name: str = "inline.yml") -> Document:
    raw = load_json_or_yaml(text, name)
    doc, problems = _built(raw, base, (), {}, name)
    problems += validate(doc)
    if problems:
        raise DocumentError(problems)
    return doc


def _read(path: str, chain: tuple[str, ...], done: dict[str, dict]) -> tuple[Document, list[str]]:
    if path in chain:
        return Document("", []), [f"include cycle through {os.path.basename(path)}"]
    if not os.path.isfile(path):
        return Document("", []), [f"include not found: {path}"]
    with open(path, encoding="utf-8") as f:
        raw = load_json_or_yaml(f.read(), path)
    return _built(raw, os.path.dirname(path), (*chain, path), done, os.path.basename(path))


def _built(raw: Any, base: str, chain: tuple[str, ...], done: dict, name: str) -> tuple[Document, list[str]]:
    if not isinstance(raw, dict):
        return Document("", []), [f"{name}: the document must be a mapping"]
    problems: list[str] = []
    unknown = [k for k in raw if k not in TOP]
    bundle = len(unknown) == 1 and str(unknown[0]).endswith("_connections")
    if bundle:
        unknown = []
        if "pipeline" in raw:
            problems.append(f"{name}: a connection bundle may hold only connections")
        if not chain[:-1]:
            problems.append(f"{name}: a connection bundle can only be included")
    marks = [k for k in unknown if raw[k] == 1 and isinstance(raw[k], int)]
    problems += [f"{name}: unknown field {k}" for k in unknown if k not in marks[:1]]
    doc = Document(str(raw.get("name", "")), raw.get("pipeline") or [], dict(raw.get("connections") or {}), dict(raw.get("parameters") or {}), base)
    if "pipeline" not in raw and not bundle and len(chain) <= 1:
        problems.append(f"{name}: no pipeline")
    for inc in raw.get("include") or []:
        full = os.path.abspath(os.path.join(base, inc))
        if full in done:
            continue
        sub, more = _read(full, chain, done)
        problems += more
        done[full] = sub
        for kind in ("connections", "parameters"):
            for k, v in getattr(sub, kind).items():
                if k in getattr(doc, kind):
                    problems.append(f"{name}: {kind[:-1]} {k} is defined twice")
                getattr(doc, kind)[k] = v
        doc.stages = [*sub.stages, *doc.stages]
    return doc, problems


def _cycle(nodes: dict[str, list[str]]) -> list[str]:
    """Nodes left after taking away those without open predecessors."""
    left = {k: set(v) & set(nodes) for k, v in nodes.items()}
    while ready := [k for k, v in left.items() if not v]:
        for k in ready:
            del left[k]
        for v in left.values():
            v -= set(ready)
    return sorted(left)


def order(nodes: dict[str, list[str]]) -> list[str]:
    """Topological order; of those that are ready the first declared goes first."""
    left, out = dict(nodes), []
    while left:
        k = next(k for k, v in left.items() if all(d in out or d not in nodes for d in v))
        out.append(k)
        del left[k]
    return out


def sources_of(step: dict) -> list[str]:
    got = step.get("from")
    refs = [got] if isinstance(got, str) else list(got or [])
    return refs or [step[k] for k in ("left", "right") if k in step]


def validate(doc: Document) -> list[str]:
    out: list[str] = []
    for n, c in doc.connections.items():
        if not isinstance(c, dict) or "type" not in c:
            out.append(f"connection {n}: no type")
        elif c["type"] != "spark" and "dsn" not in c:
            out.append(f"connection {n}: no dsn")
        elif re.match(r"^\w+://[^/@\s]+:[^/@\s]+@", str(c.get("dsn", ""))) and "${" not in str(c.get("dsn")):
            out.append(f"connection {n}: the dsn holds a password; use ${{env.NAME}}")
    for n, p in doc.parameters.items():
        if not isinstance(p, dict) or "type" not in p:
            out.append(f"parameter {n}: no type")
        elif p.get("required") and "default" in p:
            out.append(f"parameter {n}: required and default exclude each other")
    _stages(doc, doc.stages, out)
    return out


def _stages(doc: Document, stages: list[dict], out: list[str]) -> None:
    if not isinstance(stages, list):
        out.append("pipeline must be a list")
        return
    ids = [s.get("id") for s in stages if isinstance(s, dict)]
    for s in stages:
        at = f"stage {s.get('id')}"
        if "id" not in s or "type" not in s:
            out.append(f"{at}: needs id and type")
            continue
        if ids.count(s["id"]) > 1:
            out.append(f"duplicate stage id {s['id']}")
        kind = canonical(s["type"])
        if kind not in TASKS:
            out.append(f"{at}: unknown task type {s['type']}")
            continue
        _fields(at, s, STAGE, TASKS[kind], out)
        for a in s.get("after") or []:
            if a == s["id"]:
                out.append(f"{at}: comes after itself")
            elif a not in ids:
                out.append(f"{at}: after unknown stage {a}")
        if s.get("on_failure", "stop") not in ("stop", "continue", "retry"):
            out.append(f"{at}: on_failure is stop, continue or retry")
        if s.get("connection") is not None and s["connection"] not in doc.connections:
            out.append(f"{at}: unknown connection {s['connection']}")
        if kind == "dataflow":
            _steps(doc, at, s.get("steps") or [], out)
        if kind == "foreach":
            if sum(k in s for k in ("over", "over_glob", "over_query")) != 1:
                out.append(f"{at}: exactly one of over, over_glob, over_query")
            _stages(doc, s.get("body") or [], out)
    loop = _cycle({s["id"]: s.get("after") or [] for s in stages if "id" in s})
    if loop:
        out.append(f"stage cycle: {', '.join(loop)}")


def _fields(at: str, x: dict, common: set[str], own: tuple[set[str], set[str]], out: list[str]) -> None:
    need, may = own
    out += [f"{at}: missing {k}" for k in sorted(need) if k not in x]
    out += [f"{at}: unknown field {k}" for k in x if k not in common | need | may]


def _steps(doc: Document, at: str, steps: list[dict], out: list[str]) -> None:
    if not steps:
        out.append(f"{at}: dataflow has no steps")
        return
    ids, kinds = [s.get("id") for s in steps], {}
    for s in steps:
        here = f"{at}, step {s.get('id')}"
        if "id" not in s or "type" not in s:
            out.append(f"{here}: needs id and type")
            continue
        if ids.count(s["id"]) > 1:
            out.append(f"{here}: duplicate step id {s['id']}")
        kind = kinds[s["id"]] = canonical(s["type"])
        if kind not in COMPONENTS:
            out.append(f"{here}: unknown component type {s['type']}")
            continue
        _fields(here, s, STEP, COMPONENTS[kind], out)
        if s.get("connection") is not None and s["connection"] not in doc.connections:
            out.append(f"{here}: unknown connection {s['connection']}")
        refs = sources_of(s)
        if kind in SOURCES and refs:
            out.append(f"{here}: a source has no from")
        if kind not in SOURCES and not refs:
            out.append(f"{here}: needs from")
        if kind == "join" and refs and len(refs) != 2:
            out.append(f"{here}: join takes two inputs")
        if kind == "python.map" and ("function" in s) == ("script" in s):
            out.append(f"{here}: takes either function or script")
        if kind == "map" and ("add" in s) == ("select" in s):
            out.append(f"{here}: map takes either add or select")
        if kind == "map" and not (s.get("add") or s.get("select")):
            out.append(f"{here}: map has no columns")
        if kind == "split" and not s.get("cases"):
            out.append(f"{here}: split has no cases")
        for r in refs:
            if str(r).split(":")[0] not in ids:
                out.append(f"{here}: from unknown step {r}")
    loop = _cycle({s["id"]: [r.split(":")[0] for r in sources_of(s)] for s in steps if "id" in s})
    if loop:
        out.append(f"{at}: step cycle: {', '.join(loop)}")
    ports = {s["id"]: [c["name"] for c in s.get("cases") or []] + ([s["default"]] if s.get("default") else []) + list(s.get("taps") or []) for s in steps if "id" in s}
    for s in steps:
        for r in sources_of(s):
            step, _, port = str(r).partition(":")
            if kinds.get(step) in SPLITS and port not in ports[step]:
                out.append(f"{at}, step {s.get('id')}: {step} has no port {port or '(none given)'}")


def bind(doc: Document, given: dict[str, str]) -> dict[str, str]:
    """Parameter values as text: given ones, else defaults; today and now are frozen once a run."""
    problems = [f"undeclared parameter {k}" for k in given if k not in doc.parameters]
    now = datetime.datetime.now()
    out = {}
    for n, p in doc.parameters.items():
        if n in given:
            v = str(given[n])
        elif "default" in p:
            v = {"today": now.date().isoformat(), "now": now.replace(microsecond=0).isoformat()}.get(p["default"], p["default"])
            v = str(v).lower() if isinstance(v, bool) else str(v)
        elif p.get("required"):
            problems.append(f"parameter {n} is required")
            continue
        else:
            continue
        shape = {"int64": r"[+-]?\d+", "int32": r"[+-]?\d+", "float64": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "bool": r"(?i)true|false|1|0", "date": r"\d{4}-\d{2}-\d{2}"}.get(p.get("type", "string"))
        if shape and not re.fullmatch(shape, v):
            problems.append(f"parameter {n}: {v!r} is no {p['type']}")
        out[n] = v
    if problems:
        raise DocumentError(problems)
    return out


def substituted(x: Any, params: dict[str, str], variables: dict[str, str]) -> Any:
    """${env.X}, ${params.X} and ${vars.X} in parsed values; unknown prefixes pass, unknown names are errors."""
    if isinstance(x, dict):
        return {k: substituted(v, params, variables) for k, v in x.items()}
    if isinstance(x, list):
        return [substituted(v, params, variables) for v in x]
    if not isinstance(x, str):
        return x

    def one(m: re.Match) -> str:
        space = {"env": os.environ, "params": params, "vars": variables}.get(m[1])
        if space is None:
            return m[0]
        if m[2] not in space:
            raise DocumentError([f"{m[0]} is not set"])
        return str(space[m[2]])

    return _SUBST.sub(one, x)
