"""Expression engines by the name given as lang; each turns a source text over a schema into a Column."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.script import compile_script, truth
from millrace.functions.typed import ExpressionError, compile_typed

#: Output types as single letters and as logical names.
TYPES = {
    "l": "bigint", "L": "decimal(20,0)", "c": "tinyint", "C": "smallint", "s": "smallint", "S": "int", "i": "int", "I": "bigint", "f": "float", "g": "double", "u": "string", "b": "boolean", "z": "binary", "tdD": "date", "tsu:": "timestamp_ntz", "tsu:UTC": "timestamp",
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "double": "double", "float": "float",
    "bool": "boolean", "boolean": "boolean", "string": "string", "utf8": "string", "binary": "binary", "date": "date", "date32": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string", "time": "bigint",
}
LANGS = ("literal", "lua", "python", "ssisexpr", "sql")


def spark_type(name: str) -> str:
    if name in TYPES:
        return TYPES[name]
    low = name.replace(" ", "").lower()
    if low.startswith("d:"):
        return f"decimal({low[2:]})"
    if low.startswith(("decimal128(", "decimal(")):
        return "decimal" + low[low.index("(") :]
    if low.startswith("timestamp["):
        return "timestamp" if "," in low else "timestamp_ntz"
    raise ExpressionError(f"unknown type {name!r}")


@dataclass
class Scope:
    """What expressions see besides columns."""

    params: dict[str, str] = field(default_factory=dict)
    vars: dict[str, str] = field(default_factory=dict)

    @property
    def all(self) -> dict[str, str]:
        return {**self.params, **self.vars}


def compile_expression(spec: Any, schema: T.StructType, scope: Scope, default_lang: str = "lua", to: str | None = None, predicate: bool = False) -> Column:
    """spec: a source text in the default language, a scalar, or {lang, expr | value}. predicate: the value as true or not."""
    if not isinstance(spec, dict):
        spec = {"lang": default_lang, "expr": spec} if isinstance(spec, str) else {"lang": "literal", "value": spec}
    lang = spec.get("lang", "literal" if "value" in spec and "expr" not in spec else default_lang)
    source = spec.get("expr", spec.get("value"))
    if lang not in LANGS:
        raise ExpressionError(f"unknown lang {lang!r}; there are {', '.join(LANGS)}")
    if source is None:
        raise ExpressionError("an expression needs expr or value")
    if lang == "literal":
        col = _literal(source, "boolean" if predicate else to)
    elif lang == "sql":
        col = F.expr(str(source))
    elif lang == "python":
        return _python(str(source), schema, "boolean" if predicate else to or "string")
    elif lang == "ssisexpr":
        col, kind = compile_typed(str(source), schema, scope.all)
        if predicate and kind not in ("bool", "null"):
            raise ExpressionError("a condition must be boolean")
    else:
        v = compile_script(str(source), schema, scope.params)
        col = truth(v) if predicate else v.col
        if not predicate:
            to = to or "string"
    if predicate:
        return col.cast("boolean")
    return _ranged(col, to) if to else col


def _python(source: str, schema: T.StructType, to: str) -> Column:
    """A Python expression over whole columns: row.name is a pandas Series of an Arrow batch, np and pd are at hand, the value is a Series or a scalar.

    Only the columns that the source names as row.name or row["name"] travel to Python. Integers with nulls arrive as floats with NaN,
    which a result turns back into null. Values that don't fit the type raise."""
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"python: {e.msg}") from e
    of_row = lambda n: isinstance(n, ast.Name) and n.id == "row"
    named = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute) and of_row(n.value)}
    named |= {n.slice.value for n in ast.walk(tree) if isinstance(n, ast.Subscript) and of_row(n.value) and isinstance(n.slice, ast.Constant)}
    unknown = sorted(str(n) for n in named if n not in schema.names)
    if unknown:
        raise ExpressionError(f"unknown column {', '.join(unknown)}")
    if sum(map(of_row, ast.walk(tree))) > sum(isinstance(n, (ast.Attribute, ast.Subscript)) and of_row(n.value) and (isinstance(n, ast.Attribute) or isinstance(n.slice, ast.Constant)) for n in ast.walk(tree)):
        raise ExpressionError("python: row is used by column only, as row.name")
    names = sorted(named) or schema.names[:1]
    if not names:
        raise ExpressionError("python: there is no column")

    def run(*columns: pd.Series) -> pd.Series:
        import numpy as np

        row = pd.DataFrame(dict(zip(names, columns, strict=True)))
        out = eval(compile(source.strip(), "<expression>", "eval"), {"np": np, "pd": pd}, {"row": _Row(row)})
        return out if isinstance(out, pd.Series) else pd.Series(out, index=row.index)

    return F.pandas_udf(run, to)(*(F.col(f"`{n}`") for n in names))


class _Row:
    """Columns of a batch by attribute or item; no column hides behind a method of a frame."""

    def __init__(self, frame: pd.DataFrame):
        self.__dict__["_frame"] = frame

    def __getattr__(self, name: str) -> pd.Series:
        return self._frame[name]

    def __getitem__(self, name: str) -> pd.Series:
        return self._frame[name]


def _literal(value: Any, to: str | None) -> Column:
    if to == "boolean":
        text = str(value).lower()
        if text not in ("true", "1", "false", "0"):
            raise ExpressionError(f"literal {value!r} is no boolean")
        return F.lit(text in ("true", "1"))
    return F.lit(value).cast(to or "string")


def _ranged(col: Column, to: str) -> Column:
    return col.cast(to)  # ANSI casts raise out of range
