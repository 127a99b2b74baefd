"""The scripting-expression subset (the default language of conditions), lowered to Spark Columns.

Logic is two-valued as in the scripting language: null and false are false, everything else (0 and "" too) is true; `==` compares
nulls as equal; `a and b or c` yields values. Statements, tables and other calls are rejected by name.

Row scripts (compile_row_script) may also hold assignments to row and to local names, if ... elseif ... else ... end, comments and a
closing `return row`; each becomes columns, with CASE for branches, so a script costs no Python worker. Loops, functions and tables are
rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.typed import ExpressionError

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>\.\.|==|~=|<=|>=|//|[-+*/%#<>().,\[\]:=;]))""", re.X)
_BINARY = {"or": 1, "and": 2, "<": 3, ">": 3, "<=": 3, ">=": 3, "==": 3, "~=": 3, "..": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6}
_STATEMENTS = {"if", "then", "else", "elseif", "end", "for", "while", "do", "return", "local", "function", "repeat", "until"}


@dataclass
class Val:
    col: Column
    kind: str  # int num str bool nil other


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    return "str" if isinstance(dt, T.StringType) else "bool" if isinstance(dt, T.BooleanType) else "other"


def truth(v: Val) -> Column:
    if v.kind == "nil":
        return F.lit(False)
    return F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else v.col.isNotNull()


def _text(v: Val) -> Column:
    if v.kind == "bool":
        return F.when(v.col, "true").otherwise("false")
    if v.kind == "nil":
        return F.lit(None).cast("string")
    return v.col.cast("string")


class _Reader:
    def __init__(self, source: str, schema: T.StructType, params: dict[str, str]):
        self.fields, self.params, self.tokens, at = {f.name: f for f in schema.fields}, params, [], 0
        self.row: dict[str, Val] = {}  # what a script has assigned
        self.locals: dict[str, Val] = {}
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"unexpected {source[at : at + 8]!r} in a script expression")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        if self.next()[1] != op:
            raise ExpressionError(f"expected {op!r}")

    def whole(self) -> Val:
        v = self.binary(1)
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.peek()!r}: only single expressions are supported, use python.map or python.script for statements")
        return v

    def binary(self, least: int) -> Val:
        left = self.unary()
        while _BINARY.get(self.peek(), 0) >= least:
            op = self.next()[1]
            left = self.combine(op, left, self.binary(_BINARY[op] + (op != "..")))
        return left

    def unary(self) -> Val:
        op = self.peek()
        if op == "not":
            self.next()
            return Val(~truth(self.unary()), "bool")
        if op == "-":
            self.next()
            v = self.unary()
            return Val(-v.col, v.kind)
        if op == "#":
            self.next()
            return Val(F.octet_length(self.unary().col).cast("bigint"), "int")
        return self.postfix(self.primary())

    def postfix(self, v: Val) -> Val:
        while self.peek() == ":":
            self.next()
            name = self.next()[1]
            self.expect("(")
            v = self.string_call(name, [v, *self.arguments()])
        return v

    def arguments(self) -> list[Val]:
        out = []
        while self.peek() != ")":
            out.append(self.binary(1))
            if self.peek() == ",":
                self.next()
        self.expect(")")
        return out

    def primary(self) -> Val:
        kind, text = self.next()
        if kind == "num":
            return Val(F.lit(int(text)).cast("bigint"), "int") if text.isdigit() else Val(F.lit(float(text)), "num")
        if kind == "str":
            return Val(F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])), "str")
        if text == "(":
            v = self.binary(1)
            self.expect(")")
            return v
        if text in ("true", "false"):
            return Val(F.lit(text == "true"), "bool")
        if text == "nil":
            return Val(F.lit(None), "nil")
        if text in _STATEMENTS:
            raise ExpressionError(f"{text!r} is a statement: use python.map or python.script")
        if text in ("row", "params"):
            name = self.index()
            if text == "params":
                return Val(F.lit(self.params[name]), "str") if name in self.params else Val(F.lit(None), "nil")
            if name in self.row:
                return self.row[name]
            if name not in self.fields:
                return Val(F.lit(None), "nil")
            f = self.fields[name]
            return Val(F.col(f"`{name}`").cast("bigint") if _kind(f.dataType) == "int" else F.col(f"`{name}`"), _kind(f.dataType))
        if text in ("string", "math"):
            self.expect(".")
            name = self.next()[1]
            self.expect("(")
            args = self.arguments()
            return self.string_call(name, args) if text == "string" else self.math_call(name, args)
        if text in ("tostring", "tonumber"):
            self.expect("(")
            (v,) = self.arguments()
            if text == "tostring":
                return Val(F.coalesce(_text(v), F.lit("nil")), "str")
            return v if v.kind in ("int", "num") else Val(F.expr("1").cast("double") * v.col.try_cast("double"), "num")
        if text in self.locals:
            return self.locals[text]
        if text in self.fields:
            raise ExpressionError(f"write row.{text} for the column")
        raise ExpressionError(f"unknown name {text!r}")

    def index(self) -> str:
        op = self.next()[1]
        if op == ".":
            return self.next()[1]
        if op == "[":
            kind, text = self.next()
            self.expect("]")
            if kind == "str":
                return text[1:-1]
        raise ExpressionError("expected a column name")

    def combine(self, op: str, a: Val, b: Val) -> Val:
        if op in ("and", "or"):
            kind = a.kind if a.kind == b.kind else b.kind if a.kind == "nil" or (a.kind == "bool" and op == "and") else a.kind if b.kind == "nil" else None
            if a.kind == "bool" and b.kind == "bool":
                return Val(truth(a) & truth(b) if op == "and" else truth(a) | truth(b), "bool")
            if kind is None and {a.kind, b.kind} <= {"int", "num"}:
                kind = "num"
            if kind is None:
                kind = b.kind if a.kind == "bool" else "other"
            keep = a.col if a.kind == kind else F.lit(None)
            if op == "and":
                return Val(F.when(truth(a), b.col).otherwise(keep), kind)
            return Val(F.when(truth(a), keep if a.kind != kind else a.col).otherwise(b.col), kind)
        if op in ("==", "~="):
            comparable = a.kind == b.kind or "nil" in (a.kind, b.kind) or {a.kind, b.kind} <= {"int", "num"} or "other" in (a.kind, b.kind)
            same = a.col.isNull() if b.kind == "nil" else b.col.isNull() if a.kind == "nil" else a.col.eqNullSafe(b.col) if comparable else F.lit(False)
            return Val(same if op == "==" else ~same, "bool")
        if op in ("<", ">", "<=", ">="):
            x, y = a.col, b.col
            r = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
            return Val(F.when(x.isNull() | y.isNull(), F.expr("raise_error('attempt to compare a nil value')")).otherwise(r), "bool")
        if op == "..":
            return Val(F.concat(_text(a), _text(b)), "str")
        ints = a.kind == b.kind == "int"
        x, y = (a.col, b.col) if ints else (a.col.cast("double"), b.col.cast("double"))
        if op in "+-*" and op != "":
            return Val({"+": x + y, "-": x - y, "*": x * y}[op], "int" if ints else "num")
        if op == "/":
            return Val(F.try_divide(x.cast("double"), y.cast("double")), "num")
        floor_mod = ((x % y) + y) % y
        if op == "%":
            return Val(floor_mod, "int" if ints else "num")
        return Val(F.floor((x - floor_mod) / y).cast("bigint") if ints else F.floor(x / y).cast("double"), "int" if ints else "num")

    def string_call(self, name: str, args: list[Val]) -> Val:
        s = _text(args[0])
        if name in ("upper", "lower"):
            up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            return Val(F.translate(s, low, up) if name == "upper" else F.translate(s, up, low), "str")
        if name == "len":
            return Val(F.octet_length(s).cast("bigint"), "int")
        if name == "rep":
            return Val(F.repeat(s, args[1].col.cast("int")), "str")
        if name == "sub":
            n = F.char_length(s)
            fix = lambda c: F.when(c < 0, F.greatest(n + c + 1, F.lit(1))).otherwise(F.greatest(c, F.lit(1)))
            i = fix(args[1].col)
            j = F.when(args[2].col < 0, n + args[2].col + 1).otherwise(args[2].col) if len(args) > 2 else n
            return Val(F.substring(s, i.cast("int"), F.greatest(j - i + 1, F.lit(0)).cast("int")), "str")
        raise ExpressionError(f"string.{name} is not supported: use lang: sql or python.map")

    def math_call(self, name: str, args: list[Val]) -> Val:
        c = [a.col for a in args]
        if name in ("floor", "ceil"):
            return Val((F.floor if name == "floor" else F.ceil)(c[0]).cast("bigint"), "int")
        if name == "abs":
            return Val(F.abs(c[0]), args[0].kind)
        if name in ("min", "max"):
            kind = "int" if all(a.kind == "int" for a in args) else "num"
            return Val((F.least if name == "min" else F.greatest)(*c) if len(c) > 1 else c[0], kind)
        raise ExpressionError(f"math.{name} is not supported: use lang: sql")


def compile_script(source: str, schema: T.StructType, params: dict[str, str] | None = None) -> Val:
    return _Reader(source, schema, params or {}).whole()


class _Body(_Reader):
    """A row script: statements over what has been assigned so far."""

    def block(self, inner: bool) -> None:
        while self.peek() not in ("", "end", "else", "elseif"):
            kind, text = self.next()
            if text == ";":
                continue
            if text == "return" and not inner and self.tokens[self.at :] in ([("name", "row")], [("name", "row"), ("op", ";")]):
                self.at = len(self.tokens)
            elif text == "if":
                self.branches()
            elif text == "local":
                name = self.next()[1]
                self.expect("=")
                self.locals[name] = self.binary(1)
            elif text == "row" and kind == "name":
                name = self.index()
                self.expect("=")
                self.row[name] = self.binary(1)
            elif text in self.locals:
                self.expect("=")
                self.locals[text] = self.binary(1)
            else:
                raise ExpressionError(f"{text!r} is not supported in a row script: use python.map")

    def branches(self) -> None:
        """Both sides of a condition, from the same state; names that they leave different become CASE."""
        when = truth(self.binary(1))
        self.expect("then")
        row, names = dict(self.row), dict(self.locals)
        self.block(True)
        yes_row, yes_names = self.row, {k: v for k, v in self.locals.items() if k in names}
        self.row, self.locals = dict(row), dict(names)
        word = self.next()[1]
        if word == "elseif":
            self.branches()
        else:
            if word == "else":
                self.block(True)
                word = self.next()[1]
            if word != "end":
                raise ExpressionError("expected 'end'")
        other = {k: v for k, v in self.locals.items() if k in names}
        self.locals = {k: self.either(when, yes_names[k], other[k]) for k in names}
        before = lambda k: row.get(k) or self.column(k)
        self.row = {k: self.either(when, yes_row.get(k) or before(k), self.row.get(k) or before(k)) for k in {**yes_row, **self.row}}

    def column(self, name: str) -> Val:
        if name not in self.fields:
            return Val(F.lit(None), "nil")
        kind = _kind(self.fields[name].dataType)
        return Val(F.col(f"`{name}`").cast("bigint") if kind == "int" else F.col(f"`{name}`"), kind)

    @staticmethod
    def either(when: Column, yes: Val, no: Val) -> Val:
        if yes is no:
            return yes
        kinds = {yes.kind, no.kind} - {"nil"}
        kind = "num" if kinds == {"int", "num"} else kinds.pop() if len(kinds) == 1 else "nil" if not kinds else None
        if kind is None:
            raise ExpressionError(f"a name is {yes.kind} in one branch and {no.kind} in another")
        return Val(F.when(when, yes.col).otherwise(no.col), kind)


def compile_row_script(source: str, schema: T.StructType, params: dict[str, str] | None = None) -> list[Column]:
    """The columns of the schema after a row script; keys that aren't columns are dropped, nil gives null."""
    plain = re.sub(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|--[^\n]*""", lambda m: m[1] or " ", source)
    body = _Body(plain, schema, params or {})
    body.block(False)
    if body.peek():
        raise ExpressionError(f"unexpected {body.peek()!r}")
    out = []
    for f in schema.fields:
        v = body.row.get(f.name)
        if v is None:
            out.append(F.col(f"`{f.name}`"))
            continue
        kind, col = _kind(f.dataType), v.col
        if v.kind == "num" and kind == "int":
            col = F.when(col.isNull() | (col == F.floor(col)), col).otherwise(F.raise_error(F.lit(f"row.{f.name}: the number has no integer representation")))
        elif v.kind in ("int", "num") and kind == "str":
            col = _text(v)
        elif v.kind not in (kind, "nil") and not (v.kind == "int" and kind == "num"):
            raise ExpressionError(f"row.{f.name} is {kind}, the script gives {v.kind}")
        out.append(col.cast(f.dataType).alias(f.name))
    return out
