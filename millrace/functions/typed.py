"""The typed ETL expression language, lowered to Spark Columns.

A source text is read by a precedence climber into a tree whose nodes carry a Column and a kind; operators and functions choose their
Column by kind. Integers are 64-bit, floats double, decimals keep their scale; null propagates (three-valued logic). Impossible
combinations of kinds are compile errors; bad values raise at run time, inside the Column.

Two parameters change what numbers mean: $Package::LocaleID names the locale of texts that are cast to integers and floats (group marks
between whole groups of three or none; decimals are always in plain form), and $Package::IntegerOverflow set to wrap makes + - * of
integers wrap at 64 bits instead of raising.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """The text is no valid expression over these columns."""


@dataclass
class Term:
    col: Column
    kind: str  # int float dec bool str date ts time bytes guid null
    scale: int = 0
    text: str | None = None  # of string literals
    risky: bool = False  # evaluating it may raise


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<str>"(?:[^"\\]|\\.)*")|(?P<col>\[[^\]]+\])|(?P<var>@\[[^\]]+\])
    |(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%<>!~&|^?:(),]))""",
    re.X,
)
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "0": "\0"}
#: Type names of casts: kind, and the range of integers.
_TYPES: dict[str, tuple[str, tuple[int, int] | None]] = {
    "DT_I1": ("int", (-128, 127)), "DT_I2": ("int", (-32768, 32767)), "DT_I4": ("int", (-(2**31), 2**31 - 1)), "DT_I8": ("int", (-(2**63), 2**63 - 1)),
    "DT_UI1": ("int", (0, 255)), "DT_UI2": ("int", (0, 65535)), "DT_UI4": ("int", (0, 2**32 - 1)), "DT_UI8": ("int", (0, 2**63 - 1)),
    "DT_R4": ("float", None), "DT_R8": ("float", None), "DT_BOOL": ("bool", None), "DT_STR": ("str", None), "DT_WSTR": ("str", None), "DT_TEXT": ("str", None), "DT_NTEXT": ("str", None),
    "DT_DBDATE": ("date", None), "DT_DATE": ("ts", None), "DT_DBTIMESTAMP": ("ts", None), "DT_DBTIMESTAMP2": ("ts", None), "DT_DBTIMESTAMPOFFSET": ("ts", None), "DT_FILETIME": ("ts", None),
    "DT_DBTIME": ("time", None), "DT_DBTIME2": ("time", None), "DT_BYTES": ("bytes", None), "DT_IMAGE": ("bytes", None), "DT_GUID": ("guid", None), "DT_NUMERIC": ("dec", None), "DT_DECIMAL": ("dec", None), "DT_CY": ("dec", None),
}
_PARTS = {
    "year": "year", "yyyy": "year", "yy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month", "dayofyear": "dayofyear", "dy": "dayofyear", "y": "dayofyear",
    "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week", "weekday": "weekday", "dw": "weekday", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute",
    "second": "second", "ss": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond",
}
#: Parameters: the locale of numbers in texts that are cast to integers and floats, and error (default) or wrap for integer arithmetic.
LOCALE, OVERFLOW = "$Package::LocaleID", "$Package::IntegerOverflow"
#: Group and decimal marks by language, or by locale where it differs from its language.
_MARKS = {
    "C": ("", "."), "POSIX": ("", "."), "en": (",", "."), "ja": (",", "."), "zh": (",", "."), "ko": (",", "."), "de": (".", ","), "nl": (".", ","), "it": (".", ","), "es": (".", ","), "da": (".", ","), "tr": (".", ","), "id": (".", ","), "el": (".", ","),
    "pt": (".", ","), "fr": ("\u202f", ","), "sv": ("\u202f", ","), "nb": ("\u202f", ","), "fi": ("\u202f", ","), "cs": ("\u202f", ","), "pl": ("\u202f", ","), "ru": ("\u202f", ","), "uk": ("\u202f", ","), "de_CH": ("\u2019", "."), "es_MX": (",", "."),
}
_SQL_KIND = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "date": "date", "ts": "timestamp_ntz", "time": "bigint", "bytes": "binary", "guid": "string", "null": "void"}


def _fail_if(cond: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.expr(f"raise_error('{message}')")).otherwise(value)


def column_term(col: Column, dt: T.DataType) -> Term:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Term(col.cast("bigint"), "int")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return Term(col.cast("double"), "float")
    if isinstance(dt, T.DecimalType):
        return Term(col, "dec", dt.scale)
    for cls, kind in ((T.BooleanType, "bool"), (T.StringType, "str"), (T.DateType, "date"), (T.BinaryType, "bytes")):
        if isinstance(dt, cls):
            return Term(col, kind)
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return Term(col.cast("timestamp_ntz"), "ts")
    raise ExpressionError(f"column type {dt.simpleString()} has no expressions")


def _marks(name: str) -> tuple[str, str] | None:
    """The group and decimal mark of a POSIX locale name; None without one."""
    if not name:
        return None
    base = re.sub(r"[.@].*", "", name)
    marks = _MARKS.get(base, _MARKS.get(base.partition("_")[0])) if re.fullmatch(r"[a-z]{2}_[A-Z]{2}", base) or base in _MARKS else None
    if marks is None:
        raise ExpressionError(f"unknown locale {name!r}; a POSIX name like de_DE.UTF-8 is needed")
    return marks


class _Reader:
    def __init__(self, source: str, schema: T.StructType, variables: dict[str, str]):
        self.marks = _marks(variables.get(LOCALE, variables.get(LOCALE.rpartition("::")[2], "")))
        overflow = variables.get(OVERFLOW, variables.get(OVERFLOW.rpartition("::")[2], "error"))
        if overflow not in ("error", "wrap"):
            raise ExpressionError(f"{OVERFLOW} is error or wrap, not {overflow!r}")
        self.wraps = overflow == "wrap"
        self.columns = {}
        for f in schema.fields:
            self.columns.setdefault(f.name.lower(), f)
        self.variables = variables
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"unexpected character at {at}: {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        if self.next()[1] != op:
            raise ExpressionError(f"expected {op!r}")

    def whole(self) -> Term:
        t = self.ternary()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return t

    def ternary(self) -> Term:
        cond = self.binary(1)
        if self.peek() != "?":
            return cond
        self.next()
        yes = self.ternary()
        self.expect(":")
        no = self.ternary()
        if cond.kind not in ("bool", "null"):
            raise ExpressionError("the condition of ?: must be boolean")
        yes, no, kind, scale = _same(yes, no, "?:")
        return Term(F.when(cond.col.isNull(), F.lit(None)).when(cond.col, yes.col).otherwise(no.col), kind, scale, risky=cond.risky or yes.risky or no.risky)

    def binary(self, least: int) -> Term:
        left = self.unary()
        while _BINARY.get(self.peek(), 0) >= least:
            op = self.next()[1]
            left = _binary(op, left, self.binary(_BINARY[op] + 1), self.wraps)
        return left

    def unary(self) -> Term:
        op = self.peek()
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and op in "-!~" and op:
            self.next()
            t = self.unary()
            if op == "-" and t.kind == "int" and self.wraps:
                return _binary("-", Term(F.lit(0).cast("bigint"), "int"), t, True)
            if op == "-" and t.kind in ("int", "float", "dec"):
                return Term(-t.col, t.kind, t.scale, risky=True)
            if op == "!" and t.kind in ("bool", "null"):
                return Term(~t.col, "bool", risky=t.risky)
            if op == "~" and t.kind == "int":
                return Term(F.bitwise_not(t.col), "int", risky=t.risky)
            raise ExpressionError(f"unary {op} does not take {t.kind}")
        if op == "(" and self.peek(1).upper() in _TYPES:
            self.next()
            name, args = self.type_name()
            self.expect(")")
            return cast(self.unary(), name, args, self.marks)
        return self.primary()

    def type_name(self) -> tuple[str, list[int]]:
        name, args = self.next()[1].upper(), []
        while self.peek() == ",":
            self.next()
            args.append(int(self.next()[1]))
        return name, args

    def primary(self) -> Term:
        kind, text = self.next()
        if kind == "num":
            return Term(F.lit(int(text)).cast("bigint"), "int") if text.isdigit() else Term(F.lit(float(text)), "float")
        if kind == "str":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1])
            return Term(F.lit(value), "str", text=value)
        if kind == "var":
            name = text[2:-1].rpartition("::")[2]
            if name not in self.variables:
                raise ExpressionError(f"unknown variable {name}")
            return Term(F.lit(self.variables[name]), "str", text=self.variables[name])
        if text == "(":
            t = self.ternary()
            self.expect(")")
            return t
        if kind == "name" and self.peek() == "(":
            return self.call(text.upper())
        if kind == "name" and text.lower() in ("true", "false"):
            return Term(F.lit(text.lower() == "true"), "bool")
        if kind in ("name", "col"):
            name = text.strip("[]")
            f = self.columns.get(name.lower())
            if f is None:
                raise ExpressionError(f"unknown column {name}")
            return column_term(F.col(f"`{f.name}`"), f.dataType)
        raise ExpressionError(f"unexpected {text!r}")

    def call(self, name: str) -> Term:
        self.expect("(")
        if name == "NULL":
            type_name, _ = self.type_name()
            self.expect(")")
            if type_name not in _TYPES:
                raise ExpressionError(f"unknown type {type_name}")
            kind = _TYPES[type_name][0]
            return Term(F.lit(None).cast(_SQL_KIND.get(kind, "decimal(38,0)")), kind)
        args = []
        while self.peek() != ")":
            args.append(self.ternary())
            if self.peek() == ",":
                self.next()
            elif self.peek() != ")":
                raise ExpressionError("expected , or )")
        self.next()
        if name not in _FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        kinds, make = _FUNCTIONS[name]
        if len(args) != len(kinds):
            raise ExpressionError(f"{name} takes {len(kinds)} arguments, not {len(args)}")
        for a, allowed in zip(args, kinds, strict=True):
            if allowed and a.kind not in allowed and a.kind != "null":
                raise ExpressionError(f"{name} does not take {a.kind}")
        out = make(*args)
        out.risky = out.risky or any(a.risky for a in args)
        return out


def _same(a: Term, b: Term, op: str) -> tuple[Term, Term, str, int]:
    """Both terms in one kind."""
    if a.kind == "null" or b.kind == "null":
        o = b if a.kind == "null" else a
        return a, b, o.kind, o.scale
    if a.kind == b.kind:
        return a, b, a.kind, max(a.scale, b.scale)
    pair = {a.kind, b.kind}
    if pair <= {"int", "float", "dec"}:
        if "float" in pair:
            return Term(a.col.cast("double"), "float"), Term(b.col.cast("double"), "float"), "float", 0
        to = lambda t: Term(t.col.cast("decimal(19,0)"), "dec", 0) if t.kind == "int" else t
        return to(a), to(b), "dec", max(a.scale, b.scale)
    if pair == {"date", "ts"}:
        return Term(a.col.cast("timestamp_ntz"), "ts"), Term(b.col.cast("timestamp_ntz"), "ts"), "ts", 0
    raise ExpressionError(f"{op} does not take {a.kind} and {b.kind}")


def _wrapped(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic that wraps. A product of two of them has at most 38 digits; each side occurs once, so that nested ones stay small."""
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    half, size = (F.lit(Decimal(n)).cast("decimal(20,0)") for n in (2**63, 2**64))
    exact = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    return (F.pmod(exact + half, size) - half).cast("bigint")


def _binary(op: str, a: Term, b: Term, wraps: bool = False) -> Term:
    risky = a.risky or b.risky
    if op in ("&&", "||"):
        if not {a.kind, b.kind} <= {"bool", "null"}:
            raise ExpressionError(f"{op} needs booleans")
        if b.risky:  # the right side only where the left does not decide
            stop = op == "||"
            both = a.col | b.col if stop else a.col & b.col
            return Term(F.when(a.col.eqNullSafe(F.lit(stop)), F.lit(stop)).otherwise(both), "bool", risky=True)
        return Term(a.col & b.col if op == "&&" else a.col | b.col, "bool", risky=risky)
    if op in ("&", "|", "^"):
        if not {a.kind, b.kind} <= {"int", "null"}:
            raise ExpressionError(f"{op} needs integers")
        return Term({"&": a.col.bitwiseAND, "|": a.col.bitwiseOR, "^": a.col.bitwiseXOR}[op](b.col), "int", risky=risky)
    if op == "+" and {a.kind, b.kind} <= {"str", "null"} and "str" in (a.kind, b.kind):
        return Term(F.concat(a.col, b.col), "str", risky=risky)
    a, b, kind, _ = _same(a, b, op)
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if kind == "bytes":
            raise ExpressionError(f"{op} does not take bytes")
        x, y = a.col, b.col
        return Term({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool", risky=risky)
    if kind == "int":
        if op in "+-*" and wraps:
            return Term(_wrapped(op, a.col, b.col), "int", risky=risky)
        if op in "+-*":
            return Term({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "int", risky=True)
        if op == "/":
            return Term(_div(a.col, b.col), "int", risky=True)
        return Term(a.col % b.col, "int", risky=True)
    if kind == "float":
        if op in "+-*":
            return Term({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], "float", risky=risky)
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        if op == "/":
            zero = F.when((a.col == 0) | F.isnan(a.col), nan).when(a.col > 0, inf).otherwise(-inf)
            return Term(F.when(b.col == 0, zero).otherwise(F.try_divide(a.col, b.col)), "float", risky=risky)
        return Term(F.when(b.col == 0, nan).otherwise(F.try_mod(a.col, b.col)), "float", risky=risky)
    if kind == "dec":
        if op in "+-":
            return Term(a.col + b.col if op == "+" else a.col - b.col, "dec", max(a.scale, b.scale), risky=True)
        if op == "*":
            return Term(a.col * b.col, "dec", min(a.scale + b.scale, 38), risky=True)
        if op == "/":
            scale = max(a.scale, 6)
            return Term(F.round(a.col / b.col, scale), "dec", scale, risky=True)
        return Term(a.col % b.col, "dec", max(a.scale, b.scale), risky=True)
    raise ExpressionError(f"{op} does not take {kind}")


def _div(a: Column, b: Column) -> Column:
    """Truncating 64-bit division; the remainder raises on zero, and smallest / -1 stays the smallest."""
    exact = ((a - a % b).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when((b == -1) & (a == -(2**63)), a).otherwise(exact.cast("bigint"))


def _g(col: Column) -> Column:
    """A double as %g writes it: six significant digits, no trailing zeros."""
    e = F.format_string("%.5e", col)
    exp = F.regexp_extract(e, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_extract(e, r"^(-?[\d.]+)e", 1)
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = strip(F.when(exp >= 5, F.format_string("%.0f", col)).when(exp == 4, F.format_string("%.1f", col)).when(exp == 3, F.format_string("%.2f", col)).when(exp == 2, F.format_string("%.3f", col)).when(exp == 1, F.format_string("%.4f", col)).when(exp == 0, F.format_string("%.5f", col)).when(exp == -1, F.format_string("%.6f", col)).when(exp == -2, F.format_string("%.7f", col)).when(exp == -3, F.format_string("%.8f", col)).otherwise(F.format_string("%.9f", col)))
    sci = F.concat(strip(digits), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    usual = F.when((exp < -4) | (exp >= 6), sci).otherwise(plain)
    return F.when(F.isnan(col), "nan").when(col == float("inf"), "inf").when(col == float("-inf"), "-inf").when(col == 0, "0").otherwise(usual)


def _plain_number(c: Column, marks: tuple[str, str]) -> Column:
    """A number as a locale writes it, with whole groups of three or none, in plain form; other texts raise."""
    group, point = re.escape(marks[0]), re.escape(marks[1])
    if marks[0] == "\u202f":
        group = "[\u202f\u00a0]"  # either space is in use
    whole = rf"([0-9]{{1,3}}({group}[0-9]{{3}})+|[0-9]+)" if group else "[0-9]+"
    form = rf"^[ \t\n\x0B\f\r]*([+-]?({whole}({point}[0-9]*)?|{point}[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
    bare = F.regexp_replace(c, group, "") if group else c
    return _fail_if(~F.rlike(c, F.lit(form)), "not a number of the locale", F.translate(F.trim(bare), marks[1], "."))


def cast(t: Term, name: str, args: list[int], marks: tuple[str, str] | None = None) -> Term:
    if name not in _TYPES:
        raise ExpressionError(f"unknown type {name}")
    to, bounds = _TYPES[name]
    c, k = t.col, t.kind
    bad = ExpressionError(f"cannot cast {k} to {name}")
    if k == "null":
        return Term(F.lit(None).cast(_SQL_KIND.get(to, "decimal(38,0)")), to)
    if k == "str" and marks and to in ("int", "float"):
        c = _plain_number(c, marks)
    if to == "int":
        if k == "str":
            v = _fail_if(~F.rlike(c, F.lit(r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+$")), "not an integer", F.trim(c)).cast("bigint")
        elif k == "float":
            v = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")
        elif k in ("int", "bool"):
            v = c.cast("bigint")
        elif k == "dec":
            v = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")
        else:
            raise bad
        lo, hi = bounds
        if (lo, hi) != (-(2**63), 2**63 - 1):
            v = _fail_if((v < lo) | (v > hi), "integer out of range", v)
        return Term(v, "int", risky=True)
    if to == "float":
        if k not in ("int", "float", "dec", "bool", "str"):
            raise bad
        v = c.cast("double")
        return Term(v.cast("float").cast("double") if name == "DT_R4" else v, "float", risky=k == "str")
    if to == "bool":
        if k == "bool":
            return t
        if k not in ("int", "float", "dec"):
            raise bad
        return Term(c != 0, "bool", risky=t.risky)
    if to == "str":
        if k == "bool":
            v = F.when(c, "True").when(~c, "False")
        elif k == "float":
            v = _g(c)
        elif k == "ts":
            v = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))).otherwise(""))
        elif k == "bytes":
            v = F.lower(F.hex(c))
        elif k == "time":
            v = _time_text(c)
        else:
            v = c.cast("string")
        return Term(v, "str", risky=t.risky)
    if to == "date":
        if k == "str":
            return Term(_fail_if(~F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$")), "not a date", F.substring(c, 1, 10)).cast("date"), "date", risky=True)
        if k in ("date", "ts"):
            return Term(c.cast("date"), "date", risky=t.risky)
        raise bad
    if to == "ts":
        if k == "str":
            ok = F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?)?$"))
            zoned = F.rlike(c, F.lit(r"(Z|[T ].*[+-]\d{2}:?\d{2})$"))
            utc = F.to_utc_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "").cast("timestamp_ntz"), F.regexp_replace(F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1), r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
            return Term(F.when(zoned, utc.cast("timestamp_ntz")).otherwise(_fail_if(~ok, "not a timestamp", c).cast("timestamp_ntz")), "ts", risky=True)
        if k in ("date", "ts"):
            return Term(c.cast("timestamp_ntz"), "ts", risky=t.risky)
        if k in ("int", "float", "dec") and name == "DT_DATE":
            return Term((F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c.cast("double") * 86400).cast("decimal(18,6)"))), "ts", risky=True)
        raise bad
    if to == "time":
        if k == "str":
            ok = _fail_if(~F.rlike(c, F.lit(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?$")), "not a time", c)
            return Term((F.substring(ok, 1, 2).cast("bigint") * 3600 + F.substring(ok, 4, 2).cast("bigint") * 60) * 1000000 + (F.substring(ok, 7, 9).cast("decimal(9,6)") * 1000000).cast("bigint"), "time", risky=True)
        if k == "ts":
            return Term((F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1000000 + (F.date_format(c, "ss.SSSSSS").cast("decimal(9,6)") * 1000000).cast("bigint"), "time")
        if k in ("int", "time"):
            return Term(c, "time", risky=t.risky)
        raise bad
    if to == "bytes":
        if k == "str":
            return Term(_fail_if(c.isNotNull() & ~F.regexp_like(c, F.lit("^([0-9A-Fa-f]{2})*$")), "not a sequence of hex bytes", F.unhex(c)), "bytes", risky=True)
        if k == "bytes":
            return t
        raise bad
    if to == "guid":
        if k in ("str", "guid"):
            bare = F.regexp_replace(c, r"^\{|\}$", "")
            return Term(F.lower(_fail_if(~F.rlike(bare, F.lit("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")), "not a uuid", bare)), "guid", risky=True)
        raise bad
    # decimals: precision is only metadata; digits past the scale of a string are an error, of others are cut off
    scale = 4 if name == "DT_CY" else args[1] if name == "DT_NUMERIC" and len(args) > 1 else args[0] if args and name == "DT_DECIMAL" else None
    if scale is None:
        raise ExpressionError(f"{name} needs a scale")
    target = f"decimal(38,{scale})"
    if k == "str":
        v = _fail_if(F.rlike(c, F.lit(rf"\.\d{{{scale}}}\d*[1-9]")), "digits past the scale", c).cast(target)
    elif k == "float":
        v = F.format_string(f"%.{scale}f", c).cast(target)
    elif k in ("int", "bool"):
        v = c.cast("bigint").cast(target)
    elif k == "dec":
        v = c.cast(target) if t.scale <= scale else F.when(c < 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale))).cast(target)
    else:
        raise bad
    return Term(v, "dec", scale, risky=True)


def _time_text(us: Column) -> Column:
    part = lambda n, size: F.lpad(n.cast("string"), size, "0")
    s = F.floor(us / 1000000)
    frac = us % 1000000
    return F.concat(part(F.floor(s / 3600), 2), F.lit(":"), part(F.floor(s / 60) % 60, 2), F.lit(":"), part(s % 60, 2), F.when(frac > 0, F.concat(F.lit("."), part(frac, 6))).otherwise(""))


# ---- functions -------------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STR, INT, NUM, TEMP = ("str", "guid"), ("int",), ("int", "float", "dec"), ("date", "ts")


def _bytes_between(s: Column, start: Column, n: Column) -> Column:
    """Substring in bytes of UTF-8, as text; a cut inside a character leaves its bytes as they are."""
    return F.substring(s.cast("binary"), start.cast("int"), n.cast("int")).cast("string")


def _substring(s: Term, st: Term, n: Term) -> Term:
    bad = (st.col < 1) | (n.col < 0)
    big = F.lit(2**31 - 1).cast("bigint")
    ascii_only = F.octet_length(s.col) == F.char_length(s.col)
    a, m = F.least(st.col, big), F.least(n.col, big)
    return Term(_fail_if(bad, "SUBSTRING out of range", F.when(ascii_only, F.substring(s.col, a.cast("int"), m.cast("int"))).otherwise(_bytes_between(s.col, a, m))), "str", risky=True)


def _side(right: bool):
    def make(s: Term, n: Term) -> Term:
        size = F.octet_length(s.col).cast("bigint")
        m = F.least(n.col, size)
        return Term(F.when(n.col <= 0, F.lit("")).otherwise(_bytes_between(s.col, size - m + 1 if right else F.lit(1), m)), "str")

    return make


def _trim(pattern: str):
    return lambda s: Term(F.regexp_replace(s.col, pattern, ""), "str")


def _find(s: Term, f: Term, k: Term) -> Term:
    literal = F.replace(f.col, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pieces = F.split(s.col, F.concat(F.lit(r"\Q"), literal, F.lit(r"\E")))
    before = F.aggregate(F.slice(pieces, 1, F.greatest(k.col, F.lit(1)).cast("int")), F.lit(0).cast("bigint"), lambda acc, p: acc + F.octet_length(p))
    pos = F.when((f.col == "") | (F.size(pieces) <= k.col), F.lit(0).cast("bigint")).otherwise(before + (k.col - 1) * F.octet_length(f.col) + 1)
    return Term(_fail_if(k.col < 1, "FINDSTRING needs a positive occurrence", F.when(s.col.isNull() | f.col.isNull() | k.col.isNull(), F.lit(None)).otherwise(pos)), "int", risky=True)


def _tokens(s: Column, d: Column) -> Column:
    cls = F.concat(F.lit("["), F.regexp_replace(d, r"([\\\[\]^&-])", r"\\$1"), F.lit("]"))
    return F.when(d == "", F.filter(F.array(s), lambda x: x != "")).otherwise(F.filter(F.split(s, cls), lambda x: x != ""))


def _token(s: Term, d: Term, k: Term) -> Term:
    whole = F.when(d.col == "", s.col).otherwise(F.coalesce(F.get(_tokens(s.col, d.col), (k.col - 1).cast("int")), F.lit("")))
    return Term(_fail_if(k.col < 1, "TOKEN needs a positive number", F.when(s.col.isNull() | d.col.isNull() | k.col.isNull(), F.lit(None)).otherwise(whole)), "str", risky=True)


def _part(t: Term) -> str:
    if t.text is None or t.text.lower() not in _PARTS:
        raise ExpressionError("the date part must be a literal with a known name")
    return _PARTS[t.text.lower()]


def _date_part(part: str, d: Column, kind: str) -> Column:
    if kind == "date" and part in ("hour", "minute", "second", "millisecond"):
        raise ExpressionError(f"{part} needs a timestamp")
    fns = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "dayofyear": F.dayofyear, "weekday": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second}
    if part == "week":
        return F.floor((F.dayofyear(d) + 6) / 7).cast("bigint")
    if part == "millisecond":
        return F.date_format(d, "SSS").cast("bigint")
    return fns[part](d).cast("bigint")


def _add(p: Term, n: Term, d: Term) -> Term:
    part = _part(p)
    if part == "weekday":
        raise ExpressionError("DATEADD does not take weekday")
    months = {"year": 12, "quarter": 3, "month": 1}.get(part)
    if months:
        day = F.add_months(d.col.cast("date"), (n.col * months).cast("int"))
        if d.kind == "date":
            return Term(day, "date", risky=True)
        return Term(F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" "), F.date_format(d.col, "HH:mm:ss.SSSSSS"))), "ts", risky=True)
    days = {"day": 1, "dayofyear": 1, "week": 7}.get(part)
    if days:
        if d.kind == "date":
            return Term(F.date_add(d.col, (n.col * days).cast("int")), "date", risky=True)
        return Term(F.timestamp_add("DAY", (n.col * days).cast("int"), d.col), "ts", risky=True)
    if d.kind == "date":
        raise ExpressionError(f"DATEADD of {part} needs a timestamp")
    return Term(F.timestamp_add(part.upper(), n.col.cast("int"), d.col), "ts", risky=True)


def _diff(p: Term, a: Term, b: Term) -> Term:
    part = _part(p)
    if part == "weekday":
        raise ExpressionError("DATEDIFF does not take weekday")
    trunc = lambda x, y: ((x - x % y) / y).cast("bigint")
    months = ((F.year(b.col) - F.year(a.col)) * 12 + F.month(b.col) - F.month(a.col)).cast("bigint")
    days = F.datediff(b.col.cast("date"), a.col.cast("date")).cast("bigint")
    if part in ("year", "quarter", "month"):
        return Term({"year": trunc(months, F.lit(12)), "quarter": trunc(months, F.lit(3)), "month": months}[part], "int")
    if part in ("day", "dayofyear", "week"):
        return Term(trunc(days, F.lit(7)) if part == "week" else days, "int")
    us = F.timestamp_diff("MICROSECOND", a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz"))
    return Term(trunc(us, F.lit({"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000}[part])), "int")


def _replace_null(a: Term, b: Term) -> Term:
    a, b, kind, scale = _same(a, b, "REPLACENULL")
    return Term(F.coalesce(a.col, b.col), kind, scale)


def _kept_kind(f):
    return lambda x: Term(f(x.col), x.kind, x.scale, risky=x.kind == "int")


_double = lambda f: lambda *x: Term(f(*[t.col.cast("double") for t in x]), "float")
_FUNCTIONS = {
    "LEN": ((STR,), lambda s: Term(F.octet_length(s.col).cast("bigint"), "int")),
    "SUBSTRING": ((STR, INT, INT), _substring),
    "LEFT": ((STR, INT), _side(False)),
    "RIGHT": ((STR, INT), _side(True)),
    "TRIM": ((STR,), _trim(r"^[\x00-\x20]+|[\x00-\x20]+$")),
    "LTRIM": ((STR,), _trim(r"^[\x00-\x20]+")),
    "RTRIM": ((STR,), _trim(r"[\x00-\x20]+$")),
    "LOWER": ((STR,), lambda s: Term(F.translate(s.col, _UPPER, _LOWER), "str")),
    "UPPER": ((STR,), lambda s: Term(F.translate(s.col, _LOWER, _UPPER), "str")),
    "REVERSE": ((STR,), lambda s: Term(F.reverse(s.col), "str")),
    "REPLACE": ((STR, STR, STR), lambda s, f, r: Term(F.replace(s.col, f.col, r.col), "str")),
    "FINDSTRING": ((STR, STR, INT), _find),
    "TOKEN": ((STR, STR, INT), _token),
    "TOKENCOUNT": ((STR, STR), lambda s, d: Term(F.when(s.col.isNull() | d.col.isNull(), F.lit(None)).otherwise(F.size(_tokens(s.col, d.col))).cast("bigint"), "int")),
    "HEX": ((INT,), lambda n: Term(_fail_if(n.col < 0, "HEX of a negative number", F.hex(n.col)), "str", risky=True)),
    "CODEPOINT": ((STR,), lambda s: Term(_fail_if(s.col == "", "CODEPOINT of an empty string", F.ascii(s.col).cast("bigint")), "int", risky=True)),
    "ISNULL": (((),), lambda x: Term(x.col.isNull(), "bool")),
    "REPLACENULL": (((), ()), _replace_null),
    "ABS": ((NUM,), _kept_kind(F.abs)),
    "POWER": ((NUM, NUM), _double(F.pow)),
    "SQUARE": ((NUM,), _double(lambda x: x * x)),
    "SQRT": ((NUM,), _double(F.sqrt)),
    "EXP": ((NUM,), _double(F.exp)),
    "LN": ((NUM,), _double(F.ln)),
    "LOG": ((NUM,), _double(F.log10)),
    "ROUND": ((NUM, INT), lambda x, d: Term(_fail_if((d.col < 0) | (d.col > 15), "ROUND takes 0 to 15 digits", F.signum(x.col.cast("double")) * F.floor(F.abs(x.col.cast("double") * F.pow(F.lit(10.0), d.col)) + 0.5) / F.pow(F.lit(10.0), d.col)), "float", risky=True)),
    "CEILING": ((NUM,), _double(lambda x: F.ceil(x).cast("double"))),
    "FLOOR": ((NUM,), _double(lambda x: F.floor(x).cast("double"))),
    "SIGN": ((NUM,), lambda x: Term(F.signum(x.col.cast("double")).cast("bigint"), "int")),
    "GETDATE": ((), lambda: Term(F.current_timestamp().cast("timestamp_ntz"), "ts")),
    "GETUTCDATE": ((), lambda: Term(F.current_timestamp().cast("timestamp_ntz"), "ts")),
    "YEAR": ((TEMP,), lambda d: Term(F.year(d.col).cast("bigint"), "int")),
    "MONTH": ((TEMP,), lambda d: Term(F.month(d.col).cast("bigint"), "int")),
    "DAY": ((TEMP,), lambda d: Term(F.dayofmonth(d.col).cast("bigint"), "int")),
    "DATEPART": ((STR, TEMP), lambda p, d: Term(_date_part(_part(p), d.col, d.kind), "int")),
    "DATEADD": ((STR, INT, TEMP), _add),
    "DATEDIFF": ((STR, TEMP, TEMP), _diff),
}


def compile_typed(source: str, schema: T.StructType, variables: dict[str, str] | None = None) -> tuple[Column, str]:
    """The Column of an expression over columns of the schema, and its kind."""
    t = _Reader(source, schema, variables or {}).whole()
    return (t.col.cast("string") if t.kind == "null" else t.col), t.kind
