"""Row operators: each takes DataFrames and plain arguments and returns a DataFrame or one for each port. None runs a job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.engines import Scope, compile_expression, spark_type


class OperatorError(ValueError):
    """The arguments do not fit the operator or its inputs."""


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _known(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise OperatorError(f"{what}: unknown column {', '.join(missing)}; there are {', '.join(df.columns)}")


def _unique(names: Sequence[str], what: str) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise OperatorError(f"{what}: column {', '.join(twice)} would appear twice")


def filter_rows(df: DataFrame, where: Any, scope: Scope) -> DataFrame:
    """Rows where the condition is true; null drops."""
    return df.filter(compile_expression(where, df.schema, scope, predicate=True))


def _computed(spec: Any, df: DataFrame, scope: Scope) -> Column:
    kind = spec.get("type") if isinstance(spec, dict) else None
    return compile_expression({k: v for k, v in spec.items() if k not in ("type", "name")} if isinstance(spec, dict) else spec, df.schema, scope, to=spark_type(kind) if kind else None)


def map_add(df: DataFrame, add: dict[str, Any], scope: Scope) -> DataFrame:
    """Appends columns; all expressions see the input's columns only."""
    _unique([*df.columns, *add], "map")
    return df.select("*", *(_computed(spec, df, scope).alias(name) for name, spec in add.items()))


def map_select(df: DataFrame, select: list[Any], scope: Scope) -> DataFrame:
    """Columns as they are, renamed, or computed, in the order of the list."""
    out = []
    for item in select:
        if isinstance(item, str):
            _known(df, [item], "map select")
            out.append(q(item))
        elif "from" in item:
            _known(df, [item["from"]], "map select")
            out.append(q(item["from"]).alias(item["name"]))
        elif "name" in item:
            out.append(_computed(item, df, scope).alias(item["name"]))
        else:
            raise OperatorError("map select: an item needs a name")
    return df.select(*out)


def audit(df: DataFrame, columns: dict[str, Any]) -> DataFrame:
    """Appends constants: integers as bigint, decimals as double, others as string."""
    _unique([*df.columns, *columns], "audit")
    make = lambda v: F.lit(v).cast("bigint") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v) if isinstance(v, float) else F.lit(str(v))
    return df.select("*", *(make(v).alias(n) for n, v in columns.items()))


def split_rows(df: DataFrame, cases: list[dict], default: str | None, scope: Scope) -> dict[str, DataFrame]:
    """Each row goes to the first case that is true, else to the default port, if any."""
    names = [c["name"] for c in cases] + ([default] if default else [])
    _unique(names, "split")
    route = reduce(lambda w, c: w.when(compile_expression(c["where"], df.schema, scope, predicate=True), c["name"]), cases, F)
    routed = df.withColumn("__route", route.otherwise(F.lit(default)) if default else route)
    return {n: routed.filter(F.col("__route") == n).drop("__route") for n in names}


def multicast(df: DataFrame, taps: list[str]) -> dict[str, DataFrame]:
    _unique(taps, "multicast")
    return dict.fromkeys(taps, df)


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    if not isinstance(n, int) or n <= 0:
        raise OperatorError("limit: n must be a positive integer")
    return df.limit(n)


def unpivot(df: DataFrame, id_cols: list[str], value_cols: list[str], name_col: str, value_col: str) -> DataFrame:
    """A row for each value column, nulls too; columns that are not listed go."""
    _known(df, [*id_cols, *value_cols], "unpivot")
    if len({df.schema[c].dataType.simpleString() for c in value_cols}) != 1:
        raise OperatorError("unpivot: value columns must have one type")
    return df.unpivot([q(c) for c in id_cols], [q(c) for c in value_cols], name_col, value_col)


def pivot(df: DataFrame, id_cols: list[str], name_col: str, value_col: str, pivot_keys: list[str], order_by: Sequence[str] = ()) -> DataFrame:
    """A column for each declared name; the last value in the given order wins, a null too. Unknown names only make their row."""
    _known(df, [*id_cols, name_col, value_col, *order_by], "pivot")
    seq = F.struct(*(q(c) for c in order_by)) if order_by else F.monotonically_increasing_id()
    row = df.select(*(q(c) for c in id_cols), q(name_col).alias("__name"), F.struct(seq.alias("s"), q(value_col).alias("v")).alias("__v"))
    last = lambda k: F.max_by(F.when(F.col("__name") == k, F.col("__v.v")), F.when(F.col("__name") == k, F.col("__v.s"))).alias(k)
    return row.groupBy(*(q(c) for c in id_cols)).agg(*(last(k) for k in pivot_keys))


JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def join(left: DataFrame, right: DataFrame, on: dict[str, str], kind: str = "inner") -> DataFrame:
    """All columns of both; key types must be the same, names must differ; null and NaN keys match nothing."""
    if kind not in JOINS:
        raise OperatorError(f"join: unknown kind {kind!r}; there are {', '.join(JOINS)}")
    if not on:
        raise OperatorError("join: `on` needs a pair of keys")
    _known(left, list(on), "join")
    _known(right, list(on.values()), "join")
    _unique([*left.columns, *right.columns], "join")
    cond = F.lit(True)
    for a, b in on.items():
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if x != y:
            raise OperatorError(f"join: key {a} is {x.simpleString()} but {b} is {y.simpleString()}; cast one of them")
        eq = q(a) == q(b)
        cond = (cond & eq & ~F.isnan(q(a))) if isinstance(x, (T.FloatType, T.DoubleType)) else cond & eq
    return left.join(right, cond, JOINS[kind])


def lookup(df: DataFrame, ref: DataFrame, match: dict[str, str], select: dict[str, str], on_miss: str = "error") -> DataFrame:
    """Columns of the one matching reference row. More than one match is an error, as is none with on_miss error; null keys miss.

    Both sides meet in an ordinary equi-join, so Spark broadcasts the reference only while it is known to be small."""
    if on_miss not in ("error", "null", "drop"):
        raise OperatorError("lookup: on_miss is error, null or drop")
    _known(df, list(match), "lookup")
    _known(ref, [*match.values(), *select.values()], "lookup")
    _unique([*df.columns, *select], "lookup")
    for a, b in match.items():
        if df.schema[a].dataType != ref.schema[b].dataType:
            raise OperatorError(f"lookup: key {a} is {df.schema[a].dataType.simpleString()} but {b} is {ref.schema[b].dataType.simpleString()}")
    keys = {f"__k{i}": b for i, b in enumerate(match.values())}
    vals = {f"__v{i}": (out, src) for i, (out, src) in enumerate(select.items())}
    one = ref.select(*(q(b).alias(k) for k, b in keys.items()), *(q(src).alias(v) for v, (_, src) in vals.items()))
    one = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(F.first(v).alias(v) for v in vals))
    cond = reduce(lambda c, p: c & (q(p[0]) == F.col(p[1])), zip(match, keys, strict=True), F.lit(True))
    got = df.join(one, cond, "left")  # left for drop too: in an inner join the check of the matches would run on reference keys that no row asks for
    checks = F.assert_true(F.coalesce(F.col("__n"), F.lit(1)) == 1, "lookup: more than one match").isNull()
    if on_miss == "error":
        checks &= F.assert_true(F.col("__n").isNotNull(), "lookup: no match").isNull()
    got = got.filter(checks)
    if on_miss == "drop":
        got = got.filter(F.concat(q(next(iter(match))).cast("string"), F.col("__n").cast("string")).isNotNull())
    return got.select(*(q(c) for c in df.columns), *(F.col(v).alias(out) for v, (out, _) in vals.items()))


def _ordered(order_by: Sequence[str]) -> Column:
    return F.struct(*(q(c) for c in order_by))


def aggregate(df: DataFrame, group_by: list[str], compute: dict[str, dict], order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each group; null keys are a group. count counts rows. first and last need order_by."""
    _known(df, group_by, "aggregate")
    if not compute:
        raise OperatorError("aggregate: compute is empty")
    _unique([*group_by, *compute], "aggregate")
    makers: dict[str, Callable[[Column], Column]] = {
        "count": lambda c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct,
        "first": lambda c: F.min_by(c, _ordered(order_by)), "last": lambda c: F.max_by(c, _ordered(order_by)),
    }
    out = []
    for name, spec in compute.items():
        agg, over = spec.get("agg"), spec.get("over")
        if agg not in makers:
            raise OperatorError(f"aggregate: unknown agg {agg!r}; there are {', '.join(makers)}")
        if agg != "count" and over is None:
            raise OperatorError(f"aggregate: {agg} needs over")
        if agg in ("first", "last") and not order_by:
            raise OperatorError(f"aggregate: {agg} needs order_by, as rows have no order of their own")
        if over is not None:
            _known(df, [over], "aggregate")
        out.append(makers[agg](q(over) if over is not None else F.lit(1)).alias(name))
    return df.groupBy(*(q(c) for c in group_by)).agg(*out)


def distinct(df: DataFrame, keys: list[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Distinct rows, or the first row of each key in the given order (else of all its columns' order)."""
    if not keys:
        return df.distinct()
    _known(df, [*keys, *order_by], "distinct")
    first = F.min_by(F.struct("*"), F.struct(*(q(c) for c in order_by or df.columns)))
    return df.groupBy(*(q(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(first.alias("__row")).select("__row.*")


def sort(df: DataFrame, by: list[Any]) -> DataFrame:
    """Order by columns; text by its bytes; nulls first ascending, last descending."""
    if not by:
        raise OperatorError("sort: by is empty")
    out = []
    for item in by:
        name, way = (item, "asc") if isinstance(item, str) else (item["col"], item.get("dir", "asc"))
        _known(df, [name], "sort")
        if way not in ("asc", "desc"):
            raise OperatorError("sort: dir is asc or desc")
        out.append(q(name).asc_nulls_first() if way == "asc" else q(name).desc_nulls_last())
    return df.orderBy(*out)


def union(inputs: list[DataFrame]) -> DataFrame:
    """All rows of inputs with the same names and types in the same order."""
    shape = [(f.name, f.dataType) for f in inputs[0].schema]
    for k, d in enumerate(inputs[1:], 1):
        if [(f.name, f.dataType) for f in d.schema] != shape:
            raise OperatorError(f"union: input {k} has other columns than input 0")
    return reduce(DataFrame.unionAll, inputs)


def one_a_key(df: DataFrame, key: list[str], first: bool, order_by: Sequence[str] = ()) -> DataFrame:
    """Of rows with one key the last in the given order, or the first; rows with a null in the key all stay."""
    seq = F.struct(*(q(c) for c in order_by or [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]))
    whole = reduce(lambda a, b: a & b, (q(k).isNotNull() for k in key))
    pick = (F.min_by if first else F.max_by)(F.struct("*"), seq)
    return df.filter(whole).groupBy(*(q(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(pick.alias("r")).select("r.*").unionAll(df.filter(~whole))


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], on_conflict: str = "update", order_by: Sequence[str] = (), columns: list[str] | None = None) -> DataFrame:
    """The table after the incoming rows: modes update, update_if_changed, ignore and error; null keys always insert.

    Of incoming rows with one key the last in the given order counts for updates, the first for ignore. One shuffle on the key."""
    if on_conflict not in ("update", "update_if_changed", "ignore", "error"):
        raise OperatorError("upsert: on_conflict is update, update_if_changed, ignore or error")
    cols = columns or incoming.columns
    _known(incoming, [*key, *cols], "upsert")
    _known(target, cols, "upsert")
    if not key or not set(key) <= set(cols):
        raise OperatorError("upsert: key must be some of the columns")
    rest = [c for c in cols if c not in key]
    mode = "ignore" if on_conflict != "error" and not rest else on_conflict
    seq = F.struct(*(q(c) for c in order_by or [c for c in incoming.columns if not isinstance(incoming.schema[c].dataType, T.MapType)]))
    rows = incoming.select(F.struct(*(q(c).cast(target.schema[c].dataType).alias(c) for c in cols)).alias("n"), seq.alias("s"))
    whole = reduce(lambda a, b: a & b, (F.col(f"n.`{k}`").isNotNull() for k in key))
    pick = F.min_by if mode == "ignore" else F.max_by
    # a row with a null in its key is a group of its own, which matches nothing
    rows = rows.withColumn("g", F.when(whole, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    last = rows.groupBy(*(F.col(f"n.`{k}`").alias(f"__k{i}") for i, k in enumerate(key)), "g").agg(pick("n", "s").alias("n"), F.count(F.lit(1)).alias("c"))
    old = target.select(F.struct("*").alias("o"), *(q(k).alias(f"__t{i}") for i, k in enumerate(key)))
    cond = reduce(lambda a, b: a & b, (F.col(f"__t{i}") == F.col(f"__k{i}") for i in range(len(key))))
    both = old.join(last, cond, "full")
    if mode == "error":
        ok = F.assert_true(F.coalesce(F.col("c"), F.lit(1)) == 1, "upsert: key given twice").isNull() & F.assert_true(F.col("o").isNull() | F.col("n").isNull(), "upsert: key exists").isNull()
        both = both.filter(ok)
    hit = F.col("n").isNotNull() & (F.col("o").isNull() | F.lit(mode == "update"))
    if mode == "update_if_changed":
        hit |= F.col("n").isNotNull() & reduce(lambda a, b: a | b, (~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in rest))
    return both.select(*(F.when(hit, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) if c in cols else F.col(f"o.`{c}`").alias(c) for c in target.columns))


def scd2(dim: DataFrame, staging: DataFrame, key: str, tracked: list[str], batch: Column, current: str = "is_current", valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """A type-2 dimension after a batch: changed rows are closed and opened anew, new ones opened, others stay. One join."""
    cols = [key, *tracked]
    new = staging.select(F.struct(*(q(c).cast(dim.schema[c].dataType).alias(c) for c in cols)).alias("n"), q(key).cast(dim.schema[key].dataType).alias("__k"))
    open_ = dim.filter(q(current)).select(F.struct("*").alias("o"), q(key).alias("__d"))
    both = open_.join(new, F.col("__d") == F.col("__k"), "full")
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & reduce(lambda a, b: a | b, (~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in tracked))
    kept = {c: F.col(f"o.`{c}`") for c in dim.columns} | {current: F.col(f"o.`{current}`") & ~changed, valid_to: F.when(changed, batch).otherwise(F.col(f"o.`{valid_to}`"))}
    fresh = {c: F.col(f"n.`{c}`") if c in cols else F.lit(None).cast(dim.schema[c].dataType) for c in dim.columns} | {current: F.lit(True), valid_from: batch}
    row = lambda d: F.struct(*(d[c].cast(dim.schema[c].dataType).alias(c) for c in dim.columns))
    old_row, new_row = F.when(F.col("o").isNotNull(), row(kept)), F.when(F.col("n").isNotNull() & (F.col("o").isNull() | changed), row(fresh))
    rows = both.select(F.explode(F.filter(F.array(old_row, new_row), lambda r: r.isNotNull())).alias("r")).select("r.*")
    return dim.filter(~F.coalesce(q(current), F.lit(False))).unionAll(rows)


def moving_average(df: DataFrame, value: str, order_by: Sequence[str], rows: int, out: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The average of the last `rows` rows once there are that many, the usual stateful script."""
    w = Window.partitionBy(*(q(c) for c in partition_by)).orderBy(*(q(c) for c in order_by))
    return df.withColumn("__n", F.row_number().over(w)).withColumn(out, F.avg(q(value)).over(w.rowsBetween(1 - rows, 0))).filter(F.col("__n") >= rows).drop("__n")
