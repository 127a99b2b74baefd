"""Statements and upserts over JDBC: rows go to a staging table from the executors, one statement merges them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.relational import OperatorError, one_a_key


def dialect(url: str) -> str:
    """postgresql, sqlserver, or what else the URL names."""
    return url.split(":")[1]


def quoted(name: str, url: str) -> str:
    """A name, its parts between points quoted as the database wants it."""
    a, b = "[]" if dialect(url) == "sqlserver" else '""'
    return ".".join(f"{a}{part.replace(b, b * 2)}{b}" for part in name.split("."))


def staging_sql(url: str, table: str, stage: str, columns: Sequence[str]) -> str:
    """Makes an empty table with some columns of another."""
    t, s, cols = quoted(table, url), quoted(stage, url), ", ".join(quoted(c, url) for c in columns)
    if dialect(url) == "sqlserver":
        return f"SELECT {cols} INTO {s} FROM {t} WHERE 1 = 0"
    if dialect(url) == "derby":
        return f"CREATE TABLE {s} AS SELECT {cols} FROM {t} WITH NO DATA"
    return f"CREATE TABLE {s} AS SELECT {cols} FROM {t} WHERE 1 = 0"


def merge_sql(url: str, table: str, stage: str, columns: Sequence[str], key: Sequence[str], on_conflict: str) -> str:
    """One statement that brings the staged rows in. Null keys match nothing, so they are inserted."""
    q = lambda name: quoted(name, url)
    t, s, cols = q(table), q(stage), ", ".join(map(q, columns))
    rest = [c for c in columns if c not in key]
    if on_conflict == "error":
        return f"INSERT INTO {t} ({cols}) SELECT {cols} FROM {s}"
    mode = on_conflict if rest else "ignore"
    if dialect(url) == "postgresql":
        head = f"INSERT INTO {t} AS t ({cols}) SELECT {cols} FROM {s} ON CONFLICT ({', '.join(map(q, key))})"
        if mode == "ignore":
            return f"{head} DO NOTHING"
        changed = f" WHERE ({', '.join(f't.{q(c)}' for c in rest)}) IS DISTINCT FROM ({', '.join(f'EXCLUDED.{q(c)}' for c in rest)})"
        return f"{head} DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}{changed if mode == 'update_if_changed' else ''}"
    differs = " OR ".join(f"t.{q(c)} <> s.{q(c)} OR (t.{q(c)} IS NULL AND s.{q(c)} IS NOT NULL) OR (t.{q(c)} IS NOT NULL AND s.{q(c)} IS NULL)" for c in rest)
    hit = "" if mode == "ignore" else f" WHEN MATCHED{f' AND ({differs})' if mode == 'update_if_changed' else ''} THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)}"
    end = ";" if dialect(url) == "sqlserver" else ""
    return f"MERGE INTO {t} {'AS ' if end else ''}t USING {s} {'AS ' if end else ''}s ON {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in key)}{hit} WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({', '.join(f's.{q(c)}' for c in columns)}){end}"


def _connect(spark: SparkSession, url: str) -> JavaObject:
    return spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)


def execute(spark: SparkSession, url: str, statements: Iterable[str]) -> None:
    """Statements in one transaction."""
    link = _connect(spark, url)
    try:
        link.setAutoCommit(False)
        for sql in statements:
            st = link.createStatement()
            st.execute(sql)
            st.close()
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def execute_rows(spark: SparkSession, url: str, sql: str, rows: Iterable[Sequence], batch: int = 1000) -> int:
    """One prepared statement for all rows, in one transaction; how many rows there were."""
    link, n = _connect(spark, url), 0
    try:
        link.setAutoCommit(False)
        st = link.prepareStatement(sql)
        for row in rows:
            for k, v in enumerate(row, 1):
                st.setObject(k, v)
            st.addBatch()
            n += 1
            if n % batch == 0:
                st.executeBatch()
        st.executeBatch()
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()
    return n


def append(rows: DataFrame, url: str, table: str, batch: int = 10000, truncate: bool = False) -> None:
    rows.write.format("jdbc").option("url", url).option("dbtable", quoted(table, url)).option("batchsize", batch).option("truncate", truncate).mode("overwrite" if truncate else "append").save()


def upsert(rows: DataFrame, url: str, table: str, key: list[str], on_conflict: str = "update", order_by: Sequence[str] = (), columns: list[str] | None = None, batch: int = 10000) -> None:
    """Brings rows into a table with a unique key: update, update_if_changed, ignore or error.

    The executors write the staging table in batches, in parallel; the merge is one statement, so the table changes whole or not at all.
    Of rows with one key the last in the given order counts, the first for ignore; with error they fail on the table's key."""
    if on_conflict not in ("update", "update_if_changed", "ignore", "error"):
        raise OperatorError("upsert: on_conflict is update, update_if_changed, ignore or error")
    spark, cols = rows.sparkSession, columns or rows.columns
    if not key or not set(key) <= set(cols):
        raise OperatorError("upsert: key must be some of the columns")
    stage = f"{table}__stage_{uuid.uuid4().hex[:12]}"
    one = rows if on_conflict == "error" else one_a_key(rows, key, on_conflict == "ignore", order_by)
    execute(spark, url, [staging_sql(url, table, stage, cols)])
    try:
        append(one.select(*cols), url, stage, batch)
        execute(spark, url, [merge_sql(url, table, stage, cols, key, on_conflict)])
    finally:
        execute(spark, url, [f"DROP TABLE {quoted(stage, url)}"])
