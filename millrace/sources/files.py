"""Readers and writers of files. Readers return lazy DataFrames; writers run one job."""

from __future__ import annotations

import contextlib
import csv
import functools
import io
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.engines import spark_type
from millrace.operators.relational import OperatorError

#: Code page numbers that are not windows-NNNN.
CODEPAGES = {"65001": "UTF-8", "1200": "UTF-16LE", "1201": "UTF-16BE", "932": "Shift_JIS", "936": "GBK", "949": "EUC-KR", "950": "Big5", "20127": "US-ASCII", "28591": "ISO-8859-1", "28605": "ISO-8859-15", "437": "IBM437", "850": "IBM850", "852": "IBM852", "866": "IBM866"}

#: Fixed values. Charsets that Spark's own reader takes.
SPARK_CHARSETS = {"utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32", "iso-8859-1", "us-ascii"}


def charset(name: str | int) -> str:
    name = str(name)
    return CODEPAGES.get(name, f"windows-{name}") if name.isdigit() else name


def generate_ints(spark: SparkSession, row_count: int, start: int = 0, column: str = "id") -> DataFrame:
    return spark.range(start, start + row_count).select(F.col("id").alias(column))


def generate_strings(spark: SparkSession, row_count: int, prefix: str = "row_", id_column: str = "id", name_column: str = "name") -> DataFrame:
    return spark.range(row_count).select(F.col("id").alias(id_column), F.concat(F.lit(prefix), F.col("id").cast("string")).alias(name_column))


def read_csv(spark: SparkSession, path: str, columns: list[dict] | None = None, delimiter: str = ",", header: bool = True, encoding: str = "utf-8", multiline: bool = True) -> DataFrame:
    """Quoted fields may span lines, so a file is one task's; with multiline false they may not, and large files are split. Blank lines are skipped; any malformed row or field fails. Columns go by position.

    Without columns the header's names are used, all bigint. Text has no null: an empty field is ""."""
    if len(delimiter) != 1:
        raise OperatorError("csv.read: delimiter must be one character")
    name = charset(encoding)
    if name.lower() not in SPARK_CHARSETS:
        return _read_csv_decoded(spark, path, columns, delimiter, header, name)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": multiline, "mode": "FAILFAST", "encoding": name}
    if not columns:
        if not header:
            raise OperatorError("csv.read: without a header, columns must be declared")
        columns = [{"name": n, "type": "int64"} for n in spark.read.options(**options, header=True).csv(path).columns]
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    df = spark.read.schema(raw).options(**options, header=header, enforceSchema=True).csv(path)
    return df.select(*(_typed(F.col(f"c{i}"), c).alias(c["name"]) for i, c in enumerate(columns)))


def _read_csv_decoded(spark: SparkSession, path: str, columns: list[dict] | None, delimiter: str, header: bool, encoding: str) -> DataFrame:
    """Files in a charset that Spark's reader doesn't take: decoded and parsed a file a task, as that reader does with fields that span lines."""

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                lines = csv.reader(io.StringIO(content.as_py().decode(encoding), newline=""), delimiter=delimiter, strict=True)
                rows = [r for r in lines if r]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array([k == 0 for k in range(len(rows))], pa.bool_())], ["r", "first"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "r array<string>, first boolean")
    if not columns:
        if not header:
            raise OperatorError("csv.read: without a header, columns must be declared")
        columns = [{"name": n, "type": "int64"} for n in rows.where("first").first()["r"]]
    body = rows.where("not first") if header else rows
    whole = F.when(F.size("r") == len(columns), F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"malformed row: {len(columns)} fields expected, got "), F.size("r").cast("string"))))
    return body.select(whole.alias("r")).select(*(_typed(F.col("r")[i], c).alias(c["name"]) for i, c in enumerate(columns)))


def _typed(c: Column, spec: dict) -> Column:
    kind = spec.get("type", "utf8")
    if kind in ("utf8", "string", "u"):
        return F.coalesce(c, F.lit(""))
    must = F.when(c.isNull() | (c == ""), F.expr(f"raise_error('empty field in column {spec['name']}')")).otherwise(c)
    if kind == "decimal":
        return must.cast(f"decimal({spec.get('precision', 38)},{spec.get('scale', 0)})")
    if kind in ("binary", "z"):
        return F.unhex(must)
    if kind == "uuid":
        return F.lower(must)
    if kind == "time":
        return (F.substring(must, 1, 2).cast("bigint") * 3600 + F.substring(must, 4, 2).cast("bigint") * 60) * 1000000 + (F.substring(must, 7, 9).cast("decimal(9,6)") * 1000000).cast("bigint")
    return must.cast(spark_type(kind))


def number_text(c: Column, digits: int = 17) -> Column:
    """A number as C prints it with %.17g (doubles) or %.9g (floats). The JVM's own text has other digits, so this runs in Arrow batches."""

    @F.arrow_udf("string")
    def text(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else format(x, f".{digits}g") for x in v.to_pylist()], pa.string())

    return text(c.cast("double"))


def read_json(spark: SparkSession, path: str, columns: list, format: str = "ndjson") -> DataFrame:
    """Every column is text: numbers without needless digits, nested values as compact JSON, missing ones null."""
    names = [c["name"] if isinstance(c, dict) else c for c in columns]
    if not names:
        raise OperatorError("json.read: columns is empty")
    if format == "array":
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.parse_json("value").cast("array<variant>")).alias("v"))
    else:
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.parse_json("value").alias("v"))

    def cell(name: str) -> Column:
        v = F.try_variant_get("v", f"$['{name}']", "variant")
        kind = F.schema_of_variant(v)
        text = F.to_json(v)
        number = number_text(F.try_variant_get("v", f"$['{name}']", "double"))
        return F.when(F.is_variant_null(v) | v.isNull(), F.lit(None)).when(kind == "STRING", F.try_variant_get("v", f"$['{name}']", "string")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number).otherwise(text)

    return rows.select(*(cell(n).alias(n) for n in names))


def read_xml(spark: SparkSession, path: str, row_xpath: str, columns: dict[str, str]) -> DataFrame:
    """A row for each node of row_xpath, in each file; cells are text, null where nothing matches."""
    names = list(columns)
    docs = spark.read.text(path, wholetext=True)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for text in pdf["value"]:
                root = ElementTree.fromstring(text)
                steps = [s for s in row_xpath.split("/") if s]
                nodes = root.iter(steps[-1]) if row_xpath.startswith("//") else root.findall("/".join(steps[1:]) or ".") if steps and root.tag == steps[0] else root.findall("/".join(steps))
                for node in nodes:
                    out.append([_xml_cell(node, columns[n]) for n in names])
            yield pd.DataFrame(out, columns=names)

    return docs.mapInPandas(parse, schema)


def _xml_cell(node, path: str) -> str | None:
    path = path.removesuffix("/text()")
    step, _, attr = path.rpartition("@")
    if "@" in path:
        at = node.find(step.rstrip("/")) if step.strip("/.") else node
        return at.get(attr) if at is not None else None
    if path in (".", "text()", ""):
        return "".join(node.itertext())
    found = node.find(path)
    return "".join(found.itertext()) if found is not None else None


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


#: Fixed values. The format's own limits: rows of a worksheet and characters of its name.
SHEET_ROWS, SHEET_NAME = 1048576, 31

#: The defined name of a worksheet in which another goes on. It refers to that one: to its row 1 where the header is repeated, else to a cell.
_GOES_ON = "millrace_goes_on"


def _parts(z: zipfile.ZipFile, sheet: str | None) -> list[tuple[str, bool]]:
    """The file of a worksheet, then those in which it goes on; whether their first row repeats its first."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")) for s in book.find("m:sheets", _NS)]
    at = next((i for i, (name, _) in enumerate(sheets) if sheet in (None, name)), None)
    if at is None:
        raise OperatorError(f"xlsx.read: no sheet {sheet!r}")
    parts = {at: False}
    for d in book.iterfind("m:definedNames/m:definedName", _NS):
        if d.get("name") == _GOES_ON and d.get("localSheetId"):
            first, _, cells = (d.text or "").rpartition("!")
            if (first[1:-1].replace("''", "'") if first.startswith("'") else first) == sheets[at][0]:
                parts[int(d.get("localSheetId"))] = ":" in cells
    return [(t if t.startswith("xl/") else f"xl/{t}", again) for i, again in sorted(parts.items(), key=lambda p: (p[0] != at, p[0])) for t in [sheets[i][1]]]


def _elements(f, tag: str):
    """Elements of a tag, each forgotten once the next is asked for."""
    above, wanted = [], f"{{{_NS['m']}}}{tag}"
    for event, e in ElementTree.iterparse(f, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == wanted:
            yield e
            above[-1].clear()


@functools.cache
def _column(letters: str) -> int:
    return functools.reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters, 0) - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a worksheet and of those in which it goes on, as text."""
    z, shared = zipfile.ZipFile(io.BytesIO(data)), []
    value, piece = f"{{{_NS['m']}}}v", f"{{{_NS['m']}}}t"
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            shared = ["".join(t.text or "" for t in si.iter(piece)) for si in _elements(f, "si")]
    for part, again in _parts(z, sheet):
        with z.open(part) as f:
            for row in islice(_elements(f, "row"), int(again), None):
                cells: dict[int, str | None] = {}
                for c in row:
                    v, kind = c.find(value), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(piece)) if kind == "inlineStr" else v.text if v is not None else None
                    cells[_column(re.match(r"[A-Z]+", c.get("r", "A"))[0])] = shared[int(text)] if kind == "s" and text is not None else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None, sheet: str | None = None, header: bool = True) -> DataFrame:
    """A worksheet, all text, with those in which write_xlsx went on. A file is parsed in one task, row by row; Spark reads files of up to 2 GiB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if columns is None:
        if not header:
            raise OperatorError("xlsx.read: without a header, columns must be declared")

        def first(batches):
            for batch in batches:
                for data in batch.column("content"):
                    yield pa.RecordBatch.from_arrays([pa.array([[str(c) for c in row] for row in islice(sheet_rows(data.as_py(), sheet), 1)], pa.list_(pa.string()))], ["names"])

        top = files.mapInArrow(first, "names array<string>").first()
        if top is None:
            raise OperatorError("xlsx.read: no header row")
        columns = top["names"]
    names = [c["name"] if isinstance(c, dict) else c for c in columns]

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = sheet_rows(data.as_py(), sheet)
                top = next(rows, []) if header else None
                at = list(range(len(names))) if top is None else [top.index(n) if n in top else None for n in names]
                while some := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] if i is not None and i < len(r) else None for r in some], pa.string()) for i in at], names)

    return files.mapInArrow(parse, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", header: bool = True) -> int:
    """One workbook, rows streamed from the cluster one partition at a time. A worksheet that is full goes on in "Sheet1 (2)" and so on, which repeat the header."""
    esc = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    sheet, letters = str(sheet), [_letters(i) for i in range(len(df.columns))]

    def cell(at: str, v) -> str:
        if v is None:
            return f'<c r="{at}"/>'
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'

    def line(k: int, row) -> bytes:
        return (f'<row r="{k}">' + "".join(cell(f"{c}{k}", v) for c, v in zip(letters, row, strict=True)) + "</row>").encode()

    n, sheets, start, end = 0, [], f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode(), b"</sheetData></worksheet>"
    rows = df.toLocalIterator()
    row = next(rows, None)
    with _delivered(df.sparkSession, path) as local, zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        while row is not None or not sheets:
            sheets.append(_sheet_name(sheet, sheets))
            with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w") as f:
                size = f.write(start + (line(1, df.columns) if header else b""))
                first = k = 1 + bool(header)
                while row is not None and k <= SHEET_ROWS:
                    made = line(k, row)
                    if k > first and size + len(made) + len(end) > zipfile.ZIP64_LIMIT:  # a longer file would need a form that spreadsheet programs may not take
                        break
                    size += f.write(made)
                    k += 1
                    n += 1
                    row = next(rows, None)
                f.write(end)
        ids = range(1, len(sheets) + 1)
        quoted = "'" + sheet.replace("'", "''") + "'"
        going = "".join(f'<definedName name="{_GOES_ON}" localSheetId="{i}" hidden="1">{esc(quoted)}!{"$1:$1" if header else "$A$1"}</definedName>' for i in ids[:-1])
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS["p"]}"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>' + "".join(f'<sheet name="{esc(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(ids, sheets, strict=True)) + "</sheets>" + (f"<definedNames>{going}</definedNames>" if going else "") + "</workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS["p"]}">' + "".join(f'<Relationship Id="rId{i}" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
    return n


def _sheet_name(sheet: str, taken: list[str]) -> str:
    """The name, or with a number the next one that is not taken."""
    if not taken:
        return sheet
    k = len(taken) + 1
    while (name := f"{sheet[: SHEET_NAME - len(f' ({k})')]} ({k})") in taken:
        k += 1
    return name


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def rendered(c: Column, dt: T.DataType) -> Column:
    """A cell as CSV text: null is empty."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        text = number_text(c, 17 if isinstance(dt, T.DoubleType) else 9)
    elif isinstance(dt, T.TimestampNTZType):
        text = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))).otherwise(""))
    elif isinstance(dt, T.TimestampType):
        text = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))).otherwise(""), F.lit("Z"))
    elif isinstance(dt, T.BinaryType):
        text = F.lower(F.hex(c))
    elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, encoding: str = "utf-8") -> int:
    """One file; a field is quoted only where it holds the delimiter, a quote or a line end. Lines are made by Spark."""
    quote = lambda t: F.when(t.rlike(f"[{re.escape(delimiter)}\"\\r\\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    line = F.concat_ws(delimiter, *(quote(rendered(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema)).alias("line")
    first = delimiter.join(f'"{c.replace(chr(34), chr(34) * 2)}"' if re.search(f"[{re.escape(delimiter)}\"\r\n]", c) else c for c in df.columns) + "\n" if header else ""
    return _write_lines(df.select(line), path, first, "", charset(encoding))


@contextlib.contextmanager
def _delivered(spark: SparkSession, path: str):
    """A local file of the driver to write; when that went well it becomes `path`, in the store that Spark would read it from."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = java.Path(path)
    store = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    here = to.toUri().getPath() if store.getUri().getScheme() == "file" else None
    if here:
        os.makedirs(os.path.dirname(os.path.abspath(here)), exist_ok=True)
    if here:
        local = f"{here}.tmp"
    else:
        handle, local = tempfile.mkstemp(prefix="millrace-sink-")
        os.close(handle)
    try:
        yield local
        if here:
            os.replace(local, here)
        else:
            store.copyFromLocalFile(True, True, java.Path(f"file://{local}"), to)
    finally:
        if os.path.exists(local):
            os.remove(local)


def _write_lines(lines: DataFrame, path: str, first: str, last: str, encoding: str, between: str = "\n", close: str = "\n") -> int:
    n = 0
    with _delivered(lines.sparkSession, path) as local, open(local, "w", encoding=encoding, newline="") as f:
        f.write(first)
        for row in lines.toLocalIterator(prefetchPartitions=True):
            f.write(("" if n == 0 else between if between != "\n" else "") + row[0] + (close if between == "\n" else ""))
            n += 1
        f.write(last)
    return n


def write_json(df: DataFrame, path: str, format: str = "ndjson") -> int:
    """Nulls are written, NaN and infinities as null."""
    def member(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
            return F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}:"), F.coalesce(F.when(finite, number_text(c, 17 if isinstance(f.dataType, T.DoubleType) else 9)), F.lit("null")))
        whole = F.to_json(F.struct(c.alias(f.name)), {"ignoreNullFields": "false"})
        return F.substring(whole, F.lit(2), F.char_length(whole) - 2)

    lines = df.select(F.concat(F.lit("{"), F.concat_ws(",", *map(member, df.schema)), F.lit("}")).alias("line"))
    if format == "array":
        return _write_lines(lines, path, "[\n", "\n]\n", "utf-8", between=",\n")
    return _write_lines(lines, path, "", "", "utf-8")


def read_jdbc(spark: SparkSession, connection: dict, query: str, fetch: int = 1024, partition: dict | None = None) -> DataFrame:
    """A query over a connection: type spark runs it on the session's catalog, others through JDBC.

    partition: {column, lower, upper, parts} reads ranges of a column in as many tasks; without it one task reads all."""
    if connection.get("type") == "spark":
        return spark.sql(query)
    read = spark.read.format("jdbc").option("url", jdbc_url(connection)).option("fetchsize", fetch)
    if partition:
        return read.options(dbtable=f"({query}) q", partitionColumn=partition["column"], lowerBound=partition["lower"], upperBound=partition["upper"], numPartitions=partition["parts"]).load()
    return read.option("query", query).load()


def jdbc_url(connection: dict) -> str:
    dsn = str(connection["dsn"])
    if dsn.startswith("jdbc:"):
        return dsn
    kind = {"postgres": "postgresql", "mssql": "sqlserver"}.get(connection["type"], connection["type"])
    return f"jdbc:{kind}://{dsn.partition('://')[2] or dsn}"


def load_json_or_yaml(text: str, name: str):
    """A document; YAML as version 1.2 has it: only true and false are booleans, and plain decimals are numbers."""
    if name.endswith(".json"):
        return json.loads(text)
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(text, Loader)
