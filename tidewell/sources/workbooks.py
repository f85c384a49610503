"""Workbooks (.xlsx): a data source with a partition for each sheet (several, if there are very many), and a writer with a task for each workbook.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").schema("MODEL long, SEED double").option("header", 3).load("models.xlsx")

A sheet's rows are parsed as they come out of the archive, so a task holds some
rows of a sheet, and the workbook's shared strings if the sheet uses any.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
import zipfile
from functools import cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources import sinks, tables

#: Fixed values of the format: numbers of the built-in date and time formats.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Columns that say where a row stands, if the schema asks for them.
PLACES = {"sheet": "string", "sheet_no": "int", "row": "long"}
#: The schema without a given one: a row for each cell that isn't empty.
CELLS = "sheet string, sheet_no int, row long, column int, header string, text string, number double, time timestamp_ntz"
_BATCH = 2000
#: Bytes of a sheet that are parsed at once, and values of cells that are kept to be used again.
_PIECE, _KNOWN = 1 << 16, 4096
#: Rows of a sheet, at most: a fixed value of the format.
MOST_ROWS = 1 << 20


def open_file(path: str):
    """A file that can be read at any place, local or in a store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    for name in ("s3a://", "s3n://"):
        path = path.replace(name, "s3://", 1) if path.startswith(name) else path
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(archive: zipfile.ZipFile, member: str, name: str):
    """Elements of a name, one at a time; what has been read is let go."""
    with archive.open(member) as f:
        path = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if _plain(e.tag) == name:
                yield e
                # neither the element nor its place in its parent stays
                if path:
                    path[-1].clear()


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, member of the archive) of each sheet, in order."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        target = {e.get("Id"): e.get("Target") for e in _children(z, "xl/_rels/workbook.xml.rels", "Relationship")}
        out = []
        for e in _children(z, "xl/workbook.xml", "sheet"):
            at = target[next(v for k, v in e.attrib.items() if _plain(k) == "id" and "}" in k)]
            out.append((e.get("name"), at.lstrip("/") if at.startswith("/") else f"xl/{at}"))
        return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    custom = {int(e.get("numFmtId")): e.get("formatCode") for e in _children(z, "xl/styles.xml", "numFmt")}
    # letters within quotes or brackets are no date parts
    dates = DATE_FORMATS | {n for n, code in custom.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower())}
    for e in _children(z, "xl/styles.xml", "cellXfs"):
        return {i for i, x in enumerate(e) if int(x.get("numFmtId") or 0) in dates}
    return set()


def _text(e) -> str:
    """All text of a string item but phonetic hints."""
    if len(e) == 1 and e[0].tag.endswith("}t"):
        return e[0].text or ""
    return "".join(t.text or "" for part in e if _plain(part.tag) in ("t", "r") for t in ([part] if _plain(part.tag) == "t" else part) if _plain(t.tag) == "t")


@cache
def _column(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


#: A row's start or a cell as most programs write them; a chunk with anything else in it goes to the XML parser.
_PLAIN = re.compile(
    r'<row r="(\d+)"[^<>/]*>|<c r="([A-Z]+)\d+"(?: s="(\d+)")?(?: t="(?!inlineStr)(\w+)")?(?:/>|><v>([^<]+)</v></c>)|<c r="([A-Z]+)\d+"(?: s="\d+")? t="inlineStr"><is><t(?: [^<>]*[^/<>])?>([^<]*)</t></is></c>'
)
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _unescaped(text: str) -> str:
    """Text without entities and references to characters."""
    return re.sub("&([^;]*);", lambda m: chr(int("0" + m[1][1:], 16 if m[1][1] == "x" else 10)) if m[1].startswith("#") else _ENTITIES[m[1]], text)


def _plain_rows(text: str) -> list | None:
    """What _raw_rows gives for a text of whole rows; None if there is more in it than _PLAIN knows."""
    out, cells, tags, escaped = [], [], 0, "&" in text
    for row, letters, style, kind, number, text_letters, inline in _PLAIN.findall(text):
        if row:
            cells = []
            out.append((int(row) - 1, cells))
            tags += 2
        elif number:
            tags += 4
            if kind != "e":
                cells.append((_column(letters), (kind, style, _unescaped(number) if escaped else number)))
        elif text_letters:
            tags += 6
            cells.append((_column(text_letters), ("inlineStr", "", _unescaped(inline) if escaped else inline)))
        else:
            tags += 1
    return out if tags == text.count("<") and "\r" not in text else None


def _tree_rows(start: bytes, f):
    """What _raw_rows gives, by a tree that the parser builds without a call a cell; complete rows are taken from it after each piece and let go."""

    def raw(rows_):
        for row in rows_:
            cells, col = [], -1
            for c in row:
                ref, kind = c.get("r"), c.get("t") or "n"
                col = _column(ref.rstrip("0123456789")) if ref else col + 1
                wanted = "is" if kind == "inlineStr" else "v"
                x = next((x for x in c if _plain(x.tag) == wanted), None)
                if x is not None and kind != "e":
                    cells.append((col, (kind, c.get("s") or "", _text(x) if kind == "inlineStr" else x.text or "")))
            yield int(row.get("r")) - 1 if row.get("r") else None, cells

    tree = ElementTree.TreeBuilder()
    parser, root, data = ElementTree.XMLParser(target=tree), None, None
    piece = start or f.read(_PIECE)
    while piece:
        parser.feed(piece)
        root = tree.close() if root is None else root  # the root as built so far
        if data is None and root is not None:
            data = next((e for e in root if _plain(e.tag) == "sheetData"), None)
        if data is not None:
            if root[-1] is not data:  # the rows have ended
                break
            whole = data[:-1]
            del data[:-1]
            yield from raw(whole)
        piece = f.read(_PIECE)
    else:
        parser.close()
    if data is not None:
        yield from raw(data)


def _raw_rows(f):
    """(row, [(column, (kind, style, text))]) of a sheet's XML, row and column from 0; a row that names no place has None."""
    rest = b""
    while b"<sheetData>" not in rest and len(rest) < 16 * _PIECE and (piece := f.read(_PIECE)):
        rest += piece
    head, data, now = rest.partition(b"<sheetData>")
    encoding = re.search(rb"encoding=.([A-Za-z0-9_-]+)", head[:200])
    if data and b"<!" not in head and (encoding is None or encoding[1].lower() == b"utf-8"):
        while True:
            cut = now.rfind(b"</row>") + 6
            if cut > 5:
                found = _plain_rows(now[:cut].decode())
                if found is None:
                    break
                yield from found
                now = now[cut:]
            if not (piece := f.read(_PIECE)):
                break
            now += piece
        rest = head + data + now
    yield from _tree_rows(rest, f)


def rows(path: str, member: str, convert=lambda x: x):
    """(row, {column: value}) of a sheet, both from 0. Values are str, float, bool or datetime, each as convert makes it; error cells and empty ones are left out."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        dates, shared = _date_styles(z), None
        first = datetime.datetime(1899, 12, 30)
        for e in _children(z, "xl/workbook.xml", "workbookPr"):
            if e.get("date1904") in ("1", "true"):
                first = datetime.datetime(1904, 1, 1)

        def value(kind, style, text):
            nonlocal shared
            if kind in ("inlineStr", "str"):
                return text
            if kind == "s":
                if shared is None:
                    shared = pa.array([_text(si) for si in _children(z, "xl/sharedStrings.xml", "si")], pa.string())
                return shared[int(text)].as_py()
            if kind == "b":
                return text == "1"
            if kind == "d":
                return datetime.datetime.fromisoformat(text.rstrip("Z"))
            number = float(text)
            return first + datetime.timedelta(seconds=round(number * 86400, 3)) if int(style or 0) in dates else number

        at, known = -1, {}
        with z.open(member) as stream:
            for place, raw in _raw_rows(stream):
                at = at + 1 if place is None else place
                cells = {}
                for col, key in raw:
                    # equal cells have equal values, which are made once
                    if key in known:
                        cells[col] = known[key]
                    elif key[2] or key[0] in ("inlineStr", "str", "b"):
                        if len(known) >= _KNOWN:
                            known.clear()
                        cells[col] = known[key] = convert(value(*key))
                yield at, cells


def as_text(x) -> str | None:
    """A cell's value as text: whole numbers without a point."""
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
    return x.isoformat(sep=" ") if isinstance(x, datetime.datetime) else x


def as_number(x) -> float | None:
    if isinstance(x, str):
        try:
            return float(x.strip().replace(",", "."))
        except ValueError:
            return None
    return None if isinstance(x, datetime.datetime) else x if x is None else float(x)


def _as_time(x):
    if isinstance(x, str):
        try:
            return datetime.datetime.fromisoformat(x.strip())
        except ValueError:
            return None
    return x if isinstance(x, datetime.datetime) else None


def _whole(x):
    n = as_number(x)
    return int(n) if n is not None and n == n and abs(n) < 2**63 and n.is_integer() else None


_CASTS = {"string": as_text, "double": as_number, "bigint": _whole, "int": _whole, "timestamp": _as_time, "timestamp_ntz": _as_time, "boolean": lambda x: x if isinstance(x, bool) else None}
_ARROW = {
    "string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"),
    "boolean": pa.bool_()
}


def _headers(cells: dict) -> dict[int, str]:
    """Names of columns; of equal ones the first keeps its name, the others get .1, .2 and so on."""
    seen, out = {}, {}
    for col in sorted(cells):
        name = (as_text(cells[col]) or "").strip()
        n = seen[name] = seen.get(name, -1) + 1
        out[col] = f"{name}.{n}" if n else name
    return out


#: Partitions of one read, at most; beyond that a task reads several sheets, one after the other.
MOST_PARTITIONS = 256


class Sheets(InputPartition):
    """(path, name, number, member) of the sheets of a partition: one, as long as there are no more than MOST_PARTITIONS."""

    def __init__(self, sheets: list[tuple[str, str, int, str]]):
        self.sheets = sheets


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.header, self.pattern = schema, int(options.get("header", 0)), options.get("sheets", "")
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.long = [f.name for f in schema] == [c.split()[0] for c in CELLS.split(", ")]
        if not self.long and (bad := [f.name for f in schema if f.dataType.simpleString() not in _CASTS]):
            raise ValueError(f"columns {bad} have a type that no cell has")

    def partitions(self):
        found = [(p, name, n, member) for p in self.paths for n, (name, member) in enumerate(sheets(p)) if re.search(self.pattern, name)]
        each = max(1, -(-len(found) // MOST_PARTITIONS))
        return [Sheets(found[i : i + each]) for i in range(0, len(found), each)] or [Sheets([])]  # a source must have a partition

    def read(self, part: Sheets):
        for sheet in part.sheets:
            yield from self._cells(*sheet) if self.long else self._rows(*sheet)

    def _cells(self, path: str, name: str, number: int, member: str):
        ats, cols, casts, names = [], [], [], None
        for at, cells in rows(path, member, lambda x: (as_text(x), as_number(x), _as_time(x))):
            if at < self.header or names is None:
                if at >= self.header:
                    names = _headers({col: x[0] for col, x in cells.items()})
                continue
            for col in cells if len(cells) < 2 else sorted(cells):
                ats.append(at)
                cols.append(col)
                casts.append(cells[col])
            if len(casts) >= 5 * _BATCH:
                yield self._batch_of_cells(name, number, names, ats, cols, casts)
                ats, cols, casts = [], [], []
        if casts:
            yield self._batch_of_cells(name, number, names, ats, cols, casts)

    def _batch_of_cells(self, name: str, number: int, names: dict, ats: list, cols: list, casts: list) -> pa.RecordBatch:
        fields = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema])
        column = pa.array(cols, pa.int32())
        header = pa.array([names.get(i) for i in range(max(cols) + 1)], pa.string()).take(column)
        same = [pa.repeat(pa.scalar(x, fields.field(i).type), len(cols)) for i, x in enumerate((name, number))]
        values = [pa.array(x, fields.field(i).type) for i, x in enumerate(zip(*casts, strict=True), 5)]
        return pa.RecordBatch.from_arrays([*same, pa.array(ats, fields.field(2).type), column, header, *values], schema=fields)

    def _rows(self, path: str, name: str, number: int, member: str):
        held, names = [], None
        for at, cells in rows(path, member):
            if at < self.header or names is None:
                if at >= self.header:
                    names = _headers(cells)
                continue
            if cells:
                held.append(self._typed(dict(zip(PLACES, (name, number, at), strict=True)), {names[c]: x for c, x in cells.items() if c in names}))
            if len(held) >= _BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _typed(self, where: dict, by_name: dict) -> tuple:
        return tuple(where[f.name] if f.name in where and f.name not in by_name else _CASTS[f.dataType.simpleString()](by_name.get(f.name)) for f in self.schema)

    def _batch(self, held: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema])
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WorkbookSource(DataSource):
    """Format `workbook`. Options: header (the row of the names, from 0), sheets (a regular expression that names must contain), paths (a JSON list).

    Without a schema a row for each cell that isn't empty (CELLS). With one, its
    columns by their names in the header, null where a cell is empty or no such
    value, or where the sheet has no such column; sheet, sheet_no and row say
    where a row stands. Rows without a cell are left out. Dates are numbers with
    a date format; they and ISO texts are times, which name no zone (as timestamp, UTC is taken). Formulas give the
    value that is stored with them.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_workbook(spark: SparkSession, path: str | list[str], schema: str | None = None, header: int = 0, pattern: str = "") -> DataFrame:
    """Rows of all sheets of one or more workbooks; see WorkbookSource."""
    spark.dataSource.register(WorkbookSource)
    r = spark.read.format("workbook").option("header", header).option("sheets", pattern)
    r = r.option("paths", json.dumps([path] if isinstance(path, str) else list(path)))
    return (r.schema(schema) if schema else r).load()


def sheet_headers(path: str, number: int = 0, header: int = 0) -> list[str]:
    """The names in one sheet's header, in order."""
    _, member = sheets(path)[number]
    for at, cells in rows(path, member):
        if at >= header:
            return [n for _, n in sorted(_headers(cells).items())]
    return []


def parameters_workbook(spark: SparkSession, path: str, components: list[str], header: int = 3) -> DataFrame:
    """The manifest of a workbook of parameters: a sheet a cluster, whose number stands in the sheet's name after the first _.

    Rows without MODEL go; seeds are rounded half to even; a name without a number is an error.
    """
    if bad := [n for n, _ in sheets(path) if not re.fullmatch(r"[^_]*_\s*[+-]?\d+\s*(_.*)?", n)]:
        raise ValueError(f"sheets {bad} name no cluster")
    schema = ", ".join(["sheet string, sheet_no int, row long, MODEL double, SEED double", *(f"`{c}` double" for c in components)])
    df = read_workbook(spark, path, schema, header).where("MODEL is not null")
    return df.select(
        F.col("MODEL").cast("long").alias("model_id"), F.trim(F.split("sheet", "_")[1]).cast("long").alias("cluster_id"),
        F.bround("SEED").cast("long").alias("seed"), "sheet", "sheet_no", "row", *components
    )


def _named(metrics: list[str], wells: list[str]) -> list[str]:
    return [f"{m} ({w})" for m in metrics for w in wells]


def wells_of(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("producer", "injector")) -> list[str]:
    """Wells of the first sheet's header, sorted."""
    names = spark.createDataFrame([(n,) for n in sheet_headers(path)], "header string")
    return sorted(r.well for r in tables.classify_wells(names).where(F.col("kind").isin(list(kinds))).collect())


def dynamics_workbook(spark: SparkSession, path: str | list[str], metrics: list[str], time: str, wells: list[str] | None = None) -> DataFrame:
    """Long series (sheet, metric, well, time, value) of workbooks with a sheet a model and columns named `metric (well)`.

    Wells come from the first sheet's header if none are given; what is no number, or has no column, is 0.
    """
    first = path if isinstance(path, str) else path[0]
    wells = wells_of(spark, first) if wells is None else wells
    have = {n for n in sheet_headers(first) if n in _named(metrics, wells)}
    # a column that the first sheet lacks may stand in another one
    schema = ", ".join([f"sheet string, row long, `{time}` timestamp_ntz", *(f"`{n}` double" for n in sorted(have | set(_named(metrics, wells))))])
    wide = read_workbook(spark, path, schema).where(F.col(f"`{time}`").isNotNull()).withColumn("time", F.col(f"`{time}`"))
    return tables.melt_dynamics(wide, ["sheet", "time"], metrics, wells)


def ensemble_workbooks(spark: SparkSession, parameters: str, dynamics: str | list[str], components: list[str], metrics: list[str], time: str, header: int = 3) -> DataFrame:
    """Series of all members that both the workbook of parameters and those of series name; see tables.load_ensemble. What is parsed is written once."""
    manifest = parameters_workbook(spark, parameters, components, header).withColumn("ord", F.struct("sheet_no", "row"))
    folder = sinks.scratch(spark, "ensemble")
    series, manifest = (spark.read.parquet(sinks.write_table(df, f"{folder}/{n}")) for n, df in (("series", dynamics_workbook(spark, dynamics, metrics, time)), ("manifest", manifest)))
    return tables.load_ensemble(manifest, series)


def theta_workbook(spark: SparkSession, path: str, components: list[str], header: int = 3) -> DataFrame:
    """Parameters of all sheets; the cluster is the sheet's place, from 1."""
    schema = ", ".join(["sheet_no int, MODEL double", *(f"`{c}` double" for c in components)])
    rows_ = read_workbook(spark, path, schema, header).where("MODEL is not null")
    return rows_.select((F.col("sheet_no") + 1).cast("long").alias("cluster_id"), F.col("MODEL").cast("long").alias("model_id"), *components)


def seed_map_workbook(spark: SparkSession, path: str, header: int = 3) -> DataFrame:
    """(model_id, seed): complete rows of all sheets, seeds rounded, the first row of each model."""
    df = read_workbook(spark, path, "sheet_no int, row long, MODEL double, SEED double", header)
    return tables.seed_map(df.withColumn("ord", F.struct("sheet_no", "row")), "ord")


# ---------------------------------------------------------------- writing


_START = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _letters(col: int) -> str:
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


class WorkbookWriter:
    """Writes sheets one after the other, rows as they come. With shared=True texts go to the table of shared strings, which is held until the end."""

    def __init__(self, out, shared: bool = False):
        self.zip, self.names, self.now, self.at = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1), [], None, 0
        self.strings: dict[str, int] | None = {} if shared else None

    def sheet(self, name: str) -> None:
        self._end()
        self.names.append(name)
        self.now, self.at = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        self.now.write(f'{_START}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())

    def skip(self, n: int) -> None:
        self.at += n

    def row(self, values) -> None:
        self.at += 1
        cells = "".join(self._cell(f"{_letters(c)}{self.at}", v) for c, v in enumerate(values) if v is not None)
        self.now.write(f'<row r="{self.at}">{cells}</row>'.encode())

    def rows(self, columns: list[pa.Array], n: int) -> None:
        """n rows, by columns: of many rows, equal values of a column are written out once."""
        if n < 50 or not columns:
            for values in list(zip(*(c.to_pylist() for c in columns), strict=True)) or [()] * n:
                self.row(values)
            return
        at = pc.cast(pa.array(range(self.at + 1, self.at + 1 + n)), pa.string())
        self.at += n
        cells = []
        for c, column in enumerate(columns):
            distinct = column.dictionary_encode()
            ends = pa.array([self._cell("", v)[6:] or None for v in distinct.dictionary.to_pylist()], pa.string())
            cells.append(pc.binary_join_element_wise(f'<c r="{_letters(c)}', at, ends.take(distinct.indices), ""))
        # a cell without a value is null, and left out
        text = pc.binary_join_element_wise('<row r="', at, '">', *cells, "</row>", "", null_handling="skip")
        self.now.write(text.buffers()[2][: pc.sum(pc.binary_length(text)).as_py()])

    def _cell(self, ref: str, v) -> str:
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime.date):
            when = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
            return f'<c r="{ref}" s="1"><v>{(when.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v!r}</v></c>' if v == v else ""
        if self.strings is not None:
            return f'<c r="{ref}" t="s"><v>{self.strings.setdefault(v, len(self.strings))}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    def _end(self) -> None:
        if self.now is not None:
            self.now.write(b"</sheetData></worksheet>")
            self.now.close()
            self.now = None

    def close(self) -> None:
        self._end()
        n = range(1, len(self.names) + 1)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, self.names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rIdS" Type="{_RELS}/styles" Target="styles.xml"/>' + (f'<Relationship Id="rIdT" Type="{_RELS}/sharedStrings" Target="sharedStrings.xml"/>' if self.strings is not None else "") + "</Relationships>",
            "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        }
        if self.strings is not None:
            parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in self.strings) + "</sst>"
        for name, text in parts.items():
            self.zip.writestr(name, _START + text)
        self.zip.close()


def write_workbooks(df: DataFrame, folder: str, order: list[str], title_rows: int = 0, shared: bool = False, split: bool = False) -> DataFrame:
    """Write df (workbook, sheet, columns ...) as one file for each workbook, a sheet for each sheet, rows in the order of `order`.

    Columns are df's others, in their order; above them stand title_rows rows of
    remarks. A task writes one workbook after the other. With split=True a task
    writes a range of the rows in that order: a workbook, and a sheet of it, may
    be continued in another file, and always is before a sheet has more rows than
    the format allows. Returns (workbook, path), by path in order; only files
    named there count, as a repeated task writes anew.
    """
    columns = [c for c in df.columns if c not in ("workbook", "sheet")]

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        now = book = sheet = out = path = None
        task, files = TaskContext.get().partitionId(), 0

        def finished():
            now.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"workbook": book, "path": path}])

        for b in batches:
            start = 0
            books, names = b.column("workbook"), b.column("sheet")
            values = [b.column(c) for c in columns]
            while start < b.num_rows:
                key = (books[start].as_py(), names[start].as_py())
                full = split and now is not None and now.at >= MOST_ROWS
                if now is None or key[0] != book or (full and key == (book, sheet)):
                    if now is not None:
                        yield finished()
                    book, sheet = key[0], None
                    path = f"{folder}/{re.sub('[^A-Za-z0-9_-]', '_', str(book))}-" + (f"{task:05d}-{files:05d}-" if split else "") + f"{uuid.uuid4().hex[:8]}.xlsx"
                    files += 1
                    store, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(inner, compression=None)
                    now = WorkbookWriter(out, shared)
                if key[1] != sheet:
                    sheet = key[1]
                    now.sheet(sheet)
                    for k in range(title_rows):
                        now.row([f"remark {k + 1}"])
                    now.row(columns)
                end = _end_of_run(books, names, start)
                end = min(end, start + max(1, MOST_ROWS - now.at)) if split else end
                now.rows([v.slice(start, end - start) for v in values], end - start)
                start = end
        if now is not None:
            yield finished()

    keys = ("workbook", "sheet", *order)
    dealt = df.repartitionByRange(*keys) if split else df.repartition("workbook")
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, "workbook string, path string")


def _end_of_run(books: pa.Array, names: pa.Array, start: int) -> int:
    """Where the rows of one sheet end; rows are sorted by workbook and sheet."""
    low, high, key = start, len(books), (books[start], names[start])
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if (books[middle], names[middle]) == key else (low, middle)
    return high
