"""NPY matrices: a data source that reads ranges of rows (or of columns, as they lie), and a writer with a file for each range of rows.

    spark.dataSource.register(MatrixSource)
    spark.read.format("npy").load("theta.npy")           # (row, col, value)
"""

from __future__ import annotations

import ast
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources import sinks, tables
from tidewell.sources.workbooks import open_file

LONG = "row long, col long, value double"
#: Fixed value of the format.
MAGIC = b"\x93NUMPY"
#: Bytes that one partition reads, and values of one batch.
SPLIT, _VALUES = 64 << 20, 1 << 16


def header(path: str) -> tuple[np.dtype, bool, int, int, int]:
    """(dtype, columns lie together, rows, columns, place of the first value); a vector is one column."""
    with open_file(path) as f:
        start = f.read(12)
        if start[:6] != MAGIC:
            raise ValueError(f"{path} is no NPY file")
        wide = start[6] >= 2
        size, at = struct.unpack("<I", start[8:12])[0] if wide else struct.unpack("<H", start[8:10])[0], 12 if wide else 10
        f.seek(at)
        facts = ast.literal_eval(f.read(size).decode("utf-8" if start[6] >= 3 else "latin-1"))
    shape, dtype = facts["shape"], np.dtype(facts["descr"])
    if len(shape) > 2 or dtype.kind not in "fiub":
        raise ValueError(f"{path} holds no matrix of numbers, but {dtype} of shape {shape}")
    rows, cols = (*shape, 1, 1)[:2] if len(shape) else (1, 1)
    return dtype, bool(facts["fortran_order"]) and len(shape) == 2, rows, cols, at + size


class Lines(InputPartition):
    """Rows, or columns where those lie together, first to last of one file."""

    def __init__(self, path: str, base: int, first: int, last: int):
        self.path, self.base, self.first, self.last = path, base, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        out, base = [], 0
        for path in self.paths:
            dtype, across, rows, cols, _ = header(path)
            n, width = (cols, rows) if across else (rows, cols)
            step = max(1, self.split // max(1, width * dtype.itemsize))
            out += [Lines(path, base, at, min(at + step, n)) for at in range(0, n, step)]
            base += rows
        return out or [Lines("", 0, 0, 0)]  # a source must have a partition

    def read(self, part: Lines):
        if part.first == part.last:
            return
        dtype, across, rows, cols, at = header(part.path)
        width = rows if across else cols
        with open_file(part.path) as f:
            f.seek(at + part.first * width * dtype.itemsize)
            place, end = part.first * width, part.last * width
            while place < end:
                n = min(_VALUES, end - place)
                raw = f.read(n * dtype.itemsize)
                if len(raw) != n * dtype.itemsize:
                    raise ValueError(f"{part.path} is cut short")
                line, within = np.divmod(np.arange(place, place + n), width)
                row, col = (within, line) if across else (line, within)
                yield pa.RecordBatch.from_arrays([pa.array(part.base + row), pa.array(col), pa.array(np.frombuffer(raw, dtype).astype(np.float64))], names=["row", "col", "value"])
                place += n


class MatrixSource(DataSource):
    """Format `npy`: (row, col, value) of matrices of numbers; files of `paths` (a JSON list) lie below each other. Option split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self):
        return LONG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_matrix(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """(row, col, value) of one NPY file or several below each other; files that don't exist are left out, and without any the table is empty."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if tables.exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], LONG)
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy").option("paths", json.dumps(paths)).option("split", split).load()


def write_matrix(cells: DataFrame, folder: str, cols: int, rows_a_file: int = 1 << 16) -> DataFrame:
    """Write cells (row, col, value) as NPY files of rows_a_file rows each; return (first_row, path, n_rows) in the order of the rows.

    Cells that are absent or null are NaN. Only files named in the result count,
    as a repeated task writes under a new name; a file's rows are held as one array.
    """
    part = F.floor(F.col("row") / rows_a_file)

    def run(batches):
        from pyarrow import fs

        now = first = None

        def finished():
            path = f"{folder}/rows-{first:012d}-{uuid.uuid4().hex[:8]}.npy"
            store, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            matrix = np.concatenate(now)
            with store.open_output_stream(inner, compression=None) as out:
                text = f"{{'descr': '<f8', 'fortran_order': False, 'shape': {matrix.shape}, }}"
                text += " " * (-(10 + len(text) + 1) % 64) + "\n"
                out.write(MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode() + matrix.tobytes())
            return pa.RecordBatch.from_pylist([{"first_row": first, "path": path, "n_rows": len(matrix)}])

        for b in batches:
            for p, row, values in zip(b.column("part").to_pylist(), b.column("row").to_pylist(), b.column("cells"), strict=True):
                if p * rows_a_file != first:
                    if now is not None:
                        yield finished()
                    now, first = [], p * rows_a_file
                # rows that no cell names
                gap = row - first - len(now)
                now += [np.full((1, cols), np.nan)] * gap
                line = np.full((1, cols), np.nan)
                for c in values.as_py():
                    line[0, c["col"]] = np.nan if c["value"] is None else c["value"]
                now.append(line)
        if now is not None:
            yield finished()

    lines = cells.groupBy(part.alias("part"), "row").agg(F.collect_list(F.struct("col", "value")).alias("cells"))  # a row of the matrix
    files = lines.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, "first_row long, path string, n_rows long")
    spark = cells.sparkSession
    return spark.read.parquet(sinks.write_table(files, f"{folder}/_files")).orderBy("first_row")
