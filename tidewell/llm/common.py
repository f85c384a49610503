"""Shared pieces: word rules, the shared folder, Arrow batches, stable hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Bounds a Python worker's memory whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of 10,000 long documents would not fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in the folder named by ``spark.checkpoint.dir``, whose scheme is
    resolved as Spark does. Only where that is unset and all runs on one machine
    (tests) a local folder is set, removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_dir(spark.sparkContext.master)
    return qualified(spark, f"{base.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}")


@cache
def _local_dir(master: str) -> str:
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, base, True)
    return f"file://{base}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it: a plain one lies in the default file system, which need not be the local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_CLEANUP, None)
    # what this step has shuffled is of no use once its rows are written
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, needed: list[str]):
    """docs with every column that an operator does not need renamed, so that none clashes with its own, and a function that undoes this."""
    inner = {c: c if c in needed else f"_x{i}_" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    return renamed, lambda df: df.select(*(F.col(n).alias(c) for c, n in inner.items()))


def open_fs(uri: str):
    """File system and path of a URI, for use on the driver and in workers. Without scheme it is local, so folders come from shared_dir()."""
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than U+0020 and U+0009 to U+000D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: A-Z to a-z, and every ASCII byte that is not a letter or digit to a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


class WordHash(dict):
    """Memo of a 64-bit hash for each word; emptied when it grows large."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def window_hash(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Order-sensitive hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base | 1)
    out = h[:n].copy()
    for i in range(1, k):
        out *= b
        out += h[i : i + n]
    return mix64(out)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of n positions that lie in any of the windows of length k from the given starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(np.asarray(starts) + k, n), -1)
    return np.cumsum(step[:n]) > 0


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
