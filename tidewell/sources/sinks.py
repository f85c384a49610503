"""Writers (K01-K05, K07)."""

from __future__ import annotations

import atexit
import hashlib
import html
import json
import os
import shutil
import subprocess
import tempfile
import uuid
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it: a plain one lies in the default file system, which need not be the local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on one machine without that, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, local, True)
        base = f"file://{local}"
    return qualified(spark, f"{base.rstrip('/')}/tidewell-study/{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table; CSV has a header."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", skip_empty: tuple[str, ...] = ()) -> list[str]:
    """One write a table; those named in skip_empty only if they have rows."""
    return [write_table(df, f"{folder}/{name}", fmt) for name, df in tables.items() if name not in skip_empty or df.limit(1).count()]


def write_qc(tables: dict[str, DataFrame], rank: dict, folder: str) -> list[str]:
    """The quality report: tables as CSV (bounds and duplicates only if they have rows) and the rank check as JSON."""
    spark = next(iter(tables.values())).sparkSession
    out = write_tables(tables, folder, "csv", ("bounds", "duplicates"))
    spark.createDataFrame([(json.dumps(rank, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/rank_check")
    return [*out, f"{folder}/rank_check"]


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of the sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


@cache
def revision() -> tuple[str | None, bool | None]:
    """(commit, whether files are changed) of the checkout this library runs from; nothing known outside of one."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", os.path.dirname(__file__), *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD"), bool(git("status", "--porcelain", "--untracked-files=no"))
    except (OSError, subprocess.SubprocessError):
        return None, None


def write_sidecar(spark: SparkSession, path: str, artefact: str, config: dict, seed: int | None = None, **extra) -> dict:
    """Describe an output next to it: what it is, when, by which settings, seed and revision of the library it was made."""
    commit, dirty = revision()
    row = {
        "artefact": artefact, "created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "config_hash": config_hash(config),
        "seed": seed, "revision": commit, "dirty": dirty, "extra": extra
    }
    spark.createDataFrame([(json.dumps(row, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")
    return row


def write_plan(plan: DataFrame, folder: str) -> list[str]:
    """Members to re-simulate, the proxy pool and the validation members, as CSV."""
    return write_tables(
        {"resimulate": plan.where("role = 'resimulate'"), "proxy_pool": plan.where("role = 'proxy'"), "validation": plan.where("validate")},
        folder, "csv"
    )


def html_report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A page with the first rows of each table; a report's tables are small."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join(
            "<tr>" + "".join(
                f"<td>{'—' if x is None else html.escape(f'{x:.4g}' if isinstance(x, float) else str(x))}</td>" for x in r
            ) + "</tr>" for r in rows
        )
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>" if rows else f"<h2>{html.escape(name)}</h2><p>no rows</p>")
    return "<!DOCTYPE html><meta charset='utf-8'>" + "".join(parts)
