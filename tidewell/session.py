"""Session with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidewell", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session by default; on a cluster the master comes from spark-submit and `conf`. A session that runs already keeps its shuffle partitions unless `conf` has them."""
    n = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | ({} if SparkSession.getActiveSession() else {"spark.sql.shuffle.partitions": str(max(8, n))}) | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings:
        builder = builder.master(f"local[{cores}]")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
