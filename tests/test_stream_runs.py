from datetime import datetime, timedelta

import numpy as np

from tidewell.operators import geometry
from tidewell.streaming import runs


def test_stream_gives_the_runs_of_the_batch(spark, tmp_path):
    """Rows out of order within the allowed lateness, ties, nulls, and a row that is too late."""
    r = np.random.default_rng(4)
    start = datetime(2020, 1, 1)
    rows = [(f"k{i % 3}", start + timedelta(minutes=int(i)), [None, "a", "a", "b", "b"][int(r.integers(0, 5))]) for i in range(600)]
    end = [(f"k{i}", start + timedelta(days=9, minutes=m), s) for i in range(3) for m, s in ((0, "end"), (1, "past"))]
    order = np.argsort(np.arange(600) + r.integers(0, 40, 600))
    parts = [[rows[i] for i in order[at : at + 150]] for at in range(0, 600, 150)]
    parts[3].append(("k0", start, "too late"))
    parts += [end, [(f"k{i}", start + timedelta(days=20), "wake") for i in range(3)]]
    schema = "key STRING, ts TIMESTAMP, state STRING"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            running = runs.stream_runs(stream, "key", "ts", "state", "2 hours").writeStream.format("memory").queryName("runs_of_keys").option("checkpointLocation", f"{tmp_path}/cp").start()
        running.processAllAvailable()
    running.stop()
    got = sorted((x.key, x.state, x.n, x.first, x.last) for x in spark.table("runs_of_keys").collect())
    batch = geometry.runs(spark.createDataFrame([*rows, *end], schema), ["key"], ["ts"], "state")
    want = sorted((x.key, x.state, x.n, x["first"], x["last"]) for x in batch.collect() if x.state != "past")
    assert [x for x in got if x[1] != "past"] == want
