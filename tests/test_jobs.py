"""Jobs: rerun, growing input, failures between steps, one metric alone, command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from jobs import common, forecast_report, queries, text_intake

duckdb = pytest.importorskip("duckdb")


def _rows(df):
    return sorted((tuple(x if not isinstance(x, float) else round(x, 6) for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()), key=repr)
    got = sorted((tuple(x[c] for c in sorted(names)) for x in df.collect()), key=repr)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-3) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(10_001, None, "en", "s"), (10_002, "", "en", None), (10_003, " \n\t", None, None), (10_004, "1 2.5 .5 3. x4 12\n7", None, "s"), (10_004, "1 2.5 .5 3. x4 12\n7", None, "s"), (None, "1 2.5  .5 3. x4 12 7", None, "t")]
    return d.unionByName(spark.createDataFrame(odd, "doc_id LONG, text STRING, lang STRING, source STRING")).cache()


def _grow(docs, folder, part, of=3):
    docs.where(F.pmod(F.hash("text", "doc_id"), F.lit(of)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")


def test_intake_takes_only_what_is_new(spark, docs, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    _grow(docs, src, 0)
    first = text_intake.run(spark, src, out, cp)
    n = spark.read.parquet(f"{src}/documents.parquet").count()
    assert first["new_texts"] == first["texts"] == n > 0
    again = text_intake.run(spark, src, out, cp)
    assert again["new_texts"] == 0 and again["kinds"] == [] and again["report"] == first["report"]
    _grow(docs, src, 1)
    _grow(docs, src, 2)
    second = text_intake.run(spark, src, out, cp, {"files_a_batch": 1})
    assert second["texts"] == docs.count() and second["new_texts"] == docs.count() - n and len(second["kinds"]) > 1
    held = spark.read.parquet(f"{out}/measures")
    assert [r.batch_id for r in held.select("batch_id").distinct().orderBy("batch_id").collect()] == [0, 1, 2]
    # two runs over growing files give what one run over all gives
    _grow(docs, f"{tmp_path}/all", 0, 1)
    text_intake.run(spark, f"{tmp_path}/all", f"{tmp_path}/once", f"{tmp_path}/cp1")
    assert _rows(text_intake.read_report(spark, out).drop("last_batch")) == _rows(text_intake.read_report(spark, f"{tmp_path}/once").drop("last_batch"))


def test_a_run_that_failed_before_its_report_is_made_up_for(spark, docs, tmp_path, monkeypatch):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    _grow(docs, src, 0, 2)
    text_intake.run(spark, src, out, cp)
    _grow(docs, src, 1, 2)
    assert text_intake.take_new(spark, src, out, cp) == [1]  # and the report isn't written
    done = text_intake.run(spark, src, out, cp)
    assert done["new_texts"] == 0 and len(done["kinds"]) > 1
    assert text_intake.read_report(spark, out).agg(F.sum("n_texts")).first()[0] == docs.count()


def test_a_batch_that_is_written_twice_counts_once(spark, docs, tmp_path):
    """A stream repeats a batch if it fails before it notes its end: the batch's folder is replaced."""
    rows = text_intake.measures(docs).withColumn("batch_id", F.lit(5).cast("long"))
    for _ in range(2):
        common.replace_partitions(rows, f"{tmp_path}/measures", "batch_id")
    assert spark.read.parquet(f"{tmp_path}/measures").count() == docs.count()


def test_measures_and_verdicts(spark):
    m = {r.doc_id: r for r in text_intake.measures(spark.createDataFrame([(1, "1 2.5 .5 3. x4 12\n7", "a", "b"), (2, None, None, None), (3, "\n", None, None), (4, "wörter  und 7", None, None), (5, "wörter und\n7", None, None)], "doc_id LONG, text STRING, lang STRING, source STRING")).collect()}
    assert [(m[i].n_words, m[i].n_chars, m[i].n_lines, m[i].n_numbers) for i in (1, 2, 3, 4)] == [(7, 19, 2, 4), (0, 0, 0, 0), (0, 1, 2, 0), (3, 13, 1, 1)]
    assert m[4].sha256 == m[5].sha256 != m[1].sha256
    words = {"same": [10] * 12, "narrow": [100, 101, 102, 103], "wide": [1, 500, 900, 1000], "short": [2, 5, 4, 3]}
    table = [(i, f"{s} " * n if s == "same" else " ".join(f"{s}{i}-{k}" for k in range(n)), "k", s) for s, ns in words.items() for i, n in enumerate(ns)]
    df = text_intake.measures(spark.createDataFrame(table, "doc_id LONG, text STRING, lang STRING, source STRING")).withColumn("batch_id", F.lit(0).cast("long"))
    got = {r.source: r for r in text_intake.report(df, 0.1, 1.5, 0.5).collect()}
    assert {s: r.verdict for s, r in got.items()} == {"same": "COPIES", "narrow": "NARROW", "wide": "WIDE", "short": "NARROW"}
    assert got["same"].n_copies == 11 and got["wide"].n_copies == 0
    assert {r.verdict for r in text_intake.report(df, 0.0, 9.0, 1.0).collect()} <= {"OK", "SHIFTED"}


def test_intake_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING, verdict STRING, batch_id STRING").write.parquet(f"{tmp_path}/in/documents.parquet")
    done = text_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert done["texts"] == done["report"] == 0


def test_forecast_report_reruns_and_keeps_other_metrics(spark, sf_dir, tmp_path):
    out = str(tmp_path)
    one = forecast_report.run(spark, sf_dir, out)
    rows = _rows(forecast_report.read_report(spark, out))
    assert forecast_report.run(spark, sf_dir, out) == one and _rows(forecast_report.read_report(spark, out)) == rows
    part = forecast_report.run(spark, sf_dir, out, {"metrics": ["qty"], "outlier_z": 0.0})
    now = forecast_report.read_report(spark, out)
    assert part["report"] < one["report"] == now.count() and now.where("metric = 'qty' and residual_z <> 0 and not outlier").count() == 0
    assert _rows(now.where("metric <> 'qty'")) == [r for r in rows if "qty" not in r]
    best = now.where("residual_rank = 1").collect()
    assert sorted(r.metric for r in best) == ["disc", "qty", "rev"]
    assert sorted(x for x in os.listdir(f"{out}/report") if x.startswith("metric=")) == ["metric=disc", "metric=qty", "metric=rev"]


def test_compare_without_observations(spark):
    s = spark.createDataFrame([(r, i, 0, "q", "w", 2000, float(i)) for r in ("prior", "posterior") for i in range(5)] + [("prior", 1, 0, "q", "v", 2000, 1.0), ("prior", 2, 0, "q", "v", 2000, None)], "role STRING, member_id LONG, cluster_id LONG, metric STRING, well STRING, time LONG, value DOUBLE")
    none = spark.createDataFrame([], "kind STRING, metric STRING, well STRING, time LONG, d_obs DOUBLE")
    got = {r.well: r for r in forecast_report.compare(s, none, [0.1, 0.5, 0.9], 2.0).collect()}
    assert got["w"].width_ratio == 1 and got["w"].verdict == "NEUTRAL" and got["w"].residual_rank is None and got["w"].outlier is False
    assert got["v"].post_p50 is None and got["v"].prior_p50 == 1 and got["v"].reading == "—"


def test_settings_and_command_line(spark, tmp_path):
    path = str(tmp_path / "c.json")
    with open(path, "w") as f:
        json.dump({"wide": 2}, f)
    assert common.settings(spark, path, text_intake.DEFAULTS)["wide"] == 2
    assert common.settings(spark, None, text_intake.DEFAULTS) == text_intake.DEFAULTS
    with open(path, "w") as f:
        json.dump({"wider": 2}, f)
    with pytest.raises(ValueError):
        common.settings(spark, path, text_intake.DEFAULTS)
    for module in (forecast_report, text_intake):
        with open(module.__file__.replace(".py", ".json")) as f:
            assert json.load(f) == module.DEFAULTS
        with pytest.raises(SystemExit):
            common.main("", module.run, ["--output", "x"])
