"""The jobs as queries: each runs twice into one new shared folder, and gives what stands there after the second run."""

from __future__ import annotations

from jobs import forecast_report, text_intake
from tidewell.plans.ensemble import rounded
from tidewell.sources.sinks import scratch
from tidewell.virtual import BASE_SQL


def job1_forecast_report(spark, sf_dir):
    out = scratch(spark, "job1")
    for _ in range(2):
        forecast_report.run(spark, sf_dir, out)
    digits = {c: 8 if c == "width_ratio" else 3 if c in ("median_shift", "residual", "prior_crps", "post_crps") else 6 for c in forecast_report.read_report(spark, out).columns}
    return rounded(forecast_report.read_report(spark, out), digits)


def job2_text_intake(spark, sf_dir):
    out = scratch(spark, "job2")
    for _ in range(2):
        text_intake.run(spark, sf_dir, out, f"{out}/checkpoint")
    return rounded(text_intake.read_report(spark, out).drop("last_batch"), 6)


QUERIES = {f.__name__: f for f in (job1_forecast_report, job2_text_intake)}

_BAND = "SELECT metric, well, time, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, avg(value) AS m, stddev_samp(value) AS s FROM {t} GROUP BY ALL"
_CRPS = """SELECT o.metric, o.well, o.time, avg(abs(value - d_obs)) - sum((2 * k - n - 1) * value / (n * n)) AS crps FROM (SELECT *,
row_number() OVER (PARTITION BY metric, well, time ORDER BY value) AS k, count(*) OVER (PARTITION BY metric, well, time) AS n FROM {t}) o
JOIN observed b ON b.metric = o.metric AND b.well = o.well AND b.time = o.time GROUP BY ALL"""

FORECAST = BASE_SQL + f""",
late AS (SELECT * FROM post WHERE kind = 'rate'), a AS ({_BAND.format(t="rates")}), b AS ({_BAND.format(t="late")}),
ca AS ({_CRPS.format(t="rates")}), cb AS ({_CRPS.format(t="late")}),
x AS (SELECT metric, well, time, a.p10 AS prior_p10, a.p50 AS prior_p50, a.p90 AS prior_p90, ca.crps AS prior_crps, b.p10 AS post_p10, b.p50 AS post_p50,
b.p90 AS post_p90, cb.crps AS post_crps, (b.p90 - b.p10) / CASE WHEN a.p90 - a.p10 <> 0 THEN a.p90 - a.p10 ELSE 1 END AS width_ratio,
b.p50 - a.p50 AS median_shift, d_obs, b.m - d_obs AS residual, (b.m - d_obs) / CASE WHEN b.s > 0 THEN b.s ELSE 1 END AS residual_z
FROM a JOIN b USING (metric, well, time) LEFT JOIN ca USING (metric, well, time) LEFT JOIN cb USING (metric, well, time) LEFT JOIN observed USING (metric, well, time))
SELECT metric, well, time, round(prior_p10, 6) AS prior_p10, round(prior_p50, 6) AS prior_p50, round(prior_p90, 6) AS prior_p90, round(prior_crps, 3) AS prior_crps,
round(post_p10, 6) AS post_p10, round(post_p50, 6) AS post_p50, round(post_p90, 6) AS post_p90, round(post_crps, 3) AS post_crps, round(width_ratio, 8) AS width_ratio,
round(median_shift, 3) AS median_shift, round(d_obs, 6) AS d_obs, round(residual, 3) AS residual, round(residual_z, 6) AS residual_z, d_obs BETWEEN post_p10 AND post_p90 AS inside,
CASE WHEN width_ratio IS NULL THEN '—' WHEN width_ratio > 1 THEN 'broadens' ELSE 'tightens' END AS reading,
CASE WHEN prior_crps IS NULL OR post_crps IS NULL OR abs(post_crps - prior_crps) < greatest(1e-9, 1e-3 * greatest(abs(prior_crps), abs(post_crps))) THEN 'NEUTRAL'
WHEN post_crps < prior_crps THEN 'BETTER' ELSE 'WORSE' END AS verdict, coalesce(abs(residual_z) > 2.0, false) AS outlier,
CASE WHEN residual_z IS NOT NULL THEN row_number() OVER (PARTITION BY metric ORDER BY abs(residual_z) DESC NULLS LAST, well, time) END AS residual_rank FROM x
"""

_WORDS = r"[^\x20\x09-\x0D]+"
INTAKE = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, lang, source, len(regexp_extract_all(x, '{_WORDS}')) AS n_words,
len(list_filter(regexp_extract_all(x, '{_WORDS}'), lambda w: regexp_full_match(w, '[0-9]+([.][0-9]+)?'))) AS n_numbers,
sha256(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM t),
g AS (SELECT lang, source, sha, count(*) AS n, min(doc_id) AS least FROM m GROUP BY ALL),
c AS (SELECT lang, source, sum(n - first::INT)::BIGINT AS n_copies FROM (SELECT *,
row_number() OVER (PARTITION BY lang, sha ORDER BY least NULLS LAST, source NULLS LAST) = 1 AS first FROM g) GROUP BY ALL),
own AS (SELECT lang, source, count(*) AS n_texts, count_if(n_words = 0) AS n_empty, sum(n_words)::BIGINT AS n_words, sum(n_numbers)::BIGINT AS n_numbers,
avg(n_words) AS words_mean, quantile_cont(n_words, 0.1) AS a, quantile_cont(n_words, 0.5) AS b, quantile_cont(n_words, 0.9) AS d FROM m GROUP BY ALL),
kind AS (SELECT lang, quantile_cont(n_words, 0.1) AS p10, quantile_cont(n_words, 0.5) AS p50, quantile_cont(n_words, 0.9) AS p90 FROM m GROUP BY ALL),
j AS (SELECT own.*, n_copies, p10, p50, p90, (d - a) / CASE WHEN p90 - p10 <> 0 THEN p90 - p10 ELSE 1 END AS w FROM own
JOIN c ON c.lang IS NOT DISTINCT FROM own.lang AND c.source IS NOT DISTINCT FROM own.source JOIN kind ON kind.lang IS NOT DISTINCT FROM own.lang)
SELECT lang, source, n_texts, n_empty, n_copies, n_words, n_numbers, round(words_mean, 6) AS words_mean, round(a, 6) AS words_p10, round(b, 6) AS words_p50, round(d, 6) AS words_p90,
round(w, 6) AS width_ratio, round(b - p50, 6) AS median_shift,
CASE WHEN n_copies > 0.5 * n_texts THEN 'COPIES' WHEN w < 0.1 THEN 'NARROW' WHEN w > 1.5 THEN 'WIDE' WHEN NOT (b BETWEEN p10 AND p90) THEN 'SHIFTED' ELSE 'OK' END AS verdict FROM j
"""

SQL = {"job1_forecast_report": FORECAST, "job2_text_intake": INTAKE}
