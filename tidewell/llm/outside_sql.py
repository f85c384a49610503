"""DuckDB SQL of those queries that SQL can express, by their plain definitions."""

from __future__ import annotations

from tidewell.llm import quality

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_PLAIN_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, lower: bool) -> str:
    text = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')" if lower else "coalesce(text, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACE_WORDS, True)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(ws) - 3))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.y, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CASE WHEN strlen(coalesce(html,
'')) >= 100 THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) ELSE page_id END AS f FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to FROM p
"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_PLAIN_WORDS, True)} AS ws FROM documents),
b AS (SELECT item_id, {_words(_PLAIN_WORDS, True)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS l, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS k FROM b, unnest(range(1, greatest(2, len(ws) - 8))) u(i) WHERE len(ws) > 0),
dw AS (SELECT rid, i, l, array_to_string(ws[i : i + l - 1], ' ') AS k FROM d, (SELECT DISTINCT l FROM bw) s, unnest(range(1, len(ws) - l + 2)) u(i)),
h AS (SELECT rid, i, dw.l, item_id FROM dw JOIN bw ON bw.l = dw.l AND bw.k = dw.k),
p AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + l)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_SPACE_WORDS, False)} AS ws FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS k FROM d, unnest(range(1, greatest(1, len(ws) - 33))) u(i)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM w SEMI JOIN r USING (k)),
x AS (SELECT rid, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM x ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


EXACT = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents) WINDOW w AS (PARTITION BY norm)
"""


def quality_sql(least_group: int = 50) -> str:
    exact = lambda e: f"({e.replace(' / ', '::DOUBLE / ')})"
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {exact(e)}::DOUBLE AS v FROM c WHERE n_words > 0" for m,
        (_, e, _, _) in quality.METRICS.items()
    )
    limits = ", ".join(
        f"CASE WHEN o.n_own >= {least_group} THEN o.{m} WHEN l.n_own >= {least_group} THEN l.{m} ELSE a.{m} END AS limit_{m}" for m in quality.METRICS
    )
    fine = " AND ".join(f"NOT coalesce({exact(e)} > limit_{m}, false)" for m, (e, _, _, _) in quality.METRICS.items())

    rounded = ", ".join(f"round(limit_{m}, 6) AS limit_{m}" for m in quality.METRICS)

    def limit(m, times, least):
        return f"max(CASE WHEN metric = '{m}' THEN pow({quality.GAMMA}::DOUBLE, least(q2 + {times} * greatest({least}, q2 - q0), q1 + {2 * times} * greatest({least}, q1 - q0))) END) AS {m}"

    wide = ", ".join(limit(m, times, least) for m, (_, _, times, least) in quality.METRICS.items())

    def level(name, keys):
        k = "".join(f"{x}, " for x in keys)
        part = f"PARTITION BY {k}metric"
        at = ", ".join(f"min(CASE WHEN cum >= {q} * total THEN bucket END) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75)))
        return f"""
{name}_m AS (SELECT {k}metric, bucket, sum(n) AS n FROM sk GROUP BY {k}metric, bucket),
{name}_c AS (SELECT {k}metric, bucket, sum(n) OVER ({part} ORDER BY bucket) AS cum, sum(n) OVER ({part}) AS total FROM {name}_m),
{name}_q AS (SELECT {k}metric, max(total) AS total, {at} FROM {name}_c GROUP BY {k}metric),
{name} AS (SELECT {k}max(total) AS n_own, {wide} FROM {name}_q {'GROUP BY ' + ', '.join(keys) if keys else ''}),"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, CASE WHEN len({_words(_SPACE_WORDS, False)}) > 0 THEN coalesce(text, '') ELSE '' END AS text, {_words(_SPACE_WORDS, False)} AS ws FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS k FROM d, unnest(range(1, greatest(1, len(ws) - 3))) u(i)),
gr AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM gr) GROUP BY rid),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_SPACE_WORDS}') GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rw.n, 0) AS n_repeat_words FROM d LEFT JOIN rw USING (rid) LEFT JOIN li USING (rid)),
v AS ({values}),
sk AS (SELECT lang, source, metric, ceil(ln(v) / ln({quality.GAMMA}::DOUBLE))::BIGINT AS bucket, count(*) AS n FROM v GROUP BY ALL),
{level("own", ["lang", "source"])}{level("bylang", ["lang"])}{level("everything", [])}
lim AS (SELECT o.lang, o.source, {limits} FROM own o LEFT JOIN bylang l ON l.lang IS NOT DISTINCT FROM o.lang CROSS JOIN everything a),
j AS (SELECT c.*, lim.* EXCLUDE (lang, source), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM c.lang AND lim.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept, {rounded} FROM j
"""
