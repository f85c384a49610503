import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common_rows import DOCS, docs, rows
from tidewell.llm import exact_dedup
from tidewell.llm.exact_dedup import counted, merge, pack, unpack


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(table):
    groups = defaultdict(list)
    for d, t in table:
        groups[norm(t)].append(d)
    out = []
    for d, t in table:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


MORE = [(None, "null id", None, None, None, *"abcdefg"), (None, "null id", None, None, None, *"abcdefg"), (None, "one two three", None, None, None, *"abcdefg"), (3, "other text of a used id", None, None, None, *"abcdefg"), (900, " lead", None, None, None, *"abcdefg"), (901, "\x0b\nlead", None, None, None, *"abcdefg"), (902, "lead", None, None, None, *"abcdefg"), (903, "no break", None, None, None, *"abcdefg"), (904, "no break", None, None, None, *"abcdefg")]


@pytest.mark.parametrize("most", [exact_dedup.MOST_BROADCAST, 0])
def test_matches_brute_force(spark, most):
    table = [*rows(), *MORE, rows()[0], rows()[0]]
    df = spark.createDataFrame(table, DOCS).repartition(5)
    got = sorted((tuple(r) for r in exact_dedup.find_copies(df, most).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in table])
    assert sum(g[2] > 1 for g in got) > 10


@pytest.mark.parametrize("most", [exact_dedup.MOST_BROADCAST, 0])
def test_one_row_of_each_group_stays(spark, most):
    table = [*rows(), *MORE, rows()[0], rows()[0]]
    df = spark.createDataFrame(table, DOCS).repartition(5)
    left = exact_dedup.drop_copies(df, most).collect()
    assert left[0].asDict().keys() == {f.name for f in df.schema}
    texts = [norm(r.text) for r in left]
    assert set(texts) == {norm(r[1]) for r in table} and len(texts) - len(set(texts)) == 0
    want = {norm(t): k for (d, t), (_, k, *_) in zip(*(sorted(x, key=repr) for x in ([(r[0], r[1]) for r in table], brute([(r[0], r[1]) for r in table]))), strict=True) if k is not None}
    assert all(r.doc_id == want[norm(r.text)] for r in left if r.doc_id is not None)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """With fingerprints of two bits nearly every text is a suspect; the result stays the same."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.shiftleft(real(c).bitwiseAND(F.lit(3)), 62))
    got = sorted((tuple(r) for r in exact_dedup.find_copies(docs(spark)).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in rows()])


def test_a_third_of_all_rows_is_one_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.concat(F.lit("t "), "id")).alias("text"))
    got = exact_dedup.find_copies(df.repartition(8))
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000 and got.where("kept").count() == 2001


def test_empty_and_null_tables(spark):
    assert exact_dedup.find_copies(spark.createDataFrame([], DOCS)).count() == 0
    none = exact_dedup.find_copies(spark.createDataFrame([(None, None), (None, None)], "doc_id BIGINT, text STRING")).collect()
    assert [(r.keep_id, r.group_size, r.kept, r.text_sha256) for r in none] == [(None, 2, True, hashlib.sha256(b"").hexdigest())] * 2


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 64).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.dictionaries(st.integers(0, 2**bits - 1), st.integers(1, 5000), max_size=60), min_size=1, max_size=5))))
def test_filters_keep_and_add_every_count(case):
    """Round trip and merge of filters are exact for any fingerprints and counts, those with tiny remainders included."""
    bits, tables = case
    filters = []
    for t in tables:
        keys = sorted(t)
        filters.append(pack(np.array(keys, np.uint64), np.array([t[k] for k in keys], np.int64), bits))
        p, c = unpack(filters[-1])
        assert dict(zip(p.tolist(), c.tolist(), strict=True)) == t
    want = {k: sum(t.get(k, 0) for t in tables) for t in tables for k in t}
    p, c = unpack(merge(filters))
    assert dict(zip(p.tolist(), c.tolist(), strict=True)) == want and p.tolist() == sorted(want)


def test_filters_of_many():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**56, 40_000, np.uint64)
    p, c = counted(np.concatenate([x, x[:300], x[:300]]), np.ones(40_600, np.int64))
    f = pack(p, c, 56)
    assert len(f) < 9 * len(p)  # five bytes a slot, two bits of marks, a third of the slots free or more
    q, d = unpack(f)
    assert (q == p).all() and (d == c).all() and d.max() == 3


def test_filters_of_several_batches_and_blocks(spark):
    """A task that holds few fingerprints at a time gives several filters a block; merged, they count the same."""
    df = spark.range(5000).select(F.xxhash64(F.col("id") % 1700).alias("fp")).repartition(3)
    want = {r.fp: r["count"] for r in df.groupBy("fp").count().where("count > 1").collect()}
    for held in (50, 1 << 20):
        got = exact_dedup.merged(exact_dedup.filters_of(df, 8, held), 8).collect()
        assert {r.fp: r.n for r in got} == want
