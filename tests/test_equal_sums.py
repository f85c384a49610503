"""Equal sums count as equal, in whatever order their numbers were added; envelopes hold every component."""

import datetime

import pytest

from tidewell.plans import ensemble, geology  # noqa: F401
from tidewell.plans.registry import QUERIES, SQL
from tidewell.virtual import Virtual


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Two suppliers with the same numbers in another order: 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1."""
    d, day = str(tmp_path_factory.mktemp("tied")), datetime.datetime(1997, 5, 1)
    up = (0.1, 0.2, 0.3)
    lines = [(s, "A", "F", day, q, 10.0, q2, q) for s, a, b in ((1, up, up[::-1]), (2, up[::-1], up)) for q, q2 in zip(a, b, strict=True)]
    for name, rows, schema in (
        ("lineitem", lines, "l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        ("supplier", [(1, 0, 1.0), (2, 0, 2.0)], "s_suppkey long, s_nationkey int, s_acctbal double"), ("nation", [(0, 0)], "n_nationkey int, n_regionkey int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_equal_means_are_not_broader(spark, tied):
    assert [r.interpretation for r in QUERIES["f18_width_text"](spark, tied).collect()] == ["tightens"] * 2


def test_equal_totals_go_by_member(spark, tied):
    got = QUERIES["t06_order_statistics"](spark, tied).where("metric = 'qty'").collect()
    assert sorted((r.k, r.member_id, r.m) for r in got) == [(1, 1, 2), (2, 2, 2)]


def test_envelope_of_all_components(spark, sf_dir):
    """A member counts only if no component of it lies outside."""
    assert "comp <>" not in SQL["f11_envelope_drop"]
    v = Virtual(spark, sf_dir)
    lo_hi = {r[0]: (r[1], r[2]) for r in v.theta.groupBy("comp").agg({"value": "min"}).join(v.theta.groupBy("comp").agg({"value": "max"}), "comp").collect()}
    rows = v.theta_post.collect()
    out = {r.member_id for r in rows if not lo_hi[r.comp][0] <= r.value <= lo_hi[r.comp][1]}
    inside = {r.member_id for r in rows} - out
    assert {r.members for r in QUERIES["f11_envelope_drop"](spark, sf_dir).collect()} == ({len(inside)} if inside else set())
