"""Bodies by blocks are those of one task for a model."""

import numpy as np
import pytest

from tidewell.operators import geometry, slabs


def _mask(spark, shape, share, seed=1, models=(3, 5)):
    r = np.random.default_rng(seed)
    frames = []
    for m in models:
        k, j, i = np.nonzero(r.random(shape[::-1]) < share)
        flat = i + shape[0] * (j + shape[1] * k)
        frames += list(zip([m] * len(i), *(x.tolist() for x in (flat, i, j, k)), strict=True))
    return spark.createDataFrame(frames, "model long, flat long, i int, j int, k int").repartition(4)


def _rows(df):
    return sorted(tuple(r) for r in df.select("model", "flat", "body").collect())


@pytest.mark.parametrize("connectivity", [6, 26])
@pytest.mark.parametrize("most", [slabs.MOST_EDGES, 0])
@pytest.mark.parametrize(("shape", "share", "block"), [((13, 9, 7), 0.35, (4, 4, 2)), ((40, 3, 2), 0.9, (1, 1, 1)), ((6, 6, 6), 0.2, (64, 64, 16))])
def test_blocks_give_the_bodies_of_one_task(spark, connectivity, most, shape, share, block):
    mask = _mask(spark, shape, share)
    want = _rows(geometry.label_bodies(mask, connectivity))
    assert _rows(slabs.label_bodies_blocks(mask, connectivity, block, most)) == want and len({r[2] for r in want}) > (1 if share < 0.9 else 0)


def test_a_snake_through_all_blocks(spark):
    """One body that winds through every block many times."""
    cells, flat = [], lambda i, j: i + 20 * j
    for j in range(0, 20, 2):
        cells += [(1, flat(i, j), i, j, 0) for i in range(20)]
        if j < 18:
            cells.append((1, flat(19 if j % 4 == 0 else 0, j + 1), 19 if j % 4 == 0 else 0, j + 1, 0))
    mask = spark.createDataFrame(cells, "model long, flat long, i int, j int, k int")
    for most in (slabs.MOST_EDGES, 0):
        got = slabs.label_bodies_blocks(mask, 6, (3, 3, 1), most)
        assert {r.body for r in got.collect()} == {1} and got.count() == len(cells)


def test_no_cells_and_a_wrong_connectivity(spark):
    mask = _mask(spark, (3, 3, 3), 0.5)
    assert slabs.label_bodies_blocks(mask.limit(0)).count() == 0
    with pytest.raises(ValueError):
        slabs.label_bodies_blocks(mask, 18)


def test_many_small_groups_share_a_batch(spark):
    """Models of a few cells, and one of many batches: bodies and labels equal a walk from each cell, and no call is made a group."""
    from tidewell.operators import geometry

    r = np.random.default_rng(8)
    cells = [(m, n, n % 4, n // 4 % 5, n // 20) for m in range(60) for n in sorted(r.choice(60, r.integers(1, 40), replace=False).tolist())]
    cells += [(99, n, n % 30, n // 30 % 30, n // 900) for n in range(27000) if r.random() < 0.3]
    df = spark.createDataFrame(cells, "model long, flat long, i int, j int, k int")
    got = geometry.labelled(df, ["model"], 6)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    have = {(q.model, q.flat): (q.body, q.label) for q in got.collect()}
    at, want, bodies = {(m, i, j, k): n for m, n, i, j, k in cells}, {}, {}
    for m, n, i, j, k in cells:
        if (m, n) in want:
            continue
        bodies[m] = bodies.get(m, 0) + 1
        todo = [(i, j, k)]
        want[m, n] = (bodies[m], n)
        while todo:
            a, b, c = todo.pop()
            for d in ((a - 1, b, c), (a + 1, b, c), (a, b - 1, c), (a, b + 1, c), (a, b, c - 1), (a, b, c + 1)):
                near = at.get((m, *d))
                if near is not None and (m, near) not in want:
                    want[m, near] = (bodies[m], n)
                    todo.append(d)
    assert have == want


@pytest.mark.parametrize("most", [slabs.MOST_EDGES, 0])
def test_cells_and_labels_kept_off_the_driver(spark, tmp_path, monkeypatch, most):
    """No table of cells, links or roots is broadcast, however small its files are."""
    _mask(spark, (9, 7, 5), 0.4).write.parquet(str(tmp_path / "mask"))
    mask, plans, written = spark.read.parquet(str(tmp_path / "mask")), [], slabs._written

    def spy(df, *to):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *to)

    monkeypatch.setattr(slabs, "_written", spy)
    got = slabs.label_bodies_blocks(mask, 26, (2, 3, 2), most)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 4 and sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert _rows(got) == _rows(geometry.label_bodies(mask, 26))
