import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.sources import matrices


def _long(m):
    m = np.asarray(m, float)
    m = m.reshape(-1, 1) if m.ndim < 2 else m
    return sorted((int(r), int(c), float(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1]))


@pytest.mark.parametrize("split", [8, 100, 1 << 20])
def test_reads_what_numpy_writes(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(matrices, "_VALUES", 7)
    r = np.random.default_rng(1)
    held = {
        "c": r.normal(size=(13, 5)), "f": np.asfortranarray(r.normal(size=(13, 5))), "v": r.normal(size=9), "i": r.integers(-9, 9, (4, 3)), "b": np.array([[True, False]]),
        "s": r.normal(size=(3, 2)).astype(">f4"), "none": np.empty((0, 4)), "one": np.array(2.5)
    }
    for n, m in held.items():
        path = str(tmp_path / f"{n}.npy")
        np.save(path, m)
        df = matrices.read_matrix(spark, path, split)
        assert sorted(map(tuple, df.collect())) == _long(m), n
        if split == 8 and n in "cf":
            assert df.rdd.getNumPartitions() == (13 if n == "c" else 5)
    both = matrices.read_matrix(spark, [str(tmp_path / "c.npy"), str(tmp_path / "absent.npy"), str(tmp_path / "f.npy")], split)
    assert sorted(map(tuple, both.collect())) == _long(np.vstack([held["c"], held["f"]]))
    assert matrices.read_matrix(spark, str(tmp_path / "absent.npy")).count() == 0


def test_writes_what_numpy_reads(spark, tmp_path):
    r = np.random.default_rng(2)
    m = r.normal(size=(50, 4))
    m[7] = np.nan
    m[20, 2] = np.nan
    cells = spark.createDataFrame([x for x in _long(m) if x[0] != 7 and x[2] == x[2]] + [(20, 2, None)], matrices.LONG).repartition(5)
    files = matrices.write_matrix(cells, str(tmp_path / "out"), 4, rows_a_file=16).collect()
    assert [f.first_row for f in files] == [0, 16, 32, 48] and [f.n_rows for f in files] == [16, 16, 16, 2]
    assert np.array_equal(np.concatenate([np.load(f.path) for f in files]), m, equal_nan=True)
    back = matrices.read_matrix(spark, [f.path for f in files]).where(~F.isnan("value"))
    assert sorted(map(tuple, back.collect())) == [x for x in _long(m) if x[2] == x[2]]


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.npy").write_bytes(b"not a matrix")
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "text.npy", np.array(["a"]))
    for n in ("x", "cube", "text"):
        with pytest.raises(Exception, match="is no NPY file|holds no matrix"):
            matrices.read_matrix(spark, str(tmp_path / f"{n}.npy")).count()
    np.save(tmp_path / "short.npy", np.zeros((4, 4)))
    whole = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="cut short"):
        matrices.read_matrix(spark, str(tmp_path / "short.npy")).count()
