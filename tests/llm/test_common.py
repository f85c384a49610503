import pytest

from tidewell.llm import common


def test_shared_folder_has_sparks_scheme(spark, tmp_path):
    assert common.qualified(spark, f"{tmp_path}/x") == f"file:{tmp_path}/x"
    folder = common.shared_dir(spark, "x")
    assert folder.startswith("file:/") and "/tidewell/x-" in folder
    fs, path = common.open_fs(folder)
    assert fs.type_name == "local" and path.startswith("/") and not path.startswith("//")


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common._local_dir("local-cluster[3,2,1024]")
    assert common._local_dir("local[4]").startswith("file:///")


def test_materialize_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(common._CLEANUP, None)
    assert common.materialize(spark.range(5), "five").count() == 5
    assert spark.conf.get(common._CLEANUP, None) == before
