"""A session that runs already is not changed by who asks for it again."""

from tidewell.session import build_session


def test_a_running_session_keeps_its_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert build_session().conf.get("spark.sql.shuffle.partitions") == "5"
        assert build_session(**{"spark.sql.shuffle.partitions": "6"}).conf.get("spark.sql.shuffle.partitions") == "6"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
