import pytest

from querylode.llm import common


class Cluster:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        master = "yarn"

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Cluster, "x")


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    common.small_batches(spark)
    assert spark.conf.get(key) == str(2 << 20)
    spark.conf.set(key, "1000")
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)
