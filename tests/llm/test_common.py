"""Intermediate storage and session settings of the training-data operators."""

import os

import pytest

from slatework.llm import common


def test_scratch_removes_what_was_written_inside(spark):
    outer = common.materialize(spark, spark.range(3), "outer")
    with common.scratch(spark) as keep:
        a, b = (common.materialize(spark, spark.range(4), "inner") for _ in range(2))
        keep.append(b)
    assert [os.path.exists(x._slatework_path.removeprefix("file:")) for x in (outer, a, b)] == [True, False, True]
    common.discard(spark, b)
    common.discard(spark, outer)
    assert not os.path.exists(outer._slatework_path.removeprefix("file:"))


def test_scratch_removes_after_a_failure(spark):
    with pytest.raises(KeyError), common.scratch(spark):
        a = common.materialize(spark, spark.range(4), "inner")
        raise KeyError
    assert not os.path.exists(a._slatework_path.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_arrow_limits_are_only_lowered(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "100")
        common.limit_arrow(spark)
        assert [spark.conf.get(k) for k in keys] == ["100", "100"]
        spark.conf.set(keys[0], "0")  # no limit
        common.limit_arrow(spark)
        assert spark.conf.get(keys[0]) == str(common.ARROW_ROWS)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
