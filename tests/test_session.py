"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from facetrank.sources.session import cut, shared_folder


def test_cut_reads_back(spark):
    frame = spark.range(10).withColumnRenamed("id", "n")
    back = cut(frame)
    assert back.schema == frame.schema or back.dtypes == frame.dtypes
    assert sorted(r["n"] for r in back.collect()) == list(range(10))
    assert spark.sparkContext.applicationId in back.inputFiles()[0]


def test_cluster_needs_a_shared_folder():
    undefined = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
