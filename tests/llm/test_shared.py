"""Intermediate tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from codonframe.llm.components import components
from codonframe.llm.shared import only_kept, shared_dir, stored


def folders(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")))


def test_only_kept_tables_stay(spark):
    stored(spark.range(3))
    before = folders(spark)
    with only_kept(spark) as outer:
        stored(spark.range(5))
        with only_kept(spark) as inner:
            stored(spark.range(6))
            part = inner.keep(stored(spark.range(7)))
        assert part.count() == 7
        whole = outer.keep(stored(part.where("id > 2")))
    assert whole.count() == 4 and len(folders(spark) - before) == 1 and before <= folders(spark)
    with pytest.raises(ZeroDivisionError), only_kept(spark):
        part = stored(spark.range(8))
        raise ZeroDivisionError
    assert part.count() == 8


def test_rounds_of_components_leave_one_table(spark):
    before = folders(spark)
    chain = spark.range(40).selectExpr("id a", "id + 1 b")
    found = components(chain).collect()
    assert len(found) == 41 and {r.component for r in found} == {0} and len(folders(spark) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
