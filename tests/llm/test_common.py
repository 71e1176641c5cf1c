"""Where intermediate tables go, and that none is left."""

import os
from types import SimpleNamespace

import corpus_pipeline
import pytest

from palaver.llm import common, queries

SF = "/root/testdata/sf0.001"


def left(spark):
    root = common.scratch_root(spark).removeprefix("file:").replace("//", "/")
    folder = f"{root}/palaver/{spark.sparkContext.applicationId}"
    return {x for x in os.listdir(folder) if not x.startswith(".")} if os.path.isdir(folder) else set()


@pytest.mark.parametrize("name", [*sorted(queries.queries()), "pipeline"])
def test_a_scope_leaves_nothing(spark, name):
    query = (queries.queries() | {"pipeline": corpus_pipeline.run})[name]
    before = left(spark)
    with common.scratch(spark):
        assert query(spark, SF).count() > 0
    assert left(spark) == before


def test_a_scope_leaves_nothing_after_a_failure(spark):
    before = left(spark)
    with pytest.raises(RuntimeError), common.scratch(spark):
        common.stored(spark.range(3), "some")
        assert left(spark) != before
        raise RuntimeError
    assert left(spark) == before


def test_kept_tables_go_to_the_scope_around(spark):
    before = left(spark)
    with common.scratch(spark):
        with common.scratch(spark):
            df = common.kept(common.stored(spark.range(3), "some"))
            common.stored(spark.range(3), "other")
        assert df.count() == 3 and len(left(spark) - before) == 1
    assert left(spark) == before


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(spark)


def test_shuffle_files_go_with_the_query(spark):
    """The setting by which stored() has Spark delete them is one that this Spark knows."""
    assert spark.conf.get(common._CLEAN_UP) in ("true", "false")


def test_threads_do_not_delete_each_others_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    def run(_):
        with common.scratch(spark):
            return sorted(map(tuple, queries.queries()["op3_url_filters"](spark, SF).collect()), key=repr)

    before, setting = left(spark), spark.conf.get(common._CLEAN_UP)
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(run, range(6)))
    assert found[0] and all(x == found[0] for x in found)
    assert left(spark) == before and spark.conf.get(common._CLEAN_UP) == setting
