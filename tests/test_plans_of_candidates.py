"""Joins with written tables, which are small files of many rows."""

import pytest

from cellweave.operators import frontier as fr
from cellweave.plans import QUERIES


@pytest.fixture
def eager(spark):
    """A session that broadcasts whatever a file's size lets pass for small."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "100m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _broadcasts(df):
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert any("SortMergeJoin" in x for x in lines)
    return [x for x in lines if "BroadcastHashJoin" in x]


def test_route_candidates_never_go_through_the_driver(eager, sf_dir):
    df = QUERIES["r16_route_candidates"](eager, sf_dir)
    assert df.collect()
    assert _broadcasts(df) == []


def test_parts_of_many_blocks_never_go_through_the_driver(eager):
    # a snake through three blocks: one component
    cells = eager.range(0, 3 * fr.BLOCK).selectExpr("id % 2 AS w", "CAST(id AS INT) AS col", "0 AS row")
    cells = cells.unionByName(cells.selectExpr("1 - w AS w", "col", "row"))
    df = fr.label_cells(cells, ["w"], False, 1 << 20)
    assert df.groupBy("w", "label").count().count() == 2
    df.collect()
    assert _broadcasts(df) == []
