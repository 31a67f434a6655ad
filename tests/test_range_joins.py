"""Range queries are exploded into blocks, which Spark's size estimates do not see: none may be sent out as a broadcast."""

from loomseries.operators import ordered_tree as ot
from loomseries.operators import stats


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_aggregate_joins_without_a_broadcast(spark):
    data = spark.range(50).selectExpr("id as p", "cast(id as double) as v")
    ask = spark.range(20).selectExpr("id", "id as a", "id + 9 as b")
    out = stats.range_aggregate(data, "p", "v", ask, "id", "a", "b", 3)
    assert "SortMergeJoin" in _plan(out) and "BroadcastHashJoin" not in _plan(out)
    assert {r.id: r.sum_value for r in out.collect()} == {i: float(sum(range(i, i + 10))) for i in range(20)}


def test_tree_ranges_join_without_a_broadcast(spark, tmp_path):
    data = spark.range(50).selectExpr("id as p", "array(id) as v")
    tree = ot.build(data, "p", "v", str(tmp_path / "tree"), lambda x, y: x + y, (0,))
    ask = spark.range(20).selectExpr("id", "id as a", "id + 9 as b")
    before = tree.ranges(ask, "id", "a", "b")
    tree = tree.update(spark.createDataFrame([(12, [100])], "p long, v array<long>"), "p", "v")
    after = tree.ranges(ask, "id", "a", "b")
    for out, more in ((before, 0), (after, 88)):
        # The one join with the blocks; that of the results with their queries is below it.
        assert "SortMergeJoin [level" in _plan(out)
        assert {r.id: list(r.value) for r in out.collect()} == {i: [sum(range(i, i + 10)) + (more if i <= 12 <= i + 9 else 0)] for i in range(20)}
