"""Ordered range aggregates against plain loops, before and after updates."""

import numpy as np
import pytest

from loomseries.operators import ordered_tree as ot

P = 10_007


def affine():
    def then(x, y):
        """The affine map x, then y, modulo P: associative, not commutative."""
        return np.stack([x[:, 0] * y[:, 0] % P, (y[:, 0] * x[:, 1] + y[:, 1]) % P], axis=1)

    return then


then = affine()


def by_hand(values, lo, hi):
    out = np.array([[1, 0]])
    for at in sorted(p for p in values if lo <= p <= hi):
        out = then(out, np.array([values[at]]))
    return out[0].tolist()


def check(spark, tree, values, seed):
    rng = np.random.default_rng(seed)
    asked = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-300, 1500, 60), rng.integers(-3, 900, 60), strict=True))] + [(900, None, 4), (None, 0, 1000)]
    got = {r.id: list(r.value) for r in tree.ranges(spark.createDataFrame(asked, "id long, a long, b long"), "id", "a", "b").collect()}
    assert got == {i: [1, 0] if a is None else by_hand(values, a, b) for i, a, b in asked}


def test_ranges_and_updates(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    places = rng.choice(np.arange(-200, 1400), 700, replace=False).tolist()
    values = {p: [int(a), int(b)] for p, a, b in zip(places, rng.integers(1, 50, 700), rng.integers(0, P, 700), strict=True)}
    data = spark.createDataFrame([(p, v) for p, v in values.items()], "p long, v array<long>").repartition(5)
    tree = ot.build(data, "p", "v", str(tmp_path / "tree"), then, (1, 0), part=64)
    assert tree.levels == 3
    check(spark, tree, values, 2)

    read = []
    real = ot.Tree.rows
    monkeypatch.setattr(ot.Tree, "rows", lambda self, level, parts=None: (read.append((level, parts)), real(self, level, parts))[1])
    changes = {130: [3, 4], 131: [5, 6], 777: [7, 8], -5: [2, 2]}
    new = tree.update(spark.createDataFrame(list(changes.items()), "p long, v array<long>"), "p", "v")
    assert sorted(read[0][1]) == [-1, 2, 12] and all(parts is not None for _, parts in read)  # of 25 parts of leaves three are read
    plan = real(new, 0, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1]
    monkeypatch.undo()
    check(spark, new, values | changes, 3)
    check(spark, tree, values, 4)  # the version before is still there
    again = new.update(spark.createDataFrame([(777, [1, 0])], "p long, v array<long>"), "p", "v")
    rebuilt = ot.build(spark.createDataFrame(list((values | changes | {777: [1, 0]}).items()), "p long, v array<long>"), "p", "v", str(tmp_path / "other"), then, (1, 0), part=64)
    for level in range(tree.levels + 1):
        assert sorted(map(str, again.rows(level).collect())) == sorted(map(str, rebuilt.rows(level).collect()))


@pytest.mark.parametrize("rows", [[], [(5, [2, 3])], [(-9, [2, 3]), (9, [4, 5])]])
def test_few_rows(spark, tmp_path, rows):
    data = spark.createDataFrame(rows, "p long, v array<long>")
    tree = ot.build(data, "p", "v", str(tmp_path / "tree"), then, (1, 0))
    check(spark, tree, dict(rows), 5)


def test_runs_fold_in_order():
    keys = np.array([3, 3, 3, 3, 3, 7, 9, 9])
    starts, values = ot.fold_runs(keys, np.array([[x] for x in "abcdefgh"], object), lambda a, b: a + b)
    assert starts.tolist() == [0, 5, 6] and values.ravel().tolist() == ["abcde", "f", "gh"]
