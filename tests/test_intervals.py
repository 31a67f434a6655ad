"""Narrowest intervals over tiles, and texts cut in place, against plain loops."""

import random
import re

import pytest

from loomseries.functions import text as tx
from loomseries.operators import intervals


@pytest.mark.parametrize("rows_per_batch", [7, 10_000])
def test_intervals_over_many_tiles(spark, rows_per_batch):
    rng = random.Random(3)
    nodes, points = [], []
    for key in ("a", "b"):
        for i in range(120):
            start = rng.randrange(-20_000, 60_000)
            nodes.append((key, i, start, start + rng.choice([1, 40, 900, 4096, 9000, 30_000, 0, -5])))
        nodes += [(key, 120, -50_000, 90_000), (key, 121, 4096, 8192), (key, 122, 4096, 8192), (key, None, 50, 60)]
        points += [(key, i, rng.randrange(-60_000, 100_000)) for i in range(500)] + [(key, 500 + i, x) for i, x in enumerate((4095, 4096, 8191, 8192, 55))]
    points += points[:50] + [("c", 1, 5), (None, 1, 5), (None, 1, 5), ("a", 2, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        out = intervals.narrowest_interval(
            spark.createDataFrame(points, "d string, point_id int, pos long").repartition(3), spark.createDataFrame(nodes, "d string, node_id int, start long, stop long"), "d")
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key, ident, pos in points:
        inside = [n for n in nodes if key is not None and n[0] == key and pos is not None and n[2] <= pos < n[3]]
        best = min(inside, key=lambda n: (n[3] - n[2], -n[2], -1 if n[1] is None else n[1]), default=None)
        want.add((key, ident, pos, best and best[1], best and best[3] - best[2]))
    assert len(got) == len(want) and set(got) == want


def test_points_are_not_copied_for_each_width(spark):
    points = spark.range(400).selectExpr("1 as d", "cast(id as int) as point_id", "id as pos")
    nodes = spark.range(12).selectExpr("1 as d", "cast(id as int) as node_id", "0L as start", "shiftleft(1L, cast(id as int)) as stop")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield from real([batch])

    real, intervals._looked_up = intervals._looked_up, counted
    try:
        assert intervals.narrowest_interval(points, nodes, "d").count() == 400
    finally:
        intervals._looked_up = real
    assert seen.value == 412


def test_pieces(spark):
    texts = ["a b\nc", "", None, " ", "\n\n", "é\U0001f600 xß\n", "end", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    want = []
    for i, t in enumerate(texts):
        at = 0
        for k, piece in enumerate(re.split("[ \n]", t) if t is not None else ()):
            want.append((i, k, at, len(piece)))
            at += len(piece) + 1
    for size in (1, 1 << 20):
        tx.PIECE_BYTES, old = size, tx.PIECE_BYTES
        try:
            assert sorted(map(tuple, tx.pieces(df, "i", "t", " \n").collect())) == want
        finally:
            tx.PIECE_BYTES = old
