import random

from pyspark.sql import functions as F

from loomseries.operators import intervals, stats
from loomseries.operators.schedule import priority_schedule, schedule_averages
from loomseries.plans.numbering import global_rank, number_rows
from loomseries.plans.series import Series


def test_number_rows_with_a_dominant_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", v) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = {(r.k, r.t): r.rn for r in number_rows(df, ["k"], ["t"], 17).collect()}
    for key in ("hot", "cold"):
        values = sorted(t for k, t in rows if k == key)
        assert [got[key, t] for t in values] == list(range(1, len(values) + 1))


def test_global_rank(spark):
    values = [(v,) for v in random.Random(2).sample(range(10_000), 500)]
    got = {r.v: r["rank"] for r in global_rank(spark.createDataFrame(values, "v long"), "v").collect()}
    assert [got[v] for (v,) in sorted(values)] == list(range(1, 501))


def test_span_copies_only_the_tail(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "k string, t long, x double")
    s = Series.of(df, ["k"], ["t"], 10, chunk_rows=16).span(3)
    assert s.df.filter("NOT _own").filter("chunk <= 3").count() == 9
    assert s.owned().df.count() == 50


def test_running_sum_and_last(spark):
    df = spark.createDataFrame([("a", i, float(i), i if i % 7 == 0 else None) for i in range(40)],
                               "k string, t long, x double, m long")
    s = Series.of(df, ["k"], ["t"], 10, chunk_rows=8)
    rows = s.running_sum(total=F.col("x")).running_last(seen=F.col("m")).df.orderBy("t").collect()
    assert [r.total for r in rows] == [float(sum(range(i + 1))) for i in range(40)]
    assert [r.seen for r in rows] == [i - i % 7 for i in range(40)]


def test_running_stats(spark):
    values = [random.Random(5).uniform(1e6, 1e6 + 5) for _ in range(30)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t long, x double")
    rows = stats.running_stats(Series.of(df, ["k"], ["t"], 10, chunk_rows=8), "x").df.orderBy("t").collect()
    for i, r in enumerate(rows, 1):
        mean = sum(values[:i]) / i
        spread = sum((v - mean) ** 2 for v in values[:i])
        assert abs(r.mean - mean) < 1e-6 and abs(r.var_population - spread / i) < 1e-6
        assert abs(r.var_sample - (spread / (i - 1) if i > 1 else 0)) < 1e-6


def test_schedule_published_averages(spark):
    jobs = [("q", 1, 0, 5, 1), ("q", 2, 1, 4, 2), ("q", 3, 2, 3, 3), ("q", 4, 3, 2, 4), ("q", 5, 4, 1, 5)]
    df = spark.createDataFrame(jobs, "q string, id long, at long, bt long, priority int")
    avg = schedule_averages(priority_schedule(df, ["q"], 10), ["q"]).collect()[0]
    assert (avg.avg_ct, avg.avg_tat, avg.avg_wt) == (11.0, 9.0, 6.0)


def test_schedule_with_idle_gaps(spark):
    rng = random.Random(9)
    jobs = [(k, i, rng.randrange(400), rng.randrange(1, 9), rng.randrange(4)) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(jobs, "q string, id long, at long, bt long, priority int")
    got = {(r.q, r.id): r.ct for r in priority_schedule(df, ["q"], 50, chunk_rows=8).collect()}
    for key in "ab":
        left, now = [j for j in jobs if j[0] == key], 0
        while left:
            ready = [j for j in left if j[2] <= now]
            if not ready:
                now = min(j[2] for j in left)
                continue
            job = min(ready, key=lambda j: (j[4], j[2], j[1]))
            now += job[3]
            left.remove(job)
            assert got[key, job[1]] == now


def test_range_aggregate(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(-5, 5), 3) for _ in range(700)]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "p long, v double")
    asks = [(i, a := rng.randrange(700), min(699, a + rng.randrange(700))) for i in range(60)]
    asks += [(60, 0, 699), (61, 5, 5)]
    ask = spark.createDataFrame(asks, "id long, a long, b long")
    for levels in (1, 3):
        out = stats.range_aggregate(data, "p", "v", ask, "id", "a", "b", levels).collect()
        assert len(out) == len(asks)
        for r in out:
            _, a, b = asks[r.id]
            part = values[a : b + 1]
            assert (r.min_value, r.max_value) == (min(part), max(part)) and abs(r.sum_value - sum(part)) < 1e-9


def test_kmeans(spark):
    rng = random.Random(6)
    points = [(i, rng.gauss(i % 3 * 10, 1), rng.gauss(0, 1), rng.randrange(3)) for i in range(90)]
    df = spark.createDataFrame(points, "id long, x double, y double, group int")
    groups = {r.id: r.group for r in stats.kmeans(df).collect()}

    def means(assign):
        out = {}
        for g in sorted(set(assign.values())):
            part = [p for p in points if assign[p[0]] == g]
            out[g] = (sum(p[1] for p in part) / len(part), sum(p[2] for p in part) / len(part))
        return out

    now = {p[0]: p[3] for p in points}
    while True:
        centres = means(now)
        new = {p[0]: min(centres, key=lambda g: ((p[1] - centres[g][0]) ** 2 + (p[2] - centres[g][1]) ** 2, g)) for p in points}
        if sum(new[i] != now[i] for i in new) <= len(points) / 10000:
            break
        now = new
    assert groups == new


def test_narrowest_interval(spark):
    nodes = [(1, 0, 0, 100), (1, 1, 10, 60), (1, 2, 20, 30), (1, 3, 25, 26), (1, 4, 60, 100)]
    df = spark.createDataFrame(nodes, "d long, node_id int, start long, stop long")
    points = spark.createDataFrame([(1, i, i) for i in range(110)], "d long, point_id int, pos long")
    got = {r.pos: r.node_id for r in intervals.narrowest_interval(points, df, "d").collect()}
    for pos in range(110):
        inside = [n for n in nodes if n[2] <= pos < n[3]]
        want = min(inside, key=lambda n: (n[3] - n[2], -n[2], n[1]))[1] if inside else None
        assert got.get(pos) == want


def test_scan_cascade_floor_and_reset(spark):
    """Cascades, floors and resets over many chunks against a plain loop."""
    from loomseries.operators.scan import Step, scan, step_after

    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.uniform(-5, 5), rng.random() < 0.05) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, x double, cut boolean")
    s = Series.of(df, ["k"], ["t"], 16, chunk_rows=8)
    a = F.when((F.col("rn") == 1) | F.col("cut"), 0.0).otherwise(0.7)
    s = scan(
        s, e=Step(a, F.col("x")), m=step_after(3, "e", 0.25), mm=step_after(20, "m", 0.5),
        f=Step(F.lit(0.9), F.lit(-0.1), F.col("x")))
    got = {(r.k, r.t): r for r in s.df.collect()}
    for key in ("hot", "cold"):
        e = m = mm = f = 0.0
        for n, (_, t, x, cut) in enumerate((r for r in rows if r[0] == key), 1):
            e = x if n == 1 or cut else 0.7 * e + x
            m = 0.0 if n < 3 else e if n == 3 else m + (e - m) * 0.25
            mm = 0.0 if n < 20 else m if n == 20 else mm + (m - mm) * 0.5
            f = max(x, 0.9 * f - 0.1)
            r = got[key, t]
            for name, want in (("e", e), ("m", m), ("mm", mm), ("f", f)):
                assert abs(r[name] - want) < 1e-9, (name, key, n)


def test_scan_keeps_nan_until_a_reset(spark):
    from loomseries.operators.scan import Step, scan

    df = spark.createDataFrame([("a", i, None if i == 3 else 1.0) for i in range(40)], "k string, t long, x double")
    s = Series.of(df, ["k"], ["t"], 16, chunk_rows=8)
    a = F.when(F.col("rn") == 30, 0.0).otherwise(0.5)
    rows = scan(s, v=Step(a, F.col("x"))).df.orderBy("t").collect()
    assert [r.v is None for r in rows] == [3 <= i < 29 for i in range(40)]


def test_narrowest_interval_keeps_every_point(spark):
    nodes = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 3, 5), (None, 3, 0, 9)], "d string, node_id int, start long, stop long")
    points = spark.createDataFrame([("a", 0, 4), ("a", 1, 40), ("b", 2, 4), (None, 3, 4)], "d string, point_id int, pos long")
    got = {r.point_id: (r.node_id, r.width) for r in intervals.narrowest_interval(points, nodes, "d").collect()}
    assert got == {0: (2, 2), 1: (None, None), 2: (None, None), 3: (None, None)}


def test_many_groups_of_k_means(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(60) / 2, rng.randrange(60) / 2, i % 300) for i in range(900)] + [(900, None, 1.0, 3)]
    points = spark.createDataFrame(rows, "id long, x double, y double, group int").repartition(3)
    many = {r.id: r.group for r in stats.kmeans_step(points).collect()}
    monkeypatch.setattr(stats, "FEW_GROUPS", 1000)
    assert many == {r.id: r.group for r in stats.kmeans_step(points).collect()}
