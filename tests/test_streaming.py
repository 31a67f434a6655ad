import numpy as np
import pandas as pd
import pytest

from loomseries.operators.indicators import compute
from loomseries.plans.series import Series
from loomseries.operators.stats import running_stats
from loomseries.sources.files import append_batch
from loomseries.streaming import stateful
from loomseries.streaming.stateful import AverageTrueRange, MovingAverage, Progress, RunningStats, apply, ascending, run_available, smoothed


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Three files of consecutive rows, read one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("stream"))
    rng = np.random.default_rng(2)
    close = rng.uniform(10, 20, 60)
    rows = [("ab"[i % 2], i, float(c + 1), float(c - 1), float(c), float(c)) for i, c in enumerate(close)]
    schema = "sym string, t long, high double, low double, close double, real double"
    full = spark.createDataFrame(rows, schema)
    for n, (lo, hi) in enumerate([(0, 7), (7, 11), (11, 60)]):
        full.filter(f"t >= {lo} AND t < {hi}").coalesce(1).write.mode("append").parquet(f"{folder}/part{n}")
    stream = spark.readStream.schema(full.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    return full, stream


def values(df, name):
    return {(r.sym, r.t): r[name] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    np.testing.assert_allclose([a[k] for k in b], list(b.values()), rtol=1e-9)


def test_moving_average(batches):
    full, stream = batches
    got = run_available(apply(stream, MovingAverage(5, ["sym"], ["t"])))
    close(values(got, "sma"), values(compute("sma", full, [5], order=["t"], grain=10), "sma"))


def test_average_true_range(batches):
    full, stream = batches
    got = run_available(apply(stream, AverageTrueRange(4, ["sym"], ["t"])))
    close(values(got, "atr"), values(compute("atr", full, [4], order=["t"], grain=10), "atr"))


def test_incremental_save(spark, batches, tmp_path):
    """Batches land as they are read, and a repeated batch replaces itself."""
    full, stream = batches
    write = append_batch(str(tmp_path / "saved"))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    write(full.filter("t < 7"), 0)
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 60


def test_running_stats_and_progress(batches):
    full, stream = batches
    got = run_available(apply(stream, RunningStats(["sym"], ["t"])))
    want = running_stats(Series.of(full, ["sym"], ["t"], 10), "real").df
    for name in ("mean", "var_sample", "var_population"):
        close(values(got, name), values(want, name))
    steps = values(run_available(apply(stream, Progress(4, ["sym"], ["t"]))), "progress")
    assert [steps["a", t] for t in (0, 6, 8, 58)] == [-3.0, 0.0, 1.0, 26.0]


@pytest.fixture
def small_slices(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield 7
    spark.conf.set(name, before)


def test_a_key_comes_in_slices(spark, batches, small_slices):
    """No call sees more rows than a slice, and the results are those of whole batches."""
    full, stream = batches

    class Sized(MovingAverage):
        """Gives the number of rows of the slice that each row came in."""

        def fold(self, rows, state):
            return {"sma": np.full(len(rows), float(len(rows)))}, state

    sizes = values(run_available(apply(stream, Sized(5, ["sym"], ["t"]))), "sma")
    assert len(sizes) == 60 and max(sizes.values()) <= small_slices
    for name, processor, options in (("sma", MovingAverage(5, ["sym"], ["t"]), [5]), ("atr", AverageTrueRange(9, ["sym"], ["t"]), [9])):
        close(values(run_available(apply(stream, processor)), name), values(compute(name, full, options, order=["t"], grain=10), name))
    got = run_available(apply(stream, RunningStats(["sym"], ["t"])))
    want = running_stats(Series.of(full, ["sym"], ["t"], 10), "real").df
    for name in ("mean", "var_sample", "var_population"):
        close(values(got, name), values(want, name))


def test_many_batches_of_unsorted_files(spark, tmp_path, small_slices):
    """Ten files, each unsorted in itself, read one a batch; one key holds most rows, keys and times may be NULL."""
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 5 else None, None if i < 3 else i, i, float(x)) for i, x in enumerate(rng.normal(1e6, 1, 2000))]
    schema = "sym string, t long, id long, real double"
    for n in range(10):
        part = rows[n * 200 : n * 200 + 200]
        rng.shuffle(part)
        spark.createDataFrame([tuple(r) for r in part], schema).coalesce(1).write.parquet(str(tmp_path / f"{n:02}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = run_available(apply(stream, RunningStats(["sym"], ["t", "id"])))
    got = {r.id: (r["mean"], r.var_sample) for r in out.collect()}
    assert len(got) == 2000
    for sym in ("hot", None):
        mine = [(r[2], r[3]) for r in rows if r[0] == sym]
        for at in (0, 1, 40, len(mine) - 1):
            upto = [x for _, x in mine[: at + 1]]
            np.testing.assert_allclose(got[mine[at][0]], (np.mean(upto), np.var(upto, ddof=1) if at else 0.0), rtol=1e-7, atol=1e-9)


def test_a_batch_is_sorted_once(spark, batches):
    """One exchange and one sort before the state: the sort by key and order serves the operator."""
    _, stream = batches
    out = apply(stream, MovingAverage(5, ["sym"], ["t"]))
    query = out.writeStream.format("noop").option("checkpointLocation", stateful.scratch_path(spark, "streams")).trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan


def test_unsorted_rows_are_refused():
    rows = pd.DataFrame({"sym": "a", "t": [1, 2, 2, 5], "real": 1.0})
    assert ascending(rows, ["t"]) and not ascending(rows.iloc[::-1], ["t"])
    nulls = pd.DataFrame({"t": [None, None, 1.0, 2.0], "s": ["b", "c", None, "a"]})
    assert ascending(nulls, ["t", "s"]) and not ascending(nulls, ["s"]) and ascending(nulls.iloc[:0], ["t"])

    class Held:
        def exists(self):
            return False

        def update(self, value):
            raise AssertionError("no state is kept of a refused batch")

    average = MovingAverage(2, ["sym"], ["t"])
    average.state = Held()
    with pytest.raises(ValueError, match="not in the order"):
        list(average.handleInputRows(("a",), iter([rows.iloc[2:], rows.iloc[:2]]), None))


@pytest.mark.parametrize("period", [1, 2, 14, 5000])
def test_smoothed_blocks(period):
    values = np.random.default_rng(period).normal(3, 1, 1000)
    want, v = [], 7.0
    for x in values:
        v += (x - v) / period
        want.append(v)
    np.testing.assert_allclose(smoothed(values, 7.0, period), want, rtol=1e-12)
    values[300] = np.nan
    got = smoothed(values, 7.0, period)
    np.testing.assert_allclose(got[:300], want[:300], rtol=1e-12)
    assert np.isnan(got[300:]).all()
