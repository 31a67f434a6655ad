import numpy as np

from loomseries.operators import som


def made(spark, n=400):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 3)) * 5
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 3)) * 0.3
    rows = [([float(x) for x in row],) for row in v] + [(None,), ([1.0, None, 2.0],), ([],)]
    return v, spark.createDataFrame(rows, "v array<double>").repartition(4)


def test_an_epoch_is_a_weighted_mean(spark):
    v, df = made(spark)
    start = v[:6].copy()
    start[3] = start[2]  # equally near units: the first gets the rows
    weights = som.neighbourhood(2, 3, 0.7)
    units, n, error = som.epoch(df, "v", start, weights)
    apart = ((v[:, None] - start) ** 2).sum(axis=2)
    at = apart.argmin(axis=1)
    w = weights[:, at]
    assert np.allclose(units, w @ v / w.sum(axis=1, keepdims=True))
    assert n.tolist() == np.bincount(at, minlength=6).tolist() and n[3] == 0
    assert np.isclose(error, apart.min(axis=1).mean())
    assert np.allclose([weights[0, 1], weights[0, 5]], np.exp([-1 / 0.98, -5 / 0.98]))


def test_training_lowers_the_error(spark):
    v, df = made(spark)
    units, errors = som.train(df, "v", v[:6], 2, 3, epochs=6)
    assert len(errors) == 7 and errors[-1] < 0.5 * errors[0] and units.shape == (6, 3)


def test_no_rows(spark):
    _, df = made(spark)
    start = np.ones((4, 3))
    units, n, error = som.epoch(df.where("v is null"), "v", start, som.neighbourhood(2, 2, 1.0))
    assert units.tolist() == start.tolist() and n.sum() == 0 and error == 0
