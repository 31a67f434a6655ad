"""The blocked recursions equal a plain loop."""

import numpy as np
import pytest

from loomseries.operators.scan import NO_FLOOR, _compose, _follow


def loop(first, enter, a, b, lo, v):
    out = []
    for i in range(len(b)):
        if first[i]:
            v = enter[i]
        v = b[i] if a[i] == 0.0 else a[i] * v + b[i]
        if v < lo[i]:
            v = lo[i]
        out.append(v)
    return np.array(out)


def loop_compose(first, a, b, lo, run):
    big_a, big_b, big_l = run
    out = []
    for i in range(len(b)):
        if first[i]:
            big_a, big_b, big_l = 1.0, 0.0, NO_FLOOR
        if a[i] == 0.0:
            big_a, big_b, big_l = 0.0, b[i], lo[i]
        else:
            big_l = lo[i] if big_l == NO_FLOOR else max(a[i] * big_l + b[i], lo[i])
            big_a, big_b = a[i] * big_a, a[i] * big_b + b[i]
        out.append((big_a, big_b, big_l))
    return np.array(out).T


def case(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([1, 2, 3, 10, 63, 500, 4000]))
    a = rng.choice([0.9, 0.5, 1.0, 0.0], n, p=[0.5, 0.3, 0.15, 0.05])
    if seed % 3 == 0:
        a[:] = 0.97
    b = rng.normal(size=n)
    if seed % 4 == 1:
        b[rng.integers(0, n, max(1, n // 50))] = np.nan
    lo = rng.normal(size=n) if seed % 2 else np.full(n, NO_FLOOR)
    first = rng.random(n) < (0.02 if seed % 5 else 0.0)
    return first, rng.normal(size=n), a, b, lo


@pytest.mark.parametrize("seed", range(40))
def test_blocks_equal_a_loop(seed):
    first, enter, a, b, lo = case(seed)
    for v in (0.3, float("nan")):
        np.testing.assert_allclose(_follow(first, enter, a, b, lo, v), loop(first, enter, a, b, lo, v), rtol=1e-9, atol=1e-12)
    lo, b = np.where(np.isnan(b), -1.0, lo), np.nan_to_num(b)
    run = (0.5, 0.25, -0.1 if seed % 2 else NO_FLOOR)
    np.testing.assert_allclose(_compose(first, a, b, lo, run), loop_compose(first, a, b, lo, run), rtol=1e-9, atol=1e-12)


def test_no_rows():
    none = np.zeros(0)
    assert len(_follow(none > 0, none, none, none, none, 1.0)) == 0 and _compose(none > 0, none, none, none, (1, 0, NO_FLOOR)).shape == (3, 0)
