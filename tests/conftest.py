import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomseries.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", **{
        "spark__sql__shuffle__partitions": "4",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir(tmp_path_factory):
    """A folder with a small events table in which one type holds most rows."""
    rng = np.random.default_rng(7)
    n = 420
    seconds = np.sort(rng.choice(40 * 86400, n, replace=False))
    events = pd.DataFrame({
        "event_id": np.arange(n, dtype="int64"),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"),
        "user_id": rng.integers(1, 9, n),
        "event_type": rng.choice(["click", "view", "error"], n, p=[0.7, 0.25, 0.05]),
        "value": rng.integers(100, 50000, n) / 100,
        "props": ['{"k": 1}'] * n,
    })
    events["ts"] = events["ts"].astype("datetime64[us]")
    folder = tmp_path_factory.mktemp("tables")
    events.to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="session")
def duck(small_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{small_dir}/events.parquet'")
    return db


def same(df, relation, tolerance=1.1e-4):
    """Equal columns and rows; doubles within the tolerance, relative to their size."""
    got = sorted(df.columns)
    want = sorted(c[0] for c in relation.description)
    assert got == want
    keys = [c for c in got if dict(df.dtypes)[c] != "double"]
    left = df.toPandas()[got].sort_values(keys).reset_index(drop=True)
    right = relation.df()[got].sort_values(keys).reset_index(drop=True)
    assert len(left) == len(right)
    for column in got:
        if column in keys:
            assert left[column].astype(str).tolist() == right[column].astype(str).tolist(), column
        else:
            np.testing.assert_allclose(
                left[column].astype(float), right[column].astype(float), rtol=1e-6, atol=tolerance, err_msg=column)
