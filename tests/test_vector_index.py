import numpy as np

from loomseries.operators import vector_index as vi


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.6
    return [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, [0.0] * 16), (n + 1, None), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16)]


def exact(data, asked, k):
    ids = np.array([i for i, _ in data])
    v = np.array([x for _, x in data])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = v @ v[q]
        s[q] = -9
        out[q] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_all_lists_are_exact_and_few_find_most(spark):
    data = rows(900)
    df = spark.createDataFrame(data, "id long, v array<double>")
    asked = list(range(0, 900, 50))
    want = exact(data[:900], asked, 5)
    index = vi.build(df, "id", "v", lists=24)
    queries = df.where("id % 50 = 0 and id < 900")
    assert found(vi.search(index, queries, "id", "v", 5, 24)) == want
    some = found(vi.search(index, queries, "id", "v", 5, 6))
    hit = sum(len(set(some[q]) & set(want[q])) for q in asked)
    assert hit / (5 * len(asked)) >= 0.9
    assert index.rows.count() == 900


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    index = vi.build(df, "id", "v")
    assert vi.search(index, df, "id", "v", 5, 3).count() == 0
