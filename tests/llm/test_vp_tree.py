"""Nearest neighbours against brute force."""

import numpy as np

from sparkfolio.llm import vp_tree
from sparkfolio.llm.vp_tree import nearest


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for q in queries:
        x = v[ids.tolist().index(q)]
        s = (v @ x) / (np.linalg.norm(v, axis=1) * np.linalg.norm(x))
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def data(n=900, dim=16):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, dim))
    v = (centres[r.integers(12, size=n)] + 0.6 * r.normal(size=(n, dim))).astype(np.float32)
    v[100:140] = v[3]
    v[200] = v[50]
    return [(i, v[i].tolist()) for i in range(n)]


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vp_tree, "SHARD", 200 * 16 * 8)
    monkeypatch.setattr(vp_tree, "BLOCK", 30 * 16 * 8)
    rows = data()
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [float("inf")] * 16), (5006, [1.0, 2.0]), (None, [1.0] * 16), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int").repartition(3)
    queries = [i for i, _ in rows if i % 20 == 0] + [103]
    got = {}
    for x in nearest(df, df.where(df.vec_id.isin(queries + [5000, 5002])), k=5, factor=1.0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, queries, 5)
    assert got.keys() == want.keys()
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == [1, 2, 3, 4, 5] and [x[1] for x in g] == [x[0] for x in w]
        assert np.allclose([x[2] for x in g], [x[1] for x in w], atol=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.rank, x.vec_id) for x in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_recall_on_the_test_table(spark):
    import pathlib

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not pathlib.Path(path).exists():
        return
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    want = brute(rows, queries, 5)
    got = {(x.query_id, x.vec_id) for x in nearest(df, df.where("vec_id % 50 = 0")).collect()}
    assert sum((q, v) in got for q, w in want.items() for v, _ in w) / sum(map(len, want.values())) >= 0.95


def test_large_and_small_components(spark):
    """Components around 1e200 and 1e-200: squares would leave the range, cosines don't."""
    rows = [(i, [s * x for x in v]) for i, (v, s) in enumerate(zip(([1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [2.0, 1.0]), (1e200, 1e-200, 1e300, 1.0)))]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), factor=1.0).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [3, 1, 2] and np.allclose([x.score for x in got], [2 / 5**0.5, 0.5**0.5, 0], atol=1e-15)
