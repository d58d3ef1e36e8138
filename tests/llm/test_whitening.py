import numpy as np
from pyspark.sql import functions as F

from dialspan.llm import whitening as W


def brute(vectors):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(8, int((values > 1e-10 * values[0]).sum()))
    return ((n * x - s) ** 2).sum(axis=1), centred @ axes[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def held(spark, vectors, tolerance=1e-8):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    rows = W.whitened(df).orderBy("component", "vec_id").collect()
    deviation, white, explained = brute([[float(np.float32(c)) for c in v] for v in vectors])
    k = white.shape[1]
    assert len(rows) == len(vectors) * k
    table = np.array([r.whitened for r in rows]).reshape(k, -1).T
    for c in range(k):
        sign = np.sign(table[:, c] @ white[:, c])
        assert np.abs(sign * table[:, c] - white[:, c]).max() < tolerance * max(1, np.abs(white).max())
    assert [r.deviation for r in rows[: len(vectors)]] == deviation.tolist()
    assert all(abs(r.explained - explained[r.component - 1]) <= 1e-9 for r in rows)
    assert max(r.identity_error for r in rows) < tolerance and {r.n for r in rows} == {len(vectors)}


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(W, "FAN", 2)
    held(spark, rng.standard_normal((300, 24)) * np.linspace(1, 3, 24) + 5)
    held(spark, rng.standard_normal((60, 3)))  # fewer dimensions than components
    held(spark, rng.standard_normal((200, 4)) @ rng.standard_normal((4, 12)) / 1024 * 1000, 1e-5)  # four dimensions and roundings, whose axes no 64-bit number gives better
    one = rng.standard_normal(10)
    held(spark, [one] * 150 + list(rng.standard_normal((40, 10))))  # one vector that most rows have
    # eigenvalues that differ by little: the subspace, not its axes, would be unstable below this
    held(spark, np.diag([40.0, 30, 20, 10, 9, 8, 7, 6, 5]).tolist())


def test_rank_one_updates():
    rng = np.random.default_rng(2)
    for values in ([0, 0, 0, 0, 0], [1, 1, 1, 2, 2], [0, 1e-14, 1, 1 + 1e-15, 1e6], [1, 2, 3, 4, 5]):
        d, u = np.array(values, float), np.linalg.qr(rng.standard_normal((5, 5)))[0]
        for v in [*rng.standard_normal((20, 5)), np.zeros(5), u[:, 0] * 3, rng.standard_normal(5) * 1e-9, rng.standard_normal(5) * 1e5]:
            want = u @ np.diag(d) @ u.T + np.outer(v, v)
            d, u = W.rank_one(d, u, v)
            assert np.abs(u @ np.diag(d) @ u.T - want).max() <= 1e-12 * max(1e-20, np.abs(want).max())
            assert np.abs(u.T @ u - np.eye(5)).max() < 1e-12 and (np.diff(d) >= 0).all()


def test_spectra_combine():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 6)) + 100
    parts = [W.Spectrum.empty(6) for _ in range(3)]
    for k, v in enumerate(x):
        parts[k % 2].add(v, 1)
    parts[2].combine(parts[0])
    parts[2].combine(W.Spectrum.read(parts[1].row(), 6))
    centred = x - x.mean(axis=0)
    assert parts[2].n == 50 and np.allclose(parts[2].basis @ np.diag(parts[2].values) @ parts[2].basis.T, centred.T @ centred, atol=1e-9)


def test_defined_cases(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [1e20, 1.0]), (9, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "component": F.lit("y"), "x": F.lit(1)})
    got = W.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)] and {r.n for r in got} == {4}
    assert W.whitened(df.limit(0)).count() == 0 and W.whitened(df.where("vec_id = 1")).count() == 0
    far = spark.createDataFrame([(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [0.0, 5e8])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.whitened(far).collect()} == {None}
