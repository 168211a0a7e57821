import numpy as np

from tracemill.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(rows, k=4):
    """Per vec_id and component the expected figures, by numpy's eigh; whitened up to its sign."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        for c in range(min(k, len(values))):
            if values[c] > 1e-12 * values[0]:
                out.append((i, c + 1, n, deviation, (np.array(x) - s / n) @ vectors[:, c] / np.sqrt(values[c]), values[c] / values.sum()))
    return out


def compare(got, want):
    got = sorted(got, key=lambda r: (str(r["vec_id"]), r["component"], abs(r["whitened"])))
    want = sorted(want, key=lambda r: (str(r[0]), r[1], abs(r[4])))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want):
        assert abs(abs(g["whitened"]) - abs(w[4])) < 1e-7 and abs(g["explained"] / w[5] - 1) < 1e-8 and 0 <= g["identity_error"] < 1e-8
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(w[1], np.sign(g["whitened"] * w[4])) == np.sign(g["whitened"] * w[4])


def test_tables_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(whitening.whitened(d).collect(), brute([(r["vec_id"], r["embedding"]) for r in d.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1]]) for i in range(200)]
    rows += [(None, [0.0, -0.0, 1.0, 2.0, -3.0, 0.001]), (2**60 + 1, [1.0] * 6), (2**60 + 3, [1.0] * 6), (5, rows[5][1])] + [(900 + k, [1.0] * 6) for k in range(300)]
    dropped = [(300, None), (301, []), (302, [None] * 6), (303, [1.0, NAN, 1, 1, 1, 1]), (304, [INF, 1.0, 1, 1, 1, 1]), (305, [1.0, -INF, 1, 1, 1, 1])]
    d = spark.createDataFrame(rows + [(i, v and [None if c is None else float(c) for c in v]) for i, v in dropped], "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as n", "'z' as `a.b`")
    got = whitening.whitened(d).collect()
    compare(got, brute(rows))
    assert not {r["vec_id"] for r in got} & {i for i, _ in dropped}


def test_dependent_dimensions_have_no_component(spark):
    rows = [(i, [float(i % 7), float(i % 7), 0.0]) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 50 and abs(got[0]["explained"] - 1) < 1e-12
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitened(one).count() == 0


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(8)
    a = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    b = [(100 + i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(a + b, "vec_id long, embedding array<double>").repartition(3)).collect()
    compare([r for r in got if r["vec_id"] < 100], brute(a))
    compare([r for r in got if r["vec_id"] >= 100], brute(b))


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i + 1)), float(i)]) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["n"] for r in got} == {5} and {r["deviation"] for r in got if r["vec_id"] != 2} == {None}
    small = [(i, [float(2**14 * (i + 1)), float(i)]) for i in range(5)]
    compare(whitening.whitened(spark.createDataFrame(small, "vec_id long, embedding array<double>"), 1).collect(), brute(small, 1))


def test_jacobi_small_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    scale = 10.0 ** -np.arange(12)
    b = rng.normal(size=(12, 12)) * 0.1 + np.eye(12)
    a = scale[:, None] * (b @ b.T) * scale[None, :]  # graded: relative accuracy of small eigenvalues can be had
    values, vectors = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-13
    want = 1 / np.linalg.eigvalsh((1 / scale)[:, None] * np.linalg.inv(b @ b.T) * (1 / scale)[None, :])
    assert np.abs(values / np.sort(want)[::-1] - 1)[-1] < 1e-10
    flat = q[:, :3] @ np.diag([5.0, 2.0, 1.0]) @ q[:, :3].T
    values, _ = whitening.jacobi((flat + flat.T) / 2)
    assert np.abs(values[:3] - [5, 2, 1]).max() < 1e-12 and np.abs(values[3:]).max() < 1e-12
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_empty(spark):
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
