import numpy as np

from veil.operators import spectral as V


def _df(spark, A):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(A)], "id long, a array<double>").repartition(4)


def test_gram_times_equals_direct(spark):
    rng = np.random.default_rng(1)
    A, Q = rng.normal(size=(100, 10)), rng.normal(size=(10, 10))
    np.testing.assert_allclose(V.gram_times(_df(spark, A), "a", Q), A.T @ (A @ Q), rtol=1e-10, atol=1e-10)


def test_orthogonal_iteration_matches_eigh(spark):
    # the reference's own check: 100×20, k = 10, 100 iterations, vs eigh
    rng = np.random.default_rng(0)
    A = rng.normal(size=(100, 20)) * np.linspace(3, 0.1, 20)
    ev, Q = V.orthogonal_iteration(_df(spark, A), "a", k=10, iters=100)
    exact = np.sort(np.linalg.eigvalsh(A.T @ A))[::-1][:10]
    np.testing.assert_allclose(np.sort(ev)[::-1], exact, rtol=1e-4, atol=1e-4)


def test_lanczos_extremes_match_exact(spark):
    rng = np.random.default_rng(2)
    A = rng.normal(size=(200, 12))
    T = V.lanczos(_df(spark, A), "a", iters=12)
    exact = np.linalg.eigvalsh(A.T @ A / 200)
    got = np.linalg.eigvalsh(T)
    np.testing.assert_allclose([got.min(), got.max()], [exact.min(), exact.max()], rtol=1e-6)


def test_gram_matrix_and_density_normalised(spark):
    rng = np.random.default_rng(3)
    A = rng.normal(size=(50, 6))
    g = {(r["i"], r["j"]): r["value"] for r in V.gram_matrix(_df(spark, A), "a").collect()}
    M = A.T @ A / 50
    assert all(abs(g[(i, j)] - M[i, j]) < 1e-10 for i in range(6) for j in range(6))
    eigs = spark.createDataFrame([(0, float(e), 1.0 / 6) for e in np.linalg.eigvalsh(M)], "draw long, eig double, weight double")
    d = V.spectral_density(eigs, grid_len=500, sigma_squared=1e-2).collect()
    step = d[1]["x"] - d[0]["x"] if d[1]["grid_idx"] == d[0]["grid_idx"] + 1 else None
    xs = sorted((r["grid_idx"], r["x"], r["density"]) for r in d)
    step = xs[1][1] - xs[0][1]
    assert abs(sum(r[2] for r in xs) * step - 1.0) < 1e-9


def test_block_products_of_a_wide_basis(spark):
    """Two hundred columns and null vectors: no literals in the plan, the same numbers as numpy."""
    rng = np.random.default_rng(4)
    A = rng.normal(size=(70, 230))
    Q = np.linalg.qr(rng.normal(size=(230, 200)))[0]
    df = _df(spark, A).unionByName(spark.createDataFrame([(70, None)], "id long, a array<double>"))
    got = {r["id"]: r["projected"] for r in V.project(df, "a", Q, 150).collect()}
    assert got[70] is None and len(got) == 71
    np.testing.assert_allclose([got[i] for i in range(70)], A @ Q[:, :150] @ Q[:, :150].T, atol=1e-10)
    basis = spark.createDataFrame([(j, (2 * Q[:, j]).tolist()) for j in range(200)], "j int, q array<double>")
    r = V.rayleigh_df(df, "a", basis)
    assert len(r._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    np.testing.assert_allclose([x["eigenvalue"] for x in r.orderBy("j").collect()], np.square(A @ Q).sum(axis=0), rtol=1e-10)
    e = V.reconstruction_error(df, "a", Q).first()
    want = np.linalg.norm(A - A @ Q @ Q.T)
    np.testing.assert_allclose([e["abs_error"], e["rel_error"]], [want, want / np.linalg.norm(A)], rtol=1e-9)
    np.testing.assert_allclose(V.gram_times(df, "a", Q), A.T @ (A @ Q), atol=1e-9)


def test_density_adds_kernels_over_many_rows(spark):
    rng = np.random.default_rng(5)
    eig, w = rng.normal(size=3000), rng.random(3000)
    df = spark.createDataFrame([(i % 7, float(e), float(x)) for i, (e, x) in enumerate(zip(eig, w))],
                               "draw long, eig double, weight double").repartition(5)
    rows = V.spectral_density(df, grid_len=60, sigma_squared=1e-2).orderBy("grid_idx").collect()
    x = np.array([r["x"] for r in rows])
    var = 1e-2 * max(1.0, x[-1] - x[0])
    raw = (w[:, None] * np.exp(-np.square(eig[:, None] - x) / (2 * var))).sum(axis=0)
    np.testing.assert_allclose([r["density"] for r in rows], raw / (raw.sum() * (x[1] - x[0])), rtol=1e-9)
    assert V.spectral_density(df.where("eig > 99")).collect() == []
