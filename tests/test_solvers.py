import numpy as np
import pytest

from matrixframe import MatrixFrame
from matrixframe.functions import kernels, losses, metrics, prep, rng
from matrixframe.functions.losses import Loss, Regularizer
from matrixframe.operators import kmeans as km
from matrixframe.operators import linalg as la
from matrixframe.operators import solvers, svd
from matrixframe.operators.admm import admm

RNG = np.random.default_rng(1)


def mat(spark, x, parts=None):
    return MatrixFrame.from_numpy(spark, x, parts)


def lowrank(m, n, sigma):
    u, v = (np.linalg.qr(RNG.normal(size=(d, len(sigma))))[0] for d in (m, n))
    return (u * sigma) @ v.T


@pytest.mark.parametrize("shape", [(40, 6), (6, 6), (5, 9), (1, 3), (4, 1)])
def test_thin_svd(spark, shape):
    x = RNG.normal(size=shape)
    u, s, v = svd.thin_svd(mat(spark, x, 3))
    un = u.to_numpy()
    k = min(shape)
    assert s.shape == (k,) and (np.diff(s) <= 1e-12).all()
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False))
    assert np.allclose((un * s) @ v.T, x)
    assert np.allclose(un.T @ un, np.eye(k)) and np.allclose(v.T @ v, np.eye(k))


@pytest.mark.parametrize("method", [0, 1, 2, None])
def test_truncated_svd(spark, method):
    x = lowrank(60, 12, np.array([9.0, 5, 5, 1]))
    u, s, v = svd.truncated_svd(mat(spark, x, 3), 3, method)
    assert np.allclose(s, [5, 5, 9])
    assert np.allclose(u.to_numpy().T @ u.to_numpy(), np.eye(3), atol=1e-6)
    _, s, v = svd.truncated_svd(mat(spark, x), 8, method, order="desc")
    assert np.allclose(s, [9, 5, 5, 1], atol=1e-6)
    assert (v[np.abs(v).argmax(axis=0), np.arange(4)] > 0).all()
    error, share = metrics.rank_k_error(mat(spark, x), v[:, :1])
    assert np.isclose(error, 51) and np.isclose(share, 51 / 132)


def test_truncated_svd_rejects_bad_options(spark):
    a = mat(spark, np.ones((3, 2)))
    for bad in (dict(k=0), dict(k=1, method=7), dict(k=1, order="up")):
        with pytest.raises(ValueError):
            svd.truncated_svd(a, **bad)
    assert len(svd.truncated_svd(a, 2)[1]) == 1


@pytest.mark.parametrize("budget", [1 << 26, 0])
def test_lsqr(spark, budget):
    a, x = RNG.normal(size=(60, 5)), RNG.normal(size=(5, 2))
    b = a @ x + 0.1 * RNG.normal(size=(60, 2))
    got = solvers.lsqr(mat(spark, a, 3), mat(spark, b, 2), triangle_bytes=budget)
    assert np.allclose(got, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-8)
    assert np.isclose(metrics.residual(mat(spark, a), got, mat(spark, b)), ((b - a @ got) ** 2).sum())


@pytest.mark.parametrize("budget", [1 << 26, 0])
def test_ridge(spark, budget):
    a, y = RNG.normal(size=(50, 6)), RNG.normal(size=(50, 3))
    want = np.linalg.solve(a.T @ a + 0.1 * 50 * np.eye(6), a.T @ y)
    assert np.allclose(solvers.ridge_cg(mat(spark, a, 3), mat(spark, y), 0.1, gram_bytes=budget), want)


def test_ridge_equals_mllib(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    a, y = RNG.normal(size=(80, 4)), RNG.normal(size=80)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(a, y, strict=True)], ["features", "label"])
    model = LinearRegression(regParam=0.05 * y.std(), elasticNetParam=0.0, fitIntercept=False, standardization=False, solver="normal").fit(df)
    assert np.allclose(solvers.ridge_cg(mat(spark, a), mat(spark, y[:, None]), 0.05)[:, 0], model.coefficients.toArray())


def test_cg_stops_and_reports():
    x, steps, done = solvers.cg(lambda v: 2 * v, np.array([[4.0, 0]]).T, 10)
    assert done and steps == 1 and np.allclose(x[:, 0], [2, 0])
    assert not solvers.cg(lambda v: np.diag([1.0, 5, 9]) @ v, np.ones((3, 1)), 1)[2]


@pytest.mark.parametrize("loss", list(Loss))
def test_prox_minimises(loss):
    v, y = RNG.normal(size=20) * 3, np.sign(RNG.normal(size=20))
    o = losses.prox_loss(loss, v, y, 0.7)
    at = lambda z: losses.loss_value(loss, z, y) + 0.35 * ((z - v) ** 2).sum()
    best = at(o)
    for _ in range(50):
        assert at(o + 0.01 * RNG.normal(size=20)) >= best - 1e-9


@pytest.mark.parametrize("reg", list(Regularizer))
def test_prox_of_regularisers_minimises(reg):
    v = RNG.normal(size=20)
    w = losses.prox_regularizer(reg, v, 0.5, 2.0)
    at = lambda z: losses.regularizer_value(reg, 0.5, z) + ((z - v) ** 2).sum()
    for _ in range(50):
        assert at(w + 0.01 * RNG.normal(size=20)) >= at(w) - 1e-9


@pytest.mark.parametrize("parts", [1, 3])
def test_admm_squared_equals_ridge(spark, parts):
    a, y = RNG.normal(size=(60, 5)), RNG.normal(size=(60, 2))
    got = admm(mat(spark, a, 2), mat(spark, y), lam=3.0, max_iters=60, tol=1e-9, feature_partitions=parts)
    assert np.allclose(got.coefficients, np.linalg.solve(a.T @ a + 3 * np.eye(5), a.T @ y), atol=1e-5)


def squared_rounds(a, y, regularizer, lam, rounds, rho):
    """ADMM of the squared loss with outputs and duals of all rows, for features of a mean square sum of 1."""
    scale = np.sqrt((a * a).sum() / a.shape[1])
    z, penalty = a / scale, lam / scale ** (2 if regularizer == Regularizer.L2 else 1)
    inverse = np.linalg.inv(np.eye(a.shape[1]) + z.T @ z)
    o, dual = np.zeros_like(y), np.zeros_like(y)
    w, w_dual = np.zeros((a.shape[1], y.shape[1])), np.zeros((a.shape[1], y.shape[1]))
    for _ in range(rounds):
        w_half = losses.prox_regularizer(regularizer, w - w_dual, penalty, rho)
        half = losses.prox_loss(Loss.SQUARED, o - dual, y, rho)
        w = inverse @ (w_half + w_dual + z.T @ (half + dual))
        o = z @ w
        w_dual, dual = w_dual + w_half - w, dual + half - o
    return w_half / scale


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("reg", list(Regularizer))
def test_admm_squared_takes_the_rounds_of_rows_but_reads_them_twice(spark, monkeypatch, reg, limit):
    from matrixframe.operators import admm as module

    rng = np.random.default_rng(8)
    a, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 2))
    if limit is not None:
        monkeypatch.setattr(module, "LOCAL_BYTES", 8 * 4 * 4 / 8)  # ZᵀZ fits, ZᵀY doesn't fit beside it
    passes = []
    whole = MatrixFrame.sum_local
    monkeypatch.setattr(MatrixFrame, "sum_local", lambda self, *args: passes.append(1) or whole(self, *args))
    got = admm(mat(spark, a, 3), mat(spark, y), loss=Loss.SQUARED, regularizer=reg, lam=2.0, max_iters=23, tol=0.0, rho=0.3)
    assert got.rounds == 23 and len(passes) == (2 if limit is None else 3)
    assert np.allclose(got.coefficients, squared_rounds(a, y, reg, 2.0, 23, 0.3), rtol=1e-9, atol=1e-12)
    short = admm(mat(spark, a, 3), mat(spark, y), loss=Loss.SQUARED, regularizer=reg, lam=2.0, max_iters=2, tol=0.0, rho=0.3)
    assert np.allclose(short.coefficients, squared_rounds(a, y, reg, 2.0, 2, 0.3), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("loss", [Loss.HINGE, Loss.LOGISTIC])
def test_admm_separates(spark, loss):
    c = RNG.integers(0, 2, 80)
    x = RNG.normal(size=(80, 3)) + 4 * (2 * c - 1)[:, None]
    got = admm(mat(spark, x, 2), mat(spark, c[:, None]), False, loss, Regularizer.L1, lam=0.5, max_iters=12)
    assert ((x @ got.coefficients[:, 0] > 0) == (c == 1)).mean() > 0.97
    multi = admm(mat(spark, x), mat(spark, np.eye(2)[c]), False, loss, max_iters=4)
    assert multi.coefficients.shape == (3, 2)


def test_admm_lad_resists_outliers(spark):
    a, w = RNG.normal(size=(100, 2)), np.array([[1.0], [-2.0]])
    y = a @ w
    y[:10] += 100
    got = admm(mat(spark, a), mat(spark, y), loss=Loss.LAD, regularizer=Regularizer.NOREG, max_iters=30, tol=1e-6)
    assert np.allclose(got.coefficients, w, atol=0.05)


def planted(n=120, k=4, d=5):
    c = np.arange(n) % k
    return np.eye(d)[c] * d + RNG.uniform(-0.5, 0.5, (n, d)), c


@pytest.mark.parametrize("init", ["k-means||", "random", "first_k"])
def test_kmeans_objective_falls(spark, init):
    x, _ = planted()
    a = mat(spark, x, 3)
    seen = [km.kmeans(a, 4, r, 0.0, init).objective for r in (1, 2, 4)]
    assert seen[0] >= seen[1] - 1e-9 >= seen[2] - 2e-9


def test_kmeans_finds_planted_clusters(spark):
    x, c = planted()
    found = km.kmeans(mat(spark, x, 3), 4)
    df = km.cluster_ids(found.assignments).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(c)], "row_id long, label int"), "row_id")
    assert np.isclose(metrics.nmi(df, "label", "cluster").first()[0], 1)
    again = km.kmeans(mat(spark, x, 5), 4)
    assert np.allclose(found.centers, again.centers)


def test_kmeans_edges(spark):
    same = mat(spark, np.ones((6, 2)))
    found = km.kmeans(same, 3)
    assert found.objective == 0 and len(found.centers) == 1
    assert km.kmeans(mat(spark, planted()[0]), 4, stop_rule="any", epsilon=1.0).iterations >= 1
    for bad in (dict(epsilon=2), dict(init="zero"), dict(stop_rule="some"), dict(k=0)):
        with pytest.raises(ValueError):
            km.kmeans(same, **({"k": 2} | bad))
    lone = km.kmeans(mat(spark, np.array([[0.0], [1], [10]])), 3, init="first_k", centers=[[0.0], [100], [200]])
    assert len(lone.centers) == 3


def test_random_numbers_match_the_published_vectors():
    g, d, i = rng.Lcg48(1234), rng.Lcg48(4321), rng.Lcg48(1234)
    assert [g.gaussian() for _ in range(3)] == [0.14115907833078006, 0.4346588858045114, 1.1384720144986948]
    assert [d.double() for _ in range(3)] == [0.10066994332491097, 0.5308129860312976, 0.019958976169217935]
    assert [i.integer(7) for _ in range(4)] == [1, 2, 2, 4]


def test_normal_quantile_and_halton():
    assert np.allclose(rng.normal_quantile(np.array([0.5, 0.975, 0.001])), [0, 1.959963985, -3.090232306])
    p = rng.halton(500, 3)
    assert ((p > 0) & (p < 1)).all() and np.allclose(p.mean(axis=0), 0.5, atol=0.02)


def kernel_matrix(z):
    return z @ z.T


def test_feature_maps_approach_their_kernels(spark):
    x = RNG.uniform(0, 1, (8, 3))
    a = mat(spark, x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d1 = np.abs(x[:, None] - x[None]).sum(axis=2)
    checks = [
        (kernels.rbf_features(a, 4000, 0.8), np.exp(-d2 / (2 * 0.64)), 0.08),
        (kernels.gaussian_features(a, 4000, 0.8), np.exp(-d2 / (2 * 0.64)), 0.06),
        (kernels.laplacian_features(a, 6000, 1.0), np.exp(-d1), 0.1),
        (kernels.semigroup_features(a, 6000, 0.3), np.exp(-0.3 * np.sqrt(x[:, None] + x[None]).sum(axis=2)), 0.1),
        (kernels.polynomial_features(a, 4000, 2, 1.0, 1.0), (x @ x.T + 1) ** 2, 1.0),
        (kernels.matern_features(a, 6000, 0.5, 1.0), np.exp(-np.sqrt(d2)), 0.1),
    ]
    for z, want, tol in checks:
        assert np.abs(kernel_matrix(z.to_numpy()) - want).max() < tol


def test_count_sketch_keeps_inner_products_on_average(spark):
    x = np.eye(6)[:2] * 3
    z = kernels.count_sketch(mat(spark, x), 64).to_numpy()
    assert np.allclose(np.diag(z @ z.T), 9)


def test_sigma_is_the_root_of_the_mean_squared_distance(spark):
    x = RNG.normal(size=(30, 4))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.isclose(kernels.estimate_sigma(mat(spark, x, 3)), np.sqrt(d2.mean()))
    assert np.isclose(kernels.estimate_sigma(mat(spark, x, 3), 10), np.sqrt(d2[:10, :10].mean()))


def test_sigma_covers_rows_after_the_500th(spark, tmp_path):
    from matrixframe import queries

    x = np.concatenate([RNG.normal(size=(500, 64)), RNG.normal(size=(200, 64)) + 5])
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2).mean())
    assert np.isclose(kernels.estimate_sigma(mat(spark, x, 3)), want)
    spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert np.isclose(queries.sigma_estimate(spark, str(tmp_path)).first()["sigma"], want, atol=1e-6)


def test_targets_refuse_more_classes_than_the_bound(spark, monkeypatch):
    from matrixframe.operators import admm as module

    y = mat(spark, np.arange(6.0)[:, None])
    assert module.targets(y, False).n_cols == 6
    monkeypatch.setattr(module, "MOST_CLASSES", 5, raising=False)
    with pytest.raises(ValueError, match="more than 5 classes"):
        module.targets(y, False)


def test_hinge_query_runs_the_operators_default_rounds(spark, tmp_path, monkeypatch):
    from matrixframe import queries
    from matrixframe.operators import admm as module

    seen = []
    monkeypatch.setattr(queries.admm_, "admm", lambda *a, **k: seen.append(k) or module.AdmmResult(np.ones((64, 1)), 0, 0, 0, 0))
    spark.createDataFrame([(i, [1.0] * 64, i % 2) for i in range(4)], "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries.admm_hinge_l1(spark, str(tmp_path))
    assert "max_iters" not in seen[0]


def test_row_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.range(97).select((F.lit(1000) - F.col("id")).alias("v")).repartition(5)
    got = sorted((r["v"], r["row_id"]) for r in prep.index_rows(df, ["v"]).collect())
    assert [i for _, i in got] == list(range(97))
    a, b = ({r["v"]: r["row_id"] for r in prep.permute_rows(d, 4).collect()} for d in (df, df.repartition(2)))
    assert a == b and sorted(a.values()) == list(range(97)) and [a[v] for v, _ in got] != list(range(97))


def test_max_abs_normalise_guards_zero_columns(spark):
    df = spark.createDataFrame([(1.0, [0.0, -4.0]), (3.0, [0.0, 2.0])], "label double, features array<double>")
    assert sorted((r[0], r[1]) for r in prep.max_abs_normalize(df).collect()) == [(-1.0, [0.0, -1.0]), (1.0, [0.0, 0.5])]


def test_nmi_of_constant_labels(spark):
    df = spark.createDataFrame([(1, 2)] * 3, "a int, b int")
    assert metrics.nmi(df, "a", "b").first()[0] == 1.0


def test_column_functions(spark):
    x, y = RNG.normal(size=(9, 3)), RNG.normal(size=(9, 3))
    dots = {r[0]: r[1] for r in la.column_dots(mat(spark, x), mat(spark, y)).collect()}
    norms = {r[0]: r[1] for r in la.column_norms(mat(spark, x)).collect()}
    assert np.allclose([dots[j] for j in range(3)], (x * y).sum(axis=0))
    assert np.allclose([norms[j] for j in range(3)], np.linalg.norm(x, axis=0))
