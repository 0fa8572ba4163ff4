"""How sums, joins and products are planned: what meets in one task, and that no way of planning changes a result."""

import logging
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixframe import MatrixFrame, frame
from matrixframe import sources as src
from matrixframe.functions import kernels, prep
from matrixframe.functions.losses import Loss, Regularizer
from matrixframe.operators import admm, kmeans, linalg, solvers, svd
from matrixframe.plans import physical


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(600, 7))


def test_sums_of_many_partitions_merge_a_few_at_a_time(spark, x, monkeypatch):
    """500 tasks: no group of panels that meet in a task has more than FAN of them."""
    monkeypatch.setattr(frame, "PANEL_CELLS", 14)
    a = MatrixFrame.from_numpy(spark, x, 500)
    parts, left, step = a._partial_sums(lambda ids, z: z.T @ z, (7, 7))
    assert frame.partitions_of(a.df) == 500 and left <= frame.FAN and step == 2
    groups = parts.groupBy("panel").count().collect()
    assert len(groups) == 4 and max(r["count"] for r in groups) <= frame.FAN
    want = x.T @ x
    assert np.allclose(a.sum_blocks(lambda ids, z: z.T @ z, (7, 7)).to_numpy(), want)
    assert np.allclose(a.sum_local(lambda ids, z: z.T @ z, (7, 7)), want)
    monkeypatch.setattr(frame, "LOCAL_BYTES", 100)
    assert np.allclose(a.sum_local(lambda ids, z: z.T @ z, (7, 7)), want)


def test_sums_of_no_rows(spark):
    a = MatrixFrame.from_numpy(spark, np.zeros((0, 3)))
    assert np.array_equal(a.sum_local(lambda ids, z: z.sum(axis=0)[None], (1, 3)), np.zeros((1, 3)))


def test_wide_gram_goes_by_panels(spark, x, monkeypatch):
    monkeypatch.setattr(physical, "LOCAL_BYTES", 8 * 7 * 3)
    assert np.allclose(physical.gram(MatrixFrame.from_numpy(spark, x, 3)).to_numpy(), x.T @ x)


def test_inner_blocks_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(physical, "FAN", 2)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 23)), rng.normal(size=(23, 5))
    got = physical._block_product(MatrixFrame.from_numpy(spark, a, 2), MatrixFrame.from_numpy(spark, b, 3), 3)
    assert np.allclose(got.to_numpy(), a @ b)


def exchanged_widths(df, spark):
    """Columns of features that go through exchanges, from the plan's own text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_targets_join_the_narrow_rows(spark, x):
    """A feature map comes after the join, so what is shuffled has the raw width."""
    a, y = MatrixFrame.from_numpy(spark, x), MatrixFrame.from_numpy(spark, x[:, :1])
    z = kernels.rbf_features(a, 500, 1.0)
    both, split = z.paired(y)
    assert both.n_cols == 8
    ids, rows = frame.block_of(both.df.orderBy("row_id").toArrow().to_batches()[0])
    left, right = split(ids, rows)
    assert left.shape[1] == 500 and np.array_equal(right[:, 0], x[: len(ids), 0])
    wide = z.beside(y)
    plan = exchanged_widths(wide.df, spark)
    assert plan.index("MapInArrow") < plan.index("Join")  # the map is above the join
    assert np.allclose(wide.to_numpy(), np.column_stack([z.to_numpy(), x[:, :1]]))
    kept = kernels.rbf_features(a, 500, 1.0).persist()
    assert kept.paired(y)[0].n_cols == 501
    kept.unpersist()


def test_expressions_over_one_frame_stand_side_by_side_without_a_join(spark, x):
    a = MatrixFrame.from_numpy(spark, x, 3)
    head = a.map_rows(F.slice("features", 1, 3), 3)
    doubled = head.map_rows(F.transform("features", lambda v: 2 * v), 3)
    ones = a.map_rows(F.array(F.lit(1)), 1)
    for left, right, want in (
        (doubled, ones, [2 * x[:, :3], np.ones((600, 1))]), (ones, doubled, [np.ones((600, 1)), 2 * x[:, :3]]), (a, head, [x, x[:, :3]]),
        (doubled, head, [2 * x[:, :3], x[:, :3]]), (kernels.rbf_features(head, 20, 1.0), ones, [kernels.rbf_features(head, 20, 1.0).to_numpy(), np.ones((600, 1))]),
    ):
        both = left.beside(right)
        assert "Join" not in exchanged_widths(both.df, spark)
        assert np.array_equal(both.to_numpy(), np.column_stack(want))
    other = MatrixFrame.from_numpy(spark, x, 2).map_rows(F.slice("features", 1, 1), 1)
    assert "Join" in exchanged_widths(head.beside(other).df, spark)
    kept = a.map_rows(F.slice("features", 1, 2), 2).persist()
    assert kept.origin is None and np.array_equal(kept.beside(ones).to_numpy(), np.column_stack([x[:, :2], np.ones(600)]))
    kept.unpersist()


def joins_of_passes(monkeypatch, spark):
    """A list that gets, for each later sum over rows, whether its plan joins."""
    found, whole = [], MatrixFrame.sum_local
    monkeypatch.setattr(MatrixFrame, "sum_local", lambda self, *args: found.append("Join" in exchanged_widths(self.df, spark)) or whole(self, *args))
    return found


@pytest.mark.parametrize("name", ["admm_squared_l1", "admm_squared_l2"])
def test_squared_queries_join_no_rows(spark, tmp_path, monkeypatch, name):
    from matrixframe import queries

    rng = np.random.default_rng(12)
    q, p, d = rng.integers(1, 51, 400), rng.uniform(900, 100000, 400), rng.integers(0, 11, 400) / 100
    rows = [(float(a), float(b), float(c), 0.01) for a, b, c in zip(q, p, d, strict=True)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_tax double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    joins = joins_of_passes(monkeypatch, spark)
    got = queries.QUERIES[name](spark, str(tmp_path)).first()
    z, y = np.column_stack([q / 50, d * 10]), p / 100000
    if name == "admm_squared_l1":
        assert got["w"] == pytest.approx((z[:, 0] @ y - 0.05 * 400) / (z[:, 0] @ z[:, 0]), abs=2e-6)
    else:
        assert np.allclose([got["w1"], got["w2"]], np.linalg.solve(z.T @ z + 4 * np.eye(2), z.T @ y), atol=2e-6)
    assert joins == [False, False]


def test_rounds_over_rows_join_them_once(spark, x, monkeypatch):
    y = np.sign(x[:, :1])
    joins = joins_of_passes(monkeypatch, spark)
    found = admm.admm(MatrixFrame.from_numpy(spark, x, 2), MatrixFrame.from_numpy(spark, y, 3), True, Loss.HINGE, Regularizer.L1, lam=1.0, max_iters=3)
    assert len(joins) == found.rounds + 2 and not any(joins)


def test_kernel_ridge_equals_the_closed_form(spark, x):
    a = MatrixFrame.from_numpy(spark, x, 3)
    y = np.eye(3)[np.arange(600) % 3]
    z = kernels.rbf_features(a, 40, 2.0)
    zn = z.to_numpy()
    want = np.linalg.solve(zn.T @ zn + 600 * 1e-2 * np.eye(40), zn.T @ y)
    for limit in (frame.LOCAL_BYTES, 0):
        got = solvers.ridge_cg(z, MatrixFrame.from_numpy(spark, y), 1e-2, gram_bytes=limit)
        assert np.allclose(got, want, atol=1e-6)


def test_lsqr_by_rows_takes_all_sides_and_its_limit(spark, x, monkeypatch):
    monkeypatch.setattr(solvers, "REPLAY", 3)
    rng = np.random.default_rng(2)
    b = np.column_stack([x @ rng.normal(size=7), rng.normal(size=600), np.zeros(600)])
    a, frame_b = MatrixFrame.from_numpy(spark, x, 3), MatrixFrame.from_numpy(spark, b, 2)
    want = np.linalg.lstsq(x, b, rcond=None)[0]
    assert np.allclose(solvers.lsqr(a, frame_b, triangle_bytes=0), want, atol=1e-9)
    passes = []
    whole = MatrixFrame.sum_local
    monkeypatch.setattr(MatrixFrame, "sum_local", lambda self, *args: passes.append(1) or whole(self, *args))
    short = solvers.lsqr(a, frame_b, max_iters=2, triangle_bytes=0)
    assert len(passes) == 3 and not np.allclose(short, want)
    assert np.allclose(short, solvers.lsqr_steps(solvers.LocalSides(x, b), 1e-14, 2))


def test_lsqr_stays_exact_where_normal_equations_lose_digits(spark):
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(200, 5)))[0], np.linalg.qr(rng.normal(size=(5, 5)))[0]
    a = u * np.geomspace(1, 1e-6, 5) @ v.T
    x = rng.normal(size=(5, 1))
    got = solvers.lsqr(MatrixFrame.from_numpy(spark, a, 2), MatrixFrame.from_numpy(spark, a @ x), triangle_bytes=0, max_iters=60)
    assert np.allclose(got, x, rtol=1e-6)


#: Signs that the seeded generator gives for 10 columns after their 10 buckets of 16.
SIGNS = [-1, -1, -1, -1, 1, -1, 1, -1, -1, -1]


def test_count_sketch_draws():
    bucket, sign = kernels.count_sketch_table(10, 16, 1234)
    assert sign.tolist() == SIGNS and set(bucket) <= set(range(16))


def test_sketches_equal_products(x):
    rng = np.random.default_rng(4)
    bucket, sign = rng.integers(0, 5, 7), rng.choice([-1.0, 1.0], 7)
    s = np.zeros((7, 5))
    s[np.arange(7), bucket] = sign
    assert np.allclose(kernels.sketched(x, bucket, sign, 5), x @ s)


def test_nearest_equals_differences_on_ties_and_far_points():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(50, 4)), 1e8 + rng.normal(size=(50, 4)), np.zeros((3, 4))])
    c = np.concatenate([x[:5], x[50:55], x[:2], x[52:53]])
    d = kmeans.squared_distances(x, c)
    got, d2 = kmeans.nearest(x, c)
    assert np.array_equal(got, d.argmin(axis=1)) and np.array_equal(d2, d.min(axis=1))


def test_kmeans_leaves_the_callers_cache(spark, x):
    a = MatrixFrame.from_numpy(spark, x, 2).persist()
    kmeans.kmeans(a, 3, 4)
    assert a.df.storageLevel.useMemory
    a.unpersist()
    kmeans.kmeans(a, 3, 4)
    assert not a.df.storageLevel.useMemory


def test_lanczos_tells_when_it_has_not_converged():
    d = 1 + np.linspace(0, 1e-3, 400)
    with pytest.raises(RuntimeError, match="Lanczos"):
        svd.lanczos(lambda v: d * v, 400, 5, most=8)


def test_truncated_svd_finds_the_top_of_a_wide_spectrum(spark, x):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(150, 30))
    u, s, v = svd.truncated_svd(MatrixFrame.from_numpy(spark, a, 3), 6, method=0)
    true_u, true_s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s[::-1], true_s[:6])
    assert np.allclose(a @ v, u.to_numpy() * s) and np.allclose(np.abs(np.sum(u.to_numpy()[:, ::-1] * true_u[:, :6], axis=0)), 1)


def test_decompositions_agree_with_mllib(spark, x):
    a = MatrixFrame.from_numpy(spark, x, 2)
    theirs = a.to_indexed_row_matrix().computeSVD(3)
    assert np.allclose(sorted(theirs.s.toArray()), svd.truncated_svd(a, 3)[1])
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    planted = src.planted_clusters(spark, 300, 6, 4, 0.3)
    rows = MatrixFrame(planted.df.select("row_id", F.slice("features", 1, 6).alias("features")), 300, 6)
    model = KMeans(k=4, seed=1, maxIter=30).fit(rows.df.select(array_to_vector("features").alias("features")))
    ours = kmeans.kmeans(rows, 4, 30)
    assert ours.objective == pytest.approx(model.summary.trainingCost)
    true = planted.df.select("row_id", F.element_at("features", 7).cast("int").alias("c"))
    pairs = kmeans.cluster_ids(ours.assignments).join(true, "row_id").select("cluster", "c").distinct()
    assert pairs.count() == 4


@pytest.mark.parametrize("loss", list(Loss))
def test_admm_reaches_the_optimum_of_each_loss(spark, loss):
    """No direction from the solution lowers the objective by more than half a hundredth."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(80, 3))
    y = np.sign(a @ [1.0, -1.0, 0.3] + 0.8 * rng.normal(size=80)) if loss in (Loss.HINGE, Loss.LOGISTIC) else a @ [1.0, -1.0, 0.3] + rng.normal(size=80)
    found = admm.admm(
        MatrixFrame.from_numpy(spark, a, 2), MatrixFrame.from_numpy(spark, y[:, None]), True, loss, Regularizer.L1, lam=2.0, max_iters=80, tol=1e-8
    )
    from matrixframe.functions.losses import loss_value, regularizer_value

    value = lambda w: loss_value(loss, a @ w, y[:, None]) + regularizer_value(Regularizer.L1, 2.0, w)
    best = value(found.coefficients)
    assert best == pytest.approx(found.objective)
    for _ in range(200):
        assert value(found.coefficients + rng.normal(size=(3, 1)) * 10.0 ** rng.uniform(-4, 0)) >= 0.995 * best


def test_hdf5_through_a_module_that_acts_as_one(spark, tmp_path, monkeypatch):
    """The reader against a stand-in for h5py, on the driver and in Python workers."""
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "h5py.py").write_text(
        "import numpy as np\n"
        "class File:\n"
        "    def __init__(self, path, mode):\n"
        "        assert mode == 'r'\n"
        "        self.sets = dict(np.load(path))\n"
        "    def __enter__(self):\n        return self\n"
        "    def __exit__(self, *rest):\n        pass\n"
        "    def __getitem__(self, name):\n        return self.sets[name]\n"
    )
    x = np.arange(22.0).reshape(11, 2)
    with open(tmp_path / "x.h5", "wb") as f:
        np.savez(f, rows=x, flat=np.zeros(3))
    if "h5py" not in sys.modules:
        spark.sparkContext.addPyFile(str(tmp_path / "lib" / "h5py.py"))
        monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    a = src.read_hdf5(spark, str(tmp_path / "x.h5"), "rows", 2, taskbytes=48)
    assert np.array_equal(a.to_numpy(), np.hstack([x, x]))
    with pytest.raises(Exception, match="rank 1"):
        src.read_hdf5(spark, str(tmp_path / "x.h5"), "flat").dims()


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda name: None)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        frame.shared_folder(types.SimpleNamespace(sparkContext=context))


def test_loops_log_their_progress(spark, x, caplog):
    with caplog.at_level(logging.DEBUG, logger="matrixframe"):
        kmeans.kmeans(MatrixFrame.from_numpy(spark, x, 2), 2, 3)
        solvers.cg(lambda v: 2 * v, np.ones((3, 1)), 5)
    said = caplog.text
    assert "k-means round 1" in said and "cg step 1" in said and "converged" in said


def test_literal_columns_are_one_expression(spark, x):
    a = MatrixFrame.from_numpy(spark, x)
    assert np.allclose(linalg.scale_columns(a, np.arange(7)).to_numpy(), x * np.arange(7))
    u = MatrixFrame.from_numpy(spark, x[:, :1])
    assert np.allclose(linalg.rank_one_update(a, 2.0, u, np.arange(7)).to_numpy(), x + 2 * np.outer(x[:, 0], np.arange(7)))
    df = a.df.withColumn("label", F.col("row_id").cast("double"))
    got = prep.max_abs_normalize(df).orderBy("row_id").toArrow().to_pylist()
    assert np.allclose([r["features"] for r in got], x / np.abs(x).max(axis=0)) and np.isclose(sum(r["label"] for r in got), 0)
