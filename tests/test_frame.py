import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matrixframe import MatrixFrame
from matrixframe.operators import linalg as la
from matrixframe.plans import expr, physical, registry

RNG = np.random.default_rng(0)


def mat(spark, x, parts=None):
    return MatrixFrame.from_numpy(spark, x, parts)


@pytest.fixture(scope="module")
def pair(spark):
    a, b = RNG.normal(size=(50, 7)), RNG.normal(size=(7, 5))
    return a, b, mat(spark, a, 3), mat(spark, b)


@pytest.mark.parametrize("strategy", [None, "broadcast", "panels", "blocks", "coo"])
def test_matmul_strategies_agree(pair, strategy):
    a, b, am, bm = pair
    assert np.allclose(la.matmul(am, bm, strategy).to_numpy(), a @ b)


def test_small_blocks_and_panels(pair):
    a, b, am, bm = pair
    assert np.allclose(physical._panel_product(am, bm, 2 * 8 * 7).to_numpy(), a @ b)
    assert np.allclose(physical._block_product(am, bm, 3).to_numpy(), a @ b)


def test_expressions(spark, pair):
    a, b, am, bm = pair
    c = RNG.normal(size=(50, 3))
    cm = mat(spark, c)
    assert np.allclose((am.T @ am).to_numpy(), a.T @ a)
    assert np.allclose(((am @ bm).T @ cm).to_numpy(), (a @ b).T @ c)
    assert np.allclose(am.T.T.to_numpy(), a)
    assert np.allclose((am @ bm).T.to_numpy(), (a @ b).T)
    assert np.allclose((bm.T @ am.T).to_numpy(), b.T @ a.T)


def test_gram_never_turns_the_tall_side(pair, monkeypatch):
    monkeypatch.setattr(physical, "transposed", lambda a: pytest.fail("a transpose was made"))
    _, _, am, _ = pair
    (am.T @ am).frame()


def test_chain_order():
    assert expr.chain_order([(10, 1000), (1000, 1000), (1000, 1)]) == (0, (1, 2))
    assert expr.chain_order([(1, 1000), (1000, 1000), (1000, 10)]) == ((0, 1), 2)


def test_shapes_are_checked(pair):
    _, _, am, bm = pair
    with pytest.raises(ValueError, match="multiplied"):
        bm @ am
    with pytest.raises(ValueError, match="differ"):
        la.hadamard(am, bm)
    with pytest.raises(ValueError, match="strategy"):
        la.matmul(am, bm, "magic")


def test_elementwise(spark, pair):
    a, _, am, _ = pair
    b = RNG.normal(size=a.shape)
    bm = mat(spark, b)
    u = RNG.normal(size=(50, 1))
    v = np.arange(7.0)
    assert np.allclose(la.hadamard(am, bm).to_numpy(), a * b)
    assert np.allclose(la.axpy(-2, am, bm).to_numpy(), b - 2 * a)
    assert np.allclose(la.scale_columns(am, v).to_numpy(), a * v)
    assert np.allclose(la.scale_rows(am, mat(spark, u)).to_numpy(), a * u)
    assert np.allclose(la.rank_one_update(am, 3, mat(spark, u), v).to_numpy(), a + 3 * u * v)
    assert np.allclose(la.replicate_columns(am, 2).to_numpy(), np.hstack([a, a]))
    assert np.allclose(la.matvec(am, v).to_numpy()[:, 0], a @ v)
    assert np.allclose(la.atax(am, v), a.T @ (a @ v))
    assert np.isclose(la.frobenius_norm(am), np.linalg.norm(a))


def test_normalize_leaves_constant_columns(spark):
    x = np.column_stack([np.full(6, 1e8) + np.arange(6), np.full(6, 3.0), RNG.normal(size=6)])
    out = la.normalize_columns(mat(spark, x, 2)).to_numpy()
    assert np.allclose(out.mean(axis=0), 0, atol=1e-6)
    assert np.allclose(out.std(axis=0), [1, 0, 1])


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (5, 1), (3, 3)])
def test_edge_shapes(spark, shape):
    x = RNG.normal(size=shape)
    m = mat(spark, x, 4)
    assert m.dims() == shape
    assert np.allclose(la.transpose(m).to_numpy(), x.T)
    assert np.allclose(la.gram(m).to_numpy(), x.T @ x)
    assert np.allclose(physical.from_blocks(physical.to_blocks(m, 2), *shape, 2).to_numpy(), x)


def test_empty_matrix(spark):
    m = mat(spark, np.zeros((0, 3)))
    assert m.dims() == (0, 3)
    assert la.frobenius_norm(m) == 0


@pytest.mark.parametrize("ids", [[0, 2], [0, 0], [1, 2], [-1, 0]])
def test_row_ids_are_checked(spark, ids):
    df = spark.createDataFrame([(i, [1.0]) for i in ids], "row_id long, features array<double>")
    with pytest.raises(ValueError, match="row ids"):
        MatrixFrame.from_df(df)
    MatrixFrame.from_df(df, check=False)


def test_ragged_and_null_rows_are_rejected(spark):
    for rows in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0, None])], [(0, None)]):
        with pytest.raises(ValueError, match="one length"):
            MatrixFrame.from_df(spark.createDataFrame(rows, "row_id long, features array<double>"))


def test_constructors_agree(spark):
    from pyspark.ml.linalg import Vectors

    x = np.array([[1.0, 0, 2], [0, 0, 3]])
    vectors = spark.createDataFrame([(0, Vectors.sparse(3, {0: 1.0, 2: 2.0})), (1, Vectors.dense([0, 0, 3]))], ["id", "v"])
    columns = spark.createDataFrame([(0, 1, 0, 2), (1, 0, 0, 3)], ["id", "a", "b", "c"])
    coo = spark.createDataFrame([(0, 0, 1.0), (0, 2, 1.5), (0, 2, 0.5), (1, 2, 3.0)], "row_id long, col_id long, value double")
    for m in (MatrixFrame.from_df(vectors, "id", "v"), MatrixFrame.from_df(columns, "id", ["a", "b", "c"]), MatrixFrame.from_coo(coo, 2, 3)):
        assert np.array_equal(m.to_numpy(), x)
    back = MatrixFrame.from_indexed_row_matrix(mat(spark, x).to_indexed_row_matrix())
    assert np.array_equal(back.to_numpy(), x)


def test_long_transposes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(physical, "LONGEST_ROW", 3)
    with pytest.raises(ValueError, match="coo"):
        physical.transposed(mat(spark, np.zeros((4, 2))))


def test_pretty_shows_a_corner(spark):
    x = np.array([[1.5, -2.0, 1e-11], [0.25, 3.0, 4.0]])
    assert mat(spark, x).pretty().split() == ["1.5", "0", "0", "0.25", "3", "4"]
    assert mat(spark, x).pretty(1, 2).splitlines()[1] == "... 2 x 3"


def test_local_limits(spark):
    with pytest.raises(ValueError, match="gathered"):
        mat(spark, np.zeros((4, 2))).local(8)


def test_registry(spark):
    @registry.operator("twice")
    def twice(a):
        return la.scale_columns(a, np.full(a.n_cols, 2.0))

    assert np.allclose(registry.apply("twice", mat(spark, np.ones((2, 2)))).to_numpy(), 2)
    assert {"gram", "transpose", "rbf_features", "nearest_center"} <= set(registry.names())
    assert np.allclose(registry.apply("gram", mat(spark, np.ones((2, 2)))).to_numpy(), 2)
    with pytest.raises(KeyError):
        registry.apply("thrice", None)
    with pytest.raises(ValueError):
        registry.operator("twice")(twice)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 9), m=st.integers(1, 6), parts=st.integers(1, 5), seed=st.integers(0, 99))
def test_results_do_not_depend_on_partitions(spark, n, m, parts, seed):
    x = np.random.default_rng(seed).normal(size=(n, m))
    assert np.allclose(la.gram(mat(spark, x, parts)).to_numpy(), x.T @ x)
    r = physical.tsqr(mat(spark, x, parts), fan=2)
    assert np.allclose(r.T @ r, x.T @ x)
