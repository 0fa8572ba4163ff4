import numpy as np
import pytest

from matrixframe import MatrixFrame
from matrixframe import sources as src


def test_libsvm(spark, tmp_path):
    (tmp_path / "d.svm").write_text("3 1:0.5 3:2\n1 2:-1\n")
    got = src.read_libsvm(spark, str(tmp_path / "d.svm"), 4).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, [0, -1, 0, 0]), (3, [0.5, 0, 2, 0])]
    lines = spark.createDataFrame([("3 0:0.5 2:2",), ("1",)], ["line"])
    got = lines.select(src.parse_libsvm_line(lines.line, 3).alias("p")).select("p.*").collect()
    assert [(r[0], r[1]) for r in got] == [(3, [0.5, 0, 2]), (1, [0, 0, 0])]


def test_csv_labels_count_from_one(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1,0.5,2\n7,-1,3e2\n")
    got = src.read_csv(spark, str(tmp_path / "d.csv"), 2).collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, [0.5, 2]), (6, [-1, 300])]


def test_parquet_round_trip(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    src.write_parquet(MatrixFrame.from_numpy(spark, x, 2), str(tmp_path / "p"))
    assert np.array_equal(src.read_parquet(spark, str(tmp_path / "p")).to_numpy(), x)


def test_label_pairs(spark, tmp_path):
    src.write_label_pairs(spark.createDataFrame([(1, 2), (3, 4)], ["label", "cluster"]).coalesce(1), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1 2", "3 4"]


@pytest.mark.parametrize("replicas", [1, 2])
def test_npy_ranges_cover_every_row_in_order(spark, tmp_path, replicas):
    x = np.random.default_rng(0).normal(size=(101, 3))
    np.save(tmp_path / "x.npy", x)
    a = src.read_npy(spark, str(tmp_path / "x.npy"), replicas, taskbytes=24 * 10)
    assert a.df.rdd.getNumPartitions() == 11
    assert np.array_equal(a.to_numpy(), np.hstack([x] * replicas))


def test_npy_rejects_vectors(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.zeros(3))
    with pytest.raises(Exception, match="rank 1"):
        src.read_npy(spark, str(tmp_path / "v.npy")).dims()


def test_hdf5(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    x = np.arange(20.0).reshape(10, 2)
    with h5py.File(tmp_path / "x.h5", "w") as f:
        f["rows"] = x
    assert np.array_equal(src.read_hdf5(spark, str(tmp_path / "x.h5"), "rows", 2).to_numpy(), np.hstack([x, x]))


def test_generators_do_not_depend_on_partitions(spark):
    for make in (src.uniform, src.normal, src.diagonal, src.ramp):
        a, b = make(spark, 20, 3, partitions=1).to_numpy(), make(spark, 20, 3, partitions=7).to_numpy()
        assert a.shape == (20, 3) and np.array_equal(a, b)
    z = src.normal(spark, 4000, 2).to_numpy()
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05
    u = src.uniform(spark, 2000, 2, low=-1, high=1).to_numpy()
    assert u.min() >= -1 and u.max() < 1 and abs(u.mean()) < 0.05
    assert np.array_equal(src.diagonal(spark, 2, 3, 2.0).to_numpy(), [[2, 0, 0], [0, 4, 0]])
    assert np.array_equal(src.ramp(spark, 2, 2).to_numpy(), [[1, 1], [2, 2]])


def test_planted_clusters_and_least_squares(spark):
    p = src.planted_clusters(spark, 60, 5, 3, 0.5).to_numpy()
    assert (p[:, :5].argmax(axis=1) == p[:, 5]).all() and set(p[:, 5]) == {0, 1, 2}
    with pytest.raises(ValueError):
        src.planted_clusters(spark, 5, 2, 3, 0.1)
    a, x, b = src.least_squares_pair(spark, 30, 4, 2)
    assert np.allclose(b.to_numpy(), a.to_numpy() @ x)
    noisy = src.least_squares_pair(spark, 30, 4, 2, noise=0.1)[2].to_numpy()
    assert 0 < np.abs(noisy - b.to_numpy()).max() < 1


def test_repartitioned(spark):
    df = spark.range(10).repartition(4)
    assert src.repartitioned(df, 2, shuffle=False).rdd.getNumPartitions() == 2
    assert src.repartitioned(df, 6).rdd.getNumPartitions() == 6
