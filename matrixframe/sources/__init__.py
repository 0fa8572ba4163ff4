"""Readers, writers and generators of matrices."""

from .readers import (
    Hdf5DataSource,
    NpyDataSource,
    parse_libsvm_line,
    read_csv,
    read_hdf5,
    read_libsvm,
    read_npy,
    read_parquet,
    repartitioned,
    write_label_pairs,
    write_parquet,
)
from .synthetic import diagonal, least_squares_pair, normal, planted_clusters, ramp, uniform

__all__ = [
    "Hdf5DataSource", "NpyDataSource", "diagonal", "least_squares_pair", "normal", "parse_libsvm_line", "planted_clusters", "ramp",
    "read_csv", "read_hdf5", "read_libsvm", "read_npy", "read_parquet", "repartitioned", "uniform", "write_label_pairs", "write_parquet",
]
