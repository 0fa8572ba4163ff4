"""Linear algebra, solvers and clustering on ``MatrixFrame``."""
