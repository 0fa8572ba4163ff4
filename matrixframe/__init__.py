"""Distributed dense-matrix analytics on Spark DataFrames."""

from .frame import MatrixFrame

__all__ = ["MatrixFrame"]
