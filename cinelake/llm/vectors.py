"""Vectors between Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def sized(df: DataFrame, column: str, dim: int = DIM) -> DataFrame:
    """Rows whose vector has ``dim`` elements; nulls and other lengths go, in the JVM."""
    return df.filter(F.size(F.col(column)) == dim)


def matrix(values: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list array, scaled to length 1 in float32, and their row numbers.

    Usable: all elements finite (a null element is not) and not all of them zero.
    """
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():  # squares may over- or underflow although every element is finite
        with np.errstate(all="ignore"):
            flat = flat / np.abs(flat).max(axis=1, keepdims=True)
            norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return (flat[good] / norm[good, None]).astype(np.float32), good


def unit64(rows: np.ndarray) -> np.ndarray:
    """Rows in float64, scaled to length 1."""
    rows = rows.astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def raw(values: pa.Array, rows: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors at ``rows`` as they are stored."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[rows]


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
