"""3x3 / 4x4 algebra: driver-side for constants, column expressions for tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def rot_z(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]])


def rot_x(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[1.0, 0.0, 0.0], [0.0, c, -s], [0.0, s, c]])


def rot_y(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, 0.0, s], [0.0, 1.0, 0.0], [-s, 0.0, c]])


def euler_zyx(rx_deg: float, ry_deg: float, rz_deg: float) -> np.ndarray:
    """Rotation about x, then y, then z, angles in degrees."""
    return rot_z(np.radians(rz_deg)) @ rot_y(np.radians(ry_deg)) @ rot_x(np.radians(rx_deg))


def split4(matrix: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """4x4 -> (3x3 part, translation)."""
    m = np.asarray(matrix, float)
    return m[:3, :3], m[:3, 3]


def join4(a: Matrix, b: Sequence[float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = np.asarray(a, float)
    out[:3, 3] = np.asarray(b, float)
    return out


def invert(a: Matrix, b: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The affine map that undoes p -> a p + b."""
    inv = np.linalg.inv(np.asarray(a, float))
    return inv, -inv @ np.asarray(b, float)


def rotation_angle_deg(r: Matrix) -> float:
    return float(np.degrees(np.arccos(np.clip((np.trace(np.asarray(r, float)) - 1.0) / 2.0, -1.0, 1.0))))


def linear_row(row: Sequence[float], x: Column, y: Column, z: Column, offset: float = 0.0) -> Column:
    """row . (x, y, z) + offset with literal coefficients."""
    return F.lit(float(row[0])) * x + F.lit(float(row[1])) * y + F.lit(float(row[2])) * z + F.lit(float(offset))


def map_point(a: Matrix, b: Sequence[float], x: Column, y: Column, z: Column) -> list[Column]:
    """The three columns of a p + b for a literal transform."""
    return [linear_row(a[i], x, y, z, b[i]) for i in range(3)]


def map_point_cols(a: Column, b: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The three columns of a p + b where a (9, row-major) and b (3) are array columns."""
    return [a[3 * i] * x + a[3 * i + 1] * y + a[3 * i + 2] * z + b[i] for i in range(3)]


def matmul_cols(left: Column, right: Column) -> Column:
    """3x3 product of two row-major ARRAY<DOUBLE>(9) columns."""
    return F.array(
        *[sum((left[3 * i + k] * right[3 * k + j] for k in range(1, 3)), left[3 * i] * right[j])
          for i in range(3) for j in range(3)]
    )


def matvec_cols(a: Column, v: Column) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def transpose_cols(a: Column) -> Column:
    return F.array(*[a[3 * j + i] for i in range(3) for j in range(3)])


def xyz(df: DataFrame) -> tuple[Column, Column, Column]:
    return df["x"], df["y"], df["z"]
