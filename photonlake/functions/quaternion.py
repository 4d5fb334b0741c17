"""Quaternion formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate(v: tuple[Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """v turned by the unit quaternion (w, x, y, z): v + 2 w (u x v) + 2 u x (u x v)."""
    w, x, y, z = q
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    one = cross((x, y, z), v)
    two = cross((x, y, z), one)
    return tuple(v[k] + 2 * w * one[k] + 2 * two[k] for k in range(3))


def down(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The second row of the rotation matrix of a quaternion: the world's y axis in the body."""
    return 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)


def euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """roll, pitch and yaw, aviation signs, of a body whose axes point left, down and back."""
    a, b, c = down(w, x, y, z)
    return F.atan2(-a, b), F.atan2(c, F.sqrt(a * a + b * b)), F.atan2(2 * (w * y - x * z), 1 - 2 * (x * x + y * y))
