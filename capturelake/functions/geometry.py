"""Planar geometry: homographies as arrays of nine (row by row, last 1), polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

FLAT = 1e-12
SINGULAR = 1e-14


def _normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    centre = points.mean(0)
    away = np.hypot(*(points - centre).T).mean()
    if away < FLAT:
        return None
    s = np.sqrt(2) / away
    t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
    return (points - centre) * s, t


def fit_one(source: np.ndarray, target: np.ndarray) -> list[float] | None:
    """Homography of at least four pairs, least squares for more; None if they are degenerate."""
    if len(source) < 4 or not (np.isfinite(source).all() and np.isfinite(target).all()):
        return None
    a, b = _normal(source), _normal(target)
    if a is None or b is None:
        return None
    (p, tp), (q, tq) = a, b
    x, y, u, v = p[:, 0], p[:, 1], q[:, 0], q[:, 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.vstack([np.column_stack([x, y, one, zero, zero, zero, -u * x, -u * y]), np.column_stack([zero, zero, zero, x, y, one, -v * x, -v * y])])
    square, side = rows.T @ rows, rows.T @ np.concatenate([u, v])
    if np.linalg.cond(square) > 1e13:
        return None
    h = np.append(np.linalg.solve(square, side), 1.0).reshape(3, 3)
    h = np.linalg.inv(tq) @ h @ tp
    if abs(h[2, 2]) < FLAT:
        return None
    return (h / h[2, 2]).ravel().tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def _fit(source_x: pd.Series, source_y: pd.Series, target_x: pd.Series, target_y: pd.Series) -> pd.Series:
    columns = (source_x, source_y, target_x, target_y)
    return pd.Series([fit_one(np.column_stack([a, b]), np.column_stack([c, d])) for a, b, c, d in zip(*columns, strict=True)])


def fit_homography(pairs: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, h): from pairs (sx, sy) -> (dx, dy); null if there are under four or they are degenerate. A set is a handful of
    pairs in one row; sets are solved in Arrow batches."""
    sets = pairs.groupBy(key).agg(F.collect_list(F.struct("sx", "sy", "dx", "dy")).alias("p"))
    return sets.select(key, _fit(*(F.col(f"p.{c}") for c in ("sx", "sy", "dx", "dy"))).alias("h"))


def _at(h: Column, i: int) -> Column:
    return F.get(h, F.lit(i))


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point; NaN where the denominator is under 1e-12 in size."""
    w = _at(h, 6) * x + _at(h, 7) * y + _at(h, 8)
    safe = F.when(F.abs(w) >= FLAT, w)
    nan = F.when(w.isNotNull(), float("nan"))
    return tuple(F.coalesce((_at(h, 3 * i) * x + _at(h, 3 * i + 1) * y + _at(h, 3 * i + 2)) / safe, nan) for i in range(2))


def invert_homography(h: Column) -> Column:
    """Inverse scaled so that its last is 1; null if the determinant is under 1e-14 in size."""
    m = [_at(h, i) for i in range(9)]
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    cof = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    det = m[0] * cof[0] + m[1] * cof[3] + m[2] * cof[6]
    last = F.when((F.abs(det) >= SINGULAR) & (F.abs(cof[8]) >= FLAT), cof[8])
    return F.when(last.isNotNull(), F.array(*(c / last for c in cof)))


def reprojection_error(pairs: DataFrame, fits: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, error): mean distance of the mapped sources to their targets; infinite if any is not finite."""
    rows = pairs.join(fits, key)
    x, y = apply_homography(F.col("h"), F.col("sx"), F.col("sy"))
    off = F.hypot(x - F.col("dx"), y - F.col("dy"))
    bad = F.max(F.coalesce(F.isnan(off), F.lit(True)))
    return rows.groupBy(key).agg(F.when(bad, float("inf")).otherwise(F.avg(off)).alias("error"))


def polygon_signed_area(points: Column) -> Column:
    """Half the sum of cross products of an array of struct<x,y>."""
    after = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def is_convex_quad(points: Column) -> Column:
    """All turns go one way; turns under 1e-9 in size do not count, and some turn must."""
    corner = lambda i: F.get(points, F.lit(i % 4))
    turns = [
        (corner(i + 1)["x"] - corner(i)["x"]) * (corner(i + 2)["y"] - corner(i + 1)["y"]) - (corner(i + 1)["y"] - corner(i)["y"]) * (corner(i + 2)["x"] - corner(i + 1)["x"])
        for i in range(4)
    ]
    left, right = F.greatest(*turns) >= 1e-9, F.least(*turns) <= -1e-9
    return left != right
