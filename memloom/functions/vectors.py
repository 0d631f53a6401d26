"""Vector and hyperbolic geometry as Column functions over ``array<double>``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions import text as tx

EPS = 1e-7

# Radial offsets of the deterministic mapper and level scales of the hierarchy projection.
TYPE_OFFSET = {"RAW": 0.05, "FACT": 0.2, "EVENT": 0.12, "ANCHOR": -0.15}
STATUS_OFFSET = {"active": 0.0, "outdated": -0.1, "exception": 0.08, "disputed": -0.05}
LEVEL_SCALE = {"TOPIC": 0.36, "EVENT": 0.58, "FACT": 0.80, "RAW": 0.95, "ANCHOR": 0.42}


def _choice(column: Column, table: dict[str, float], default: float) -> Column:
    result = F.lit(default)
    for key, value in table.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(left: Column, right: Column) -> Column:
    """Cosine with 0 for (near-)zero vectors."""
    size = norm(left) * norm(right)
    return F.when(size <= 1e-12, F.lit(0.0)).otherwise(dot(left, right) / size)


def _fused_dot(left: list[float], right: list[float]) -> float:
    total = 0.0
    for x, y in zip(left, right):
        total = math.fma(x, y, total)
    return total


def fused_cosine(left: Column, right: Column) -> Column:
    """``cosine`` of finite vectors with products and sums rounded together, as DuckDB sums a dot product.

    For thresholds that many cosines hit exactly: a tie falls on the same side in both. Null where a vector is null.
    """

    def one(a, b) -> float | None:
        if a is None or b is None:
            return None
        a, b = a.tolist(), b.tolist()
        size = math.sqrt(_fused_dot(a, a)) * math.sqrt(_fused_dot(b, b))
        return 0.0 if size <= 1e-12 else _fused_dot(a, b) / size

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")(left, right)


def normalize(vector: Column) -> Column:
    return tx.let(norm(vector), lambda size: F.when(size <= 1e-12, vector).otherwise(F.transform(vector, lambda x: x / size)))


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def _spatial(point: Column) -> Column:
    return F.slice(point, 2, F.size(point) - 1)


def exp_map(tangent: Column, curvature: float = 1.0) -> Column:
    """Point on the hyperboloid reached from the origin along a tangent vector (time coordinate first)."""
    root = math.sqrt(curvature)
    stretch = tx.let(norm(tangent) * root, lambda length: F.sinh(length) / F.greatest(length, F.lit(EPS)))
    spatial = tx.let(stretch, lambda factor: F.transform(tangent, lambda x: x * factor))
    return tx.let(spatial, lambda s: F.concat(F.array(F.sqrt(F.lit(1.0 / curvature) + F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x * x))), s))


def lorentz_inner(left: Column, right: Column) -> Column:
    return dot(_spatial(left), _spatial(right)) - left.getItem(0) * right.getItem(0)


def lorentz_distance(left: Column, right: Column, curvature: float = 1.0) -> Column:
    product = lorentz_inner(left, right) * F.lit(-curvature)
    return F.acosh(F.greatest(product, F.lit(1.0 + EPS))) / F.lit(math.sqrt(curvature))


def lorentz_radius(point: Column, curvature: float = 1.0) -> Column:
    """Distance from the origin."""
    product = point.getItem(0) * F.lit(math.sqrt(curvature))
    return F.acosh(F.greatest(product, F.lit(1.0 + EPS))) / F.lit(math.sqrt(curvature))


def to_poincare(point: Column, curvature: float = 1.0) -> Column:
    shift = F.greatest(point.getItem(0) + F.lit(1.0 / math.sqrt(curvature)), F.lit(EPS))
    return F.transform(_spatial(point), lambda x: x / shift)


def cone_aperture(confidence: Column, low: float = 0.1, high: float = 1.0) -> Column:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.lit(low) + (F.lit(1.0) - bounded) * F.lit(high - low)


def cone_violation(parent: Column, child: Column, confidence: Column) -> Column:
    """Angle between two points beyond the aperture of the parent's cone."""
    p, c = _spatial(parent), _spatial(child)
    ratio = dot(p, c) / F.greatest(norm(p) * norm(c), F.lit(EPS))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    return F.greatest(F.lit(0.0), angle - cone_aperture(confidence))


def node_radius_scale(node_type: Column, status: Column, confidence: Column) -> Column:
    """Tangent scale of a node by type, status and confidence; unknown types get no offset."""
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    base = (
        F.lit(0.45)
        + _choice(node_type, TYPE_OFFSET, 0.0)
        + _choice(status, STATUS_OFFSET, 0.0)
        + F.lit(0.2) * bounded
    )
    return F.when(node_type == "ANCHOR", base * F.lit(0.75)).otherwise(base)


def project_node(tangent: Column, node_type: Column, status: Column, confidence: Column) -> Column:
    return exp_map(scale(tangent, node_radius_scale(node_type, status, confidence)))


def project_query(tangent: Column) -> Column:
    return exp_map(scale(tangent, F.lit(0.55)))


def level_scale(node_type: Column, confidence: Column) -> Column:
    return _choice(node_type, LEVEL_SCALE, 0.65) + F.lit(0.06) * F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), confidence)
    )


def project_level(tangent: Column, node_type: Column, confidence: Column) -> Column:
    return exp_map(scale(tangent, level_scale(node_type, confidence)))


def project_level_query(tangent: Column) -> Column:
    return exp_map(scale(tangent, F.lit(0.72)))
