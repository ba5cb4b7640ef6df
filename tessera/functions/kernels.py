"""Density and SVM kernels, distances and vector converters as column builders (JVM-side, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled distance beyond which a kernel is taken as zero.
RANGE = {"discrete": 1.0, "uniform": 1.0, "triangular": 1.0, "epanechnikov": 1.0, "cosine": 1.0, "gaussian": 3.5, "cauchy": 6.0, "logistic": 6.0}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def density(name: str, d: Column) -> Column:
    """The kernel's weight at scaled distance d >= 0, without its normaliser; zero beyond RANGE."""
    value = {
        "discrete": lambda: F.when(F.round(d) == 0, 1.0).otherwise(0.0),
        "uniform": lambda: F.lit(1.0),
        "triangular": lambda: 1.0 - d,
        "epanechnikov": lambda: 1.0 - d * d,
        "cosine": lambda: F.cos(d * (math.pi / 2)),
        "gaussian": lambda: F.exp(d * d * -0.5),
        "cauchy": lambda: 1.0 / (1.0 + d * d),
        "logistic": lambda: F.exp(-d) / F.pow(1.0 + F.exp(-d), F.lit(2.0)),
    }[name]()
    return F.when(d < RANGE[name], value).otherwise(0.0)


def normaliser(name: str) -> float:
    """The kernel's integral over one dimension, cut at RANGE."""
    r = RANGE[name]
    return {
        "discrete": 1.0, "uniform": 2.0, "triangular": 1.0, "epanechnikov": 4 / 3, "cosine": 4 / math.pi,
        "gaussian": math.sqrt(2 * math.pi) * math.erf(r / math.sqrt(2)), "cauchy": 2 * math.atan(r), "logistic": 2 * (1 / (1 + math.exp(-r)) - 0.5),
    }[name]


def fisher(a: Column, b: Column, concentration: float, mirrored: bool = False) -> Column:
    """Directional kernel of unit vectors, without its normaliser."""
    k = dot(a, b) * concentration
    return (F.exp(k) + F.exp(-k)) / 2 if mirrored else F.exp(k)


def composite(parts: list[tuple[str, Column]]) -> Column:
    """Product of kernels over groups of dimensions: (kernel, scaled distance) pairs."""
    if not parts:
        raise ValueError("a composite kernel needs a child")
    out = density(*parts[0])
    for name, d in parts[1:]:
        out = out * density(name, d)
    return out


def svm(name: str, a: Column, b: Column, p1: float = 1.0, p2: float = 1.0) -> Column:
    return {
        "linear": lambda: dot(a, b),
        "homo_poly": lambda: F.pow(dot(a, b), F.lit(p1)),
        "poly": lambda: F.pow(dot(a, b) + 1.0, F.lit(p1)),
        "rbf": lambda: F.exp(squared_distance(a, b) * -p1),
        "gbf": lambda: F.exp(squared_distance(a, b) * (-0.5 / p1**2)),
        "sigmoid": lambda: F.tanh(dot(a, b) * p1 + p2),
    }[name]()


def to_angle(t: Column) -> Column:
    return F.array(F.cos(t), F.sin(t))


def from_angle(v: Column) -> Column:
    return F.atan2(v[1], v[0])


def to_radial(r: Column, t: Column) -> Column:
    return F.array(r * F.cos(t), r * F.sin(t))


def from_radial(v: Column) -> Column:
    return F.array(F.hypot(v[0], v[1]), F.atan2(v[1], v[0]))


def to_spherical(r: Column, inclination: Column, azimuth: Column) -> Column:
    return F.array(r * F.sin(inclination) * F.cos(azimuth), r * F.sin(inclination) * F.sin(azimuth), r * F.cos(inclination))


def angle_axis_to_quaternion(x: Column, y: Column, z: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    s = F.when(n > 0, F.sin(n / 2) / n).otherwise(0.5)
    return F.array(F.cos(n / 2), x * s, y * s, z * s)
