"""Conversion between WGS84 and the metric national grid by the published polynomial approximation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin of both systems and the published coefficients (power of the first, power of the second, factor)
LAT0, LON0 = 52.15517440, 5.38720621
X0, Y0 = 155000.0, 463000.0
TO_X = [
    (0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608),
    (0, 2, -0.008), (2, 3, 0.148),
]
TO_Y = [
    (1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439),
    (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054),
]
TO_LAT = [
    (0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738),
    (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012),
]
TO_LON = [
    (1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199),
    (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026),
]


def _poly(a: Column, b: Column, terms: list) -> Column:
    total = F.lit(0.0)
    for p, q, k in terms:
        term = F.lit(k)
        for _ in range(p):
            term = term * a
        for _ in range(q):
            term = term * b
        total = total + term
    return total


def poly_sql(a: str, b: str, terms: list) -> str:
    """The same polynomial as SQL text for the comparison engine."""
    return " + ".join(" * ".join([f"CAST({k} AS DOUBLE)", *[f"({a})"] * p, *[f"({b})"] * q]) for p, q, k in terms)


def to_metric(lat: Column, lon: Column) -> tuple[Column, Column]:
    a, b = (lat - LAT0) * 0.36, (lon - LON0) * 0.36
    return _poly(a, b, TO_X) + X0, _poly(a, b, TO_Y) + Y0


def to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    a, b = (x - X0) * 1e-5, (y - Y0) * 1e-5
    return _poly(a, b, TO_LAT) / 3600 + LAT0, _poly(a, b, TO_LON) / 3600 + LON0
