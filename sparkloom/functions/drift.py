"""Scalar functions of drift checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSI_MODERATE, PSI_SIGNIFICANT, P_VALUE = 0.1, 0.2, 0.05
SHARE_FLOOR = 1e-6


def psi_severity(psi: Column) -> Column:
    return F.when(psi < PSI_MODERATE, "stable").when(psi < PSI_SIGNIFICANT, "moderate").otherwise("significant")


def drift_detected(psi: Column, p_value: Column) -> Column:
    """Strictly above the PSI bound, so a PSI of exactly 0.2 is significant but not by itself drift."""
    return (psi > PSI_SIGNIFICANT) | (p_value < P_VALUE)


def bin_of(x: Column, inner_edges: Column) -> Column:
    """0-based bin of left-closed bins with infinite outer edges."""
    return F.size(F.filter(inner_edges, lambda e: e <= x))


def ks_p_asymptotic(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Kolmogorov's series 2 sum (-1)^(k-1) exp(-2 k^2 t^2), 1 where t is near 0."""
    t2 = d * d * (n * m / (n + m))
    parts = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t2))
    return F.when(t2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))))
