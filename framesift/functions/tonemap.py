"""Tone mapping of HDR samples (0 to 1) to sRGB as column expressions: HLG and PQ transfers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the published transfer functions, luma weights and primaries matrix (fixed values).
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
LUMA = (0.2627, 0.6780, 0.0593)
TO_SRGB = ((1.6605, -0.5877, -0.0728), (-0.1246, 1.1329, -0.0083), (-0.0182, -0.1006, 1.1187))
WHITE = 10000.0 / 203.0


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _gamma(x: Column) -> Column:
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def _to_srgb(rgb: list[Column]) -> list[Column]:
    return [_gamma(_clamp(a * rgb[0] + b * rgb[1] + c * rgb[2])) for a, b, c in TO_SRGB]


def hlg(rgb: list[Column]) -> list[Column]:
    linear = [F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - HLG_C) / HLG_A) + HLG_B) / 12) for x in rgb]
    luma = sum((w * x for w, x in zip(LUMA[1:], linear[1:])), LUMA[0] * linear[0])
    gain = F.pow(F.greatest(luma, F.lit(1e-6)), F.lit(0.2))
    return _to_srgb([x * gain for x in linear])


def pq(rgb: list[Column]) -> list[Column]:
    def linear(x: Column) -> Column:
        p = F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / PQ_M2))
        return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))

    return _to_srgb([_clamp(linear(x) * WHITE) for x in rgb])
