"""Exponential averages as window expressions.

With q = 1 - alpha the average is a weighted sum of the past with weights
q**i.  Summing spans of doubling length,

    S(1)[t] = b[t],   S(2n)[t] = S(n)[t] + q**n * S(n)[t - n],

needs one ``lag`` per doubling, all on the same window, so it costs one shuffle
and log2(span) passes.  Weights below 1e-17 cannot change a double, which bounds
the span; a hot key can therefore be cut into blocks that overlap by the span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.plans.series import windowed

NEGLIGIBLE = 1e-17
_WEIGHT = "__weight"


@dataclass(frozen=True)
class Decay:
    """One average: ``adjusted`` divides by the sum of the weights seen so far."""

    out: str
    value: str
    alpha: float
    adjusted: bool = False

    @property
    def doublings(self) -> int:
        if self.alpha >= 1.0:
            return 0
        span = math.log(NEGLIGIBLE) / math.log1p(-self.alpha)
        return max(1, math.ceil(math.log2(span)))

    @property
    def back(self) -> int:
        return 2**self.doublings


def by_span(out: str, value: str, span: int) -> Decay:
    """Adjusted average with alpha = 2 / (span + 1)."""
    return Decay(out, value, 2.0 / (span + 1.0), adjusted=True)


def add_decays(df: DataFrame, w: WindowSpec, decays: Sequence[Decay]) -> DataFrame:
    """Add the averages over ``w``; all of them share the passes of equal length.

    Each is a weighted sum over a sum of weights.  A null has weight 0, but the
    weights of older rows still age with it, and its own row shows the average so
    far: null before the first value.  The recursive form gives its first value
    the whole weight.
    """
    sums: dict[str, Column] = {}
    for d in decays:
        x = F.col(d.value)
        weight = F.lit(1.0)
        if not d.adjusted:
            nth = F.count(d.value).over(w.rowsBetween(Window.unboundedPreceding, 0))
            weight = F.when(nth == 1, F.lit(1.0)).otherwise(F.lit(d.alpha))
        weight = F.when(x.isNull(), F.lit(0.0)).otherwise(weight)
        sums[d.out] = F.coalesce(x * weight, F.lit(0.0))
        sums[d.out + _WEIGHT] = weight
    out = df.withColumns(sums)
    for step in range(max(d.doublings for d in decays)):
        reach = 2**step
        out = out.withColumns(
            {
                c: F.col(c) + F.lit((1.0 - d.alpha) ** reach) * F.coalesce(F.lag(c, reach).over(w), F.lit(0.0))
                for d in decays
                if step < d.doublings
                for c in (d.out, d.out + _WEIGHT)
            }
        )
    average = {d.out: F.when(F.col(d.out + _WEIGHT) > 0, F.col(d.out) / F.col(d.out + _WEIGHT)) for d in decays}
    return out.withColumns(average).drop(*[d.out + _WEIGHT for d in decays])


def decayed(df: DataFrame, decays: Sequence[Decay], **series) -> DataFrame:
    """Add exponential averages per key."""
    back = max(d.back for d in decays)
    return windowed(df, lambda x, w: add_decays(x, w, decays), back=back, **series)
