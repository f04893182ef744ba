"""Option chains: Black-Scholes value and Greeks per contract, summed per book."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREEKS = ("delta", "gamma", "theta", "vega", "rho")


# Hart's rational approximation of the normal distribution function (5666), highest power first.
_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOWER = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
)
_FAR = 7.07106781186547


def _polynomial(x: Column, terms: Sequence[float]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + F.lit(t)
    return out


def normal_cdf(x: Column) -> Column:
    """Normal distribution function to about 1e-15, as a column expression."""
    size = F.abs(x)
    near = _polynomial(size, _UPPER) / _polynomial(size, _LOWER)
    far = size + F.lit(0.65)
    for n in (4.0, 3.0, 2.0, 1.0):
        far = size + F.lit(n) / far
    tail = F.exp(-size * size / 2) * F.when(size < _FAR, near).otherwise(F.lit(1.0) / (far * F.lit(math.sqrt(2 * math.pi))))
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def price_chain(df: DataFrame, dividend: float = 0.0) -> DataFrame:
    """Add value, Greeks, intrinsic and time value, moneyness.

    Needs spot, strike, years, rate, volatility, kind (call or put), all in
    column expressions.  Theta is per day, vega and rho per percent.
    """
    c = F.col
    s, k, t, r, v = c("spot"), c("strike"), c("years"), c("rate"), c("volatility")
    call, live = c("kind") == "call", t > 0
    root = F.sqrt(F.when(live, t))
    d1 = F.when(live, (F.log(s / k) + (r - F.lit(dividend) + v * v / 2) * t) / (v * root))
    d = df.withColumns({"_d1": d1}).withColumn("_d2", c("_d1") - v * root)
    d = d.withColumns({"_n1": normal_cdf(F.coalesce("_d1", F.lit(0.0))), "_n2": normal_cdf(F.coalesce("_d2", F.lit(0.0)))})
    carry, disc = F.exp(F.lit(-dividend) * t), F.exp(-r * t)
    density = F.exp(-c("_d1") * c("_d1") / 2) / F.lit(math.sqrt(2 * math.pi))
    n1, n2 = c("_n1"), c("_n2")
    intrinsic = F.greatest(F.lit(0.0), F.when(call, s - k).otherwise(k - s))
    value = F.when(call, s * carry * n1 - k * disc * n2).otherwise(k * disc * (1 - n2) - s * carry * (1 - n1))
    fade = -(s * density * v * carry) / (2 * root)
    theta = F.when(call, fade - r * k * disc * n2 + F.lit(dividend) * s * carry * n1).otherwise(
        fade + r * k * disc * (1 - n2) - F.lit(dividend) * s * carry * (1 - n1)
    )

    def alive(x: Column) -> Column:
        return F.when(live, x).otherwise(F.lit(0.0))

    return d.withColumns(
        {
            "value": F.when(live, F.greatest(F.lit(0.0), value)).otherwise(intrinsic), "intrinsic_value": intrinsic,
            "moneyness": F.when(call, F.try_divide(s, k)).otherwise(F.try_divide(k, s)),
            "delta": alive(carry * F.when(call, n1).otherwise(n1 - 1)), "gamma": alive(carry * density / (s * v * root)),
            "theta": alive(theta / 365), "vega": alive(s * carry * density * root / 100),
            "rho": alive(F.when(call, k * t * disc * n2).otherwise(-k * t * disc * (1 - n2)) / 100),
        }
    ).withColumn("time_value", c("value") - c("intrinsic_value")).drop("_d1", "_d2", "_n1", "_n2")


def position_greeks(chain: DataFrame, quantity: str = "quantity", multiplier: float = 100.0) -> DataFrame:
    return chain.withColumns({f"position_{g}": F.col(g) * F.col(quantity) * F.lit(multiplier) for g in (*GREEKS, "value")})


def book_greeks(positions: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    return positions.groupBy(*by).agg(*[F.sum(f"position_{g}").alias(g) for g in (*GREEKS, "value")])


def delta_hedge(positions: DataFrame, by: str = "symbol") -> DataFrame:
    """Hedge quantity per underlying, and the gamma profit of its recorded move (column ``move``)."""
    return positions.groupBy(by).agg(
        (-F.sum("position_delta")).alias("hedge_quantity"),
        F.sum(F.lit(0.5) * F.col("gamma") * F.col("move") * F.col("move") * F.col("quantity")).alias("gamma_pnl"),
    )
