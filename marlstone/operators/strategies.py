"""Rule strategies: each adds a column `signal`, the wanted position in [-1, 1], to a panel of bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, LazySpec, divide, frame, full

from . import indicators as I

_HELD = LazySpec(lambda: SERIES.rowsBetween(Window.unboundedPreceding, 0))


def positions(entry: Column, leave: Column, value: float = 1.0) -> Column:
    """value from an entry on, 0 from an exit on, 0 before the first; an entry beats an exit on the same bar."""
    event = F.when(F.coalesce(entry, F.lit(False)), F.lit(value)).when(F.coalesce(leave, F.lit(False)), F.lit(0.0))
    return F.coalesce(F.last(event, ignorenulls=True).over(_HELD), F.lit(0.0))


def ma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50, kind: str = "ema", allow_short: bool = False) -> DataFrame:
    if kind == "ema":
        df = I.with_ema(I.with_ema(bars, fast, "_f"), slow, "_s")
    else:
        df = bars.withColumn("_f", I.sma(F.col("close"), fast)).withColumn("_s", I.sma(F.col("close"), slow))
    below = F.when(F.col("_f").isNotNull() & F.col("_s").isNotNull(), -1.0).otherwise(0.0) if allow_short else F.lit(0.0)
    return df.withColumn("signal", F.when(F.col("_f") > F.col("_s"), 1.0).otherwise(below)).drop("_f", "_s")


def breakout(bars: DataFrame, entry: int = 20, leave: int = 10, allow_short: bool = False) -> DataFrame:
    before = lambda n: SERIES.rowsBetween(-n, -1)
    whole = lambda n, x: F.when(F.count("close").over(before(n)) == n, x)
    close = F.col("close")
    df = bars.withColumns({"_hi": whole(entry, F.max("high").over(before(entry))), "_lo": whole(leave, F.min("low").over(before(leave)))})
    signal = positions(close >= F.col("_hi"), close <= F.col("_lo"))
    if allow_short:
        df = df.withColumns({"_lo2": whole(entry, F.min("low").over(before(entry))), "_hi2": whole(leave, F.max("high").over(before(leave)))})
        signal = signal + positions(close <= F.col("_lo2"), close >= F.col("_hi2"), -1.0)
    return df.withColumn("signal", signal).drop("_hi", "_lo", "_lo2", "_hi2")


def ts_momentum(bars: DataFrame, lookback: int = 60, allow_short: bool = False) -> DataFrame:
    move = I.momentum(F.col("close"), lookback) - 1
    below = F.when(move < 0, -1.0).otherwise(0.0) if allow_short else F.lit(0.0)
    return bars.withColumn("signal", F.when(move > 0, 1.0).otherwise(below))


def macd_trend(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, allow_short: bool = False) -> DataFrame:
    df = I.with_macd(bars, fast, slow, signal)
    below = F.when(F.col("macd_hist") < 0, -1.0).otherwise(0.0) if allow_short else F.lit(0.0)
    return df.withColumn("signal", F.when(F.col("macd_hist") > 0, 1.0).otherwise(below)).drop("macd", "macd_signal", "macd_hist")


def _reversion(df: DataFrame, low: Column, leave: Column, allow_short: bool, high: Column, leave_short: Column) -> DataFrame:
    signal = positions(low, leave)
    if allow_short:
        signal = signal + positions(high, leave_short, -1.0)
    return df.withColumn("signal", signal)


def zscore_reversion(bars: DataFrame, n: int = 20, entry: float = 2.0, leave: float = 0.5, allow_short: bool = False) -> DataFrame:
    z = F.col("_z")
    return _reversion(bars.withColumn("_z", I.zscore(F.col("close"), n)), z <= -entry, z >= -leave, allow_short, z >= entry, z <= leave).drop("_z")


def bollinger_reversion(bars: DataFrame, n: int = 20, k: float = 2.0, allow_short: bool = False) -> DataFrame:
    df = bars.withColumns({f"_{a}": c for a, c in I.bollinger(F.col("close"), n, k).items()})
    c, mid = F.col("close"), F.col("_bb_mid")
    out = _reversion(df, c <= F.col("_bb_lower"), c >= mid, allow_short, c >= F.col("_bb_upper"), c <= mid)
    return out.drop("_bb_mid", "_bb_upper", "_bb_lower", "_bb_pct")


def rsi_reversion(bars: DataFrame, n: int = 14, oversold: float = 30.0, leave: float = 50.0, overbought: float = 70.0, allow_short: bool = False) -> DataFrame:
    r = F.col("_rsi")
    return _reversion(I.with_rsi(bars, n, "_rsi"), r <= oversold, r >= leave, allow_short, r >= overbought, r <= leave).drop("_rsi")


def pair_spread(bars: DataFrame, partner: DataFrame, n: int = 60) -> DataFrame:
    """bars with hedge, spread and spread_z against partner (dt, partner_close), whose holes are filled forward."""
    df = bars.join(partner, "dt", "left").withColumn("_p", F.last("partner_close", ignorenulls=True).over(_HELD))
    x, y = F.col("close"), F.col("_p")
    hedge = full(x + y, n, divide(F.covar_samp(x, y).over(frame(n)), F.var_samp(y).over(frame(n))))
    df = df.withColumn("hedge", hedge).withColumn("spread", x - F.col("hedge") * y)
    return df.withColumn("spread_z", I.zscore(F.col("spread"), n)).drop("_p", "partner_close")


def pairs_reversion(bars: DataFrame, partner: DataFrame, n: int = 60, entry: float = 2.0, leave: float = 0.5) -> DataFrame:
    z = F.col("spread_z")
    df = pair_spread(bars, partner, n)
    return df.withColumn("signal", positions(z <= -entry, z >= -leave) + positions(z >= entry, z <= leave, -1.0)).drop("hedge", "spread", "spread_z")


def with_trend_filter(signal: Column, adx: Column, least: float = 20.0) -> Column:
    return F.when(adx >= least, signal).otherwise(0.0)


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "ma_crossover": ma_crossover, "breakout": breakout, "ts_momentum": ts_momentum, "macd_trend": macd_trend,
    "zscore_reversion": zscore_reversion, "bollinger_reversion": bollinger_reversion, "rsi_reversion": rsi_reversion,
}
# The default grids that searches go through. Parameters are named as in the functions above.
PARAM_GRIDS: dict[str, dict[str, list]] = {
    "ma_crossover": {"fast": [10, 20, 30], "slow": [50, 100, 150]},
    "breakout": {"entry": [20, 40, 55], "leave": [10, 20]},
    "ts_momentum": {"lookback": [60, 90, 120, 180]},
    "macd_trend": {"fast": [8, 12], "slow": [21, 26], "signal": [9]},
    "zscore_reversion": {"n": [10, 20, 30], "entry": [1.0, 1.5, 2.0]},
    "bollinger_reversion": {"n": [10, 20, 30], "k": [1.5, 2.0, 2.5]},
    "rsi_reversion": {"n": [7, 14, 21], "oversold": [20, 30]},
}
