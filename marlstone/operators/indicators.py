"""Technical indicators as columns of a panel of bars. Standard deviations are population ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.dsl import with_ewm
from marlstone.functions.kernels import SERIES, divide, frame, full

PERIODS_A_YEAR = 252


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(frame(n)))


def wma(x: Column, n: int) -> Column:
    total = n * (n + 1) / 2
    return full(x, n, sum((F.lag(x, k).over(SERIES) * ((n - k) / total) for k in range(n)), F.lit(0.0)))


def std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_pop(x).over(frame(n)))


def zscore(x: Column, n: int) -> Column:
    return divide(x - sma(x, n), std(x, n))


def momentum(x: Column, n: int) -> Column:
    return divide(x, F.lag(x, n).over(SERIES))


def roc(x: Column, n: int) -> Column:
    return (momentum(x, n) - 1) * 100


def bollinger(x: Column, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, s = sma(x, n), std(x, n)
    return {"bb_mid": mid, "bb_upper": mid + s * k, "bb_lower": mid - s * k, "bb_pct": divide(x - (mid - s * k), s * (2 * k))}


def true_range() -> Column:
    """The first bar has no close before it: its range is high - low."""
    before = F.lag("close").over(SERIES)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def realized_vol(returns: Column, n: int = 20, periods: int = PERIODS_A_YEAR) -> Column:
    return std(returns, n) * math.sqrt(periods)


def donchian(n: int = 20) -> dict[str, Column]:
    hi, lo = full(F.col("high"), n, F.max("high").over(frame(n))), full(F.col("low"), n, F.min("low").over(frame(n)))
    return {"dc_upper": hi, "dc_lower": lo, "dc_mid": (hi + lo) / 2}


def with_ema(bars: DataFrame, n: int, out: str, of: str = "close") -> DataFrame:
    return with_ewm(bars, {out: (F.col(of), 2.0 / (n + 1), n)})


def with_rsi(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """100 without losses, 50 without moves."""
    move = F.col("close") - F.lag("close").over(SERIES)
    df = bars.withColumn("_up", F.greatest(move, F.lit(0.0) * move)).withColumn("_down", F.greatest(-move, F.lit(0.0) * move))
    df = with_ewm(df, {"_au": (F.col("_up"), 1.0 / n, n), "_ad": (F.col("_down"), 1.0 / n, n)})
    value = F.when((F.col("_au") == 0) & (F.col("_ad") == 0), 50.0).when(F.col("_ad") == 0, 100.0).otherwise(100 - 100 / (1 + divide(F.col("_au"), F.col("_ad"))))
    return df.withColumn(out, F.when(F.col("_au").isNotNull(), value)).drop("_up", "_down", "_au", "_ad")


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = with_ewm(bars, {"_f": (F.col("close"), 2.0 / (fast + 1), fast), "_s": (F.col("close"), 2.0 / (slow + 1), slow)}).withColumn("macd", F.col("_f") - F.col("_s"))
    df = with_ewm(df, {"macd_signal": (F.col("macd"), 2.0 / (signal + 1), signal)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def with_atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return with_ewm(bars.withColumn("_tr", true_range()), {out: (F.col("_tr"), 1.0 / n, n)}).drop("_tr")


def with_adx(bars: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    up, down = F.col("high") - F.lag("high").over(SERIES), F.lag("low").over(SERIES) - F.col("low")
    df = bars.withColumn("_tr", true_range()).withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_m", F.when((down > up) & (down > 0), down).otherwise(0.0))
    df = with_ewm(df, {"_a": (F.col("_tr"), 1.0 / n, n), "_ap": (F.col("_p"), 1.0 / n, 1), "_am": (F.col("_m"), 1.0 / n, 1)})
    plus, minus = divide(F.col("_ap") * 100, F.col("_a")), divide(F.col("_am") * 100, F.col("_a"))
    df = df.withColumn("_dx", divide(F.abs(plus - minus) * 100, plus + minus))
    return with_ewm(df, {out: (F.col("_dx"), 1.0 / n, n)}).drop("_tr", "_p", "_m", "_a", "_ap", "_am", "_dx")
