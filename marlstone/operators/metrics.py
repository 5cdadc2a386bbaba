"""Performance figures as aggregates over a column of period returns, and per-trade excursions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, divide

PERIODS = 252


def total_return(r: str) -> Column:
    return F.product(1 + F.col(r)) - 1


def cagr(r: str, periods: int = PERIODS) -> Column:
    """0 without rows, -1 if all is lost, the plain total return for very short series."""
    n, growth = F.count(r), F.product(1 + F.col(r))
    short = max(5, periods // 12)
    return F.when(n == 0, 0.0).when(growth <= 0, -1.0).when(n < short, growth - 1).otherwise(F.pow(growth, F.lit(float(periods)) / n) - 1)


def volatility(r: str, periods: int = PERIODS) -> Column:
    return F.stddev_pop(r) * math.sqrt(periods)


def sharpe(r: str, risk_free: float = 0.0, periods: int = PERIODS) -> Column:
    s = F.stddev_pop(r)
    return F.when((F.count(r) > 0) & (s > 0), divide(F.avg(r) - risk_free / periods, s) * math.sqrt(periods)).otherwise(0.0)


def sortino(r: str, risk_free: float = 0.0, periods: int = PERIODS) -> Column:
    excess = F.col(r) - risk_free / periods
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2.0))))
    return F.when(down > 0, divide(F.avg(excess), down) * math.sqrt(periods)).otherwise(0.0)


def win_rate(r: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(r) != 0, (F.col(r) > 0).cast("double"))), F.lit(0.0))


def profit_factor(r: str, cap: float = 100.0) -> Column:
    gain, loss = F.sum(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0)), -F.sum(F.when(F.col(r) < 0, F.col(r)).otherwise(0.0))
    return F.when(loss > 0, F.least(divide(gain, loss), F.lit(cap))).when(gain > 0, F.lit(cap))


def exposure(position: str) -> Column:
    return F.avg((F.col(position) != 0).cast("double"))


def with_drawdown(df: DataFrame, equity: str, w=SERIES) -> DataFrame:
    return df.withColumn("drawdown", divide(F.col(equity), F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)


def summary(df: DataFrame, r: str = "ret", position: str | None = "position", by: str = "symbol", periods: int = PERIODS) -> DataFrame:
    """One row for each `by` with all figures. df needs dt; rows without a return don't count."""
    w = Window.partitionBy(by).orderBy("dt")
    rows = df.where(F.col(r).isNotNull())
    rows = rows.withColumn("_e", F.product(1 + F.col(r)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_d", divide(F.col("_e"), F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))) - 1)
    figures = [
        F.count(r).alias("n_periods"), total_return(r).alias("total_return"), cagr(r, periods).alias("cagr"), volatility(r, periods).alias("volatility"),
        sharpe(r, periods=periods).alias("sharpe"), sortino(r, periods=periods).alias("sortino"), F.min("_d").alias("max_drawdown"),
        win_rate(r).alias("win_rate"), profit_factor(r).alias("profit_factor"),
    ]
    if position:
        figures.append(exposure(position).alias("exposure"))
    out = rows.groupBy(by).agg(*figures)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, divide(F.col("cagr"), F.abs("max_drawdown"))).otherwise(0.0))


def capm(df: DataFrame, r: str, market: str, by: str = "symbol", periods: int = PERIODS) -> DataFrame:
    """alpha (a year), beta, corr, r2, treynor and information ratio; NULL below 3 common rows."""
    rows = df.where(F.col(r).isNotNull() & F.col(market).isNotNull()).select(by, F.col(r).alias("r"), F.col(market).alias("m"))
    cov = F.avg(F.col("r") * F.col("m")) - F.avg("r") * F.avg("m")
    agg = rows.groupBy(by).agg(F.count("r").alias("n"), divide(cov, F.var_pop("m")).alias("beta"), divide(cov, F.stddev_pop("r") * F.stddev_pop("m")).alias("corr"), F.avg("r").alias("mr"), F.avg("m").alias("mm"), F.stddev_pop(F.col("r") - F.col("m")).alias("te"))
    ok = lambda c: F.when(F.col("n") >= 3, c)
    return agg.select(
        by, ok((F.col("mr") - F.col("beta") * F.col("mm")) * periods).alias("alpha"), ok(F.col("beta")).alias("beta"), ok(F.col("corr")).alias("corr"),
        ok(F.col("corr") * F.col("corr")).alias("r2"), ok(divide(F.col("mr") * periods, F.col("beta"))).alias("treynor"),
        ok(divide((F.col("mr") - F.col("mm")) * math.sqrt(periods), F.col("te"))).alias("information_ratio"),
    )


def mae_mfe(df: DataFrame, position: str = "position") -> DataFrame:
    """A row for each holding (a stretch of bars with the same non-zero side): entry, exit, side, worst and best move since entry."""
    side = F.signum(F.coalesce(F.col(position), F.lit(0.0)))
    rows = df.withColumn("_s", side)
    rows = rows.withColumn("_new", (F.coalesce(F.lag("_s").over(SERIES), F.lit(0.0)) != F.col("_s")).cast("int")).withColumn("_id", F.sum("_new").over(SERIES.rowsBetween(Window.unboundedPreceding, 0)))
    held = rows.where("_s <> 0").withColumn("_entry", F.first("close").over(Window.partitionBy("symbol", "_id").orderBy("dt")))
    move = F.col("_s") * (divide(F.col("close"), F.col("_entry")) - 1)
    return held.groupBy("symbol", "_id").agg(
        F.min("dt").alias("entry_dt"), F.max("dt").alias("exit_dt"), F.first("_s").alias("side"), F.count("*").alias("bars"),
        F.least(F.min(move), F.lit(0.0)).alias("mae"), F.greatest(F.max(move), F.lit(0.0)).alias("mfe"), F.max_by(move, "dt").alias("final"),
    ).drop("_id")


def downturn(df: DataFrame, r: str, by: str = "symbol") -> DataFrame:
    """The worst calendar quarter of each series: quarter, total return and bars (at least 5)."""
    q = df.where(F.col(r).isNotNull()).groupBy(by, F.date_trunc("quarter", "dt").cast("date").alias("quarter")).agg(total_return(r).alias("ret"), F.count(r).alias("bars")).where("bars >= 5")
    return q.groupBy(by).agg(F.min_by(F.struct("quarter", "ret", "bars"), F.struct("ret", "quarter")).alias("w")).select(by, "w.*")
