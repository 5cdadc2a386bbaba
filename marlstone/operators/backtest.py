"""Backtests with a lag between signal and position, turnover costs and an optional square-root impact, as window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.dsl import grown
from marlstone.functions.kernels import SERIES, LazySpec, divide

from . import metrics

COMMISSION_BPS = SLIPPAGE_BPS = 1.0
IMPACT_BPS, CAPITAL = 10.0, 1e6
_SO_FAR = LazySpec(lambda: SERIES.rowsBetween(Window.unboundedPreceding, 0))


def backtest(bars: DataFrame, signal: str = "signal", lag: int = 1, commission: float = COMMISSION_BPS, slippage: float = SLIPPAGE_BPS, impact: bool = False, capital: float = CAPITAL) -> DataFrame:
    """bars with position, turnover, gross, cost, ret and equity for each symbol. The first bar's turnover is its whole position."""
    if lag < 0 or commission < 0 or slippage < 0:
        raise ValueError("lag and costs can't be negative")
    wanted = F.coalesce(F.col(signal), F.lit(0.0))
    position = F.coalesce(F.lag(wanted, lag).over(SERIES), F.lit(0.0)) if lag else wanted
    asset = F.coalesce(divide(F.col("close"), F.lag("close").over(SERIES)) - 1, F.lit(0.0))
    df = bars.withColumns({"position": position, "asset_ret": asset})
    df = df.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(SERIES), F.lit(0.0))))
    cost = F.col("turnover") * ((commission + slippage) / 1e4)
    if impact:
        share = divide(F.col("turnover") * capital, F.col("close") * F.col("volume"))
        cost = cost + F.col("turnover") * F.coalesce(F.sqrt(share), F.lit(0.0)) * (IMPACT_BPS / 1e4)
    df = df.withColumn("gross", F.col("position") * F.col("asset_ret")).withColumn("cost", cost).withColumn("ret", F.col("gross") - F.col("cost"))
    return df.withColumn("equity", F.product(1 + F.col("ret")).over(_SO_FAR))


def trades(tested: DataFrame) -> DataFrame:
    """The ledger: bars on which the position changed."""
    return tested.where("turnover > 0").select("symbol", "dt", "close", "position", "turnover", "cost")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return backtest(bars.withColumn("signal", F.lit(1.0)), lag=0, commission=0.0, slippage=0.0)


def cost_sensitivity(tested: DataFrame, levels=(0, 1, 2, 5, 10, 20), by: str = "symbol") -> DataFrame:
    """Figures at each cost level: gross and turnover don't depend on it, so one scan serves all levels."""
    bps = F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("bps")
    rows = tested.select(by, "dt", "gross", "turnover", bps).withColumn("ret", F.col("gross") - F.col("turnover") * F.col("bps") / 1e4)
    return rows.groupBy(by, "bps").agg(metrics.total_return("ret").alias("total_return"), metrics.sharpe("ret").alias("sharpe"))


def backtest_portfolio(bars: DataFrame, weights: DataFrame, lag: int = 1, commission: float = COMMISSION_BPS, slippage: float = SLIPPAGE_BPS) -> DataFrame:
    """(dt, gross, turnover, cost, ret, equity) of a portfolio. weights (dt, symbol, weight) may have rows for rebalance dates only: between
    them a weight is held. On a rebalance date, a symbol without a row has weight 0."""
    dates = weights.select("dt").distinct().withColumn("_reb", F.lit(True))
    df = bars.select("symbol", "dt", "close").join(weights, ["symbol", "dt"], "left").join(dates, "dt", "left")
    held = F.last(F.when(F.col("_reb"), F.coalesce("weight", F.lit(0.0))), ignorenulls=True).over(_SO_FAR)
    asset = F.coalesce(divide(F.col("close"), F.lag("close").over(SERIES)) - 1, F.lit(0.0))
    df = df.withColumns({"_held": held, "_asset": asset})
    df = df.withColumn("_w", F.coalesce(F.lag("_held", lag).over(SERIES) if lag else F.col("_held"), F.lit(0.0)))
    df = df.withColumn("_t", F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(SERIES), F.lit(0.0))))
    days = df.groupBy("dt").agg(F.sum(F.col("_w") * F.col("_asset")).alias("gross"), F.sum("_t").alias("turnover"))
    days = days.withColumn("cost", F.col("turnover") * ((commission + slippage) / 1e4)).withColumn("ret", F.col("gross") - F.col("cost"))
    # one row a date: small whatever the number of symbols
    return days.withColumn("equity", F.product(1 + F.col("ret")).over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)))


def rebalance_dates(bars: DataFrame, period: str = "month") -> DataFrame:
    """The last date in each period that has a bar."""
    return bars.groupBy(F.date_trunc(period, "dt").alias("p")).agg(F.max("dt").alias("dt")).select("dt")


def walk_forward(returns: DataFrame, folds: int = 5, train: float = 0.6, least: int = 30) -> DataFrame:
    """Selects a configuration on each fold's training stretch by Sharpe and tests it on the fold: all folds and configurations in one plan.

    returns: (symbol, dt, config, ret), one row for each configuration. Gives (symbol, fold, config, train_sharpe, test_sharpe, test_return).
    """
    by = Window.partitionBy("symbol", "config").orderBy("dt")
    rows = returns.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol", "config")))
    size = F.floor(F.col("n") / (folds + 1))
    rows = rows.withColumn("size", size).where(F.col("size") >= least).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("fold") * F.col("size")
    length = F.floor(F.col("size") * train / (1 - train))
    is_test = (F.col("i") >= start) & (F.col("i") < F.when(F.col("fold") == folds, F.col("n")).otherwise(start + F.col("size")))
    is_train = (F.col("i") < start) & (F.col("i") >= start - length)
    rows = rows.withColumn("a", F.when(is_train, F.col("ret"))).withColumn("b", F.when(is_test, F.col("ret")))
    each = rows.where("a is not null or b is not null").groupBy("symbol", "fold", "config").agg(metrics.sharpe("a").alias("train_sharpe"), metrics.sharpe("b").alias("test_sharpe"), metrics.total_return("b").alias("test_return"))
    best = Window.partitionBy("symbol", "fold").orderBy(F.col("train_sharpe").desc_nulls_last(), "config")
    return each.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def with_cn_rules(bars: DataFrame, wanted: str = "wanted") -> DataFrame:
    """bars with position: no shorts; no buying on a bar locked at its upper limit, no selling at its lower one. Folded over each symbol."""
    code = F.col("symbol")
    limit = F.when(code.startswith("300") | code.startswith("301") | code.startswith("688") | code.startswith("689"), 0.20).when(code.startswith("8") | code.startswith("4") | code.startswith("92"), 0.30).otherwise(0.10)
    move = divide(F.col("close"), F.lag("close").over(SERIES)) - 1
    df = bars.withColumn("_up", F.coalesce(move >= limit - 1e-4, F.lit(False))).withColumn("_down", F.coalesce(move <= -limit + 1e-4, F.lit(False)))
    rows = df.withColumn("_w", F.greatest(F.coalesce(F.col(wanted), F.lit(0.0)), F.lit(0.0)))
    series = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("dt", "_up", "_down", "_w"))).alias("s"))
    empty = F.slice(F.transform("s", lambda b: F.struct(b["dt"].alias("dt"), b["_w"].alias("position"))), 1, 0)

    def step(acc, b):
        p: Column = F.when(b["_up"] & (b["_w"] > acc["p"]), acc["p"]).when(b["_down"] & (b["_w"] < acc["p"]), acc["p"]).otherwise(b["_w"])
        return F.struct(p.alias("p"), *grown(acc, F.struct(b["dt"].alias("dt"), p.alias("position"))))

    start = F.struct(F.lit(0.0).alias("p"), F.slice(F.array(empty), 1, 0).alias("out"), empty.alias("run"))
    folded = series.select("symbol", F.explode(F.aggregate("s", start, step, lambda a: F.flatten(F.concat(a["out"], F.array(a["run"]))))).alias("o")).select("symbol", "o.*")
    return df.drop("_up", "_down").join(folded, ["symbol", "dt"], "left")
