"""Where profit came from, and what past trials and signals say."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import divide

from .models import date_statistics


def pnl_by_symbol(positions: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """positions (symbol, ...) with realized_pnl, the sum over trades (symbol, realized_pnl); null without trades of a symbol."""
    if trades is None:
        return positions
    return positions.join(trades.groupBy("symbol").agg(F.sum("realized_pnl").alias("realized_pnl")), "symbol", "left")


def attribute_by_sector(pnl: DataFrame, sectors: DataFrame, column: str = "unrealized_pnl") -> DataFrame:
    """(sector, pnl), largest first; names without a sector are 'other'."""
    return pnl.join(sectors.select("symbol", "sector"), "symbol", "left").groupBy(F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.sum(column).alias("pnl")).orderBy(F.desc("pnl"), "sector")


def factor_attribution(rows: DataFrame, ret: str, factors: list[str], least: int = 10) -> DataFrame | None:
    """(factor, beta, r2) of the least-squares fit of a portfolio's returns on factor returns, with alpha as a factor; None with fewer than
    `least` rows. Sums over rows are aggregated, only they are solved."""
    k = len(factors)
    spark = rows.sparkSession
    one = date_statistics(rows.withColumn("dt", F.lit(0)), factors, ret).first()
    if one is None or one.n < least:
        return None
    n, s = one.n, np.asarray(one.s, float)
    q = np.zeros((k, k))
    q[np.triu_indices(k)] = s[k : k + k * (k + 1) // 2]
    q = q + np.triu(q, 1).T
    mu, my = s[:k] / n, one.sy / n
    a, b = q - n * np.outer(mu, mu), s[-k:] - mu * one.sy
    beta = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    syy = rows.where(" and ".join(f"{c} is not null" for c in [*factors, ret])).agg(F.sum(F.col(ret) * F.col(ret))).first()[0] - n * my * my
    r2 = float(beta @ b / syy) if syy > 0 else 0.0
    return spark.createDataFrame([("alpha", float(my - mu @ beta), r2), *((f, float(x), r2) for f, x in zip(factors, beta))], "factor string, beta double, r2 double")


def suggest_factors(trials: DataFrame, regime: str | None = None) -> DataFrame:
    """(factor, trials, success, icir) from trials (factors 'a+b', icir, regime), best first by share of trials with a positive ICIR, then by
    its mean."""
    rows = trials if regime is None else trials.where(F.col("regime") == regime)
    rows = rows.where(F.col("icir").isNotNull() & ~F.isnan("icir") & (F.abs("icir") < float("inf")))
    each = rows.select(F.explode(F.split("factors", "\\+")).alias("factor"), "icir").where("factor <> ''")
    return each.groupBy("factor").agg(F.count("*").alias("trials"), F.avg((F.col("icir") > 0).cast("double")).alias("success"), F.avg("icir").alias("mean_icir")).orderBy(F.desc("success"), F.desc("mean_icir"), "factor")


def best_trials(trials: DataFrame, market: str | None = None, regime: str | None = None, top: int = 10) -> DataFrame:
    """The top trials of a market and regime by ICIR; those without a finite one come last."""
    rows = trials if market is None else trials.where(F.col("market") == market)
    rows = rows if regime is None else rows.where(F.col("regime") == regime)
    finite = F.when(~F.isnan("icir") & (F.abs("icir") < float("inf")), F.col("icir"))
    return rows.orderBy(finite.desc_nulls_last(), "trial").limit(top)


def calibration(outcomes: DataFrame, score: str = "score", outcome: str = "fwd", bins: int = 4) -> DataFrame:
    """(bucket, n, low, high, mean_outcome) by quantiles of the score; equal edges make fewer buckets, so ties stay together."""
    rows = outcomes.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    edges = rows.agg(F.percentile(score, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("e")).select(F.array_distinct("e").alias("e"))
    place = F.greatest(F.size(F.filter(F.slice("e", 1, F.size("e") - 1), lambda x: x < F.col(score))), F.lit(1))
    cut = rows.crossJoin(F.broadcast(edges)).withColumn("bucket", place)  # one row
    return cut.groupBy("bucket").agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.avg(outcome).alias("mean_outcome"))


def hit_rates(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(signals, hit_rate, mean_fwd): of evaluated signals."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("signals"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("fwd").alias("mean_fwd"))


def spans(tested: DataFrame) -> DataFrame:
    """(symbol, side, entry_dt, exit_dt, bars, ret): the stretches in which a backtest held one side."""
    by = Window.partitionBy("symbol").orderBy("dt")
    side = F.signum("position")
    rows = tested.withColumn("_s", side).withColumn("_new", (F.coalesce(F.lag("_s").over(by), F.lit(0.0)) != F.col("_s")).cast("int"))
    rows = rows.withColumn("_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("_s <> 0").groupBy("symbol", "_id").agg(F.first("_s").alias("side"), F.min("dt").alias("entry_dt"), F.max("dt").alias("exit_dt"), F.count("*").alias("bars"), (F.product(1 + F.col("ret")) - 1).alias("ret"))
    return out.drop("_id")


def share_of_total(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("share", divide(F.col(column), F.sum(column).over(Window.partitionBy())))
