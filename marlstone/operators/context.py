"""Readings of the market around a portfolio: index regime, breadth, overlays, macro blends, peers and sector scores, gates and hedges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, divide, frame, full
from marlstone.functions.scalars import MACRO_WEIGHTS, blend, clip, regime_of

# Weights of the parts of the market layer.
OVERLAY_WEIGHTS = {"index": 0.5, "breadth": 0.2, "macro": 0.3}


def index_regime(bars: DataFrame, slow: int = 200, lookback: int = 63, vol: int = 20, least: int = 30) -> DataFrame:
    """A row per index: score in [-1, 1] of its last bar from the distance to its slow mean, its momentum and its volatility; above_ma, momentum,
    ann_vol and regime. The mean takes at most all bars but one; an index with fewer than `least` closes has score 0."""
    df = bars.where("close is not null").withColumns({"_i": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))), "_r": divide(F.col("close"), F.lag("close").over(SERIES)) - 1})
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = df.withColumn("_n", n).withColumn("_past", F.col("_i") - 1)
    last = rows.groupBy("symbol").agg(
        F.max("_n").alias("n"), F.max(F.when(F.col("_i") == 1, F.col("close"))).alias("px"),
        F.avg(F.when(F.col("_i") <= F.least(F.lit(slow), F.col("_n") - 1), F.col("close"))).alias("ma"),
        F.max(F.when(F.col("_i") == lookback, F.col("close"))).alias("was"), F.stddev_pop(F.when(F.col("_i") <= vol, F.col("_r"))).alias("sd"),
    )
    mom = F.when(F.col("n") > lookback, divide(F.col("px"), F.col("was")) - 1).otherwise(0.0)
    rv = F.when(F.col("n") > vol, F.col("sd") * math.sqrt(252)).otherwise(0.0)
    last = last.withColumns({"momentum": mom, "ann_vol": rv, "above_ma": F.col("px") > F.col("ma")})
    trend = F.coalesce(F.tanh((divide(F.col("px"), F.col("ma")) - 1) * 8), F.lit(0.0))
    score = trend * 0.5 + F.tanh(F.col("momentum") * 6) * 0.35 - F.tanh((F.col("ann_vol") - 0.15) / 0.15) * 0.15
    last = last.withColumn("score", F.when(F.col("n") >= least, clip(score)).otherwise(0.0))
    return last.select("symbol", "score", "above_ma", "momentum", "ann_vol", regime_of(F.col("score")).alias("regime"))


def market_breadth(bars: DataFrame, n: int = 50) -> DataFrame:
    """One row: the share of names whose last close is above their n-bar mean (of those with more than n bars), and the share as a score."""
    rows = bars.where("close is not null").withColumn("_ma", full(F.col("close"), n, F.avg("close").over(frame(n)))).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    last = rows.where(F.col("_k") > n).groupBy("symbol").agg(F.max_by(F.struct("close", "_ma"), "dt").alias("b"))
    out = last.agg(F.count("*").alias("n"), F.avg((F.col("b.close") > F.col("b._ma")).cast("double")).alias("breadth"))
    return out.select("breadth", F.coalesce(F.col("breadth") * 2 - 1, F.lit(0.0)).alias("score"), "n")


def market_overlay(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The market layer's score from those of index, breadth and macro that are known."""
    return clip(blend(parts, {**OVERLAY_WEIGHTS, **(weights or {})}))


def macro_score(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The macro layer's score from the readings of vix, rates, curve, econ, geo and event that are known, by weights over these."""
    return clip(blend(parts, {**MACRO_WEIGHTS, **(weights or {})}))


def peers(universe: DataFrame) -> DataFrame:
    """(symbol, peer): the other names of each name's sector. The result is of that size: sectors of a universe are short lists."""
    a, b = universe.select("symbol", "sector"), universe.select(F.col("symbol").alias("peer"), "sector")
    return a.join(b, "sector").where("symbol <> peer").select("symbol", "peer")


def by_sector(universe: DataFrame) -> DataFrame:
    return universe.groupBy("sector").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def propagate_event(events: DataFrame, universe: DataFrame, share: float = 0.5) -> DataFrame:
    """(symbol, peer, spillover): an event's impact (symbol, impact) reaches the peers of its name at half its size."""
    return peers(universe).join(events, "symbol").select("symbol", "peer", (F.col("impact") * share).alias("spillover"))


def sector_scores(universe: DataFrame, scores: DataFrame) -> DataFrame:
    """universe (symbol, sector) with its sector's score, 0 for sectors without one."""
    return universe.join(scores.select("sector", F.col("score").alias("sector_score")), "sector", "left").withColumn("sector_score", F.coalesce("sector_score", F.lit(0.0)))


def context_gate(factors: DataFrame, context: DataFrame, least: float = 0.3) -> DataFrame:
    """factors (name, ...) with is_active and reason: off where the context (name, activation, relevance) says so or finds it little relevant;
    a factor that it doesn't name stays on."""
    df = factors.join(context.select("name", "activation", "relevance"), "name", "left")
    off, weak = F.col("activation") == F.lit(False), F.col("relevance") < least
    reason = F.concat_ws("; ", F.when(off, "not activated"), F.when(weak, "low relevance"))
    return df.withColumn("is_active", ~(F.coalesce(off, F.lit(False)) | F.coalesce(weak, F.lit(False)))).withColumn("reason", reason)


def hedge_ratio(beta: Column, macro: Column, market: Column) -> Column:
    """Share of the book to hedge: how hostile the known readings are, by the portfolio's beta (1 if unknown) between 0.5 and 2, halved."""
    known = macro.isNotNull().cast("double") + market.isNotNull().cast("double")
    risk = F.coalesce(divide(-F.coalesce(macro, F.lit(0.0)) - F.coalesce(market, F.lit(0.0)), known), F.lit(0.0))
    return F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)) * F.least(F.greatest(F.coalesce(beta, F.lit(1.0)), F.lit(0.5)), F.lit(2.0)) / 2


def earnings_setup(price: Column, iv: Column, days: Column, put_iv: Column, call_iv: Column, ratio: Column) -> tuple[Column, Column]:
    """(expected move, mean of the known option readings)."""
    from marlstone.functions import scalars as S

    return S.expected_move(price, iv, days), blend({"skew": S.iv_skew_signal(put_iv, call_iv), "pcr": S.put_call_signal(ratio)}, {"skew": 1.0, "pcr": 1.0})
