"""Cross-sections: standardisation, weights, rank correlations with forward returns, scorecards and crowding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import DATE, EPS, SERIES, _ranked, divide, frame, full

PRICE_FACTORS = ("mom20", "mom60", "mom120", "rev5", "rev10", "vol20", "dist_high60", "dist_low60")


def z(x: Column, *by: str) -> Column:
    """Population z-score over (dt, by); 0 where all values are equal."""
    w = Window.partitionBy("dt", *by)
    s = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when(s > 0, divide(x - F.avg(x).over(w), s)).otherwise(0.0))


def forward_return(horizon: int) -> Column:
    return divide(F.lead("close", horizon).over(SERIES), F.col("close")) - 1


def price_factors(bars: DataFrame, short: int = 20) -> DataFrame:
    """bars with eight factors of closes, as z-scores over each date. The windows are multiples of `short` (20: 5 to 120 bars)."""
    c, m = F.col("close"), short
    change = lambda n: divide(c, F.lag(c, n).over(SERIES)) - 1
    logr = F.when(F.lag(c).over(SERIES) > 0, F.ln(divide(c, F.lag(c).over(SERIES))))
    high, low = full(c, 3 * m, F.max(c).over(frame(3 * m))), full(c, 3 * m, F.min(c).over(frame(3 * m)))
    raw = {"mom20": change(m), "mom60": change(3 * m), "mom120": change(6 * m), "rev5": -change(max(1, m // 4)), "rev10": -change(max(1, m // 2)), "_lr": logr, "dist_high60": divide(c, high) - 1, "dist_low60": divide(c, low) - 1}
    df = bars.withColumns(raw).withColumn("vol20", full(F.col("_lr"), m, F.stddev_samp("_lr").over(frame(m)))).drop("_lr")
    return df.withColumns({f: z(F.col(f)) for f in PRICE_FACTORS})


def rank_and_weight(df: DataFrame, score: str, top: float = 0.2, long_short: bool = True) -> DataFrame:
    """(dt, symbol, weight): equal weights on the top (and bottom) fraction of each date's scores; ties go by symbol."""
    rows = df.where(F.col(score).isNotNull())
    up, down = Window.partitionBy("dt").orderBy(F.col(score).desc(), "symbol"), Window.partitionBy("dt").orderBy(F.col(score), F.col("symbol").desc())
    n = F.count(F.lit(1)).over(DATE)
    k = F.greatest(F.rint(n * top), F.lit(1.0))
    rows = rows.withColumns({"_k": k, "_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    weight = F.when(F.col("_u") <= F.col("_k"), 1.0 / F.col("_k"))
    if long_short:
        weight = weight.when(F.col("_d") <= F.col("_k"), -1.0 / F.col("_k"))
    return rows.select("dt", "symbol", weight.otherwise(0.0).alias("weight")).where("weight <> 0")


def daily_rank_ic(df: DataFrame, factor: str, target: str, least: int = 5) -> DataFrame:
    """(dt, n, ic): Spearman correlation over the names that have both, on dates with at least `least` of them."""
    rows = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull()).select("dt", F.col(factor).alias("f"), F.col(target).alias("t"))
    rows = rows.withColumns({"a": _ranked(F.col("f"), "dt"), "b": _ranked(F.col("t"), "dt")})
    cov = F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")
    days = rows.groupBy("dt").agg(F.count("*").alias("n"), divide(cov, F.stddev_pop("a") * F.stddev_pop("b")).alias("ic"))
    return days.where(F.col("n") >= least)


def ic_summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))


def quantile_returns(df: DataFrame, factor: str, target: str, q: int = 5) -> DataFrame:
    """Mean forward return of each of q buckets by the factor's rank on each date (ties by symbol)."""
    rows = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    r = F.row_number().over(Window.partitionBy("dt").orderBy(factor, "symbol"))
    rows = rows.withColumn("bucket", F.floor((r - 1) / F.count(F.lit(1)).over(DATE) * q).cast("int") + 1)
    days = rows.groupBy("dt", "bucket").agg(F.avg(target).alias("ret"))
    return days.groupBy("bucket").agg(F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("std_ret"), F.count("*").alias("dates"))


def ic_decay(df: DataFrame, factor: str, horizons=(1, 3, 5, 10)) -> DataFrame:
    """Mean rank correlation at each horizon."""
    df = df.withColumns({f"_h{h}": forward_return(h) for h in horizons})
    parts = [daily_rank_ic(df, factor, f"_h{h}").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("dates")).withColumn("horizon", F.lit(h)) for h in horizons]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_short_returns(df: DataFrame, factor: str, top: float = 0.2) -> DataFrame:
    """(dt, ret): the factor of the bar before buckets names, and their return on this bar is earned."""
    df = df.withColumns({"_f": F.lag(factor).over(SERIES), "_r": divide(F.col("close"), F.lag("close").over(SERIES)) - 1}).where("_f is not null and _r is not null")
    pct = _ranked(F.col("_f"), "dt")
    days = df.withColumn("_p", pct).groupBy("dt").agg(F.avg(F.when(F.col("_p") > 1 - top, F.col("_r"))).alias("up"), F.avg(F.when(F.col("_p") <= top, F.col("_r"))).alias("down"))
    return days.select("dt", (F.col("up") - F.col("down")).alias("ret"))


def holdings_overlap(df: DataFrame, a: str, b: str, top: float = 0.2, least: int = 5) -> DataFrame:
    """(dt, overlap): Jaccard likeness of two factors' top buckets."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": _ranked(F.col(a), "dt") > 1 - top, "_b": _ranked(F.col(b), "dt") > 1 - top})
    both, any_ = F.sum((F.col("_a") & F.col("_b")).cast("int")), F.sum((F.col("_a") | F.col("_b")).cast("int"))
    return rows.groupBy("dt").agg(F.count("*").alias("n"), divide(both.cast("double"), any_.cast("double")).alias("overlap")).where(F.col("n") >= least).select("dt", "overlap")


def valuation_spread(df: DataFrame, factor: str, value: str, top: float = 0.2) -> DataFrame:
    rows = df.where(F.col(factor).isNotNull() & F.col(value).isNotNull()).withColumn("_p", _ranked(F.col(factor), "dt"))
    days = rows.groupBy("dt").agg(F.avg(F.when(F.col("_p") > 1 - top, F.col(value))).alias("up"), F.avg(F.when(F.col("_p") <= top, F.col(value))).alias("down"))
    return days.select("dt", (F.col("up") - F.col("down")).alias("spread"))


def neutralize(df: DataFrame, x: str, group: str, style: str | None = None, out: str = "neutral", least: int = 5) -> DataFrame:
    """x less its group's mean on the date, then less its regression on a style; kept as it is on dates with fewer than `least` names."""
    df = df.withColumn("_g", F.col(x) - F.avg(x).over(Window.partitionBy("dt", group)))
    if style is None:
        return df.withColumnRenamed("_g", out)
    g, s = F.when(F.col(style).isNotNull(), F.col("_g")), F.when(F.col("_g").isNotNull(), F.col(style))
    cov = F.avg(g * s).over(DATE) - F.avg(g).over(DATE) * F.avg(s).over(DATE)
    beta = divide(cov, F.var_pop(s).over(DATE))
    rest = g - F.avg(g).over(DATE) - F.coalesce(beta, F.lit(0.0)) * (s - F.avg(s).over(DATE))
    return df.withColumn(out, F.when(F.count(g).over(DATE) >= least, rest).otherwise(F.col("_g"))).drop("_g")


def factor_correlation(df: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, corr): mean over dates of the rank correlations of all pairs, from one pass over rank columns."""
    rows = df.where(" and ".join(f"{f} is not null" for f in factors)).withColumns({f"_r_{f}": _ranked(F.col(f), "dt") for f in factors})
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    cells = [divide(F.avg(F.col(f"_r_{a}") * F.col(f"_r_{b}")) - F.avg(f"_r_{a}") * F.avg(f"_r_{b}"), F.stddev_pop(f"_r_{a}") * F.stddev_pop(f"_r_{b}")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    days = rows.groupBy("dt").agg(*cells)
    one = days.agg(*(F.avg(f"c{i}").alias(f"c{i}") for i in range(len(pairs))))
    made = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(made))


def churn(df: DataFrame, factor: str, top: float = 0.2) -> DataFrame:
    """(dt, churn): share of a date's top bucket that wasn't in the one of the date before."""
    tops = df.where(F.col(factor).isNotNull()).withColumn("_p", _ranked(F.col(factor), "dt")).where(F.col("_p") > 1 - top).select("dt", "symbol")
    dates = tops.select("dt").distinct().withColumn("before", F.lag("dt").over(Window.orderBy("dt")))  # one row a date
    old = tops.select(F.col("dt").alias("before"), "symbol", F.lit(1).alias("was"))
    return tops.join(dates, "dt").where("before is not null").join(old, ["before", "symbol"], "left").groupBy("dt").agg((1 - F.count("was") / F.count("*")).alias("churn"))


def top_by_sector(df: DataFrame, score: str, sector: str, n: int) -> DataFrame:
    w = Window.partitionBy(sector).orderBy(F.col(score).desc_nulls_last(), "symbol")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def liquidity_filter(bars: DataFrame, least_days: int = 60, least_dollars: float = 1e6, last: int = 60) -> DataFrame:
    """Symbols with enough bars and a high enough median of close x volume over their last bars."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    rows = bars.withColumn("_r", F.row_number().over(w)).withColumn("_dv", F.col("close") * F.col("volume"))
    agg = rows.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.percentile(F.when(F.col("_r") <= last, F.col("_dv")), F.lit(0.5)).alias("median_dollars"))
    return agg.where((F.col("n_bars") >= least_days) & (F.col("median_dollars") >= least_dollars))


def dynamic_universe(bars: DataFrame, asof, least_days: int = 60, least_adv: float = 0.0, window: int = 63) -> DataFrame:
    """As of a date: symbols with enough history and mean dollar volume over their last bars; what isn't known keeps a symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    rows = bars.where(F.col("dt") <= F.lit(asof)).withColumn("_r", F.row_number().over(w))
    agg = rows.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.avg(F.when(F.col("_r") <= window, F.col("close") * F.col("volume"))).alias("adv"))
    return agg.where((F.col("n_bars") >= least_days) & (F.col("adv").isNull() | (F.col("adv") >= least_adv)))


def crowding_score(overlap: Column, corr: Column, spread_pct: Column) -> Column:
    """Mean of what is known of three readings in [0, 1]."""
    parts = [F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in (overlap, corr, spread_pct)]
    known = sum((c.isNotNull().cast("int") for c in parts), F.lit(0))
    return divide(sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)), known.cast("double"))


__all__ = [n for n in globals() if not n.startswith("_") and n not in ("EPS", "math")]
