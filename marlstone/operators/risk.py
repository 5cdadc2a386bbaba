"""Risk and portfolio construction. What grows with the panel is aggregated in Spark; algebra on k x k matrices runs on the driver."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, divide, frame, full

from .indicators import PERIODS_A_YEAR



def returns(bars: DataFrame, lookback: int | None = None) -> DataFrame:
    """(symbol, dt, ret); with lookback, of the last so many dates of the panel."""
    rows = bars.withColumn("ret", divide(F.col("close"), F.lag("close").over(SERIES)) - 1).where("ret is not null").select("symbol", "dt", "ret")
    if lookback is None:
        return rows
    last = rows.select("dt").distinct().orderBy(F.desc("dt")).limit(lookback)
    return rows.join(F.broadcast(last), "dt", "left_semi")


def pair_stats(rets: DataFrame) -> DataFrame:
    """(a, b, n, cov, corr) of all pairs a < b of names, over their common dates."""
    a, b = rets.select("dt", F.col("symbol").alias("a"), F.col("ret").alias("x")), rets.select("dt", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    pairs = a.join(b, "dt").where("a < b")
    cov = F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), divide(cov, F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))


def covariance(rets: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and their sample covariance matrix. It is for portfolios, whose dense solvers need names^2 doubles on the driver (10,000 names:
    0.8 GB); covariances of larger universes stay distributed in pair_stats."""
    own = rets.groupBy("symbol").agg(F.var_samp("ret").alias("v")).orderBy("symbol").collect()
    names = [r.symbol for r in own]
    at = {n: i for i, n in enumerate(names)}
    m = np.diag([r.v or 0.0 for r in own]).astype(float)
    for r in pair_stats(rets).select("a", "b", "cov").collect():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.cov or 0.0
    return names, m


def effective_bets(cov: np.ndarray, w: np.ndarray) -> float:
    values, vectors = np.linalg.eigh(cov)
    part = (vectors.T @ w) ** 2 * np.clip(values, 1e-12, None)
    p = np.clip(part / part.sum() if part.sum() > 0 else np.full(len(w), 1 / len(w)), 1e-12, None)
    return float(np.exp(-(p * np.log(p)).sum()))


def diversification(cov: np.ndarray, w: np.ndarray) -> float:
    whole = math.sqrt(max(float(w @ cov @ w), 0.0))
    return float(w @ np.sqrt(np.diag(cov)) / whole) if whole > 0 else 1.0


def contributions(cov: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each name's share of the portfolio's variance."""
    whole = float(w @ cov @ w)
    return w * (cov @ w) / whole if whole > 0 else np.zeros(len(w))


def _box(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with 0 <= w <= cap and sum 1, by bisection on the shift."""
    lo, hi = float((w - cap).min()) - 1, float(w.max()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(w - (lo + hi) / 2, 0, cap)


def min_variance(cov: np.ndarray, cap: float = 1.0, rounds: int = 3000) -> np.ndarray:
    """Long-only weights of least variance under a cap, by projected gradient."""
    return mean_variance(np.zeros(len(cov)), cov, 1.0, cap, rounds)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 1.0, rounds: int = 3000) -> np.ndarray:
    n = len(cov)
    if cap * n < 1:
        raise ValueError("the cap leaves no weights that sum to 1")
    sigma = (cov + cov.T) / 2 + 1e-12 * np.eye(n)
    step = 1 / (aversion * np.linalg.eigvalsh(sigma)[-1])
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        new = _box(w - step * (aversion * sigma @ w - mu), cap)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def max_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Long-only weights of the best ratio of mean to deviation, found along aversions."""
    best = max((mean_variance(mu, cov, a, cap) for a in np.geomspace(0.1, 1e4, 25)), key=lambda w: (mu @ w) / math.sqrt(max(float(w @ cov @ w), 1e-18)))
    return best


def efficient_frontier(mu: np.ndarray, cov: np.ndarray, points: int = 15) -> list[tuple[float, float]]:
    """(deviation, mean) of long-only portfolios from least variance up."""
    return [(math.sqrt(float(w @ cov @ w)), float(mu @ w)) for w in (mean_variance(mu, cov, a) for a in np.geomspace(1e4, 0.1, points))]


def risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights with equal risk contributions: cyclical coordinate descent on the convex form."""
    n = len(cov)
    w = 1 / np.sqrt(np.clip(np.diag(cov), 1e-18, None))
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            rest = float(cov[i] @ w - cov[i, i] * w[i])
            w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i]) if cov[i, i] > 0 else 0.0
        if np.abs(w - old).max() < 1e-12 * max(1.0, np.abs(w).max()):
            break
    return w / w.sum()


def black_litterman(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, omega: np.ndarray, aversion: float = 2.5, tau: float = 0.05) -> np.ndarray:
    """Posterior means from market weights and views p r = q with uncertainty omega."""
    prior = aversion * cov @ market
    a, o = np.linalg.inv(tau * cov + 1e-12 * np.eye(len(cov))), np.linalg.inv(omega)
    return np.linalg.solve(a + p.T @ o @ p, a @ prior + p.T @ o @ q)


def var_cvar(rets: DataFrame, weights: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Historical value at risk and the mean beyond it, of (symbol, weight) held constant."""
    days = rets.join(weights, "symbol").groupBy("dt").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    edge = days.agg(F.percentile("ret", F.lit(alpha)).alias("var"))
    return days.crossJoin(F.broadcast(edge)).groupBy("var").agg(F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"), F.count("*").alias("days"))


def concentration(weights: DataFrame) -> DataFrame:
    whole = weights.agg(F.sum(F.abs("weight")).alias("s"))
    w = weights.crossJoin(F.broadcast(whole)).withColumn("w", divide(F.abs("weight"), F.col("s")))
    return w.agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max("w").alias("max_weight"), F.max_by("symbol", F.struct("w", "symbol")).alias("top_name")).withColumn("effective_n", divide(F.lit(1.0), F.col("hhi")))


def sector_exposure(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """Share of gross weight in each sector; names without one are 'other'."""
    w = weights.join(sectors, "symbol", "left").groupBy(F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.sum(F.abs("weight")).alias("gross"))
    return w.select("sector", divide(F.col("gross"), F.sum("gross").over(Window.partitionBy())).alias("share"))


def beta_to(portfolio: DataFrame, market: DataFrame) -> DataFrame:
    rows = portfolio.select("dt", F.col("ret").alias("x")).join(market.select("dt", F.col("ret").alias("y")), "dt")
    return rows.agg(divide(F.covar_samp("x", "y"), F.var_samp("y")).alias("beta"), F.count("*").alias("n"))


def stress(weights: DataFrame, betas: DataFrame, market_shock: float) -> DataFrame:
    return weights.join(betas, "symbol", "left").agg((F.sum(F.col("weight") * F.coalesce("beta", F.lit(1.0))) * market_shock).alias("loss"))


def inverse_vol(weights: DataFrame, bars: DataFrame, n: int = 20) -> DataFrame:
    """(dt, symbol, weight): weights over own volatility, rescaled to each date's gross."""
    vol = bars.withColumn("_r", divide(F.col("close"), F.lag("close").over(SERIES)) - 1).withColumn("vol", full(F.col("_r"), n, F.stddev_pop("_r").over(frame(n)))).select("symbol", "dt", "vol")
    rows = weights.join(vol, ["symbol", "dt"]).withColumn("_x", divide(F.col("weight"), F.col("vol"))).where("_x is not null")
    day = Window.partitionBy("dt")
    return rows.select("dt", "symbol", divide(F.col("_x") * F.sum(F.abs("weight")).over(day), F.sum(F.abs("_x")).over(day)).alias("weight"))


def vol_target(df: DataFrame, ret: str = "ret", target: float = 0.10, n: int = 21, cap: float = 2.0, periods: int = PERIODS_A_YEAR, out: str = "scale") -> DataFrame:
    """df with scale: target over the volatility realised up to the bar before, at most cap; 1 while it isn't known."""
    r = F.col(ret)
    df = df.withColumn("_v", full(r, n, F.stddev_pop(r).over(frame(n))) * math.sqrt(periods))
    before = F.lag("_v").over(SERIES)
    return df.withColumn(out, F.when(before == 0, cap).otherwise(F.coalesce(F.least(divide(F.lit(target), before), F.when(before.isNotNull(), cap)), F.lit(1.0)))).drop("_v")


def kelly_fraction(win: Column, ratio: Column, cap: float = 0.5) -> Column:
    return F.least(F.greatest(win - divide(1 - win, ratio), F.lit(0.0)), F.lit(cap))


def trend_regime(n: int = 200) -> Column:
    return F.coalesce(F.signum(F.col("close") - full(F.col("close"), n, F.avg("close").over(frame(n)))), F.lit(0.0))


def expanding_rank(df: DataFrame, x: str) -> DataFrame:
    """(symbol, dt, below, so_far): of the known values of x up to each bar, how many are less than the bar's own, and how many there are.

    A sorted list of each symbol's values grows by insertion, so a bar costs a binary search and not a pass over its history.
    """

    def run(pdf):
        seen, below = [], []
        pdf = pdf.sort_values("dt")
        for v in pdf[x].tolist():
            below.append(bisect_left(seen, v))
            insort(seen, v)
        return pdf.assign(below=below, so_far=range(1, len(below) + 1))[["symbol", "dt", "below", "so_far"]]

    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("dt", df.schema["dt"].dataType), T.StructField("below", T.LongType()), T.StructField("so_far", T.LongType())])
    return df.where(F.col(x).isNotNull()).select("symbol", "dt", x).groupBy("symbol").applyInPandas(run, schema)


def vol_regime(bars: DataFrame, n: int = 21, states: int = 3, history: int = 252, out: str = "vol_state") -> DataFrame:
    """State of each bar's realised volatility against its own past quantiles; the middle state before `history` bars.

    A value is above the (interpolated) p-quantile of N values that it is one of if more than p (N - 1) of them are less.
    """
    so_far = SERIES.rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("_r", divide(F.col("close"), F.lag("close").over(SERIES)) - 1).withColumn("_i", F.row_number().over(SERIES))
    df = df.withColumn("_v", full(F.col("_r"), n, F.stddev_pop("_r").over(frame(n))))
    df = df.join(expanding_rank(df, "_v").withColumnsRenamed({"below": "_below", "so_far": "_n"}), ["symbol", "dt"], "left")
    above = lambda k: (F.col("_below") > (F.col("_n") - 1) * (k / states)).cast("double")
    state = F.when(F.col("_v").isNotNull() & (F.col("_i") > history), sum((above(k) for k in range(1, states)), F.lit(0.0)))
    df = df.withColumn("_s", state).withColumn(out, F.coalesce(F.last("_s", ignorenulls=True).over(so_far), F.lit((states - 1) / 2)))
    return df.drop("_r", "_i", "_v", "_s", "_below", "_n")


def regime_scale(bars: DataFrame, bear: float = 0.5, wild: float = 0.4, slow: int = 200, n: int = 21, states: int = 3, history: int = 252) -> DataFrame:
    """bars with scale: less exposure in wild and in falling markets."""
    df = vol_regime(bars, n, states, history, "_vs").withColumn("_t", trend_regime(slow))
    part = F.col("_vs") / max(1, states - 1)
    return df.withColumn("scale", (1 - part * (1 - wild)) * F.when(F.col("_t") < 0, bear).otherwise(1.0)).drop("_vs", "_t")


def drift_regime(bars: DataFrame, n: int = 63, least: float = 0.6, out: str = "drift") -> DataFrame:
    """bars with drift: 1 where more than `least` of the n bars up to the one before closed up, else 0, as for bars with less history."""
    up = F.coalesce(F.col("close") > F.lag("close").over(SERIES), F.lit(False)).cast("double")
    df = bars.withColumn("_u", up).withColumn("_s", F.coalesce((full(F.col("_u"), n, F.avg("_u").over(frame(n))) > least).cast("double"), F.lit(0.0)))
    return df.withColumn(out, F.coalesce(F.lag("_s").over(SERIES), F.lit(0.0))).drop("_u", "_s")


def drift_gate(rows: DataFrame, factor: str, bars: DataFrame, n: int = 63, least: float = 0.6, activate_in: str = "drift", out: str = "gated") -> DataFrame:
    """rows (symbol, dt, factor) with the factor where the symbol's own drift state is the wanted one, else null, as for symbols without bars."""
    if activate_in not in ("drift", "non_drift"):
        raise ValueError(f"activate_in is drift or non_drift, not {activate_in!r}")
    state = drift_regime(bars, n, least, "_state").select("symbol", "dt", "_state")
    return rows.join(state, ["symbol", "dt"], "left").withColumn(out, F.when(F.col("_state") == (1.0 if activate_in == "drift" else 0.0), F.col(factor))).drop("_state")


def brinson(rows: DataFrame) -> DataFrame:
    """Allocation, selection and interaction by sector from (symbol, sector, port_w, bench_w, port_ret, bench_ret); see Brinson-Fachler.

    Weights are rescaled to 1. A sector that one side lacks takes the benchmark's return there.
    """
    clean = rows.select(F.coalesce("sector", F.lit("Unknown")).alias("sector"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("port_w", "bench_w", "port_ret", "bench_ret")))
    s = clean.groupBy("sector").agg(F.sum("port_w").alias("wp"), F.sum("bench_w").alias("wb"), F.sum(F.col("port_w") * F.col("port_ret")).alias("cp"), F.sum(F.col("bench_w") * F.col("bench_ret")).alias("cb"))
    t = s.agg(F.sum("wp").alias("tp"), F.sum("wb").alias("tb"), divide(F.sum("cb"), F.sum("wb")).alias("rb"))
    s = s.crossJoin(F.broadcast(t)).withColumns({"rbs": F.coalesce(divide(F.col("cb"), F.col("wb")), F.col("rb")), "pw": divide(F.col("wp"), F.col("tp")), "bw": divide(F.col("wb"), F.col("tb"))})
    s = s.withColumn("rps", F.coalesce(divide(F.col("cp"), F.col("wp")), F.col("rbs")))
    bet, pick = F.col("pw") - F.col("bw"), F.col("rps") - F.col("rbs")
    return s.select("sector", (bet * (F.col("rbs") - F.col("rb"))).alias("allocation"), (F.col("bw") * pick).alias("selection"), (bet * pick).alias("interaction"))


def portfolio_health(bars: DataFrame, weights: DataFrame, sectors: DataFrame, lookback: int = 120) -> tuple[dict[str, float], list[str]]:
    """(figures, warnings) of a book (symbol, weight): effective bets, diversification, mean correlation, concentration, tail losses and the largest
    sector. Names without a return on each of the last dates are left out of the matrix, and a warning says how many."""
    rets = returns(bars.join(weights.select("symbol"), "symbol", "left_semi"), lookback)
    days = rets.agg(F.countDistinct("dt").alias("n")).first().n
    whole = rets.join(rets.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") == days).select("symbol"), "symbol", "left_semi")
    names, cov = covariance(whole)
    held = {r.symbol: r.weight for r in weights.collect()}  # a book
    w = np.array([held[n] for n in names])
    w = w / np.abs(w).sum() if np.abs(w).sum() > 0 else w
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1.0)
    off = corr[np.triu_indices(len(names), 1)]
    tail, size = var_cvar(rets, weights).first(), concentration(weights).first()
    top = sector_exposure(weights, sectors).orderBy(F.desc("share")).first()
    figures = {
        "names": float(len(held)), "effective_bets": effective_bets(cov, w), "diversification": diversification(cov, w), "mean_correlation": float(off.mean()) if len(off) else 0.0,
        "hhi": size.hhi, "max_weight": size.max_weight, "var": tail["var"], "cvar": tail["cvar"], "top_sector_share": top.share,
    }
    said = []
    if len(names) < len(held):
        said.append(f"{len(held) - len(names)} names without a full history are not in the matrix")
    if figures["effective_bets"] < max(2, 0.25 * len(held)):
        said.append("few effective bets")
    if figures["mean_correlation"] > 0.6:
        said.append("names move together")
    if top.share > 0.5:
        said.append(f"more than half is in {top.sector}")
    return figures, said


def mixture_regime(bars: DataFrame, symbol: str, states: int = 3, lookback: int = 504, vol: int = 10) -> DataFrame:
    """(dt, ret, vol, state) of a name's last bars by a Gaussian mixture over return and volatility; states are ordered by mean return, 0 the worst."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    df = bars.where(F.col("symbol") == symbol).withColumn("ret", divide(F.col("close"), F.lag("close").over(SERIES)) - 1)
    df = df.withColumn("vol", full(F.col("ret"), vol, F.stddev_samp("ret").over(frame(vol)))).where("vol is not null").withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))).where(F.col("_i") <= lookback)
    rows = VectorAssembler(inputCols=["ret", "vol"], outputCol="_x").transform(df.select("dt", "ret", "vol"))
    model = GaussianMixture(k=states, featuresCol="_x", predictionCol="_k", seed=0).fit(rows)
    order = sorted(range(states), key=lambda k: float(model.gaussians[k].mean[0]))
    place = F.create_map(*(F.lit(x) for new, old in enumerate(order) for x in (old, new)))
    return model.transform(rows).select("dt", "ret", "vol", F.element_at(place, F.col("_k")).alias("state"))
