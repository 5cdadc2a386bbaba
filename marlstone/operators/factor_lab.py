"""Quality of a factor: what it adds to others, how long it lives, how crowded it is, and which factors pass all gates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, _ranked, divide, frame, full

from . import cross_section as CS
from .models import date_statistics

LAGS = (1, 3, 5, 10, 21, 42)


def _residual_fit(k: int):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for n, sy, s in zip(pdf.n, pdf.sy, pdf.s):
                s = np.asarray(s, float)
                q = np.zeros((k, k))
                q[np.triu_indices(k)] = s[k : k + k * (k + 1) // 2]
                q = q + np.triu(q, 1).T
                mu = s[:k] / n
                b = np.linalg.lstsq(q - n * np.outer(mu, mu), s[-k:] - mu * sy, rcond=1e-12)[0]
                out.append([float(sy / n - mu @ b), *b.tolist()])
            yield pd.DataFrame({"dt": pdf.dt, "beta": out})

    return run


def orthogonalize(df: DataFrame, x: str, refs: list[str], out: str = "orthogonal") -> DataFrame:
    """df with x less its least-squares fit on refs and a constant over each date; null on dates with fewer than len(refs) + 4 names.

    A date's sums are all that the fit needs, so the panel is aggregated once and the solved coefficients, one row a date, are joined back.
    """
    k = len(refs)
    sums = date_statistics(df, refs, x).where(F.col("n") >= k + 4)
    fitted = sums.select("dt", "n", "sy", "s").mapInPandas(_residual_fit(k), T.StructType([df.schema["dt"], T.StructField("beta", T.ArrayType(T.DoubleType()))]))
    fit = sum((F.col(r) * F.get("beta", F.lit(i + 1)) for i, r in enumerate(refs)), F.get("beta", F.lit(0)))
    return df.join(fitted, "dt", "left").withColumn(out, F.col(x) - fit).drop("beta")


def incremental_ic(df: DataFrame, x: str, refs: list[str], target: str) -> DataFrame:
    """One row: mean rank correlation of x, of what refs leave of it, and their ratio (null where the first is next to nothing)."""
    rest = orthogonalize(df, x, refs, "_rest")
    raw = CS.daily_rank_ic(df, x, target).agg(F.avg("ic").alias("raw_ic"))
    left = CS.daily_rank_ic(rest, "_rest", target).agg(F.avg("ic").alias("orthogonal_ic"))
    both = raw.crossJoin(F.broadcast(left))  # one row each
    return both.withColumn("incremental_ratio", F.when(F.abs("raw_ic") > 1e-8, divide(F.col("orthogonal_ic"), F.col("raw_ic"))))


def rolling_ic(df: DataFrame, factor: str, horizon: int = 21, window: int = 63) -> DataFrame:
    """(dt, ic): the mean of the last `window` days' rank correlations, from a third of them on (10 at least)."""
    days = CS.daily_rank_ic(df.withColumn("_t", CS.forward_return(horizon)), factor, "_t", 1).withColumn("ic", F.when(F.col("n") >= 5, F.col("ic")))
    dates = df.select("dt").distinct().join(days.select("dt", "ic"), "dt", "left")
    w = Window.orderBy("dt").rowsBetween(1 - window, 0)  # one row a date
    return dates.select("dt", F.when(F.count("ic").over(w) >= max(10, window // 3), F.avg("ic").over(w)).alias("ic"))


def lagged(df: DataFrame, factor: str, lags=LAGS) -> DataFrame:
    """(lag, ic, spread): mean rank correlation of the factor with the single-bar return `lag` bars on, and mean return of its top over its
    bottom fifth then."""
    df = df.withColumn("_r", divide(F.col("close"), F.lag("close").over(SERIES)) - 1).withColumn("_p", _ranked(F.col(factor), "dt"))
    rows = df.select("symbol", "dt", factor, "_p", *(F.lead("_r", k).over(SERIES).alias(f"_f{k}") for k in lags))
    ahead = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_f{k}").alias("fut")) for k in lags))).alias("a")
    rows = rows.select("dt", factor, "_p", ahead).select("dt", factor, "_p", "a.*")
    both = rows.where(F.col(factor).isNotNull() & F.col("fut").isNotNull()).withColumns({"_a": _ranked(F.col(factor), "dt", "lag"), "_b": _ranked(F.col("fut"), "dt", "lag")})
    cov = F.avg(F.col("_a") * F.col("_b")) - F.avg("_a") * F.avg("_b")
    ic = both.groupBy("lag", "dt").agg(F.count("*").alias("n"), divide(cov, F.stddev_pop("_a") * F.stddev_pop("_b")).alias("ic")).where("n >= 5").groupBy("lag").agg(F.avg("ic").alias("ic"))
    days = rows.groupBy("lag", "dt").agg((F.avg(F.when(F.col("_p") >= 0.8, F.col("fut"))) - F.avg(F.when(F.col("_p") <= 0.2, F.col("fut")))).alias("s"))
    return ic.join(days.groupBy("lag").agg(F.avg("s").alias("spread")), "lag", "full")


def _log_half_life(points: DataFrame, value: str) -> Column:
    """Over rows (lag, value, _first: the value at the least lag): ln 2 over the rate at which |value| falls, of the points of _first's sign;
    infinite where it doesn't fall, null with fewer than 3 points."""
    usable = (F.signum(value) == F.signum("_first")) & (F.abs(value) > 1e-12)
    y, x = F.when(usable, F.ln(F.abs(value))), F.when(usable, F.col("lag").cast("double"))
    slope = F.regr_slope(y, x)
    return F.when((F.count(y) >= 3) & (F.max(F.abs("_first")) > 0), F.when(slope >= -1e-12, float("inf")).otherwise(divide(F.lit(-math.log(2)), slope)))


def half_life(df: DataFrame, factor: str, lags=LAGS) -> DataFrame:
    """One row: the signal's half-life in bars by its own lag-1 autocorrelation (median over names), by the fall of its lagged rank
    correlations, and by that of its lagged spreads; and the median of those that are finite."""
    before = df.select("symbol", F.col(factor).alias("_x"), F.lag(factor).over(SERIES).alias("_y"))
    paired = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    a, b = F.when(paired, F.col("_x")), F.when(paired, F.col("_y"))
    each = before.groupBy("symbol").agg(F.count("_x").alias("n"), divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("rho")).where("n > 10")
    rho = each.agg(F.median("rho").alias("rho")).select(F.when((F.col("rho") > 0) & (F.col("rho") < 1), divide(F.lit(-math.log(2)), F.ln("rho"))).alias("ar1"))
    points = lagged(df, factor, lags)
    first = points.agg(F.min_by("ic", "lag").alias("_ic0"), F.min_by("spread", "lag").alias("_sp0"))
    points = points.crossJoin(F.broadcast(first))  # a row for each lag, and one row
    fits = [points.withColumn("_first", F.col(f0)).agg(_log_half_life(points, v).alias(name)) for v, f0, name in (("ic", "_ic0", "ic_decay"), ("spread", "_sp0", "quantile_spread"))]
    one = rho.crossJoin(F.broadcast(fits[0])).crossJoin(F.broadcast(fits[1]))
    good = F.filter(F.array("ar1", "ic_decay", "quantile_spread"), lambda v: v.isNotNull() & (v > 0) & (v < float("inf")))
    s, n = F.array_sort(good), F.size(good)
    middle = F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return one.withColumn("median", middle)


def decay_warning(df: DataFrame, factor: str, rebalance: int = 21, horizon: int = 21, window: int = 63) -> DataFrame:
    """One row: recent_ic, longterm_ic, half_life and whether the factor wears out: recent below half of the long-term correlation, or a
    half-life shorter than the time between rebalances."""
    roll = rolling_ic(df, factor, horizon, window).where("ic is not null")
    w = Window.orderBy(F.desc("dt"))
    ranked = roll.withColumn("_i", F.row_number().over(w)).crossJoin(F.broadcast(roll.agg(F.count("*").alias("_n"))))  # one row a date
    recent = F.when(F.col("_i") <= F.greatest(F.lit(10), F.floor(F.col("_n") / 10)), F.col("ic"))
    enough = F.count("*") >= 40
    figures = ranked.agg(F.when(enough, F.avg(recent)).alias("recent_ic"), F.when(enough, F.avg("ic")).alias("longterm_ic"))
    out = figures.crossJoin(F.broadcast(half_life(df, factor).select(F.col("median").alias("half_life"))))
    blunt = (F.col("longterm_ic") > 0.005) & (F.col("recent_ic") < 0.5 * F.col("longterm_ic"))
    return out.withColumn("is_blunt", F.coalesce(blunt, F.lit(False))).withColumn("is_short", F.coalesce(F.col("half_life") < rebalance, F.lit(False))).withColumn("warning", F.col("is_blunt") | F.col("is_short"))


def factor_to_signal(df: DataFrame, factor: str, lookback: int = 60, mode: str = "momentum", clip: float = 2.0) -> DataFrame:
    """df with signal: the factor's z-score over its own last bars, held to +-clip and scaled to [-1, 1]; negated for reversion, 0 if unknown."""
    if mode not in ("momentum", "reversion"):
        raise ValueError(f"mode is momentum or reversion, not {mode!r}")
    x, r = F.col(factor), frame(lookback)
    z = full(x, lookback, divide(x - F.avg(x).over(r), F.stddev_pop(x).over(r)))
    held = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))) / clip
    return df.withColumn("signal", F.coalesce(-held if mode == "reversion" else held, F.lit(0.0)))


def _pearson(a: Column, b: Column, w=None) -> Column:
    """Correlation over the rows that have both."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    of = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return divide(of(F.avg(x * y)) - of(F.avg(x)) * of(F.avg(y)), of(F.stddev_pop(x)) * of(F.stddev_pop(y)))


def factor_scorecard(df: DataFrame, factor: str, horizon: int = 21, existing: list[str] = ()) -> DataFrame:
    """A row per symbol: ic (correlation with the forward return), ic_ir (mean over deviation of the rolling one), autocorr, coverage,
    max_corr_existing and verdict."""
    f, t = F.col(factor), F.col("_t")
    win = max(63, 3 * horizon)
    df = df.withColumn("_t", CS.forward_return(horizon)).withColumn("_y", F.lag(factor).over(SERIES))
    both = f.isNotNull() & t.isNotNull()
    df = df.withColumn("_roll", F.when(F.count(F.when(both, f)).over(frame(win)) == win, _pearson(f, t, frame(win))))
    close = [F.when(F.count(F.when(f.isNotNull() & F.col(e).isNotNull(), f)) > 10, F.abs(_pearson(f, F.col(e)))) for e in existing]
    figures = df.groupBy("symbol").agg(
        F.when(F.count(F.when(both, f)) >= 10, _pearson(f, t)).alias("ic"), divide(F.avg("_roll"), F.stddev_pop("_roll")).alias("ic_ir"), F.when(F.count(f) > 3, _pearson(f, F.col("_y"))).alias("autocorr"),
        (F.count(f) / F.count(F.lit(1))).alias("coverage"), F.coalesce(F.greatest(F.lit(0.0), F.lit(0.0), *close), F.lit(0.0)).alias("max_corr_existing"),
    )
    why = F.concat_ws("; ", F.when(F.abs("ic") < 0.02, "weak predictive power"), F.when(F.abs("ic_ir") < 0.3, "unstable IC"), F.when(F.col("autocorr") < 0.5, "high turnover"), F.when(F.col("max_corr_existing") > 0.7, "redundant"))
    return figures.withColumn("verdict", F.when(why == "", "looks promising").otherwise(why))


def factor_return_correlation(df: DataFrame, factor: str, others: list[str], lookback: int = 63) -> DataFrame:
    """(dt, corr): rolling correlation of the factor's long-short returns with each other factor's, averaged over the others."""
    mine = CS.long_short_returns(df, factor).withColumnRenamed("ret", "_m")
    days = df.select("dt").distinct().join(mine, "dt", "left")
    for i, o in enumerate(others):
        days = days.join(CS.long_short_returns(df, o).withColumnRenamed("ret", f"_o{i}"), "dt", "left")
    w, least = Window.orderBy("dt").rowsBetween(1 - lookback, 0), max(20, lookback // 2)  # one row a date
    each = [F.when(F.count(F.when(F.col("_m").isNotNull(), F.col(f"_o{i}"))).over(w) >= least, _pearson(F.col("_m"), F.col(f"_o{i}"), w)) for i in range(len(others))]
    days = days.select("dt", *(c.alias(f"_c{i}") for i, c in enumerate(each)))
    known = sum((F.col(f"_c{i}").isNotNull().cast("double") for i in range(len(each))), F.lit(0.0))
    return days.select("dt", divide(sum((F.coalesce(f"_c{i}", F.lit(0.0)) for i in range(len(each))), F.lit(0.0)), known).alias("corr"))


def fit_hyperbolic_decay(points: DataFrame, t: str = "t", value: str = "ic") -> DataFrame:
    """One row (K, lam, half_life, r2): K / (1 + lam t) through the positive points, from the line through 1 / value; null with fewer than 4."""
    p = points.where(F.col(value) > 1e-12).select(F.col(t).cast("double").alias("t"), F.col(value).alias("y"))
    line = p.agg(F.count("*").alias("n"), F.regr_slope(1 / F.col("y"), F.col("t")).alias("b"), F.regr_intercept(1 / F.col("y"), F.col("t")).alias("a"), F.avg("y").alias("m"))
    line = line.withColumn("K", F.when((F.col("n") >= 4) & (F.col("a") > 0), 1 / F.col("a"))).withColumn("lam", F.col("b") * F.col("K"))
    each = p.crossJoin(F.broadcast(line)).withColumn("e", F.col("y") - divide(F.col("K"), 1 + F.col("lam") * F.col("t")))
    fit = each.groupBy("K", "lam").agg((1 - divide(F.sum(F.col("e") * F.col("e")), F.sum((F.col("y") - F.col("m")) * (F.col("y") - F.col("m"))))).alias("r2"))
    return fit.select("K", "lam", F.when(F.col("lam") > 0, 1 / F.col("lam")).when(F.col("lam").isNotNull(), float("inf")).alias("half_life"), "r2")


def mrp(rows: DataFrame, ret: str, regime: str, by: list[str] = ()) -> DataFrame:
    """The least annualised mean return over regimes: what a strategy earns in its worst market."""
    each = rows.where(F.col(ret).isNotNull() & F.col(regime).isNotNull()).groupBy(*by, regime).agg((F.avg(ret) * 252.0).alias("_m"))
    return each.groupBy(*by).agg(F.min("_m").alias("mrp"))


def _steady(values: list[Column]) -> Column:
    """Least over largest of values turned to the sign of their mean; 0 if one is against it, or if fewer than 2 are known."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v)
    turned = F.transform(known, lambda v: v * F.when(total < 0, -1.0).otherwise(1.0))
    share = F.least(F.greatest(divide(F.array_min(turned), F.array_max(turned)), F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(known) >= 2) & (F.array_max(turned) > 0), share).otherwise(0.0)


def alpha_eval(df: DataFrame, factor: str, existing: list[str] = (), horizon: int = 21, window: int = 63) -> DataFrame:
    """One row: predictive, robustness (rank correlations at 0.7, 1 and 1.3 times the horizon), diversity, stability, composite; mean_ic.

    What makes a factor plausible is for a reader to say: see the prompts in functions.prompts.
    """
    hs = sorted({max(1, round(horizon * m)) for m in (0.7, 1.0, 1.3)})
    df = df.withColumns({f"_h{h}": CS.forward_return(h) for h in hs})
    one = None
    for h in hs:
        ic = CS.daily_rank_ic(df, factor, f"_h{h}").agg(F.avg("ic").alias(f"_ic{h}"))
        one = ic if one is None else one.crossJoin(F.broadcast(ic))  # one row each
    for i, e in enumerate(existing):
        one = one.crossJoin(F.broadcast(CS.daily_rank_ic(df, factor, e).agg(F.abs(F.avg("ic")).alias(f"_e{i}"))))
    days = df.select("dt").distinct().join(CS.daily_rank_ic(df, factor, f"_h{horizon}").select("dt", "ic"), "dt", "left")
    known = days.where("ic is not null").count()  # one row a date
    win = min(window, max(20, known // 4))
    w = Window.orderBy("dt").rowsBetween(1 - win, 0)
    roll = days.select(F.when(F.count("ic").over(w) >= max(10, win // 2), F.avg("ic").over(w)).alias("r"))
    one = one.crossJoin(F.broadcast(roll.agg(F.coalesce(divide(F.abs(F.avg("r")), F.stddev_pop("r")), F.lit(0.0)).alias("_ir"))))
    alike = F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(f"_e{i}", F.lit(0.0)) for i in range(len(existing))))
    out = one.select(
        F.coalesce(F.least(F.abs(f"_ic{horizon}") / 0.05, F.when(F.col(f"_ic{horizon}").isNotNull(), 1.0)), F.lit(0.0)).alias("predictive"), _steady([F.col(f"_ic{h}") for h in hs]).alias("robustness"),
        F.least(F.greatest(1 - alike, F.lit(0.0)), F.lit(1.0)).alias("diversity"), (F.col("_ir") / (1 + F.col("_ir"))).alias("stability"), F.col(f"_ic{horizon}").alias("mean_ic"),
    )
    return out.withColumn("composite", (F.col("predictive") + F.col("robustness") + F.col("diversity") + F.col("stability")) / 4)


def prescreen(df: DataFrame, factors: list[str], horizon: int = 21, most: int = 12, least_ic: float = 0.01, most_corr: float = 0.85, rebalance: int | None = 21, crowding: dict[str, float] | None = None) -> list[dict]:
    """One entry per factor: rankic, half_life, max_corr_selected, crowding, decision. Gates in this order: weak, fast_decay, redundant (by
    falling strength, against those that passed), crowded ones (above 0.7) count half, capacity. Panels are reduced in Spark; the greedy
    pass is over one number for each factor and pair."""
    df = df.withColumn("_t", CS.forward_return(horizon))
    ics = {f: CS.daily_rank_ic(df, f, "_t").agg(F.avg("ic")).first()[0] for f in factors}
    rows = {f: {"name": f, "rankic": ics[f], "half_life": None, "max_corr_selected": None, "crowding": (crowding or {}).get(f), "decision": None} for f in factors}
    kept = []
    for f in factors:
        if ics[f] is None or abs(ics[f]) < least_ic:
            rows[f]["decision"] = "weak"
            continue
        rows[f]["half_life"] = life = half_life(df, f).first()["median"] if rebalance is not None else None
        if life is not None and life < rebalance:
            rows[f]["decision"] = "fast_decay"
        else:
            kept.append(f)
    kept.sort(key=lambda f: (-abs(ics[f]), f))
    alike = {}
    if len(kept) > 1:
        alike = {(r.a, r.b): abs(r["corr"] or 0.0) for r in CS.factor_correlation(df, kept).collect()}
    chosen = []
    for f in kept:
        rows[f]["max_corr_selected"] = worst = max((alike.get((f, c), alike.get((c, f), 0.0)) for c in chosen), default=0.0)
        if worst > most_corr:
            rows[f]["decision"] = "redundant"
        else:
            chosen.append(f)
    score = {f: abs(ics[f]) * (0.5 if len(chosen) > 1 and (rows[f]["crowding"] or 0.0) > 0.7 else 1.0) for f in chosen}
    for place, f in enumerate(sorted(chosen, key=lambda f: (-score[f], f))):
        rows[f]["decision"] = "selected" if place < max(1, most) else "capacity"
    return list(rows.values())


def is_causal(make, bars: DataFrame, cuts: list, factor: str = "factor", tolerance: float = 1e-9) -> bool:
    """Whether make(bars) gives each bar the same factor when the bars after each cut date are missing."""
    whole = make(bars).select("symbol", "dt", F.col(factor).alias("_a"))
    for cut in cuts:
        part = make(bars.where(F.col("dt") <= F.lit(cut))).select("symbol", "dt", F.col(factor).alias("_b"))
        moved = whole.join(part, ["symbol", "dt"]).where(F.col("_a").isNull() != F.col("_b").isNull()).limit(1).count()
        if moved or whole.join(part, ["symbol", "dt"]).where(F.abs(F.col("_a") - F.col("_b")) > tolerance).limit(1).count():
            return False
    return True


#: name -> a function of bars that adds the column `factor`.
CUSTOM: dict = {}


def register(name: str, make, sample: DataFrame, cuts: list) -> None:
    """Adds a factor to CUSTOM if it doesn't look ahead on a sample of bars."""
    if not is_causal(make, sample, cuts):
        raise ValueError(f"{name} changes when later bars are missing")
    CUSTOM[name] = make


def backtest_factor(make, bars: DataFrame, cuts: list | None = None, lookback: int = 60, mode: str = "momentum") -> DataFrame:
    """The backtest of a factor as a signal; with cuts, only if it doesn't look ahead."""
    from . import backtest as BT

    if cuts and not is_causal(make, bars, cuts):
        raise ValueError("the factor changes when later bars are missing")
    return BT.backtest(factor_to_signal(make(bars), "factor", lookback, mode))
