"""Searches over strategies: parameter grids, a bandit over families, ensembles of members, clusters of trials, robustness of a choice.

A configuration is a value of the column `config`; all configurations of a family are one plan over the panel, so a search costs a scan for
each family, not for each trial. What loops on the driver sees one figure a trial.
"""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import divide

from . import backtest as BT
from . import metrics, strategies, validation

#: Figures of which less is better.
LOWER_IS_BETTER = {"volatility"}


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def config_returns(bars: DataFrame, family: str, grid: dict[str, list] | None = None, commission: float = 1.0, slippage: float = 1.0) -> DataFrame:
    """(symbol, dt, config, signal, position, turnover, gross, ret) of every configuration of a family; config is its parameters as JSON."""
    out = None
    for params in combinations(strategies.PARAM_GRIDS[family] if grid is None else grid):
        tested = BT.backtest(strategies.REGISTRY[family](bars, **params), commission=commission, slippage=slippage)
        one = tested.select("symbol", "dt", F.lit(json.dumps(params, sort_keys=True)).alias("config"), "signal", "position", "turnover", "gross", "ret")
        out = one if out is None else out.unionByName(one)
    return out


def grid_search(bars: DataFrame, family: str, grid: dict[str, list] | None = None, metric: str = "sharpe", stress_bps: float = 0.0) -> DataFrame:
    """A row per symbol and configuration with its figures and place (1: best by metric; unknown ones last). With stress_bps, stressed_sharpe
    charges so much more on turnover, and takes the place of sharpe as the metric."""
    rows = config_returns(bars, family, grid).withColumn("_s", F.col("ret") - F.col("turnover") * (stress_bps / 1e4))
    figures = {"total_return": metrics.total_return("ret"), "cagr": metrics.cagr("ret"), "volatility": metrics.volatility("ret"), "sharpe": metrics.sharpe("ret"), "sortino": metrics.sortino("ret"), "win_rate": metrics.win_rate("ret"), "profit_factor": metrics.profit_factor("ret")}
    if stress_bps > 0:
        figures["stressed_sharpe"] = metrics.sharpe("_s")
        metric = "stressed_sharpe" if metric == "sharpe" else metric
    table = rows.groupBy("symbol", "config").agg(*(v.alias(k) for k, v in figures.items()), F.avg((F.col("position") != 0).cast("double")).alias("exposure"))
    order = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    return table.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(order, "config")))


def screen(bars: DataFrame, families: list[str] | None = None, grids: dict | None = None, folds: int = 4, least: int = 30) -> DataFrame:
    """(symbol, family, config, sharpe, oos_sharpe): each family's best configuration, and its Sharpe over the folds of a walk forward, in
    which it would have had to stand (null where the history is too short)."""
    out = None
    for family in families or list(strategies.REGISTRY):
        rows = config_returns(bars, family, (grids or {}).get(family))
        best = rows.groupBy("symbol", "config").agg(metrics.sharpe("ret").alias("sharpe"))
        best = best.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("sharpe").desc_nulls_last(), "config"))).where("_r = 1").drop("_r")
        own = rows.join(best, ["symbol", "config"])
        by = Window.partitionBy("symbol").orderBy("dt")
        placed = own.withColumn("_i", F.row_number().over(by) - 1).withColumn("_size", F.floor(F.count(F.lit(1)).over(Window.partitionBy("symbol")) / (folds + 1)))
        late = placed.withColumn("_o", F.when((F.col("_size") >= least) & (F.col("_i") >= F.col("_size")), F.col("ret")))
        one = late.groupBy("symbol", "config", "sharpe").agg(F.when(F.count("_o") > 0, metrics.sharpe("_o")).alias("oos_sharpe")).withColumn("family", F.lit(family))
        out = one if out is None else out.unionByName(one)
    return out.select("symbol", "family", "config", "sharpe", "oos_sharpe")


class UCB1:
    """A bandit: the arm with the largest mean reward plus sqrt(2 ln total / pulls); arms not yet pulled come first."""

    def __init__(self, arms: list[str]):
        self.arms, self.pulls, self.means = list(arms), dict.fromkeys(arms, 0), dict.fromkeys(arms, 0.0)

    def select(self) -> str:
        fresh = [a for a in self.arms if not self.pulls[a]]
        if fresh:
            return fresh[0]
        total = sum(self.pulls.values())
        return max(self.arms, key=lambda a: self.means[a] + math.sqrt(2 * math.log(total) / self.pulls[a]))

    def update(self, arm: str, reward: float) -> None:
        self.pulls[arm] += 1
        self.means[arm] += (reward - self.means[arm]) / self.pulls[arm]


def reward(sharpe: float | None) -> float:
    """A Sharpe ratio as a number between 0 and 1; 0 if it isn't known."""
    return 1 / (1 + math.exp(-sharpe)) if sharpe is not None and math.isfinite(sharpe) else 0.0


def research(bars: DataFrame, symbol: str, iterations: int = 30, families: list[str] | None = None, grids: dict | None = None, seed: int = 0) -> list[dict]:
    """The trials of a bandit over families on one symbol, best first: each draws a configuration and is rewarded by its Sharpe out of sample.

    Every family's grid is evaluated once in Spark when it is first drawn; further draws look their figure up.
    """
    own, rng = bars.where(F.col("symbol") == symbol), random.Random(seed)
    bandit, known, trials = UCB1(families or list(strategies.REGISTRY)), {}, []
    for _ in range(max(iterations, 1)):
        family = bandit.select()
        if family not in known:
            rows = config_returns(own, family, (grids or {}).get(family)).withColumn("_i", F.percent_rank().over(Window.partitionBy("config").orderBy("dt")))
            late = rows.where("_i > 0.6").groupBy("config").agg(metrics.sharpe("ret").alias("oos"))
            known[family] = {r.config: r.oos for r in late.collect()}  # one row a configuration
        config = rng.choice(sorted(known[family]))
        sharpe = known[family][config]
        bandit.update(family, reward(sharpe))
        trials.append({"family": family, "config": config, "oos_sharpe": sharpe})
    return sorted(trials, key=lambda t: (-(t["oos_sharpe"] if t["oos_sharpe"] is not None else -math.inf), t["family"], t["config"]))


def _lagged_sharpe(rows: DataFrame, by: list[str], halflife: float, least: int) -> DataFrame:
    """rows (by..., dt, ret) with _sh: annualised exponentially weighted Sharpe of the rows before, in each group; null before `least` of them.

    The recursion over a group is folded in closed form: weights q^age over running sums, in frames of rows, so nothing is collected. Frames
    end after 40 half-lives, beyond which weights are below 1e-12.
    """
    q = 0.5 ** (1 / halflife)
    w = Window.partitionBy(*by).orderBy("dt")
    i = F.row_number().over(w)
    span = w.rowsBetween(-int(40 * halflife), 0)
    # within one frame, q^(now - i) = q^now / q^i; i is counted in blocks so that powers stay in range
    df = rows.withColumn("_i", i.cast("double"))
    pairs = F.collect_list(F.struct("_i", F.coalesce("ret", F.lit(0.0)).alias("r"))).over(span)
    df = df.withColumn("_h", pairs)
    weight = lambda x: F.pow(F.lit(q), F.col("_i") - x["_i"])
    add = lambda f: F.aggregate("_h", F.lit(0.0), lambda s, x: s + f(x))
    df = df.withColumns({"_w": add(weight), "_w2": add(lambda x: weight(x) * weight(x)), "_m": add(lambda x: weight(x) * x["r"])}).withColumn("_m", F.col("_m") / F.col("_w"))
    var = add(lambda x: weight(x) * (x["r"] - F.col("_m")) * (x["r"] - F.col("_m"))) / F.col("_w")
    df = df.withColumn("_v", divide(var * F.col("_w") * F.col("_w"), F.col("_w") * F.col("_w") - F.col("_w2")))
    sharpe = F.when((F.col("_i") >= least) & (F.col("_v") > 0), F.col("_m") / F.sqrt("_v") * math.sqrt(252))
    return df.withColumn("_now", sharpe).withColumn("_sh", F.lag("_now").over(w)).drop("_i", "_h", "_w", "_w2", "_m", "_v", "_now")


def _softmax(rows: DataFrame, over: list[str], temperature: float) -> DataFrame:
    z = F.exp(F.least(F.greatest(F.coalesce("_sh", F.lit(0.0)) / max(temperature, 1e-6), F.lit(-10.0)), F.lit(10.0)))
    return rows.withColumn("weight", z / F.sum(z).over(Window.partitionBy(*over))).drop("_sh")


def ewma_weights(members: DataFrame, halflife: float = 63, temperature: float = 1.0, least: int = 10) -> DataFrame:
    """members (symbol, dt, member, ret) with weight: softmax over members of their exponentially weighted Sharpe up to the bar before; a
    member whose ratio isn't known counts as neutral."""
    return _softmax(_lagged_sharpe(members, ["symbol", "member"], halflife, least), ["symbol", "dt"], temperature)


def regime_weights(members: DataFrame, states: DataFrame, halflife: float = 63, temperature: float = 1.0, least: int = 20) -> DataFrame:
    """As ewma_weights, with each member's ratio over earlier bars of the same state only. states: (symbol, dt, state)."""
    rows = members.join(states.select("symbol", "dt", "state"), ["symbol", "dt"], "left")
    return _softmax(_lagged_sharpe(rows, ["symbol", "member", "state"], halflife, least), ["symbol", "dt"], temperature)


def blend_signals(members: DataFrame) -> DataFrame:
    """(symbol, dt, signal): the weighted sum of members' signals (symbol, dt, member, signal, weight)."""
    return members.groupBy("symbol", "dt").agg(F.sum(F.coalesce("signal", F.lit(0.0)) * F.col("weight")).alias("signal"))


def ensemble(bars: DataFrame, members: list[tuple[str, dict]], weighting: str = "ewma", halflife: float = 63, states: DataFrame | None = None) -> DataFrame:
    """The backtest of a blend of strategies (family, parameters), weighted equally, by ewma or by regime."""
    rows = None
    for i, (family, params) in enumerate(members):
        tested = BT.backtest(strategies.REGISTRY[family](bars, **params))
        one = tested.select("symbol", "dt", F.lit(i).alias("member"), "signal", "ret")
        rows = one if rows is None else rows.unionByName(one)
    if weighting == "equal" or len(members) == 1:
        weighted = rows.withColumn("weight", F.lit(1.0 / len(members)))
    else:
        weighted = regime_weights(rows, states, halflife) if weighting == "regime" else ewma_weights(rows, halflife)
    return BT.backtest(bars.join(blend_signals(weighted), ["symbol", "dt"], "left"))


def trial_correlations(trials: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and correlations of trials (dt, trial, ret) over their common dates: a matrix of trials, not of rows."""
    names = sorted(r.trial for r in trials.select("trial").distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    a, b = trials.select("dt", F.col("trial").alias("a"), F.col("ret").alias("x")), trials.select("dt", F.col("trial").alias("b"), F.col("ret").alias("y"))
    cells = a.join(b, "dt").where("a < b").groupBy("a", "b").agg(divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("c")).collect()
    m = np.eye(len(names))
    for r in cells:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.c or 0.0
    return names, m


def k_medoids(distance: np.ndarray, k: int, rounds: int = 30) -> tuple[np.ndarray, list[int]]:
    """(labels, medoids): from the most central point and then the farthest ones; ties go to the first."""
    n = len(distance)
    chosen = [int(distance.sum(1).argmin())]
    while len(chosen) < min(k, n):
        gap = distance[:, chosen].min(1)
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
    for _ in range(rounds):
        labels = distance[:, chosen].argmin(1)
        moved = []
        for j, old in enumerate(chosen):
            own = np.flatnonzero(labels == j)
            moved.append(int(own[distance[np.ix_(own, own)].sum(1).argmin()]) if len(own) else old)
        if moved == chosen:
            break
        chosen = moved
    return distance[:, chosen].argmin(1), chosen


def cluster_trials(trials: DataFrame, k: int = 5) -> tuple[dict[str, int], list[str]]:
    """(cluster of each trial, the trial at each cluster's centre) by one less correlation."""
    names, corr = trial_correlations(trials)
    if not names:
        return {}, []
    labels, medoids = k_medoids(1 - corr, max(1, k))
    return dict(zip(names, labels.tolist())), [names[m] for m in medoids]


def selection_robustness(trials: DataFrame) -> dict[str, float]:
    """Of trials (dt, trial, ret): the probability that the choice is overfit, the chance that the best ratio is luck, and how many there were."""
    each = trials.groupBy("trial").agg(F.count("ret").alias("n"), metrics.sharpe("ret", periods=1).alias("s")).collect()  # one row a trial
    sharpes = [r.s for r in each]
    best = max(each, key=lambda r: (r.s, r.trial))
    spread = float(np.std(sharpes, ddof=1)) if len(sharpes) > 1 else 0.0
    return {"pbo": float(validation.pbo(trials)), "expected_max_sharpe": float(validation.expected_max_sharpe(len(each), spread)), "best_sharpe": float(best.s), "trials": float(len(each))}


def warm_start(bars: DataFrame, remembered: list[tuple[str, dict]]) -> DataFrame:
    """(symbol, family, config, sharpe): what remembered configurations are worth on these bars, best first by symbol."""
    out = None
    for family, params in remembered:
        one = config_returns(bars, family, {k: [v] for k, v in params.items()}).groupBy("symbol", "config").agg(metrics.sharpe("ret").alias("sharpe")).withColumn("family", F.lit(family))
        out = one if out is None else out.unionByName(one)
    return out.select("symbol", "family", "config", "sharpe")


def best_by(table: DataFrame, metric: Column, by: list[str]) -> DataFrame:
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(metric.desc_nulls_last()))).where("_r = 1").drop("_r")


