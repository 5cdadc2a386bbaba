"""Is a backtest luck? Probabilistic and deflated Sharpe ratios, combinatorial cross-validation, and bootstrap tests.

Trials are rows (dt, trial, ret). Moments of each (block, trial) are summed once in Spark; all combinations of blocks are sums of these.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import divide

EULER = 0.5772156649015329


def moments(df: DataFrame, r: str = "ret", by: str = "symbol") -> DataFrame:
    """n, sr (a period, sample deviation), skew and kurt (moments over n, sample deviation) of each series."""
    rows = df.where(F.col(r).isNotNull())
    rows = rows.withColumn("_d", F.col(r) - F.avg(r).over(Window.partitionBy(by)))
    a = rows.groupBy(by).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.avg(F.pow("_d", F.lit(3.0))).alias("m3"), F.avg(F.pow("_d", F.lit(4.0))).alias("m4"))
    flat = (F.col("n") < 3) | F.col("s").isNull() | (F.col("s") == 0)
    over = lambda x, k, other: F.when(flat, other).otherwise(divide(F.col(x), F.pow("s", F.lit(float(k)))))
    return a.select(by, "n", over("m", 1, 0.0).alias("sr"), over("m3", 3, 0.0).alias("skew"), over("m4", 4, 3.0).alias("kurt"))


def psr(n: int, sr: float, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe ratio is above the benchmark, both a period."""
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if n < 3 or var <= 0:
        return float("nan")
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(var))


def probabilistic_sharpe(df: DataFrame, r: str = "ret", by: str = "symbol", benchmark: float = 0.0) -> DataFrame:
    """moments with z, the normal score of the probability that the Sharpe ratio beats the benchmark; the probability is its distribution function."""
    m = moments(df, r, by)
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    return m.withColumn("z", F.when((F.col("n") >= 3) & (var > 0), divide((F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1.0), F.sqrt(F.greatest(var, F.lit(0.0))))))


def expected_max_sharpe(trials: int, spread: float = 1.0) -> float:
    if trials < 2:
        return 0.0
    q = NormalDist().inv_cdf
    return spread * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(n: int, sr: float, skew: float, kurt: float, trials: int, spread: float | None = None) -> float:
    spread = math.sqrt((1 + sr * sr / 2) / max(n - 1, 1)) if spread is None else spread
    return psr(n, sr, skew, kurt, expected_max_sharpe(trials, spread))


def block_sums(trials: DataFrame, blocks: int) -> DataFrame:
    """(block, trial, n, s, q): count, sum and sum of squares of each trial's returns in each of `blocks` stretches of dates of equal length."""
    dates = trials.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")) - 1)  # one row a date
    n = dates.agg(F.count("*").alias("n_dates"))
    dates = dates.crossJoin(F.broadcast(n)).withColumn("block", F.least(F.floor(F.col("i") / F.greatest(F.floor(F.col("n_dates") / blocks), F.lit(1))), F.lit(blocks - 1)).cast("int"))
    return trials.join(dates.select("dt", "block"), "dt").groupBy("block", "trial").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))


def _cube(trials: DataFrame, blocks: int) -> tuple[list[str], np.ndarray]:
    rows = block_sums(trials, blocks).collect()  # blocks x trials cells
    names = sorted({r.trial for r in rows})
    at = {t: i for i, t in enumerate(names)}
    cube = np.zeros((blocks, len(names), 3))
    for r in rows:
        cube[r.block, at[r.trial]] = (r.n, r.s or 0.0, r.q or 0.0)
    return names, cube


def _sharpe(m: np.ndarray) -> np.ndarray:
    n = np.maximum(m[..., 0], 1)
    mean = m[..., 1] / n
    s = np.sqrt(np.maximum(m[..., 2] / n - mean**2, 0))
    return np.where(s > 1e-15, mean / np.where(s > 1e-15, s, 1), 0.0)


def pbo(trials: DataFrame, blocks: int = 10) -> float:
    """Share of the splits into two halves of the blocks in which the best trial of one half is below the median of the other."""
    _, cube = _cube(trials, blocks)
    if cube.shape[1] < 2:
        return float("nan")
    below = total = 0
    for half in itertools.combinations(range(blocks), blocks // 2):
        rest = [b for b in range(blocks) if b not in half]
        best = int(np.argmax(_sharpe(cube[list(half)].sum(0))))
        out = _sharpe(cube[rest].sum(0))
        rank = (np.sum(out < out[best]) + (np.sum(out == out[best]) + 1) / 2) / (len(out) + 1)
        below += rank < 0.5
        total += 1
    return below / total


def cpcv(trials: DataFrame, blocks: int = 8, held: int = 2, periods: int = 252) -> dict[str, list[float]]:
    """Out-of-sample Sharpe ratios (a year) of each trial over all choices of held blocks."""
    names, cube = _cube(trials, blocks)
    paths = [_sharpe(cube[list(c)].sum(0)) * math.sqrt(periods) for c in itertools.combinations(range(blocks), held)]
    return {t: [float(p[i]) for p in paths] for i, t in enumerate(names)}


def spa(matrix: np.ndarray, boots: int = 1000, block: int = 10, seed: int = 0) -> tuple[float, float]:
    """p-values of the best mean of a (dates x trials) matrix of excess returns against luck, as is and recentred, by stationary bootstrap."""
    n, _ = matrix.shape
    rng = np.random.default_rng(seed)
    mean = matrix.mean(0)
    dev = matrix.std(0)
    keep = mean >= -dev * math.sqrt(2 * math.log(math.log(max(n, 3))) / n)
    best = math.sqrt(n) * mean.max()
    hits = np.zeros(2)
    for _ in range(boots):
        fresh, start = rng.random(n) < 1 / block, rng.integers(0, n, n)
        at = np.empty(n, int)
        at[0] = start[0]
        for i in range(1, n):
            at[i] = start[i] if fresh[i] else (at[i - 1] + 1) % n
        moved = matrix[at].mean(0)
        hits += [math.sqrt(n) * (moved - mean).max() >= best, math.sqrt(n) * (moved - np.where(keep, mean, 0)).max() >= best]
    return float(hits[0] / boots), float(hits[1] / boots)
