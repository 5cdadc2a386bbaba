"""Walk-forward ridge models from sufficient statistics.

For each date, n, sum x, sum x x', sum y and sum x y over its names are summed once. Any training window is a sum over dates, so all
rebalance dates, penalties and subsets of factors are solved from one scan. A label of date s is used at t only if s's label is known
strictly before t (purge).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import _ranked, divide


def date_statistics(df: DataFrame, factors: list[str], target: str) -> DataFrame:
    """(dt, n, sy, x: sums, xx: sums of products row by row, xy) of the names with all factors and the target, on each date."""
    rows = df.where(" and ".join(f"{c} is not null" for c in [*factors, target]))
    k = len(factors)
    sums = [F.sum(f) for f in factors] + [F.sum(F.col(factors[i]) * F.col(factors[j])) for i in range(k) for j in range(i, k)] + [F.sum(F.col(f) * F.col(target)) for f in factors]
    return rows.groupBy("dt").agg(F.count("*").cast("double").alias("n"), F.sum(target).alias("sy"), F.array(*sums).alias("s"))


def solve(n: float, sy: float, s: np.ndarray, k: int, alpha: float) -> tuple[np.ndarray, float]:
    """(weights on raw factors, constant) of the ridge on factors standardised over the window."""
    sx, tri, xy = s[:k], s[k : k + k * (k + 1) // 2], s[-k:]
    q = np.zeros((k, k))
    q[np.triu_indices(k)] = tri
    q = q + np.triu(q, 1).T
    mu, my = sx / n, sy / n
    d = np.sqrt(np.maximum(np.diag(q) / n - mu**2, 0))
    d = np.where(d > 0, d, 1.0)
    a = (q - n * np.outer(mu, mu)) / np.outer(d, d) + alpha * np.eye(k)
    w = np.linalg.solve(a, (xy - mu * sy) / d) / d
    return w, float(my - mu @ w)


def _fit(k: int, alpha: float):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [solve(r.n, r.sy, np.asarray(r.s, float), k, alpha) for r in pdf.itertuples()]
            yield pd.DataFrame({"dt": pdf.dt, "w": [w.tolist() for w, _ in out], "c": [c for _, c in out]})

    return run


def walk_forward_ridge(df: DataFrame, factors: list[str], target: str, horizon: int, every: DataFrame, window: int = 252, least_dates: int = 20, alpha: float = 1.0) -> DataFrame:
    """(dt, symbol, pred, target) on the dates of `every` (dt): each predicted by a ridge on the dates of its window before the purge."""
    stats = date_statistics(df, factors, target)
    dates = df.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))  # one row a date
    stats = stats.join(dates, "dt")
    targets = every.join(dates, "dt").select(F.col("dt").alias("t"), F.col("i").alias("ti"))
    m = 2 * len(factors) + len(factors) * (len(factors) + 1) // 2
    # a window's sums are the difference of two running sums over dates, so targets meet two rows each and not their whole window
    run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = dates.select("i").join(stats.drop("dt"), "i", "left")  # one row a date
    sums = whole.select("i", F.sum(F.coalesce("n", F.lit(0.0))).over(run).alias("n"), F.sum(F.coalesce("sy", F.lit(0.0))).over(run).alias("sy"), F.count("n").over(run).alias("d"), *(F.sum(F.coalesce(F.get("s", F.lit(j)), F.lit(0.0))).over(run).alias(f"s{j}") for j in range(m)))
    cols = ["n", "sy", "d", *(f"s{j}" for j in range(m))]
    late = targets.join(sums.withColumnRenamed("i", "hi"), F.col("ti") - horizon - 1 == F.col("hi")).withColumnsRenamed({c: f"{c}_b" for c in cols})
    both = late.join(sums.withColumnRenamed("i", "lo"), F.col("ti") - window - 1 == F.col("lo"), "left")
    part = {c: F.col(f"{c}_b") - F.coalesce(F.col(c), F.lit(0)) for c in cols}
    sums = both.select("t", part["n"].alias("n"), part["sy"].alias("sy"), F.array(*(part[f"s{j}"] for j in range(m))).alias("s"), part["d"].alias("d")).where((F.col("d") >= least_dates) & (F.col("n") > 0))
    fitted = sums.select(F.col("t").alias("dt"), "n", "sy", "s").mapInPandas(_fit(len(factors), alpha), "dt date, w array<double>, c double")
    rows = df.where(" and ".join(f"{c} is not null" for c in factors)).join(fitted, "dt")
    pred = sum((F.col(f) * F.get("w", F.lit(j)) for j, f in enumerate(factors)), F.col("c"))
    return rows.select("dt", "symbol", pred.alias("pred"), F.col(target).alias("target"))


def scorecard(preds: DataFrame, top: float = 0.2, cost_bps: float = 2.0, least: int = 8) -> DataFrame:
    """One row: mean rank correlation, its ratio, hit share, and mean, deviation of the long-short return after cost."""
    rows = preds.where("pred is not null and target is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dt"))).where(F.col("n") >= least)
    rows = rows.withColumns({"a": _ranked(F.col("pred"), "dt"), "b": _ranked(F.col("target"), "dt")})
    cov = F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")
    ls = F.avg(F.when(F.col("a") > 1 - top, F.col("target"))) - F.avg(F.when(F.col("a") <= top, F.col("target"))) - 2 * cost_bps / 1e4
    days = rows.groupBy("dt").agg(divide(cov, F.stddev_pop("a") * F.stddev_pop("b")).alias("ic"), ls.alias("ls"))
    return days.agg(F.count("*").alias("dates"), F.avg("ic").alias("rank_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).alias("rank_icir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"), F.avg("ls").alias("ls_mean"), F.stddev_pop("ls").alias("ls_std"))


def conformal_width(residuals: np.ndarray, alpha: float = 0.1) -> float | None:
    """Split-conformal half-width: the ceil((n + 1)(1 - alpha))-th smallest absolute residual; None below 8 of them."""
    r = np.sort(np.abs(residuals[np.isfinite(residuals)]))
    if len(r) < 8:
        return None
    return float(np.quantile(r, min(1.0, np.ceil((len(r) + 1) * (1 - alpha)) / len(r))))
