"""Kernels of the expression language as Spark columns. Every result is NULL where it isn't known, never NaN or infinite."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.window import WindowSpec
from pyspark.sql.window import Window

EPS = 1e-12


class LazySpec(WindowSpec):
    """A window that is made when it is used, so that modules can be imported before there is a session."""

    def __new__(cls, make):
        return object.__new__(cls)

    def __init__(self, make):
        self._make = make

    @property
    def _jspec(self):
        return self._make()._jspec


SERIES = LazySpec(lambda: Window.partitionBy("symbol").orderBy("dt"))
DATE = LazySpec(lambda: Window.partitionBy("dt"))


def frame(n: int):
    return SERIES.rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column) -> Column:
    """value where the last n bars all have x."""
    return F.when(F.count(x).over(frame(n)) == n, value)


def clean(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _weights(n: int) -> list[float]:
    return [(n - k) * 2.0 / (n * (n + 1)) for k in range(n)]


def _corr(x: Column, y: Column, n: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = frame(n)
    cov = F.avg(a * b).over(r) - F.avg(a).over(r) * F.avg(b).over(r)
    # beyond nine digits the sums form is noise, which must not decide ranks
    return full(a, n, F.round(divide(cov, F.stddev_pop(a).over(r) * F.stddev_pop(b).over(r)), 9))


def _skew(x: Column, n: int) -> Column:
    return full(x, n, F.skewness(x).over(frame(n)) * (math.sqrt(n * (n - 1)) / (n - 2))) if n > 2 else F.lit(None).cast("double")


def _kurt(x: Column, n: int) -> Column:
    return full(x, n, ((n + 1) * F.kurtosis(x).over(frame(n)) + 6) * ((n - 1) / ((n - 2) * (n - 3)))) if n > 3 else F.lit(None).cast("double")


def _place(x: Column, n: int, best) -> Column:
    return full(x, n, (F.array_position(F.collect_list(x).over(frame(n)), best(x).over(frame(n))) - 1).cast("double"))


def _ranked(x: Column, *by: str) -> Column:
    has = x.isNull()
    order = Window.partitionBy(*by, has).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(~has, (F.rank().over(order) + (ties - 1) / 2.0) / F.count(x).over(Window.partitionBy(*by)))


def _winsor(x: Column, q: float) -> Column:
    lo, hi = F.percentile(x, F.lit(q)).over(DATE), F.percentile(x, F.lit(1 - q)).over(DATE)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def _power(x: Column, p: Column) -> Column:
    return clean(F.when(~((x == 0) & (p < 0)), F.pow(x, p)))


def _index() -> Column:
    return F.col("_i").cast("double")


#: name -> function of (columns..., literals). Names that share a kernel are listed together.
TIME_SERIES = {
    "delay ref": lambda x, n: F.lag(x, n).over(SERIES),
    "delta": lambda x, n: x - F.lag(x, n).over(SERIES),
    "ts_mean sma mean": lambda x, n: full(x, n, F.avg(x).over(frame(n))),
    "ts_std std": lambda x, n: full(x, n, F.stddev_samp(x).over(frame(n))),
    "ts_sum sum": lambda x, n: full(x, n, F.sum(x).over(frame(n))),
    "ts_max max": lambda x, n: full(x, n, F.max(x).over(frame(n))),
    "ts_min min": lambda x, n: full(x, n, F.min(x).over(frame(n))),
    "ts_skew skew": _skew,
    "ts_kurt kurt": _kurt,
    "ts_median": lambda x, n: full(x, n, F.percentile(x, F.lit(0.5)).over(frame(n))),
    "wma decay_linear ts_decay_linear": lambda x, n: full(x, n, sum((F.lag(x, k).over(SERIES) * w for k, w in enumerate(_weights(n))), F.lit(0.0))),
    "ts_rank": lambda x, n: full(x, n, F.size(F.filter(F.collect_list(x).over(frame(n)), lambda v: v <= F.element_at(F.collect_list(x).over(frame(n)), -1))) / float(n)),
    "ts_zscore": lambda x, n: full(x, n, (x - F.avg(x).over(frame(n))) / (F.stddev_samp(x).over(frame(n)) + EPS)),
    "ts_arg_max ts_argmax imax idxmax": lambda x, n: _place(x, n, F.max),
    "ts_arg_min ts_argmin imin idxmin": lambda x, n: _place(x, n, F.min),
    "ts_corr corr": _corr,
    "ts_cov cov": lambda x, y, n: full(F.when(y.isNotNull(), x), n, F.covar_samp(x, y).over(frame(n))),
    "ts_quantile": lambda x, n, q: full(x, n, F.percentile(x, F.lit(q)).over(frame(n))),
    "roc": lambda x, n: divide(x, F.lag(x, n).over(SERIES)) - 1,
    "slope": lambda x, n: full(x, n, F.regr_slope(x, _index()).over(frame(n))),
    "rsquare rsqr": lambda x, n: full(x, n, F.when(F.stddev_pop(x).over(frame(n)) == 0, 0.0).otherwise(F.regr_r2(x, _index()).over(frame(n)))),
    "resi": lambda x, n: full(x, n, x - (F.regr_intercept(x, _index()).over(frame(n)) + F.regr_slope(x, _index()).over(frame(n)) * _index())),
}
CROSS_SECTION = {
    "rank": lambda x: _ranked(x, "dt"),
    "zscore": lambda x: (x - F.avg(x).over(DATE)) / (F.stddev_samp(x).over(DATE) + EPS),
    "scale": lambda x, a=1.0: divide(x * a, F.sum(F.abs(x)).over(DATE)),
    "quantile": _winsor,
}
GROUPED = {
    "group_rank": lambda x, g: _ranked(x, "dt", g),
    "group_neutralize": lambda x, g: x - F.avg(x).over(Window.partitionBy("dt", g)),
}
ROW = {
    "abs": F.abs,
    "sign": lambda x: F.signum(x),
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "exp": lambda x: clean(F.exp(x)),
    "power pow": _power,
    "signedpower": lambda x, p: clean(F.signum(x) * F.pow(F.abs(x), p)),
    "greater": lambda x, y: F.when(x >= y, x).otherwise(y),
    "less": lambda x, y: F.when(x <= y, x).otherwise(y),
    "where if": lambda c, a, b: F.when(c.isNull(), None).when(c != 0, a).otherwise(b),
}
BINARY = {
    "+": lambda x, y: x + y,
    "-": lambda x, y: x - y,
    "*": lambda x, y: x * y,
    "/": divide,
    "**": _power,
    "%": lambda x, y: x - y * F.floor(divide(x, y)),
}
COMPARE = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}


def by_name(table: dict) -> dict:
    return {name: fn for names, fn in table.items() for name in names.split()}
