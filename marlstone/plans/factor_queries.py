"""Queries of the expression language: bars, one query for each operator, and the libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dsl
from marlstone.functions.library import ALPHA101, ALPHA158
from marlstone.sources import bars as B

from . import twins

QUERIES, ORACLES = {}, {}

#: One formula for each operator: with the names it goes by in the language.
EXAMPLES = {
    "delay": "delay(close, 3)", "delta": "delta(close, 5)", "ts_mean": "ts_mean(close, 10)", "ts_std": "ts_std(close, 10)", "ts_sum": "ts_sum(volume, 8)",
    "ts_max": "ts_max(high, 12)", "ts_min": "ts_min(low, 12)", "ts_skew": "ts_skew(close, 10)", "ts_kurt": "ts_kurt(close, 10)", "ts_median": "ts_median(close, 9)",
    "ema": "ema(close, 12)", "wma": "wma(close, 6)", "decay_linear": "decay_linear(volume, 5)", "ts_rank": "ts_rank(close, 10)", "ts_zscore": "ts_zscore(close, 15)",
    "ts_arg_max": "ts_arg_max(close, 10)", "ts_arg_min": "ts_arg_min(close, 10)", "ts_corr": "ts_corr(close, volume, 10)", "ts_cov": "ts_cov(close, open, 10) / 1000",
    "ts_quantile": "ts_quantile(close, 20, 0.8)", "roc": "roc(close, 4)", "slope": "slope(close, 10)", "rsquare": "rsquare(close, 10)", "resi": "resi(close, 10)",
    "abs": "abs(close - open)", "sign": "sign(close - open)", "log": "log(close - 1000)", "sqrt": "sqrt(open - close)", "exp": "exp(returns / 100)",
    "power": "power(close / 1000, 1.5)", "signedpower": "signedpower(returns, 2)", "greater": "greater(open, delay(close, 1))", "less": "less(open, delay(close, 1))",
    "where": "where(returns > 0, high, low)", "rank": "rank(close)", "zscore": "zscore(close)", "scale": "scale(close - open)", "quantile": "quantile(close, 0.1)",
    "group_rank": "group_rank(close)", "group_neutralize": "group_neutralize(close)", "arithmetic": "(close - open) % 7 + volume ** 0.5 * -1", "compare": "(close >= open) + (high != low) - (low < open)",
    "ternary": "(close if returns > 0 else open)", "kbar": "kmid2 + kup2 - klow2 + ksft2", "kbar_open": "kmid + klen + kup - klow + ksft", "wvma": "wvma(10)", "qtlu": "qtlu(20) - qtld(20)",
}


def bars(period: str, by: str):
    def run(spark, sf_dir):
        df = B.line_bars(spark, sf_dir, period, by)
        return df.select("symbol", "dt", *(F.round(c, 7).alias(c) for c in ("open", "high", "low", "close", "volume")), F.round(F.col("vwap") * F.col("volume"), 2).alias("traded"))

    return run


def bars_oracle(period: str, by: str) -> str:
    return f"WITH {twins.bars_sql(period, by)} SELECT symbol, dt, " + ", ".join(f"round({c}, 7) AS {c}" for c in ("open", "high", "low", "close", "volume")) + ", round(vwap * volume, 2) AS traded FROM bars"


def formulas(wanted: dict[str, str], digits: int = 6, group=None):
    def run(spark, sf_dir):
        panel = B.line_bars(spark, sf_dir)
        if group is not None:
            panel = panel.withColumn("grp", F.substring("symbol", 1, group))
        c = dsl.Compiler("grp" if group is not None else None)
        values = {n: c.add(f)[0] for n, f in wanted.items()}
        return c.apply(panel).select("symbol", "dt", *((F.round(v + twins.NUDGE, digits) + F.lit(0.0)).alias(n) for n, v in values.items()))

    return run


for _name, (_period, _by) in {"bars_w": ("week", "p_brand"), "bars_d": ("day", "p_brand"), "bars_m": ("month", "l_suppkey")}.items():
    QUERIES[_name], ORACLES[_name] = bars(_period, _by), bars_oracle(_period, _by)
for _name, _text in EXAMPLES.items():
    _group = 7 if _name.startswith("group") else None  # a brand's first digit
    QUERIES[f"dsl_{_name}"] = formulas({"value": _text}, group=_group)
    ORACLES[f"dsl_{_name}"] = twins.Twin("grp").sql({"value": _text}, group="substr(symbol, 1, 7)" if _group is not None else None)
# these two rank numbers that are equal up to noise (a correlation of two points; differences of logarithms): engines order them differently
_NOISY = ("alpha002", "alpha045")
_STABLE = {k: v for k, v in ALPHA101.items() if k not in _NOISY}
QUERIES["alpha101"], ORACLES["alpha101"] = formulas(_STABLE, 5), twins.Twin().sql(_STABLE, digits=5)
QUERIES["alpha101_noisy"] = formulas({k: ALPHA101[k] for k in _NOISY}, 5)
_ITEMS = list(ALPHA158.items())
for _k in range(2):
    _part = dict(_ITEMS[_k::2])
    QUERIES[f"alpha158_{_k + 1}"], ORACLES[f"alpha158_{_k + 1}"] = formulas(_part, 5), twins.Twin().sql(_part, digits=5)
