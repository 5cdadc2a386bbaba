"""Queries over bars: indicators, strategies, backtests, cross-sections, risk, execution and scalars, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.functions.kernels import SERIES, divide
from marlstone.operators import backtest as BT
from marlstone.operators import cross_section as CS
from marlstone.operators import execution as X
from marlstone.operators import indicators as I
from marlstone.operators import metrics as M
from marlstone.operators import models, risk, strategies, validation
from marlstone.sources import bars as B
from marlstone.sources import files
from marlstone.streaming.bars import sessions, stream_bars

from .twins import NUDGE, bars_sql, over

QUERIES, ORACLES = {}, {}
_S = "OVER (PARTITION BY symbol ORDER BY dt)"
_RUN = "OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *((F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys))


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def weekly(spark, d):
    return B.line_bars(spark, d)


def monthly(spark, d):
    return B.line_bars(spark, d, "month", "l_suppkey")


def bars_cte(sql: str, period: str = "week", by: str = "p_brand", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{bars_sql(period, by)}, {sql}" if not sql.startswith("SELECT") else f"WITH {bars_sql(period, by)} {sql}"


def r(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({c})::DOUBLE + {NUDGE}, {digits}) + 0.0::DOUBLE AS {name or c}"  # no negative zeros


def full(x: str, n: int, v: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {v} END"


def ewm_sql(x: str, alpha: float, least: int) -> str:
    """A column of closed form over b (with _i from 1) for x without gaps after its first value."""
    q = 1 - alpha
    at = f"(_i - min(CASE WHEN {x} IS NOT NULL THEN _i END) OVER (PARTITION BY symbol))"
    return f"CASE WHEN count({x}) {_RUN} >= {least} THEN pow({q!r}, {x}_o) * sum(CASE WHEN {x}_o = 0 THEN {x} ELSE {alpha!r} * {x} * pow({q!r}, -{x}_o) END) {_RUN} END", f"{at} AS {x}_o"


# indicators
add(
    "indicators_window",
    lambda s, d: rounded(
        weekly(s, d).select("symbol", "dt", I.sma(F.col("close"), 10).alias("sma"), I.wma(F.col("close"), 5).alias("wma"), I.zscore(F.col("close"), 20).alias("z"), I.momentum(F.col("close"), 6).alias("mom"), I.roc(F.col("close"), 6).alias("roc"), I.true_range().alias("tr"), *(c.alias(n) for n, c in {**I.bollinger(F.col("close")), **I.donchian(10)}.items())),
        ["symbol", "dt"],
    ),
    bars_cte(
        "SELECT symbol, dt, "
        + ", ".join(
            r(v, n)
            for n, v in {
                "sma": full("close", 10, f"avg(close) {over(10)}"),
                "wma": full("close", 5, " + ".join(f"lag(close, {k}) {_S} * {(5 - k) / 15.0!r}" for k in range(5))),
                "z": full("close", 20, f"(close - avg(close) {over(20)}) / nullif(stddev_pop(close) {over(20)}, 0)"),
                "mom": f"close / lag(close, 6) {_S}",
                "roc": f"(close / lag(close, 6) {_S} - 1) * 100",
                "tr": f"greatest(high - low, abs(high - lag(close) {_S}), abs(low - lag(close) {_S}))",
                "bb_mid": full("close", 20, f"avg(close) {over(20)}"),
                "bb_upper": full("close", 20, f"avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}"),
                "bb_lower": full("close", 20, f"avg(close) {over(20)} - 2 * stddev_pop(close) {over(20)}"),
                "bb_pct": full("close", 20, f"(close - avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}) / nullif(4 * stddev_pop(close) {over(20)}, 0)"),
                "dc_upper": full("high", 10, f"max(high) {over(10)}"),
                "dc_lower": full("low", 10, f"min(low) {over(10)}"),
                "dc_mid": full("low", 10, f"(max(high) {over(10)} + min(low) {over(10)}) / 2"),
            }.items()
        )
        + " FROM bars"
    ),
)
add(
    "realized_vol",
    lambda s, d: rounded(weekly(s, d).withColumn("r", divide(F.col("close"), F.lag("close").over(SERIES)) - 1).select("symbol", "dt", I.realized_vol(F.col("r"), 20).alias("vol")), ["symbol", "dt"]),
    bars_cte(f"x AS (SELECT *, close / lag(close) {_S} - 1 AS rt FROM bars) SELECT symbol, dt, {r(full('rt', 20, f'stddev_pop(rt) {over(20)} * sqrt(252)'), 'vol')} FROM x"),
)
_NUMBERED = f"n AS (SELECT *, row_number() {_S} AS _i, close - lag(close) {_S} AS mv, CASE WHEN lag(close) {_S} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {_S}), abs(low - lag(close) {_S})) END AS tr, high - lag(high) {_S} AS hu, lag(low) {_S} - low AS ld FROM bars)"
_E12, _O = ewm_sql("close", 2 / 13, 12)
_E26, _ = ewm_sql("close", 2 / 27, 26)
_SIG, _OM = ewm_sql("macd", 0.2, 9)
add(
    "indicators_macd",
    lambda s, d: rounded(I.with_macd(weekly(s, d)).select("symbol", "dt", "macd", "macd_signal", "macd_hist"), ["symbol", "dt"], 5),
    bars_cte(f"{_NUMBERED}, a AS (SELECT *, {_O} FROM n), b AS (SELECT *, {_E12} - {_E26} AS macd FROM a), c AS (SELECT *, {_OM} FROM b), e AS (SELECT *, {_SIG} AS sg FROM c) SELECT symbol, dt, {r('macd', 'macd', 5)}, {r('sg', 'macd_signal', 5)}, {r('macd - sg', 'macd_hist', 5)} FROM e"),
)
_ATR, _OT = ewm_sql("tr", 1 / 14, 14)
_UP, _OU = ewm_sql("up", 1 / 14, 14)
_DN, _OD = ewm_sql("dn", 1 / 14, 14)
add(
    "indicators_rsi_atr",
    lambda s, d: rounded(I.with_atr(I.with_rsi(weekly(s, d))).select("symbol", "dt", "rsi", "atr"), ["symbol", "dt"], 5),
    bars_cte(
        f"{_NUMBERED}, u AS (SELECT *, greatest(mv, 0.0 * mv) AS up, greatest(-mv, 0.0 * mv) AS dn FROM n), a AS (SELECT *, {_OT}, {_OU}, {_OD} FROM u), e AS (SELECT *, {_ATR} AS atr_, {_UP} AS au, {_DN} AS ad FROM a) "
        f"SELECT symbol, dt, {r('CASE WHEN au IS NULL THEN NULL WHEN au = 0 AND ad = 0 THEN 50 WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END', 'rsi', 5)}, {r('atr_', 'atr', 5)} FROM e"
    ),
)
_P, _OP = ewm_sql("pdm", 1 / 14, 1)
_MM, _OMM = ewm_sql("mdm", 1 / 14, 1)
_DX, _ODX = ewm_sql("dx", 1 / 14, 14)
add(
    "indicators_adx",
    lambda s, d: rounded(I.with_adx(weekly(s, d)).select("symbol", "dt", "adx"), ["symbol", "dt"], 5),
    bars_cte(
        f"{_NUMBERED}, u AS (SELECT *, CASE WHEN hu > ld AND hu > 0 THEN hu ELSE 0.0 END AS pdm, CASE WHEN ld > hu AND ld > 0 THEN ld ELSE 0.0 END AS mdm FROM n), a AS (SELECT *, {_OT}, {_OP}, {_OMM} FROM u), "
        f"e AS (SELECT *, {_ATR} AS atr_, {_P} AS pp, {_MM} AS mm FROM a), f AS (SELECT *, 100 * abs(100 * pp / nullif(atr_, 0) - 100 * mm / nullif(atr_, 0)) / nullif(100 * pp / nullif(atr_, 0) + 100 * mm / nullif(atr_, 0), 0) AS dx FROM e), g AS (SELECT *, {_ODX} FROM f), h AS (SELECT symbol, dt, {_DX} AS adx FROM g) SELECT symbol, dt, {r('adx', 'adx', 5)} FROM h"
    ),
)

# strategies and backtests
_SIGNALS = {
    "ma_crossover": (lambda b: strategies.ma_crossover(b, 5, 20, kind="sma"), f"x AS (SELECT *, {full('close', 5, f'avg(close) {over(5)}')} AS f, {full('close', 20, f'avg(close) {over(20)}')} AS sl FROM bars), sig AS (SELECT *, CASE WHEN f > sl THEN 1.0 ELSE 0.0 END AS signal FROM x)"),
    "ts_momentum": (lambda b: strategies.ts_momentum(b, 20, True), f"sig AS (SELECT *, CASE WHEN close / lag(close, 20) {_S} - 1 > 0 THEN 1.0 WHEN close / lag(close, 20) {_S} - 1 < 0 THEN -1.0 ELSE 0.0 END AS signal FROM bars)"),
    "breakout": (
        lambda b: strategies.breakout(b, 20, 10),
        "x AS (SELECT *, CASE WHEN count(close) OVER p20 = 20 THEN max(high) OVER p20 END AS hi, CASE WHEN count(close) OVER p10 = 10 THEN min(low) OVER p10 END AS lo FROM bars WINDOW p20 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), p10 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), "
        f"y AS (SELECT *, CASE WHEN close >= hi THEN 1.0 WHEN close <= lo THEN 0.0 END AS ev FROM x), sig AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {_RUN}, 0.0) AS signal FROM y)",
    ),
    "zscore_reversion": (
        lambda b: strategies.zscore_reversion(b, 20, 1.5, 0.5),
        f"x AS (SELECT *, {full('close', 20, f'(close - avg(close) {over(20)}) / nullif(stddev_pop(close) {over(20)}, 0)')} AS z FROM bars), y AS (SELECT *, CASE WHEN z <= -1.5 THEN 1.0 WHEN z >= -0.5 THEN 0.0 END AS ev FROM x), sig AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {_RUN}, 0.0) AS signal FROM y)",
    ),
    "bollinger_reversion": (
        lambda b: strategies.bollinger_reversion(b, 20, 1.5),
        f"x AS (SELECT *, {full('close', 20, f'avg(close) {over(20)}')} AS mid, {full('close', 20, f'stddev_pop(close) {over(20)}')} AS sd FROM bars), y AS (SELECT *, CASE WHEN close <= mid - 1.5 * sd THEN 1.0 WHEN close >= mid THEN 0.0 END AS ev FROM x), sig AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {_RUN}, 0.0) AS signal FROM y)",
    ),
    "macd_trend": (
        lambda b: strategies.macd_trend(b),
        f"{_NUMBERED}, a AS (SELECT *, {_O} FROM n), b AS (SELECT *, {_E12} - {_E26} AS macd FROM a), c AS (SELECT *, {_OM} FROM b), e AS (SELECT *, {_SIG} AS sg FROM c), sig AS (SELECT *, CASE WHEN macd - sg > 0 THEN 1.0 ELSE 0.0 END AS signal FROM e)",
    ),
    "rsi_reversion": (
        lambda b: strategies.rsi_reversion(b, 14, 40.0, 50.0),
        f"{_NUMBERED}, u AS (SELECT *, greatest(mv, 0.0 * mv) AS up, greatest(-mv, 0.0 * mv) AS dn FROM n), a AS (SELECT *, {_OU}, {_OD} FROM u), e AS (SELECT *, {_UP} AS au, {_DN} AS ad FROM a), x AS (SELECT *, CASE WHEN au IS NULL THEN NULL WHEN au = 0 AND ad = 0 THEN 50 WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END AS rsi FROM e), "
        f"y AS (SELECT *, CASE WHEN rsi <= 40 THEN 1.0 WHEN rsi >= 50 THEN 0.0 END AS ev FROM x), sig AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {_RUN}, 0.0) AS signal FROM y)",
    ),
}
_BT = f"""b0 AS (SELECT symbol, dt, close, coalesce(lag(signal) {_S}, 0.0) AS position, coalesce(close / lag(close) {_S} - 1, 0.0) AS ar FROM sig),
b1 AS (SELECT *, abs(position - coalesce(lag(position) {_S}, 0.0)) AS turnover FROM b0),
bt AS (SELECT *, position * ar AS gross, turnover * 2 / 1e4 AS cost, position * ar - turnover * 2 / 1e4 AS ret FROM b1)"""
_SUMMARY = f"""eq AS (SELECT *, product(1 + ret) {_RUN} AS e FROM bt), dd AS (SELECT *, e / greatest(max(e) {_RUN}, 1.0) - 1 AS d FROM eq),
g AS (SELECT symbol, count(*) AS n_periods, product(1 + ret) - 1 AS total_return, CASE WHEN product(1 + ret) <= 0 THEN -1 WHEN count(*) < 21 THEN product(1 + ret) - 1 ELSE pow(product(1 + ret), 252.0 / count(*)) - 1 END AS cagr,
 stddev_pop(ret) * sqrt(252) AS volatility, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END AS sharpe,
 CASE WHEN sqrt(avg(least(ret, 0) ** 2)) > 0 THEN avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252) ELSE 0 END AS sortino, min(d) AS max_drawdown,
 coalesce(avg(CASE WHEN ret <> 0 THEN (ret > 0)::INT END), 0) AS win_rate,
 CASE WHEN -sum(least(ret, 0)) > 0 THEN least(sum(greatest(ret, 0)) / -sum(least(ret, 0)), 100) WHEN sum(greatest(ret, 0)) > 0 THEN 100 END AS profit_factor, avg((position <> 0)::INT) AS exposure FROM dd GROUP BY symbol)
SELECT symbol, n_periods, {", ".join(r(c) for c in ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "win_rate", "profit_factor", "exposure"))}, {r("CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END", "calmar")} FROM g"""


def _summary_of(make):
    return lambda s, d: rounded(M.summary(BT.backtest(make(weekly(s, d)))), ["symbol"])


for _n, (_make, _sql) in _SIGNALS.items():
    add(f"strategy_{_n}", _summary_of(_make), bars_cte(f"{_sql}, {_BT}, {_SUMMARY}"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Crossover backtest by symbol on monthly bars by brand: short windows, as the smallest tables are sparse."""
    return rounded(M.summary(BT.backtest(strategies.ma_crossover(B.line_bars(spark, sf_dir, "month"), 3, 8, kind="sma"))), ["symbol"])


_CROSS, _CROSS_SQL = _SIGNALS["ma_crossover"]
add(
    "backtest_bars",
    lambda s, d: rounded(BT.backtest(_CROSS(weekly(s, d))).select("symbol", "dt", "position", "turnover", "gross", "cost", "ret", "equity"), ["symbol", "dt"]),
    bars_cte(f"{_CROSS_SQL}, {_BT} SELECT symbol, dt, {', '.join(r(c) for c in ('position', 'turnover', 'gross', 'cost', 'ret'))}, {r(f'product(1 + ret) {_RUN}', 'equity')} FROM bt"),
)
add("backtest_trades", lambda s, d: rounded(BT.trades(BT.backtest(_CROSS(weekly(s, d)))), ["symbol", "dt"], 5), bars_cte(f"{_CROSS_SQL}, {_BT} SELECT symbol, dt, {r('close', 'close', 5)}, {r('position', 'position', 5)}, {r('turnover', 'turnover', 5)}, {r('cost', 'cost', 5)} FROM bt WHERE turnover > 0"))
add(
    "cost_sensitivity",
    lambda s, d: rounded(BT.cost_sensitivity(BT.backtest(_CROSS(weekly(s, d)))), ["symbol", "bps"]),
    bars_cte(f"{_CROSS_SQL}, {_BT}, l AS (SELECT symbol, dt, bps, gross - turnover * bps / 1e4 AS ret FROM bt, (SELECT unnest([0, 1, 2, 5, 10, 20])::DOUBLE AS bps)) SELECT symbol, bps, {r('product(1 + ret) - 1', 'total_return')}, {r('CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END', 'sharpe')} FROM l GROUP BY symbol, bps"),
)
add(
    "buy_and_hold",
    lambda s, d: rounded(M.summary(BT.buy_and_hold(weekly(s, d))).select("symbol", "total_return", "sharpe", "max_drawdown"), ["symbol"]),
    bars_cte(f"bt AS (SELECT symbol, dt, 1.0 AS position, coalesce(close / lag(close) {_S} - 1, 0.0) AS ret FROM bars), eq AS (SELECT *, product(1 + ret) {_RUN} AS e FROM bt), dd AS (SELECT *, e / greatest(max(e) {_RUN}, 1.0) - 1 AS d FROM eq) SELECT symbol, {r('product(1 + ret) - 1', 'total_return')}, {r('CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END', 'sharpe')}, {r('min(d)', 'max_drawdown')} FROM dd GROUP BY symbol"),
)
add("rebalance_dates", lambda s, d: BT.rebalance_dates(weekly(s, d)), bars_cte("SELECT max(dt) AS dt FROM bars GROUP BY date_trunc('month', dt)"))
add(
    "mae_mfe",
    lambda s, d: rounded(M.mae_mfe(BT.backtest(_CROSS(weekly(s, d)))), ["symbol", "entry_dt"]),
    bars_cte(
        f"{_CROSS_SQL}, {_BT}, i AS (SELECT *, sign(position) AS sd, (coalesce(lag(sign(position)) {_S}, 0) <> sign(position))::INT AS nw FROM bt), j AS (SELECT *, sum(nw) {_RUN} AS id FROM i), k AS (SELECT *, first_value(close) OVER (PARTITION BY symbol, id ORDER BY dt) AS en FROM j WHERE sd <> 0) "
        f"SELECT symbol, min(dt) AS entry_dt, max(dt) AS exit_dt, {r('min(sd)', 'side')}, count(*) AS bars, {r('least(min(sd * (close / en - 1)), 0)', 'mae')}, {r('greatest(max(sd * (close / en - 1)), 0)', 'mfe')}, {r('max_by(sd * (close / en - 1), dt)', 'final')} FROM k GROUP BY symbol, id"
    ),
)
add(
    "downturn_quarter",
    lambda s, d: rounded(M.downturn(BT.buy_and_hold(weekly(s, d)), "ret"), ["symbol"]),
    bars_cte(f"bt AS (SELECT symbol, dt, coalesce(close / lag(close) {_S} - 1, 0.0) AS ret FROM bars), q AS (SELECT symbol, date_trunc('quarter', dt)::DATE AS quarter, product(1 + ret) - 1 AS ret, count(*) AS bars FROM bt GROUP BY ALL HAVING count(*) >= 5) SELECT symbol, quarter, {r('ret')}, bars FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ret, quarter) = 1"),
)
_RET = f"x AS (SELECT *, close / lag(close) {_S} - 1 AS rt FROM bars), m AS (SELECT dt, avg(rt) AS mr FROM x WHERE rt IS NOT NULL GROUP BY dt), j AS (SELECT x.symbol, x.dt, rt, mr FROM x JOIN m USING (dt) WHERE rt IS NOT NULL)"


def _with_market(s, d):
    rets = risk.returns(weekly(s, d))
    return rets.join(rets.groupBy("dt").agg(F.avg("ret").alias("mkt")), "dt")


add(
    "capm",
    lambda s, d: rounded(M.capm(_with_market(s, d), "ret", "mkt").select("symbol", "alpha", "beta", "corr", "r2", "information_ratio"), ["symbol"], 5),
    bars_cte(f"{_RET} SELECT symbol, {r('(avg(rt) - covar_pop(rt, mr) / var_pop(mr) * avg(mr)) * 252', 'alpha', 5)}, {r('covar_pop(rt, mr) / var_pop(mr)', 'beta', 5)}, {r('corr(rt, mr)', 'corr', 5)}, {r('corr(rt, mr) ** 2', 'r2', 5)}, {r('(avg(rt) - avg(mr)) * sqrt(252) / stddev_pop(rt - mr)', 'information_ratio', 5)} FROM j GROUP BY symbol"),
)

# cross-sections on monthly bars of suppliers
_FWD = f"f AS (SELECT *, close / lag(close, 3) {_S} - 1 AS mom, lead(close, 1) {_S} / close - 1 AS fwd FROM bars)"
_RK = "rk AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2.0 AS b, count(*) OVER (PARTITION BY dt) AS nn FROM f WHERE mom IS NOT NULL AND fwd IS NOT NULL)"


def _factor(s, d):
    return monthly(s, d).withColumns({"mom": I.momentum(F.col("close"), 3) - 1, "fwd": CS.forward_return(1)})


add("rank_ic", lambda s, d: rounded(CS.daily_rank_ic(_factor(s, d), "mom", "fwd"), ["dt"]), bars_cte(f"{_FWD}, {_RK} SELECT dt, count(*) AS n, {r('corr(a, b)', 'ic')} FROM rk GROUP BY dt HAVING count(*) >= 5", "month", "l_suppkey"))
add("ic_summary", lambda s, d: rounded(CS.ic_summary(CS.daily_rank_ic(_factor(s, d), "mom", "fwd")), []), bars_cte(f"{_FWD}, {_RK}, i AS (SELECT dt, corr(a, b) AS ic FROM rk GROUP BY dt HAVING count(*) >= 5) SELECT count(ic) AS dates, {r('avg(ic)', 'mean_ic')}, {r('avg(ic) / (stddev_pop(ic) + 1e-9)', 'icir')}, {r('avg((ic > 0)::INT)', 'hit')} FROM i", "month", "l_suppkey"))
add(
    "quantile_returns",
    lambda s, d: rounded(CS.quantile_returns(_factor(s, d), "mom", "fwd"), ["bucket"], 5),
    bars_cte(f"{_FWD}, k AS (SELECT *, floor((row_number() OVER (PARTITION BY dt ORDER BY mom, symbol) - 1) / count(*) OVER (PARTITION BY dt)::DOUBLE * 5)::INT + 1 AS bucket FROM f WHERE mom IS NOT NULL AND fwd IS NOT NULL), g AS (SELECT dt, bucket, avg(fwd) AS ret FROM k GROUP BY ALL) SELECT bucket, {r('avg(ret)', 'mean_ret', 5)}, {r('stddev_pop(ret)', 'std_ret', 5)}, count(*) AS dates FROM g GROUP BY bucket", "month", "l_suppkey"),
)
add("long_short", lambda s, d: rounded(CS.long_short_returns(_factor(s, d), "mom"), ["dt"], 5), bars_cte(f"{_FWD}, h AS (SELECT *, lag(mom) {_S} AS pf, close / lag(close) {_S} - 1 AS rt FROM f), k AS (SELECT *, (rank() OVER (PARTITION BY dt ORDER BY pf) + (count(*) OVER (PARTITION BY dt, pf) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS p FROM h WHERE pf IS NOT NULL AND rt IS NOT NULL) SELECT dt, {r('avg(CASE WHEN p > 0.8 THEN rt END) - avg(CASE WHEN p <= 0.2 THEN rt END)', 'ret', 5)} FROM k GROUP BY dt", "month", "l_suppkey"))
add(
    "top_weights",
    lambda s, d: rounded(CS.rank_and_weight(_factor(s, d), "mom"), ["dt", "symbol"]),
    bars_cte(f"{_FWD}, k AS (SELECT *, greatest(round_even(count(*) OVER (PARTITION BY dt) * 0.2, 0), 1) AS k, row_number() OVER (PARTITION BY dt ORDER BY mom DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY mom, symbol DESC) AS w FROM f WHERE mom IS NOT NULL) SELECT dt, symbol, {r('CASE WHEN u <= k THEN 1.0 / k ELSE -1.0 / k END', 'weight')} FROM k WHERE u <= k OR w <= k", "month", "l_suppkey"),
)
add(
    "portfolio_backtest",
    lambda s, d: rounded(BT.backtest_portfolio(monthly(s, d), CS.rank_and_weight(_factor(s, d), "mom")).drop("equity"), ["dt"], 5),
    bars_cte(
        f"""{_FWD}, k AS (SELECT *, greatest(round_even(count(*) OVER (PARTITION BY dt) * 0.2, 0), 1) AS k, row_number() OVER (PARTITION BY dt ORDER BY mom DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY mom, symbol DESC) AS w FROM f WHERE mom IS NOT NULL),
w AS (SELECT dt, symbol, CASE WHEN u <= k THEN 1.0 / k ELSE -1.0 / k END AS weight FROM k WHERE u <= k OR w <= k),
h AS (SELECT b.symbol, b.dt, b.close, last_value(CASE WHEN d.dt IS NOT NULL THEN coalesce(w.weight, 0) END IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.dt ROWS UNBOUNDED PRECEDING) AS held FROM bars b LEFT JOIN w ON b.symbol = w.symbol AND b.dt = w.dt LEFT JOIN (SELECT DISTINCT dt FROM w) d ON b.dt = d.dt),
p AS (SELECT symbol, dt, coalesce(lag(held) {_S}, 0) AS pw, coalesce(close / lag(close) {_S} - 1, 0) AS ar FROM h), t AS (SELECT *, abs(pw - coalesce(lag(pw) {_S}, 0)) AS tt FROM p),
g AS (SELECT dt, sum(pw * ar) AS gross, sum(tt) AS turnover FROM t GROUP BY dt) SELECT dt, {r('gross', 'gross', 5)}, {r('turnover', 'turnover', 5)}, {r('turnover * 2 / 1e4', 'cost', 5)}, {r('gross - turnover * 2 / 1e4', 'ret', 5)} FROM g""",
        "month", "l_suppkey",
    ),
)
add("churn", lambda s, d: rounded(CS.churn(_factor(s, d), "mom"), ["dt"]), bars_cte(f"{_FWD}, k AS (SELECT dt, symbol, (rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS p FROM f WHERE mom IS NOT NULL), t AS (SELECT dt, symbol FROM k WHERE p > 0.8), e AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS bf FROM (SELECT DISTINCT dt FROM t)) SELECT t.dt, {r('1 - count(o.symbol) / count(*)::DOUBLE', 'churn')} FROM t JOIN e ON t.dt = e.dt LEFT JOIN t o ON o.dt = e.bf AND o.symbol = t.symbol WHERE e.bf IS NOT NULL GROUP BY t.dt", "month", "l_suppkey"))
add("holdings_overlap", lambda s, d: rounded(CS.holdings_overlap(_factor(s, d).withColumn("v", F.col("volume")), "mom", "v"), ["dt"]), bars_cte(f"{_FWD}, k AS (SELECT dt, (rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) > 0.8 AS a, (rank() OVER (PARTITION BY dt ORDER BY volume) + (count(*) OVER (PARTITION BY dt, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) > 0.8 AS b FROM f WHERE mom IS NOT NULL) SELECT dt, {r('sum((a AND b)::INT) / nullif(sum((a OR b)::INT), 0)::DOUBLE', 'overlap')} FROM k GROUP BY dt HAVING count(*) >= 5", "month", "l_suppkey"))
add("valuation_spread", lambda s, d: rounded(CS.valuation_spread(_factor(s, d), "mom", "volume"), ["dt"], 5), bars_cte(f"{_FWD}, k AS (SELECT dt, volume, (rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS p FROM f WHERE mom IS NOT NULL) SELECT dt, {r('avg(CASE WHEN p > 0.8 THEN volume END) - avg(CASE WHEN p <= 0.2 THEN volume END)', 'spread', 5)} FROM k GROUP BY dt", "month", "l_suppkey"))
add("price_factors", lambda s, d: rounded(CS.price_factors(weekly(s, d), 8).select("symbol", "dt", "mom20", "rev5", "vol20", "dist_high60"), ["symbol", "dt"], 5), bars_cte(f"x AS (SELECT *, close / lag(close, 8) {_S} - 1 AS a, -(close / lag(close, 2) {_S} - 1) AS b, ln(close / lag(close) {_S}) AS lr, close / ({full('close', 24, f'max(close) {over(24)}')}) - 1 AS c FROM bars), y AS (SELECT *, {full('lr', 8, f'stddev_samp(lr) {over(8)}')} AS v FROM x) SELECT symbol, dt, " + ", ".join(r(f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN stddev_pop({c}) OVER (PARTITION BY dt) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY dt)) / stddev_pop({c}) OVER (PARTITION BY dt) ELSE 0 END END", n, 5) for c, n in (("a", "mom20"), ("b", "rev5"), ("v", "vol20"), ("c", "dist_high60"))) + " FROM y"))
add("neutralize", lambda s, d: rounded(CS.neutralize(_factor(s, d).where("mom is not null").withColumn("g", F.substring("symbol", 1, 1)), "mom", "g", "volume").select("symbol", "dt", "neutral"), ["symbol", "dt"], 5), bars_cte(f"{_FWD}, a AS (SELECT *, mom - avg(mom) OVER (PARTITION BY dt, substr(symbol, 1, 1)) AS g FROM f WHERE mom IS NOT NULL), c AS (SELECT dt, count(*) AS n, avg(g) AS mg, avg(volume) AS mv, coalesce(covar_pop(g, volume) / nullif(var_pop(volume), 0), 0) AS beta FROM a GROUP BY dt) SELECT symbol, a.dt, {r('CASE WHEN n >= 5 THEN g - mg - beta * (volume - mv) ELSE g END', 'neutral', 5)} FROM a JOIN c ON a.dt = c.dt", "month", "l_suppkey"))
add("liquidity_filter", lambda s, d: rounded(CS.liquidity_filter(monthly(s, d), 40, 1e5, 30), ["symbol"], 2), bars_cte(f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM bars) SELECT symbol, count(*) AS n_bars, {r('median(CASE WHEN rn <= 30 THEN close * volume END)', 'median_dollars', 2)} FROM x GROUP BY symbol HAVING count(*) >= 40 AND median(CASE WHEN rn <= 30 THEN close * volume END) >= 1e5", "month", "l_suppkey"))
add("dynamic_universe", lambda s, d: rounded(CS.dynamic_universe(monthly(s, d), "1999-06-30", 30, 1e5, 12), ["symbol"], 2), bars_cte(f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM bars WHERE dt <= DATE '1999-06-30') SELECT symbol, count(*) AS n_bars, {r('avg(CASE WHEN rn <= 12 THEN close * volume END)', 'adv', 2)} FROM x GROUP BY symbol HAVING count(*) >= 30 AND (avg(CASE WHEN rn <= 12 THEN close * volume END) >= 1e5)", "month", "l_suppkey"))

# risk, validation, models
add("pair_correlation", lambda s, d: rounded(risk.pair_stats(risk.returns(weekly(s, d), 120)), ["a", "b"]), bars_cte(f"{_RET}, l AS (SELECT DISTINCT dt FROM j ORDER BY dt DESC LIMIT 120), k AS (SELECT * FROM j WHERE dt IN (SELECT dt FROM l)) SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, {r('covar_samp(x.rt, y.rt)', 'cov')}, {r('corr(x.rt, y.rt)', 'corr')} FROM k x JOIN k y ON x.dt = y.dt AND x.symbol < y.symbol GROUP BY ALL"))


def _equal(s, d):
    return weekly(s, d).select("symbol").distinct().withColumn("weight", F.lit(0.04))


add("var_cvar", lambda s, d: rounded(risk.var_cvar(risk.returns(weekly(s, d)), _equal(s, d)), []), bars_cte(f"{_RET}, p AS (SELECT dt, sum(rt * 0.04) AS ret FROM j GROUP BY dt), q AS (SELECT quantile_cont(ret, 0.05) AS v FROM p) SELECT {r('v', 'var')}, {r('avg(CASE WHEN ret <= v THEN ret END)', 'cvar')}, count(*) AS days FROM p, q GROUP BY v"))
add("concentration", lambda s, d: rounded(risk.concentration(weekly(s, d).groupBy("symbol").agg(F.sum("volume").alias("weight"))), []), bars_cte(f"w AS (SELECT symbol, sum(volume) / (SELECT sum(volume) FROM bars) AS w FROM bars GROUP BY symbol) SELECT {r('sum(w * w)', 'hhi')}, {r('max(w)', 'max_weight')}, arg_max(symbol, (w, symbol)) AS top_name, {r('1 / sum(w * w)', 'effective_n')} FROM w"))
add("sector_exposure", lambda s, d: rounded(risk.sector_exposure(weekly(s, d).groupBy("symbol").agg(F.sum("volume").alias("weight")), weekly(s, d).select("symbol", F.substring("symbol", 1, 7).alias("sector")).distinct()), ["sector"]), bars_cte(f"SELECT substr(symbol, 1, 7) AS sector, {r('sum(volume) / (SELECT sum(volume) FROM bars)', 'share')} FROM bars GROUP BY 1"))
add("inverse_vol", lambda s, d: rounded(risk.inverse_vol(weekly(s, d).select("dt", "symbol", F.lit(0.04).alias("weight")), weekly(s, d)), ["dt", "symbol"]), bars_cte(f"x AS (SELECT *, close / lag(close) {_S} - 1 AS rt FROM bars), y AS (SELECT dt, symbol, 0.04 / nullif({full('rt', 20, f'stddev_pop(rt) {over(20)}')}, 0) AS iv FROM x), z AS (SELECT * FROM y WHERE iv IS NOT NULL) SELECT dt, symbol, {r('iv * sum(0.04::DOUBLE) OVER (PARTITION BY dt) / sum(iv) OVER (PARTITION BY dt)', 'weight')} FROM z"))
add("trend_regime", lambda s, d: weekly(s, d).select("symbol", "dt", risk.trend_regime(40).alias("trend")), bars_cte(f"SELECT symbol, dt, coalesce(sign(close - ({full('close', 40, f'avg(close) {over(40)}')})), 0)::DOUBLE AS trend FROM bars"))
add("regime_scale", lambda s, d: rounded(risk.regime_scale(weekly(s, d), slow=40, n=10, history=60).select("symbol", "dt", "scale"), ["symbol", "dt"]), bars_cte(f"x AS (SELECT *, close / lag(close) {_S} - 1 AS rt, row_number() {_S} AS i FROM bars), y AS (SELECT *, {full('rt', 10, f'stddev_pop(rt) {over(10)}')} AS v FROM x), z AS (SELECT *, CASE WHEN v IS NOT NULL AND i > 60 THEN (v > quantile_cont(v, 0.3333333333333333) {_RUN})::INT + (v > quantile_cont(v, 0.6666666666666666) {_RUN})::INT END AS st FROM y) SELECT symbol, dt, {r(f'(1 - coalesce(last_value(st IGNORE NULLS) {_RUN}, 1) / 2.0 * 0.6) * CASE WHEN close < ({full("close", 40, f"avg(close) {over(40)}")}) THEN 0.5 ELSE 1 END', 'scale')} FROM z"))
add("sharpe_moments", lambda s, d: rounded(validation.probabilistic_sharpe(BT.buy_and_hold(weekly(s, d))), ["symbol"], 5), bars_cte(f"bt AS (SELECT symbol, coalesce(close / lag(close) {_S} - 1, 0.0) AS ret FROM bars), c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS dv FROM bt), g AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(dv ** 3) / stddev_samp(ret) ** 3 AS skew, avg(dv ** 4) / stddev_samp(ret) ** 4 AS kurt FROM c GROUP BY symbol) SELECT symbol, n, {r('sr', 'sr', 5)}, {r('skew', 'skew', 5)}, {r('kurt', 'kurt', 5)}, {r('CASE WHEN 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 THEN sr * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 0)) END', 'z', 5)} FROM g"))
add("validation_blocks", lambda s, d: rounded(validation.block_sums(risk.returns(weekly(s, d)).withColumnRenamed("symbol", "trial"), 10), ["block", "trial"], 4), bars_cte(f"{_RET}, e AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT dt FROM j)) SELECT least(floor(i / greatest(floor(nd / 10.0), 1)), 9)::INT AS block, symbol AS trial, count(*) AS n, {r('sum(rt)', 's', 4)}, {r('sum(rt * rt)', 'q', 4)} FROM j JOIN e ON j.dt = e.dt GROUP BY ALL"))


def _pbo(s, d):
    rets = risk.returns(weekly(s, d)).withColumnRenamed("symbol", "trial")
    rows = [("pbo", float(validation.pbo(rets)))] + [(f"cpcv_{t}", float(sum(v) / len(v))) for t, v in sorted(validation.cpcv(rets).items())]
    return s.createDataFrame(rows, "what string, value double")


add("overfitting", _pbo)
add("walk_forward", lambda s, d: rounded(BT.walk_forward(_configs(s, d)), ["symbol", "fold"]))


def _configs(s, d):
    out = None
    for n in (4, 8, 16):
        one = BT.backtest(strategies.ts_momentum(weekly(s, d), n)).select("symbol", "dt", F.lit(f"n={n:02d}").alias("config"), "ret")
        out = one if out is None else out.unionByName(one)
    return out


def _ridge(s, d):
    df = CS.price_factors(weekly(s, d), 4).withColumn("fwd", CS.forward_return(4))
    return models.walk_forward_ridge(df, list(CS.PRICE_FACTORS), "fwd", 4, BT.rebalance_dates(df), 104, 40)


add("ridge_walk_forward", lambda s, d: rounded(_ridge(s, d), ["dt", "symbol"]))
add("ridge_scorecard", lambda s, d: rounded(models.scorecard(_ridge(s, d)), []))


def _weights(s, d):
    names, cov = risk.covariance(risk.returns(weekly(s, d), 120))
    rows = [(n, float(a), float(b), float(c)) for n, a, b, c in zip(names, risk.min_variance(cov, 0.2), risk.risk_parity(cov), risk.contributions(cov, risk.risk_parity(cov)))]
    return s.createDataFrame(rows, "symbol string, min_variance double, risk_parity double, contribution double")


add("portfolio_weights", lambda s, d: rounded(_weights(s, d), ["symbol"]))

# attribution, execution, scalars, as-of joins, streams
_BR = "SELECT s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _brinson(s, d):
    sectors = B.table(s, d, "supplier").join(B.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(B.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("sector"))
    rows = B.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("port_w"), F.sum("l_extendedprice").alias("bench_w"), F.avg("l_discount").alias("port_ret"), F.avg("l_tax").alias("bench_ret"))
    return rounded(risk.brinson(rows.join(sectors, "l_suppkey")), ["sector"])


add(
    "brinson", _brinson,
    f"""WITH sec AS ({_BR}), i AS (SELECT l_suppkey, sum(l_quantity) AS wp, sum(l_extendedprice) AS wb, avg(l_discount) AS rp, avg(l_tax) AS rb FROM lineitem GROUP BY 1), s AS (SELECT sector, sum(wp) AS wp, sum(wb) AS wb, sum(wp * rp) / sum(wp) AS rps, sum(wb * rb) / sum(wb) AS rbs, sum(wb * rb) AS cb FROM i JOIN sec ON l_suppkey = symbol GROUP BY 1),
t AS (SELECT sum(wp) AS tp, sum(wb) AS tb, sum(cb) / sum(wb) AS rb FROM s) SELECT sector, {r('(wp / tp - wb / tb) * (rbs - rb)', 'allocation')}, {r('wb / tb * (rps - rbs)', 'selection')}, {r('(wp / tp - wb / tb) * (rps - rbs)', 'interaction')} FROM s, t""",
)


def _shortfall(s, d):
    li = B.table(s, d, "lineitem")
    fills = li.select(F.col("l_orderkey").alias("order_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("time"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    orders = B.table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.lit(1500.0).alias("decision_price"), F.lit(None).cast("double").alias("arrival_price"), F.lit(None).cast("double").alias("final_price"), F.lit(120.0).alias("target_qty"))
    return rounded(X.shortfall(fills, orders), ["order_id"], 5)


add(
    "implementation_shortfall", _shortfall,
    f"""WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS filled, sum(l_extendedprice) / sum(l_quantity) AS af, arg_min(l_extendedprice / l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS fi, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS la FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END AS s, f.*, coalesce(least(coalesce(filled, 0) / 120, 1), 0) AS rate, coalesce(fi, 1500) AS arr, coalesce(la, 1500) AS fin FROM orders LEFT JOIN f ON o_orderkey = k),
p AS (SELECT order_id, rate, rate * s * (arr - 1500) / 1500 * 1e4 AS a, coalesce(rate * s * (af - arr) / 1500 * 1e4, 0) AS b, (1 - rate) * s * (fin - 1500) / 1500 * 1e4 AS c FROM o) SELECT order_id, {r('rate', 'fill_rate', 5)}, {r('a', 'delay_bps', 5)}, {r('b', 'execution_bps', 5)}, {r('c', 'opportunity_bps', 5)}, {r('a + b + c', 'shortfall_bps', 5)} FROM p""",
)
add("twap_schedule", lambda s, d: B.table(s, d, "part").select("p_partkey", F.array_join(X.twap(F.floor("p_retailprice").cast("long"), F.lit(6)).cast("array<string>"), ",").alias("slices")), "SELECT p_partkey, array_to_string(list_transform(range(0, 6), lambda i: (floor(p_retailprice)::BIGINT // 6 + CASE WHEN i < floor(p_retailprice)::BIGINT % 6 THEN 1 ELSE 0 END)::VARCHAR), ',') AS slices FROM part")
_PROFILES = ("array(5.0D, 3.0D, 2.0D, 4.0D)", "array(0.0D, 0.0D, 0.0D)", "array(1.0D, 0.0D, 7.0D)")
_VWAP_SQL = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size::BIGINT * 100 + 7 END AS t,
  CASE p_partkey % 3 WHEN 0 THEN [5.0, 3.0, 2.0, 4.0] WHEN 1 THEN [0.0, 0.0, 0.0] ELSE [1.0, 0.0, 7.0] END::DOUBLE[] AS v FROM part),
q AS (SELECT *, list_sum(v) AS w, len(v) AS n, CASE WHEN list_sum(v) > 0 THEN list_transform(v, lambda x: t * x / list_sum(v)) END AS raw FROM p),
f AS (SELECT *, list_transform(raw, lambda x: floor(x)::BIGINT) AS low, list_transform(raw, lambda x: x - floor(x)) AS frac FROM q)
SELECT p_partkey, array_to_string(CASE WHEN t = 0 THEN [] WHEN w > 0 THEN list_transform(range(1, n + 1), lambda i: low[i] + CASE WHEN i = list_position(frac, list_max(frac)) THEN t - list_sum(low)::BIGINT ELSE 0 END)
  ELSE list_transform(range(0, n), lambda i: t // n + CASE WHEN i < t % n THEN 1 ELSE 0 END) END, ',') AS slices FROM f"""


def _vwap(s, d):
    profile = F.when(F.col("p_partkey") % 3 == 0, F.expr(_PROFILES[0])).when(F.col("p_partkey") % 3 == 1, F.expr(_PROFILES[1])).otherwise(F.expr(_PROFILES[2]))
    total = F.when(F.col("p_partkey") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("p_size").cast("long") * 100 + 7)
    return B.table(s, d, "part").select("p_partkey", F.array_join(X.vwap(total, profile).cast("array<string>"), ",").alias("slices"))


add("vwap_schedule", _vwap, _VWAP_SQL)


def _sentiment_sql() -> str:
    table = "map {" + ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in {**S.POSITIVE, **S.NEGATIVE}.items()) + "}"
    negators = "[" + ", ".join(f"'{n}'" for n in S.NEGATORS) + "]"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, w FROM w), m AS (SELECT {table} AS t),
h AS (SELECT doc_id, CASE WHEN len(list_intersect(list_slice(w, greatest(i - 3, 1), i - 1), {negators})) > 0 AND i > 1 THEN -t[x] ELSE t[x] END AS v FROM e, m WHERE t[x] IS NOT NULL),
g AS (SELECT doc_id, avg(v) AS a FROM h GROUP BY doc_id) SELECT d.doc_id, round(least(greatest(coalesce(a, 0.0) / 1.6, -1.0), 1.0)::DOUBLE, 6) AS sentiment FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


add("headline_sentiment", lambda s, d: B.table(s, d, "documents").select("doc_id", F.round(S.sentiment(F.col("text")), 6).alias("sentiment")), _sentiment_sql())
add(
    "signals_scalar",
    lambda s, d: rounded(
        B.table(s, d, "supplier").withColumn("x", F.col("s_acctbal") / 1000).select("s_suppkey", S.vix_signal(F.col("x") * 4 + 15, F.lit(20.0)).alias("vix"), S.rates_signal(F.col("x") / 10).alias("rates"), S.curve_signal(F.col("x") / 7).alias("curve"), S.expected_move(F.lit(100.0), F.abs("x") / 10, F.lit(30)).alias("move"), S.iv_skew_signal(F.abs("x") / 20 + 0.1, F.lit(0.3)).alias("skew"), S.put_call_signal(F.abs("x") / 5).alias("pcr"), S.insider_signal(F.col("s_acctbal") * 1000).alias("insider"), S.short_interest_signal(F.abs("x"), F.col("x") / 3).alias("short"), S.northbound_signal(F.col("x") * 9).alias("north"), S.trends_signal(F.abs("x"), F.lit(4.0)).alias("trends")),
        ["s_suppkey"],
    ),
    "WITH b AS (SELECT s_suppkey, s_acctbal, s_acctbal / 1000 AS x FROM supplier), v AS (SELECT *, x * 4 + 15 AS l FROM b) SELECT s_suppkey, "
    + ", ".join(
        r(v, n)
        for n, v in {
            "vix": "least(greatest(0.6 * CASE WHEN l < 14 THEN 0.4 WHEN l < 18 THEN 0.15 WHEN l < 22 THEN 0 WHEN l < 28 THEN -0.35 WHEN l < 35 THEN -0.7 ELSE -1 END::DOUBLE + 0.4 * tanh((20 - l) / 10), -1), 1)",
            "rates": "-tanh(x / 10 / 0.5)", "curve": "tanh(x / 7 / 0.5)", "move": "100 * abs(x) / 10 * sqrt(30 / 365.0::DOUBLE)",
            "skew": "-tanh((abs(x) / 20 + 0.1 - 0.3) / ((abs(x) / 20 + 0.1 + 0.3) * 0.5) * 4)", "pcr": "-tanh((abs(x) / 5 - 0.9) / 0.4)", "insider": "tanh(s_acctbal * 1000 / 5e6)",
            "short": "-0.6 * tanh((abs(x) - 5) / 8) - 0.4 * tanh(x / 3 / 3)", "north": "tanh(x * 9 / 50)", "trends": "tanh(abs(x) / 4 - 1)",
        }.items()
    ) + " FROM v",
)


def _asof(s, d):
    signals = B.table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.expr("date_add(DATE'1997-01-01', cast(p_partkey % 700 as int))").alias("day"), (F.col("p_size") - 25.0).alias("score"), "p_partkey")
    return rounded(files.evaluate_signals(signals, weekly(s, d), 4).select("p_partkey", "symbol", "day", "score", "fwd", "hit"), ["p_partkey", "symbol", "day"], 5)


add("asof_signal_outcome", _asof, bars_cte(f"y AS (SELECT symbol, dt, close, lead(close, 4) {_S} AS ex FROM bars), g AS (SELECT p_partkey, p_brand AS symbol, DATE '1997-01-01' + (p_partkey % 700)::INT AS day, p_size - 25.0::DOUBLE AS score FROM part), j AS (SELECT g.*, y.close, y.ex FROM g ASOF JOIN y ON g.symbol = y.symbol AND g.day >= y.dt) SELECT p_partkey, symbol, day::DATE AS day, {r('score', 'score', 5)}, {r('ex / close - 1', 'fwd', 5)}, (sign(ex / close - 1) = sign(score))::INT AS hit FROM j WHERE ex IS NOT NULL"))
add("bars_h", lambda s, d: rounded(B.event_bars(s, d), ["symbol", "dt"]), f"WITH t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS dt, value AS px, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS o FROM events) SELECT symbol, dt, {r('min_by(px, o)', 'open')}, {r('max(px)', 'high')}, {r('min(px)', 'low')}, {r('max_by(px, o)', 'close')}, count(*)::DOUBLE AS volume, {r('avg(px)', 'vwap')} FROM t GROUP BY symbol, dt")
add("stream_bars_batch", lambda s, d: rounded(stream_bars(B.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size")), "1 day").select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "high", "low", "volume", "ticks"), ["symbol", "day"]), f"SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d') AS day, {r('max(value)', 'high')}, {r('min(value)', 'low')}, count(*)::DOUBLE AS volume, count(*) AS ticks FROM events GROUP BY 1, 2")
add("user_sessions", lambda s, d: sessions(B.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")), "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events), i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g), c AS (SELECT user_id, id, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
add("cube_report", lambda s, d: B.table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
