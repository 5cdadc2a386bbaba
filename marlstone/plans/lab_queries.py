"""Queries over the factor lab, universes, ratings, context, searches and scorecards, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import calendars
from marlstone.functions import scalars as S
from marlstone.operators import attribution as A
from marlstone.operators import backtest as BT
from marlstone.operators import context as C
from marlstone.operators import execution as X
from marlstone.operators import cross_section as CS
from marlstone.operators import factor_lab as L
from marlstone.operators import indicators as I
from marlstone.operators import learners, metrics, models, ratings, risk, search, strategies, validation
from marlstone.operators import multi_factor as MF
from marlstone.operators import universe as U
from marlstone.reporting import text as R
from marlstone.sources import bars as B

from .market_queries import _BR, _DN, _E12, _E26, _NUMBERED, _O, _OD, _OM, _OU, _RET, _RUN, _S, _SIG, _UP, bars_cte, ewm_sql, full, monthly, r, rounded, weekly
from .twins import over

QUERIES, ORACLES = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def suppliers(sql: str, recursive: bool = False) -> str:
    return bars_cte(sql, "month", "l_suppkey", recursive)


def ranks(table: str, a: str, b: str, by: str = "dt") -> str:
    """Average ranks ra, rb of a and b within `by`, over rows that have both."""
    one = lambda x, n: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS {n}"
    return f"SELECT *, {one(a, 'ra')}, {one(b, 'rb')} FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


def panel(s, d):
    """Monthly bars of suppliers with mom, vol (volume), rev and the next return."""
    return monthly(s, d).withColumns({"mom": I.momentum(F.col("close"), 3) - 1, "vol": F.col("volume"), "rev": -(I.momentum(F.col("close"), 1) - 1), "fwd": CS.forward_return(1)})


_P = f"p AS (SELECT *, close / lag(close, 3) {_S} - 1 AS mom, volume AS vol, -(close / lag(close, 1) {_S} - 1) AS rev, lead(close, 1) {_S} / close - 1 AS fwd, close / lag(close) {_S} - 1 AS rt FROM bars)"
_D = "OVER (PARTITION BY dt)"

# factor lab
add("orthogonalize", lambda s, d: rounded(L.orthogonalize(panel(s, d), "mom", ["vol"]).where("orthogonal is not null").select("symbol", "dt", "orthogonal"), ["symbol", "dt"], 5),
    suppliers(f"{_P}, q AS (SELECT symbol, dt, mom, vol, count(*) {_D} AS n, regr_slope(mom, vol) {_D} AS b, regr_intercept(mom, vol) {_D} AS a FROM p WHERE mom IS NOT NULL AND vol IS NOT NULL) SELECT symbol, dt, {r('mom - a - b * vol', 'orthogonal', 5)} FROM q WHERE n >= 5"))
_ORTH = f"{_P}, q AS (SELECT *, count(*) {_D} AS n, regr_slope(mom, vol) {_D} AS b, regr_intercept(mom, vol) {_D} AS a FROM p WHERE mom IS NOT NULL AND vol IS NOT NULL), o AS (SELECT *, mom - a - b * vol AS rest FROM q WHERE n >= 5)"
add("incremental_ic", lambda s, d: rounded(L.incremental_ic(panel(s, d), "mom", ["vol"], "fwd"), [], 5),
    suppliers(f"{_ORTH}, x AS ({ranks('p', 'mom', 'fwd')}), y AS ({ranks('o', 'rest', 'fwd')}), a1 AS (SELECT avg(ic) AS ic FROM (SELECT corr(ra, rb) AS ic FROM x GROUP BY dt HAVING count(*) >= 5)), b1 AS (SELECT avg(ic) AS ic FROM (SELECT corr(ra, rb) AS ic FROM y GROUP BY dt HAVING count(*) >= 5)) "
              f"SELECT {r('a1.ic', 'raw_ic', 5)}, {r('b1.ic', 'orthogonal_ic', 5)}, {r('b1.ic / a1.ic', 'incremental_ratio', 5)} FROM a1, b1"))  # fmt: skip
_IC = f"x AS ({ranks('p', 'mom', 'fwd')}), i AS (SELECT dt, corr(ra, rb) AS ic FROM x GROUP BY dt HAVING count(*) >= 5), dts AS (SELECT DISTINCT dt FROM p), al AS (SELECT dts.dt, ic FROM dts LEFT JOIN i ON dts.dt = i.dt)"
add("rolling_ic", lambda s, d: rounded(L.rolling_ic(panel(s, d), "mom", 1, 24), ["dt"]),
    suppliers(f"{_P}, {_IC} SELECT dt, {r('CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END', 'ic')} FROM al WINDOW w AS (ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"))
add("ic_decay", lambda s, d: rounded(CS.ic_decay(panel(s, d), "mom", (1, 3, 6)), ["horizon"]),
    suppliers(f"{_P}, h AS (SELECT unnest([1, 3, 6])::INT AS horizon), f AS (SELECT dt, 1::INT AS horizon, mom, lead(close, 1) {_S} / close - 1 AS t FROM p UNION ALL SELECT dt, 3, mom, lead(close, 3) {_S} / close - 1 FROM p UNION ALL SELECT dt, 6, mom, lead(close, 6) {_S} / close - 1 FROM p), x AS ({ranks('f', 'mom', 't', 'dt, horizon')}), i AS (SELECT horizon, dt, corr(ra, rb) AS ic FROM x GROUP BY ALL HAVING count(*) >= 5) SELECT horizon, {r('avg(ic)', 'mean_ic')}, count(ic) AS dates FROM i GROUP BY horizon"))
_LAGS = (1, 2, 3, 5, 8)
_LAGGED = f"""{_P}, pr AS (SELECT *, (rank() OVER (PARTITION BY dt, mom IS NULL ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(mom) {_D} AS pc FROM p),
lg AS ({' UNION ALL '.join(f'SELECT symbol, dt, mom, CASE WHEN mom IS NOT NULL THEN pc END AS pc, {k}::INT AS lag, lead(rt, {k}) {_S} AS fut FROM pr' for k in _LAGS)}),
x AS ({ranks('lg', 'mom', 'fut', 'dt, lag')}), ic AS (SELECT lag, avg(ic) AS ic FROM (SELECT lag, dt, corr(ra, rb) AS ic FROM x GROUP BY ALL HAVING count(*) >= 5) GROUP BY lag),
sp AS (SELECT lag, avg(s) AS spread FROM (SELECT lag, dt, avg(CASE WHEN pc >= 0.8 THEN fut END) - avg(CASE WHEN pc <= 0.2 THEN fut END) AS s FROM lg GROUP BY ALL) GROUP BY lag), lp AS (SELECT ic.lag, ic, spread FROM ic JOIN sp ON ic.lag = sp.lag)"""
add("lagged_ic", lambda s, d: rounded(L.lagged(panel(s, d), "mom", _LAGS), ["lag"]), suppliers(f"{_LAGGED} SELECT lag, {r('ic')}, {r('spread')} FROM lp"))


def _fit_sql(v: str, name: str) -> str:
    ok = f"sign({v}) = sign(z0) AND abs({v}) > 1e-12"
    slope = f"regr_slope(CASE WHEN {ok} THEN ln(abs({v})) END, CASE WHEN {ok} THEN lag::DOUBLE END)"
    return f"(SELECT CASE WHEN count(*) FILTER ({ok}) >= 3 THEN CASE WHEN {slope} >= -1e-12 THEN 'inf'::DOUBLE ELSE -ln(2) / {slope} END END FROM (SELECT *, first_value({v}) OVER (ORDER BY lag) AS z0 FROM lp)) AS {name}"


add("half_life", lambda s, d: rounded(L.half_life(panel(s, d), "mom", _LAGS), [], 4),
    suppliers(f"{_LAGGED}, ac AS (SELECT symbol, mom AS x, lag(mom) {_S} AS y FROM p), rh AS (SELECT median(rho) AS rho FROM (SELECT corr(x, y) AS rho FROM ac GROUP BY symbol HAVING count(x) > 10)), "
              f"hl AS (SELECT CASE WHEN rho > 0 AND rho < 1 THEN -ln(2) / ln(rho) END AS ar1, {_fit_sql('ic', 'ic_decay')}, {_fit_sql('spread', 'quantile_spread')} FROM rh) "
              f"SELECT {r('ar1', 'ar1', 4)}, {r('ic_decay', 'ic_decay', 4)}, {r('quantile_spread', 'quantile_spread', 4)}, {r('list_median(list_filter([ar1, ic_decay, quantile_spread], lambda v: v > 0 AND isfinite(v)))', 'median', 4)} FROM hl"))  # fmt: skip
add("decay_warning", lambda s, d: rounded(L.decay_warning(panel(s, d), "mom", 3, 1, 24).select("recent_ic", "longterm_ic", "is_blunt"), []),
    suppliers(f"{_P}, {_IC}, ro AS (SELECT dt, CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END AS ic FROM al WINDOW w AS (ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), rk AS (SELECT ic, row_number() OVER (ORDER BY dt DESC) AS k, count(*) OVER () AS n FROM ro WHERE ic IS NOT NULL), "
              f"g AS (SELECT avg(ic) FILTER (k <= greatest(10, floor(n / 10))) AS re, avg(ic) AS lo FROM rk HAVING count(*) >= 40) SELECT {r('re', 'recent_ic')}, {r('lo', 'longterm_ic')}, coalesce(lo > 0.005 AND re < 0.5 * lo, false) AS is_blunt FROM (SELECT 1) LEFT JOIN g ON true"))  # fmt: skip
add("factor_signal", lambda s, d: rounded(L.factor_to_signal(weekly(s, d).withColumn("x", F.col("close") - F.col("open")), "x", 20, "reversion").select("symbol", "dt", "signal"), ["symbol", "dt"]),
    bars_cte(f"x AS (SELECT *, close - open AS x FROM bars), z AS (SELECT *, {full('x', 20, f'(x - avg(x) {over(20)}) / nullif(stddev_pop(x) {over(20)}, 0)')} AS z FROM x) SELECT symbol, dt, {r('CASE WHEN z IS NULL THEN 0 ELSE -least(greatest(z, -2), 2) / 2 END', 'signal')} FROM z"))
_W = "OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
add("factor_scorecard", lambda s, d: rounded(L.factor_scorecard(weekly(s, d).withColumns({"x": I.momentum(F.col("close"), 4) - 1, "v": F.col("volume")}), "x", 4, ["v"]), ["symbol"], 4),
    bars_cte(f"f AS (SELECT *, close / lag(close, 4) {_S} - 1 AS x, volume AS v, lead(close, 4) {_S} / close - 1 AS t FROM bars), g AS (SELECT *, lag(x) {_S} AS y, CASE WHEN count(x + t) {_W} = 63 THEN corr(x, t) {_W} END AS ro FROM f), "
             f"h AS (SELECT symbol, corr(x, t) AS ic, avg(ro) / nullif(stddev_pop(ro), 0) AS ir, corr(x, y) AS ac, count(x) / count(*)::DOUBLE AS cov, abs(corr(x, v)) AS mx FROM g GROUP BY symbol) "
             f"SELECT symbol, {r('ic', 'ic', 4)}, {r('ir', 'ic_ir', 4)}, {r('ac', 'autocorr', 4)}, {r('cov', 'coverage', 4)}, {r('mx', 'max_corr_existing', 4)}, coalesce(nullif(concat_ws('; ', CASE WHEN abs(ic) < 0.02 THEN 'weak predictive power' END, CASE WHEN abs(ir) < 0.3 THEN 'unstable IC' END, CASE WHEN ac < 0.5 THEN 'high turnover' END, CASE WHEN mx > 0.7 THEN 'redundant' END), ''), 'looks promising') AS verdict FROM h"))  # fmt: skip


def _ls_sql(x: str, name: str) -> str:
    return f"{name} AS (SELECT dt, avg(rt) FILTER (pc > 0.8) - avg(rt) FILTER (pc <= 0.2) AS ret FROM (SELECT dt, rt, (rank() OVER (PARTITION BY dt ORDER BY pf) + (count(*) OVER (PARTITION BY dt, pf) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) AS pc FROM (SELECT dt, rt, lag({x}) {_S} AS pf FROM p) WHERE pf IS NOT NULL AND rt IS NOT NULL) GROUP BY dt)"


add("factor_return_correlation", lambda s, d: rounded(L.factor_return_correlation(panel(s, d), "mom", ["vol", "rev"], 24), ["dt"], 5),
    suppliers(f"{_P}, {_ls_sql('mom', 'm1')}, {_ls_sql('vol', 'm2')}, {_ls_sql('rev', 'm3')}, j AS (SELECT d.dt, m1.ret AS a, m2.ret AS b, m3.ret AS c FROM (SELECT DISTINCT dt FROM p) d LEFT JOIN m1 ON d.dt = m1.dt LEFT JOIN m2 ON d.dt = m2.dt LEFT JOIN m3 ON d.dt = m3.dt), "
              f"k AS (SELECT dt, CASE WHEN count(a + b) OVER w >= 20 THEN corr(a, b) OVER w END AS x, CASE WHEN count(a + c) OVER w >= 20 THEN corr(a, c) OVER w END AS y FROM j WINDOW w AS (ORDER BY dt ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT dt, {r('list_avg(list_filter([x, y], lambda v: v IS NOT NULL))', 'corr', 5)} FROM k"))  # fmt: skip
add("hyperbolic_decay", lambda s, d: rounded(L.fit_hyperbolic_decay(B.table(s, d, "part").groupBy("p_size").agg(F.avg(1 / (F.col("p_size") + F.col("p_retailprice") / 1000)).alias("ic")), "p_size"), [], 5),
    f"WITH p AS (SELECT p_size::DOUBLE AS t, avg(1 / (p_size + p_retailprice / 1000)) AS y FROM part GROUP BY 1), l AS (SELECT regr_slope(1 / y, t) AS b, 1 / regr_intercept(1 / y, t) AS k, avg(y) AS m FROM p), e AS (SELECT k, b * k AS lam, y, m, k / (1 + b * k * t) AS f FROM p, l) SELECT {r('k', 'K', 5)}, {r('lam', 'lam', 5)}, {r('CASE WHEN lam > 0 THEN 1 / lam ELSE 1e999 END', 'half_life', 5)}, {r('1 - sum((y - f) ** 2) / sum((y - m) ** 2)', 'r2', 5)} FROM e GROUP BY k, lam")
add("min_regime", lambda s, d: rounded(L.mrp(BT.buy_and_hold(weekly(s, d)).withColumn("regime", risk.trend_regime(40)), "ret", "regime", ["symbol"]), ["symbol"], 5),
    bars_cte(f"x AS (SELECT symbol, coalesce(close / lag(close) {_S} - 1, 0) AS rt, coalesce(sign(close - ({full('close', 40, f'avg(close) {over(40)}')})), 0) AS g FROM bars), m AS (SELECT symbol, g, avg(rt) * 252 AS m FROM x GROUP BY ALL) SELECT symbol, {r('min(m)', 'mrp', 5)} FROM m GROUP BY symbol"))
add("alpha_eval", lambda s, d: rounded(L.alpha_eval(panel(s, d), "mom", ["vol"], 3).select("predictive", "robustness", "diversity", "mean_ic"), [], 5),
    suppliers(f"{_P}, hh AS ({' UNION ALL '.join(f'SELECT dt, {h} AS h, mom, lead(close, {h}) {_S} / close - 1 AS t FROM p' for h in (2, 3, 4))}), x AS ({ranks('hh', 'mom', 't', 'dt, h')}), ic AS (SELECT h, avg(ic) AS ic FROM (SELECT h, dt, corr(ra, rb) AS ic FROM x GROUP BY ALL HAVING count(*) >= 5) GROUP BY h), "
              f"v AS ({ranks('p', 'mom', 'vol')}), dv AS (SELECT abs(avg(ic)) AS c FROM (SELECT corr(ra, rb) AS ic FROM v GROUP BY dt HAVING count(*) >= 5)), tu AS (SELECT ic * CASE WHEN (SELECT sum(ic) FROM ic) < 0 THEN -1 ELSE 1 END AS z FROM ic), rb AS (SELECT CASE WHEN max(z) > 0 THEN least(greatest(min(z) / max(z), 0), 1) ELSE 0 END AS ro FROM tu) "
              f"SELECT {r('least(abs(ic) / 0.05, 1)', 'predictive', 5)}, {r('ro', 'robustness', 5)}, {r('1 - c', 'diversity', 5)}, {r('ic', 'mean_ic', 5)} FROM ic, dv, rb WHERE h = 3"))  # fmt: skip
add("factor_correlation", lambda s, d: rounded(CS.factor_correlation(panel(s, d), ["mom", "vol", "rev"]), ["a", "b"], 5),
    suppliers(f"{_P}, q AS (SELECT * FROM p WHERE mom IS NOT NULL AND vol IS NOT NULL AND rev IS NOT NULL), k AS (SELECT dt, {', '.join(f'rank() OVER (PARTITION BY dt ORDER BY {x}) + (count(*) OVER (PARTITION BY dt, {x}) - 1) / 2.0 AS {x}' for x in ('mom', 'vol', 'rev'))} FROM q), "
              f"g AS (SELECT dt, corr(mom, vol) AS x, corr(mom, rev) AS y, corr(vol, rev) AS z FROM k GROUP BY dt) SELECT unnest(['mom', 'mom', 'vol']) AS a, unnest(['vol', 'rev', 'rev']) AS b, unnest([round(avg(x)::DOUBLE + 3.7e-8, 5), round(avg(y)::DOUBLE + 3.7e-8, 5), round(avg(z)::DOUBLE + 3.7e-8, 5)]) AS corr FROM g"))  # fmt: skip
add("drift_regime", lambda s, d: risk.drift_regime(weekly(s, d), 12, 0.5).select("symbol", "dt", "drift"),
    bars_cte(f"u AS (SELECT *, coalesce(close > lag(close) {_S}, false)::INT AS up FROM bars), v AS (SELECT symbol, dt, ({full('up', 12, f'avg(up) {over(12)}')}) > 0.5 AS st FROM u) SELECT symbol, dt, coalesce(lag(CASE WHEN st THEN 1.0 ELSE 0.0 END) {_S}, 0.0)::DOUBLE AS drift FROM v"))
add("drift_gate", lambda s, d: rounded(risk.drift_gate(weekly(s, d).select("symbol", "dt", "volume"), "volume", weekly(s, d).where("symbol <> 'Brand#11'"), 12, 0.5, "non_drift").select("symbol", "dt", "gated"), ["symbol", "dt"]),
    bars_cte(f"u AS (SELECT *, coalesce(close > lag(close) {_S}, false)::INT AS up FROM bars), v AS (SELECT symbol, dt, volume, ({full('up', 12, f'avg(up) {over(12)}')}) > 0.5 AS st FROM u), w AS (SELECT *, coalesce(lag(CASE WHEN st THEN 1 ELSE 0 END) {_S}, 0) AS g FROM v) SELECT symbol, dt, {r(chr(67) + 'ASE WHEN g = 0 AND symbol <> ' + chr(39) + 'Brand#11' + chr(39) + ' THEN volume END', 'gated')} FROM w"))
add("vol_target", lambda s, d: rounded(risk.vol_target(risk.returns(weekly(s, d)), "ret", 0.5, 12).select("symbol", "dt", "scale"), ["symbol", "dt"], 5),
    bars_cte(f"x AS (SELECT symbol, dt, close / lag(close) {_S} - 1 AS rt FROM bars), y AS (SELECT symbol, dt, {full('rt', 12, f'stddev_pop(rt) {over(12)} * sqrt(252)')} AS v FROM x WHERE rt IS NOT NULL), z AS (SELECT *, lag(v) {_S} AS pv FROM y) SELECT symbol, dt, {r('CASE WHEN pv IS NULL THEN 1 WHEN pv = 0 THEN 2 ELSE least(0.5 / pv, 2) END', 'scale', 5)} FROM z"))


# universes
def candidates(s, d):
    """Suppliers as a universe: figures derived from balances, keys and the region as sector."""
    region = B.table(s, d, "nation").join(B.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("sector"))
    rows = B.table(s, d, "supplier").join(region, "s_nationkey")
    k = F.col("s_suppkey")
    return rows.select(
        k.cast("string").alias("symbol"), "sector", (F.abs("s_acctbal") * 1e6).alias("mktcap"), F.when(k % 7 > 0, (F.col("s_acctbal") + 2000) * 1e4).alias("adv_usd"), F.when(k % 11 > 0, F.col("s_acctbal") + 1500.0).alias("price"),
        F.when(k % 5 > 0, F.lit(12000.0)).alias("high52"), F.lit(6000.0).alias("avg200"), F.when(k % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(k % 3 == 1, F.array(F.lit("B"))).otherwise(F.array(F.lit("C"))).alias("in_index"),
        F.when(k % 13 > 0, F.expr("date_add(DATE'1995-01-01', cast(s_suppkey * 17 % 2000 as int))")).alias("list_date"), F.when(k % 4 == 0, F.expr("date_add(DATE'1996-01-01', cast(s_suppkey * 29 % 2000 as int))")).alias("delist_date"),
    )


_CAND = """cand AS (SELECT s_suppkey::VARCHAR AS symbol, s_suppkey AS k, r_name AS sector, abs(s_acctbal) * 1e6 AS mktcap, CASE WHEN s_suppkey % 7 > 0 THEN (s_acctbal + 2000) * 1e4 END AS adv_usd, CASE WHEN s_suppkey % 11 > 0 THEN s_acctbal + 1500 END AS price,
  CASE WHEN s_suppkey % 5 > 0 THEN 12000.0::DOUBLE END AS high52, 6000.0::DOUBLE AS avg200, CASE s_suppkey % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['B'] ELSE ['C'] END AS in_index,
  CASE WHEN s_suppkey % 13 > 0 THEN DATE '1995-01-01' + (s_suppkey * 17 % 2000)::INT END AS list_date, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1996-01-01' + (s_suppkey * 29 % 2000)::INT END AS delist_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_Z = lambda x: f"CASE WHEN stddev_pop({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () WHEN {x} IS NOT NULL THEN 0.0 END"
_SCORES = f"""{_CAND}, nb AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) - 1 AS i, max(close) OVER (PARTITION BY symbol) AS mx FROM bars),
mv AS (SELECT symbol, max(close) FILTER (i = 0) / max(close) FILTER (i = 6) - 1 AS m6, max(close) FILTER (i = 0) / max(close) FILTER (i = 12) - 1 AS m12, max(close) FILTER (i = 0) / max(mx) AS oh FROM nb GROUP BY symbol),
s0 AS (SELECT c.*, coalesce((m6 + m12) / 2, m6, m12, price / avg200 - 1) AS hot, coalesce(price / high52, oh) AS hi52, CASE WHEN mv.symbol IS NOT NULL THEN m12 ELSE price / avg200 - 1 END AS rs FROM cand c LEFT JOIN mv ON c.symbol = mv.symbol),
s1 AS (SELECT *, coalesce(hot, median(hot) OVER ()) AS fh, coalesce(hi52, median(hi52) OVER ()) AS fi, coalesce(rs, median(rs) OVER ()) AS fr, log10(greatest(mktcap, 1)) AS lm, CASE WHEN adv_usd IS NOT NULL THEN log10(greatest(adv_usd, 1)) ELSE 0 END AS la FROM s0),
s2 AS (SELECT *, fr - median(fr) OVER (PARTITION BY sector) AS ld FROM s1), s3 AS (SELECT *, {_Z('lm')} AS size_z, {_Z('la')} AS liq_z, {_Z('fh')} AS hot_z, {_Z('fi')} AS hi52_z, {_Z('ld')} AS lz FROM s2),
sc AS (SELECT *, lz * 0.6 + size_z * 0.4 AS lead_z, size_z * 0.2 + liq_z * 0.15 + hot_z * 0.3 + hi52_z * 0.15 + (lz * 0.6 + size_z * 0.4) * 0.2 AS score FROM s3)"""


def _scores(s, d):
    return U.compute_scores(candidates(s, d), monthly(s, d), horizons=(6, 12))


add("universe_scores", lambda s, d: rounded(_scores(s, d).select("symbol", "sector", "hot", "hi52", "size_z", "liq_z", "lead_z", "score"), ["symbol"], 5), suppliers(f"{_SCORES} SELECT symbol, sector, {', '.join(r(c, c, 5) for c in ('hot', 'hi52', 'size_z', 'liq_z', 'lead_z', 'score'))} FROM sc"))
_SEL = "se AS (SELECT *, coalesce(mktcap >= 1e9, false) AND coalesce(adv_usd >= 2e7, false) AND len(list_intersect(in_index, ['A', 'B'])) > 0 AS gate FROM sc), sl AS (SELECT *, CASE WHEN gate THEN row_number() OVER (PARTITION BY sector, gate ORDER BY score DESC NULLS LAST, symbol) END AS place FROM se), un AS (SELECT *, coalesce(place <= 3, false) AS selected FROM sl)"


def _universe(s, d):
    return U.scored_universe(_scores(s, d), 3, 1e9, 2e7, ["A", "B"])


add("universe_selection", lambda s, d: _universe(s, d).select("symbol", "sector", "gate", F.coalesce("place", F.lit(0)).alias("place"), "selected"), suppliers(f"{_SCORES}, {_SEL} SELECT symbol, sector, gate, coalesce(place, 0) AS place, selected FROM un"))


def _manual(s, d):
    return U.merge_manual(_universe(s, d), candidates(s, d).where("cast(symbol as int) % 9 = 0").select("symbol"))


add("universe_manual", lambda s, d: _manual(s, d).select("symbol", "source", "rank"), suppliers(f"{_SCORES}, {_SEL}, mm AS (SELECT *, CASE WHEN selected THEN 'data' ELSE 'manual' END AS source FROM un WHERE selected OR k % 9 = 0) SELECT symbol, source, row_number() OVER (ORDER BY source, CASE WHEN source = 'data' THEN sector END, score DESC NULLS LAST, symbol) AS rank FROM mm"))
add("universe_breadth", lambda s, d: U.breadth_warnings(_manual(s, d), 20), suppliers(f"{_SCORES}, {_SEL} SELECT count(DISTINCT symbol) AS names, count(DISTINCT sector) AS sectors, count(DISTINCT symbol) < 20 AS is_few, count(DISTINCT sector) <= 1 AS is_one_sector FROM un WHERE selected OR k % 9 = 0"))
add("anti_survivorship", lambda s, d: U.anti_survivorship(candidates(s, d), "1998-06-30").select("symbol", "warning"), f"WITH {_CAND} SELECT symbol, CASE WHEN list_date IS NULL THEN 'no list_date' ELSE '' END AS warning FROM cand WHERE coalesce(list_date <= DATE '1998-06-30', true) AND coalesce(delist_date > DATE '1998-06-30', true)")
add("rolling_universe", lambda s, d: U.rolling_universe(monthly(s, d), BT.rebalance_dates(monthly(s, d), "quarter"), 12, 1e5, 6),
    suppliers(f"q AS (SELECT max(dt) AS day FROM bars GROUP BY date_trunc('quarter', dt)), k AS (SELECT symbol, dt, count(*) {_RUN} AS n, avg(close * volume) {over(6)} AS adv FROM bars), a AS (SELECT day, y.symbol FROM q, (SELECT DISTINCT symbol FROM bars) y) SELECT a.day AS dt, a.symbol FROM a ASOF JOIN k ON a.symbol = k.symbol AND a.day >= k.dt WHERE n >= 12 AND coalesce(adv >= 1e5, true)"))
add("top_by_sector", lambda s, d: rounded(CS.top_by_sector(_scores(s, d), "score", "sector", 2).select("symbol", "sector", "place", "score"), ["symbol"], 5), suppliers(f"{_SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC NULLS LAST, symbol) AS place FROM sc) SELECT symbol, sector, place, {r('score', 'score', 5)} FROM t WHERE place <= 2"))


# fundamentals and blends
def snapshot(s, d):
    k, a = F.col("s_suppkey"), F.col("s_acctbal")
    cols = {"pe": a / 300 + 10, "pb": F.when(k % 6 > 0, a / 2000), "roe": a / 50000 + k / 1000, "net_margin": F.when(k % 4 > 0, k / 500.0), "debt_to_equity": a / 9000, "revenue_growth": F.sin(k.cast("double")), "earnings_growth": F.when(k % 5 > 0, F.cos(k.cast("double")))}
    return B.table(s, d, "supplier").select(k.cast("string").alias("symbol"), *(c.alias(n) for n, c in cols.items()))


_SNAP = "sn AS (SELECT s_suppkey::VARCHAR AS symbol, s_acctbal / 300 + 10 AS pe, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal / 2000 END AS pb, s_acctbal / 50000 + s_suppkey / 1000 AS roe, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey / 500.0::DOUBLE END AS net_margin, s_acctbal / 9000 AS debt_to_equity, sin(s_suppkey::DOUBLE) AS revenue_growth, CASE WHEN s_suppkey % 5 > 0 THEN cos(s_suppkey::DOUBLE) END AS earnings_growth FROM supplier)"
_FUND = f"""{_SNAP}, fz AS (SELECT symbol, {', '.join(f'{w} * ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS {x}' for x, w in (('pe', -1), ('pb', -1), ('roe', 1), ('net_margin', 1), ('debt_to_equity', -1), ('revenue_growth', 1), ('earnings_growth', 1)))} FROM sn),
fu AS (SELECT symbol, {', '.join(f'list_avg(list_filter([{l}], lambda v: v IS NOT NULL)) AS {n}' for n, l in (('value', 'pe, pb'), ('quality', 'roe, net_margin, debt_to_equity'), ('growth', 'revenue_growth, earnings_growth')))} FROM fz)"""
add("fundamental_factors", lambda s, d: rounded(MF.with_fundamental_factors(snapshot(s, d)).select("symbol", "value", "quality", "growth"), ["symbol"], 5), f"WITH {_FUND} SELECT symbol, {r('value', 'value', 5)}, {r('quality', 'quality', 5)}, {r('growth', 'growth', 5)} FROM fu")
add("sentiment_factor", lambda s, d: rounded(MF.sentiment_factor(B.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.sin("s_acctbal").alias("score"))), ["symbol"], 5), f"SELECT s_suppkey::VARCHAR AS symbol, {r('(sin(s_acctbal) - avg(sin(s_acctbal)) OVER ()) / stddev_pop(sin(s_acctbal)) OVER ()', 'sentiment', 5)} FROM supplier")


def _blend(s, d, **more):
    static = MF.with_fundamental_factors(snapshot(s, d)).select("symbol", "value", "quality")
    return MF.multi_factor_signal(monthly(s, d), {"momentum": 0.4, "low_vol": 0.2, "value": 0.3, "quality": 0.1}, static, "quarter", 0.2, 0.1, True, 6, 1, 6, **more)


_DZ = lambda x: f"coalesce(CASE WHEN {x} IS NOT NULL THEN coalesce(({x} - avg({x}) {_D}) / nullif(stddev_pop({x}) {_D}, 0), 0) END, 0)"
add("multi_factor_weights", lambda s, d: rounded(_blend(s, d), ["dt", "symbol"]),
    suppliers(f"{_FUND}, {_P}, lv AS (SELECT p.symbol, dt, lag(close, 1) {_S.replace('symbol', 'p.symbol')} / lag(close, 7) {_S.replace('symbol', 'p.symbol')} - 1 AS m, -(CASE WHEN count(rt) OVER w6 = 6 THEN stddev_pop(rt) OVER w6 END) AS l, value, quality FROM p LEFT JOIN fu ON p.symbol = fu.symbol WINDOW w6 AS (PARTITION BY p.symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), "
              f"bl AS (SELECT symbol, dt, 0.4 * {_DZ('m')} + 0.2 * {_DZ('l')} + 0.3 * coalesce(value, 0) + 0.1 * coalesce(quality, 0) AS sc FROM lv), rb AS (SELECT * FROM bl WHERE dt IN (SELECT max(dt) FROM bars GROUP BY date_trunc('quarter', dt))), "
              f"rr AS (SELECT *, greatest(round_even(count(*) {_D} * 0.2, 0), 1) AS k, greatest(round_even(count(*) {_D} * 0.1, 0), 1) AS j, row_number() OVER (PARTITION BY dt ORDER BY sc DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY sc, symbol) AS w FROM rb) "
              f"SELECT dt, symbol, {r('CASE WHEN u <= k THEN 1.0 / k ELSE 0 END - CASE WHEN w <= j THEN 1.0 / j ELSE 0 END', 'weight')} FROM rr"))  # fmt: skip
add("multi_factor_smoothed", lambda s, d: rounded(_blend(s, d, smoothing=0.4), ["dt", "symbol"]))

# ratings and levels
_EMA = {n: ewm_sql("close", 2 / (n + 1), n)[0] for n in ratings.MEANS}
_OSC = f"""{_NUMBERED}, q1 AS (SELECT *, greatest(mv, 0.0 * mv) AS up, greatest(-mv, 0.0 * mv) AS dn, (high + low + close) / 3 AS tp FROM n), q2 AS (SELECT *, {_O}, {_OU}, {_OD} FROM q1),
q3 AS (SELECT *, {_E12} - {_E26} AS macd, {_UP} AS au, {_DN} AS ad, {', '.join(f"{e} AS e{n}, {full('close', n, f'avg(close) {over(n)}')} AS m{n}" for n, e in _EMA.items())}, {full('low', 14, f'min(low) {over(14)}')} AS ll, {full('high', 14, f'max(high) {over(14)}')} AS hh, {full('tp', 20, f'avg(tp) {over(20)}')} AS tm FROM q2),
q4 AS (SELECT *, {_OM}, abs(tp - tm) AS ta, CASE WHEN au IS NULL THEN NULL WHEN au = 0 AND ad = 0 THEN 50 WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END AS rsi, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS bk FROM q3),
q5 AS (SELECT *, {_SIG} AS sg, {full('ta', 20, f'avg(ta) {over(20)}')} AS md, close / lag(close, 10) {_S} - 1 AS roc FROM q4)"""
_MEAN_OF = lambda votes: f"coalesce(list_avg(list_filter([{', '.join(votes)}], lambda v: v IS NOT NULL)), 0)"
_VOTES = [f"CASE WHEN {x}{n} IS NOT NULL THEN CASE WHEN close > {x}{n} THEN 1.0 ELSE -1.0 END END" for n in ratings.MEANS for x in "me"]
_VOTE = lambda x, low, high: f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {x} < {low} THEN 1.0 WHEN {x} > {high} THEN -1.0 ELSE 0.0 END END"
_WAVES = [_VOTE("rsi", 30, 70), _VOTE("((close - ll) / nullif(hh - ll, 0) * 100)", 20, 80), _VOTE("((tp - tm) / nullif(md * 0.015, 0))", -100, 100), _VOTE("((hh - close) / nullif(hh - ll, 0) * -100)", -80, -20), "CASE WHEN macd > sg THEN 1.0 ELSE -1.0 END", "CASE WHEN roc IS NOT NULL THEN CASE WHEN roc > 0 THEN 1.0 ELSE -1.0 END END"]
add("tech_rating", lambda s, d: rounded(ratings.tech_rating(weekly(s, d)), ["symbol", "dt"], 4),
    bars_cte(f"{_OSC}, t AS (SELECT symbol, dt, {_MEAN_OF(_VOTES)} AS a, {_MEAN_OF(_WAVES)} AS b FROM q5 WHERE bk = 1) SELECT symbol, dt, {r('a', 'means', 4)}, {r('b', 'oscillators', 4)}, {r('(a + b) / 2', 'score', 4)}, CASE WHEN (a + b) / 2 >= 0.5 THEN 'strong buy' WHEN (a + b) / 2 >= 0.1 THEN 'buy' WHEN (a + b) / 2 > -0.1 THEN 'neutral' WHEN (a + b) / 2 > -0.5 THEN 'sell' ELSE 'strong sell' END AS label FROM t"))
_HELD = lambda x: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 100) END"
_PART = "CASE WHEN {0} IS NOT NULL THEN {1} ELSE 0 END"
_WEIGHTS = (("p1", 0.25), ("p2", 0.2), ("p3", 0.2), ("p4", 0.15), ("p5", 0.1), ("p6", 0.1))
add("strength", lambda s, d: rounded(ratings.strength(weekly(s, d)), ["symbol"], 3),
    bars_cte(f"{_OSC}, h AS (SELECT *, close / lag(close, 125) {_S} - 1 AS r125, close / lag(close, 63) {_S} - 1 AS r63, {full('close', 20, f'min(close) {over(20)}')} AS lo, {full('close', 20, f'max(close) {over(20)}')} AS hi FROM q4), k AS (SELECT *, max(r125) FILTER (bk = 1) OVER (PARTITION BY symbol) AS n125, max(r63) FILTER (bk = 1) OVER (PARTITION BY symbol) AS n63 FROM h), "
             f"g AS (SELECT symbol, max(close) FILTER (bk = 1) AS c, max(m200) FILTER (bk = 1) AS m200, max(m50) FILTER (bk = 1) AS m50, CASE WHEN count(r125) >= 20 THEN avg((r125 <= n125)::INT) * 100 END AS p2, CASE WHEN count(r63) >= 20 THEN avg((r63 <= n63)::INT) * 100 END AS p4, max(rsi) FILTER (bk = 1) AS p5, max(lo) FILTER (bk = 1) AS lo, max(hi) FILTER (bk = 1) AS hi FROM k GROUP BY symbol), "
             f"w AS (SELECT *, {_HELD('(50 + (c / m200 - 1) * 100)')} AS p1, {_HELD('(50 + (c / m50 - 1) * 250)')} AS p3, CASE WHEN hi > lo THEN {_HELD('((c - lo) / (hi - lo) * 100)')} ELSE 50 END AS p6 FROM g), z AS (SELECT symbol, ({' + '.join(f'coalesce({p} * {x}, 0)' for p, x in _WEIGHTS)}) / ({' + '.join(_PART.format(p, x) for p, x in _WEIGHTS)}) AS st FROM w) "
             f"SELECT symbol, {r('st', 'strength', 3)}, CASE WHEN st >= 80 THEN 'very strong' WHEN st >= 60 THEN 'strong' WHEN st >= 40 THEN 'neutral' WHEN st >= 20 THEN 'weak' ELSE 'very weak' END AS label FROM z"))  # fmt: skip
_LINE = lambda level: f"close + CASE WHEN {level / (100 - level)!r} * ad - au >= 0 THEN ({level / (100 - level)!r} * ad - au) * 13 ELSE ({level / (100 - level)!r} * ad - au) * 13 / {level / (100 - level)!r} END"
add("rsi_isolines", lambda s, d: rounded(ratings.rsi_isolines(weekly(s, d)).select("symbol", "dt", "rsi_price_30", "rsi_price_70"), ["symbol", "dt"], 4), bars_cte(f"{_OSC} SELECT symbol, dt, {r(_LINE(30.0), 'rsi_price_30', 4)}, {r(_LINE(70.0), 'rsi_price_70', 4)} FROM q3"))
_TR = f"tr AS (SELECT *, row_number() {_S} AS i, CASE WHEN lag(close) {_S} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {_S}), abs(low - lag(close) {_S})) END AS tr FROM bars)"
_Y = "OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_LEVELS = f"""{_TR}, ew AS (SELECT *, pow(13 / 14.0::DOUBLE, i - 1) * sum(CASE WHEN i = 1 THEN tr ELSE tr / 14 * pow(13 / 14.0::DOUBLE, 1 - i) END) {_RUN} AS atr FROM tr),
lv AS (SELECT symbol, dt, close AS c, atr, [{full('close', 20, f'avg(close) {over(20)}')}, {full('close', 50, f'avg(close) {over(50)}')}, {full('close', 200, f'avg(close) {over(200)}')}, {full('close', 20, f'avg(close) {over(20)} - 2 * stddev_pop(close) {over(20)}')}, {full('low', 20, f'min(low) {over(20)}')}, {full('low', 60, f'min(low) {over(60)}')}, min(low) {_Y}] AS dn,
 [{full('close', 20, f'avg(close) {over(20)} + 2 * stddev_pop(close) {over(20)}')}, {full('high', 20, f'max(high) {over(20)}')}, {full('high', 60, f'max(high) {over(60)}')}, max(high) {_Y}] AS up, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS bk, count(*) OVER (PARTITION BY symbol) AS n FROM ew),
l1 AS (SELECT *, list_max(list_filter(dn, lambda x: x < c)) AS s1, list_min(list_filter(up, lambda x: x > c)) AS r1 FROM lv WHERE bk = 1 AND n >= 60),
l2 AS (SELECT *, list_max(list_filter(dn, lambda x: x < s1)) AS s2, list_min(list_filter(up, lambda x: x > r1)) AS r2, greatest(coalesce(s1, c - 1.5 * atr), c - 1.5 * atr) AS a0, c - 0.5 * atr AS b0 FROM l1),
l3 AS (SELECT *, least(a0, b0) AS bl, greatest(a0, b0) AS bh, (a0 + b0) / 2 AS en FROM l2), l4 AS (SELECT *, least(en - 2 * atr, coalesce(s1 - 0.3 * atr, en - 2 * atr)) AS st FROM l3), l5 AS (SELECT *, coalesce(r1, en + 2 * (en - st)) AS t1, en + 2 * (en - st) AS t2 FROM l4)"""
add("trade_levels", lambda s, d: rounded(ratings.trade_levels(weekly(s, d)).select("symbol", "dt", "price", "atr", "support1", "support2", "resistance1", "resistance2", "buy_low", "buy_high", "stop_loss", "target1", "target2", "reward_risk", "target1_pct"), ["symbol", "dt"], 4),
    bars_cte(f"{_LEVELS} SELECT symbol, dt, {', '.join(r(v, n, 4) for v, n in (('c', 'price'), ('atr', 'atr'), ('s1', 'support1'), ('s2', 'support2'), ('r1', 'resistance1'), ('r2', 'resistance2'), ('bl', 'buy_low'), ('bh', 'buy_high'), ('st', 'stop_loss'), ('t1', 'target1'), ('t2', 'target2'), ('CASE WHEN en > st THEN (t1 - en) / (en - st) END', 'reward_risk'), ('t1 / c - 1', 'target1_pct')))} FROM l5"))


def _k():
    return F.col("s_suppkey")


add("classify_signal", lambda s, d: B.table(s, d, "supplier").select("s_suppkey", ratings.classify_signal(F.when(_k() % 9 > 0, _k() % 100 + 0.0), (_k() % 4).cast("double"), (_k() % 3 - 1).cast("double"), _k() % 2 == 0, _k() % 17 == 0, F.lit(False)).alias("verdict")),
    "WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey % 100 ELSE 50 END AS rsi, s_suppkey % 4 AS rr, s_suppkey % 3 - 1 AS t, s_suppkey % 2 = 0 AS z, s_suppkey % 17 = 0 AS e FROM supplier) SELECT s_suppkey, CASE WHEN t < 0 THEN CASE WHEN rsi <= 30 THEN 'watch' ELSE 'short' END WHEN e THEN 'watch' WHEN t > 0 AND rsi < 70 AND rr >= 1.5 AND z THEN 'long' ELSE 'watch' END AS verdict FROM x")

# context
add("market_breadth", lambda s, d: rounded(C.market_breadth(weekly(s, d), 20), []), bars_cte(f"x AS (SELECT symbol, close, {full('close', 20, f'avg(close) {over(20)}')} AS ma, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT {r('avg((close > ma)::INT)', 'breadth')}, {r('2 * avg((close > ma)::INT) - 1', 'score')}, count(*) AS n FROM x WHERE k = 1 AND n > 20"))
add("index_regime", lambda s, d: rounded(C.index_regime(weekly(s, d), 40, 13, 10), ["symbol"], 5),
    bars_cte(f"x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS i, close / lag(close) {_S} - 1 AS rt FROM bars), g AS (SELECT symbol, max(close) FILTER (i = 1) AS px, avg(close) FILTER (i <= 40) AS ma, max(close) FILTER (i = 1) / max(close) FILTER (i = 13) - 1 AS mo, stddev_pop(rt) FILTER (i <= 10) * sqrt(252) AS rv FROM x GROUP BY symbol), "
             f"h AS (SELECT *, least(greatest(0.5 * tanh((px / ma - 1) * 8) + 0.35 * tanh(mo * 6) - 0.15 * tanh((rv - 0.15) / 0.15), -1), 1) AS sc FROM g) SELECT symbol, {r('sc', 'score', 5)}, px > ma AS above_ma, {r('mo', 'momentum', 5)}, {r('rv', 'ann_vol', 5)}, CASE WHEN sc < -0.25 THEN 'risk-off' WHEN sc > 0.25 THEN 'risk-on' ELSE 'neutral' END AS regime FROM h"))  # fmt: skip


def _parts(s, d):
    k = F.col("s_suppkey")
    x = lambda m: F.when(k % m > 0, F.sin(k * 1.0 / m))
    return B.table(s, d, "supplier").select("s_suppkey", C.macro_score({"vix": x(2), "rates": x(3), "curve": x(5), "econ": x(7), "geo": x(11), "event": x(13)}).alias("macro"), C.market_overlay({"index": x(2), "breadth": x(3), "macro": x(5)}).alias("market"), C.hedge_ratio(x(3) * 3, x(5), x(7)).alias("hedge"))


def _blend_sql(parts: dict[str, tuple[int, float]]) -> str:
    x = lambda m: f"CASE WHEN s_suppkey % {m} > 0 THEN sin(s_suppkey / {m}.0::DOUBLE) END"
    top, low = " + ".join(f"coalesce({x(m)} * {w}, 0)" for m, w in parts.values()), " + ".join(f"CASE WHEN s_suppkey % {m} > 0 THEN {w} ELSE 0 END" for m, w in parts.values())
    return f"least(greatest(coalesce(({top}) / nullif({low}, 0), 0), -1), 1)"


add("macro_market", lambda s, d: rounded(_parts(s, d), ["s_suppkey"], 5),
    f"SELECT s_suppkey, {r(_blend_sql({'vix': (2, 0.28), 'rates': (3, 0.18), 'curve': (5, 0.14), 'econ': (7, 0.18), 'geo': (11, 0.12), 'event': (13, 0.1)}), 'macro', 5)}, {r(_blend_sql({'index': (2, 0.5), 'breadth': (3, 0.2), 'macro': (5, 0.3)}), 'market', 5)}, "
    + r("least(greatest(coalesce(-list_avg(list_filter([CASE WHEN s_suppkey % 5 > 0 THEN sin(s_suppkey / 5.0::DOUBLE) END, CASE WHEN s_suppkey % 7 > 0 THEN sin(s_suppkey / 7.0::DOUBLE) END], lambda v: v IS NOT NULL)), 0), 0), 1) * least(greatest(coalesce(CASE WHEN s_suppkey % 3 > 0 THEN sin(s_suppkey / 3.0::DOUBLE) * 3 END, 1), 0.5), 2) / 2", "hedge", 5) + " FROM supplier")
_UNI = f"un AS (SELECT symbol::VARCHAR AS symbol, sector FROM ({_BR}))"


def _sectors(s, d):
    return candidates(s, d).select("symbol", "sector")


add("event_spillover", lambda s, d: rounded(C.propagate_event(B.table(s, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_acctbal") / 10000).alias("impact")), _sectors(s, d)), ["symbol", "peer"]), f"WITH {_UNI} SELECT a.symbol, b.symbol AS peer, {r('s_acctbal / 10000 * 0.5', 'spillover')} FROM un a JOIN un b ON a.sector = b.sector AND a.symbol <> b.symbol JOIN supplier ON s_suppkey::VARCHAR = a.symbol WHERE s_acctbal > 8000")
add("sector_members", lambda s, d: C.by_sector(_sectors(s, d)).select("sector", F.array_join("symbols", ",").alias("symbols")), f"WITH {_UNI} SELECT sector, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM un GROUP BY sector")
add("sector_scores", lambda s, d: C.sector_scores(_sectors(s, d), s.createDataFrame([("ASIA", 0.4), ("EUROPE", -0.1)], "sector string, score double")), f"WITH {_UNI} SELECT symbol, sector, CASE sector WHEN 'ASIA' THEN 0.4 WHEN 'EUROPE' THEN -0.1 ELSE 0 END::DOUBLE AS sector_score FROM un")
add("context_gate", lambda s, d: C.context_gate(B.table(s, d, "nation").select(F.col("n_name").alias("name")), B.table(s, d, "nation").where("n_nationkey % 4 > 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 > 0).alias("activation"), (F.col("n_nationkey") / 25.0).alias("relevance"))).select("name", "is_active", "reason"),
    "WITH c AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 5 > 0 END AS a, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey / 25.0 END AS rel FROM nation) SELECT name, NOT (coalesce(a = false, false) OR coalesce(rel < 0.3, false)) AS is_active, concat_ws('; ', CASE WHEN a = false THEN 'not activated' END, CASE WHEN rel < 0.3 THEN 'low relevance' END) AS reason FROM c")

# attribution
add("pnl_by_symbol", lambda s, d: rounded(A.pnl_by_symbol(B.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").alias("unrealized_pnl")), B.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("symbol"), (F.col("l_extendedprice") * F.col("l_discount")).alias("realized_pnl"))), ["symbol"], 3),
    f"SELECT s_suppkey::VARCHAR AS symbol, {r('s_acctbal', 'unrealized_pnl', 3)}, {r('x', 'realized_pnl', 3)} FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice * l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_suppkey = s_suppkey")
add("pnl_by_sector", lambda s, d: rounded(A.attribute_by_sector(B.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").alias("unrealized_pnl")), _sectors(s, d).where("sector <> 'AFRICA'")), ["sector"], 3), f"WITH {_UNI} SELECT CASE WHEN sector = 'AFRICA' THEN 'other' ELSE sector END AS sector, {r('sum(s_acctbal)', 'pnl', 3)} FROM un JOIN supplier ON s_suppkey::VARCHAR = symbol GROUP BY 1")


def _two_factors(s, d):
    rets = risk.returns(weekly(s, d))
    days = rets.groupBy("dt").agg(F.avg("ret").alias("mkt"), F.avg(F.when(F.col("symbol") < "Brand#2", F.col("ret"))).alias("half"), F.avg(F.when(F.substring("symbol", -1, 1) == "3", F.col("ret"))).alias("port"))
    return A.factor_attribution(days, "port", ["mkt"])


add("factor_attribution", lambda s, d: rounded(_two_factors(s, d), ["factor"], 5), bars_cte(f"{_RET}, g AS (SELECT dt, avg(rt) AS m, avg(rt) FILTER (right(symbol, 1) = '3') AS p FROM j GROUP BY dt), f AS (SELECT regr_intercept(p, m) AS a, regr_slope(p, m) AS b, regr_r2(p, m) AS r2 FROM g) SELECT 'alpha' AS factor, {r('a', 'beta', 5)}, {r('r2', 'r2', 5)} FROM f UNION ALL SELECT 'mkt', {r('b', 'beta', 5)}, {r('r2', 'r2', 5)} FROM f"))


def _trials(s, d):
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, ("mom", "vol", "value", "carry", "size")))
    two = F.concat(F.get(names, (k % 5).cast("int")), F.lit("+"), F.get(names, (k * 3 % 4 + 1).cast("int")))
    return B.table(s, d, "part").select(k.alias("trial"), two.alias("factors"), F.when(k % 23 > 0, F.sin(k * 1.0)).otherwise(float("nan")).alias("icir"), F.when(k % 2 == 0, "bull").otherwise("bear").alias("regime"), F.lit("US").alias("market"))


_TRIALS = "tl AS (SELECT p_partkey AS trial, ['mom', 'vol', 'value', 'carry', 'size'][p_partkey % 5 + 1] || '+' || ['mom', 'vol', 'value', 'carry', 'size'][p_partkey * 3 % 4 + 2] AS factors, CASE WHEN p_partkey % 23 > 0 THEN sin(p_partkey::DOUBLE) END AS icir, p_partkey % 2 = 0 AS bull FROM part)"
add("suggest_factors", lambda s, d: rounded(A.suggest_factors(_trials(s, d), "bull"), ["factor"]), f"WITH {_TRIALS}, e AS (SELECT unnest(string_split(factors, '+')) AS factor, icir FROM tl WHERE bull AND icir IS NOT NULL) SELECT factor, count(*) AS trials, {r('avg((icir > 0)::INT)', 'success')}, {r('avg(icir)', 'mean_icir')} FROM e GROUP BY factor")
add("best_trials", lambda s, d: rounded(A.best_trials(_trials(s, d), "US", "bear", 12).select("trial", "icir"), ["trial"]), f"WITH {_TRIALS} SELECT trial, {r('icir')} FROM tl WHERE NOT bull ORDER BY tl.icir DESC NULLS LAST, trial LIMIT 12")
add("calibration", lambda s, d: rounded(A.calibration(B.table(s, d, "part").select((F.col("p_size") % 9).cast("double").alias("score"), F.col("p_retailprice").alias("fwd"))), ["bucket"], 4),
    f"WITH x AS (SELECT (p_size % 9)::DOUBLE AS score, p_retailprice AS fwd FROM part), e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM x), c AS (SELECT score, fwd, greatest(len(list_filter(e[1:-2], lambda v: v < score)), 1) AS bucket FROM x, e) SELECT bucket, count(*) AS n, {r('min(score)', 'low', 4)}, {r('max(score)', 'high', 4)}, {r('avg(fwd)', 'mean_outcome', 4)} FROM c GROUP BY bucket")

# searches
_GRID = {"lookback": [4, 8, 16]}
_MOM = lambda n: f"sg{n} AS (SELECT *, CASE WHEN close / lag(close, {n}) {_S} - 1 > 0 THEN 1.0 ELSE 0.0 END AS signal FROM bars), po{n} AS (SELECT symbol, dt, signal, coalesce(lag(signal) {_S}, 0.0) AS position, coalesce(close / lag(close) {_S} - 1, 0.0) AS ar FROM sg{n}), cf{n} AS (SELECT *, position * ar - abs(position - coalesce(lag(position) {_S}, 0)) * 2 / 1e4 AS ret, abs(position - coalesce(lag(position) {_S}, 0)) AS turnover, '{{\"lookback\": {n}}}' AS config FROM po{n})"
_CONFIGS = ", ".join(_MOM(n) for n in (4, 8, 16)) + ", cfg AS (" + " UNION ALL ".join(f"SELECT symbol, dt, config, signal, position, ret, turnover FROM cf{n}" for n in (4, 8, 16)) + ")"
_SHARPE = "CASE WHEN stddev_pop({0}) > 0 THEN avg({0}) / stddev_pop({0}) * sqrt(252) ELSE 0 END"
add("grid_search", lambda s, d: rounded(search.grid_search(weekly(s, d), "ts_momentum", _GRID, stress_bps=5.0).select("symbol", "config", "total_return", "sharpe", "stressed_sharpe", "exposure", "place"), ["symbol", "config"], 5),
    bars_cte(f"{_CONFIGS}, g AS (SELECT symbol, config, product(1 + ret) - 1 AS tr, {_SHARPE.format('ret')} AS sh, {_SHARPE.format('(ret - turnover * 5 / 1e4)')} AS ss, avg((position <> 0)::INT) AS ex FROM cfg GROUP BY ALL) SELECT symbol, config, {r('tr', 'total_return', 5)}, {r('sh', 'sharpe', 5)}, {r('ss', 'stressed_sharpe', 5)}, {r('ex', 'exposure', 5)}, row_number() OVER (PARTITION BY symbol ORDER BY ss DESC NULLS LAST, config)::INT AS place FROM g"))
add("screen_strategies", lambda s, d: rounded(search.screen(weekly(s, d), ["ts_momentum"], {"ts_momentum": _GRID}), ["symbol", "family", "config"], 5),
    bars_cte(f"{_CONFIGS}, g AS (SELECT symbol, config, {_SHARPE.format('ret')} AS sh FROM cfg GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sh DESC, config) = 1), i AS (SELECT c.*, sh, row_number() OVER (PARTITION BY c.symbol ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY c.symbol) AS n FROM cfg c JOIN b ON c.symbol = b.symbol AND c.config = b.config), "
             f"o AS (SELECT *, CASE WHEN floor(n / 5) >= 30 AND i >= floor(n / 5) THEN ret END AS o FROM i) SELECT symbol, 'ts_momentum' AS family, config, {r('sh', 'sharpe', 5)}, {r('CASE WHEN count(o) > 0 THEN ' + _SHARPE.format('o') + ' END', 'oos_sharpe', 5)} FROM o GROUP BY symbol, config, sh"))  # fmt: skip
_FOLD = f"""{_CONFIGS}, wi AS (SELECT *, row_number() OVER (PARTITION BY symbol, config ORDER BY dt) - 1 AS i, floor(count(*) OVER (PARTITION BY symbol, config) / 6) AS sz, count(*) OVER (PARTITION BY symbol, config) AS n FROM cfg),
wf AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS fold FROM wi WHERE sz >= 30), ws AS (SELECT *, CASE WHEN i < fold * sz AND i >= fold * sz - floor(sz * 0.6 / 0.4) THEN ret END AS a, CASE WHEN i >= fold * sz AND i < CASE WHEN fold = 5 THEN n ELSE fold * sz + sz END THEN ret END AS b FROM wf),
we AS (SELECT symbol, fold, config, {_SHARPE.format('a')} AS tr, {_SHARPE.format('b')} AS te, product(1 + b) - 1 AS rt FROM ws WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY ALL)"""
add("walk_forward", lambda s, d: rounded(BT.walk_forward(search.config_returns(weekly(s, d), "ts_momentum", _GRID).select("symbol", "dt", "config", "ret")), ["symbol", "fold"], 5),
    bars_cte(f"{_FOLD} SELECT symbol, fold, config, {r('tr', 'train_sharpe', 5)}, {r('te', 'test_sharpe', 5)}, {r('rt', 'test_return', 5)} FROM we QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY tr DESC NULLS LAST, config) = 1"))


def _members(s, d):
    return search.config_returns(weekly(s, d), "ts_momentum", _GRID).select("symbol", "dt", F.col("config").alias("member"), "signal", "ret")


_HL = 12
_Q = 0.5 ** (1 / _HL)


def _ewm_weights_sql(by: str, least: int, more: str = "") -> str:
    """Exponentially weighted figures of rows of cfg (numbered j within `by`) by a self-join of each group."""
    return f"""{more}, nj AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dt) AS j FROM mb),
ew AS (SELECT a.symbol, a.config, a.dt, a.j, {'a.state,' if 'state' in by else ''} sum(pow({_Q!r}, a.j - b.j)) AS w, sum(pow({_Q!r}, 2 * (a.j - b.j))) AS w2, sum(pow({_Q!r}, a.j - b.j) * b.ret) AS m, sum(pow({_Q!r}, a.j - b.j) * b.ret * b.ret) AS q FROM nj a JOIN nj b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND b.j <= a.j GROUP BY ALL),
es AS (SELECT *, (q / w - (m / w) ** 2) * w * w / nullif(w * w - w2, 0) AS v FROM ew), eh AS (SELECT *, lag(CASE WHEN j >= {least} AND v > 1e-18 THEN m / w / sqrt(v) * sqrt(252) END) OVER (PARTITION BY {by} ORDER BY dt) AS sh FROM es),
ez AS (SELECT *, exp(least(greatest(coalesce(sh, 0), -10), 10)) AS z FROM eh) SELECT symbol, dt, config AS member, {r('z / sum(z) OVER (PARTITION BY symbol, dt)', 'weight', 4)} FROM ez"""


add("ewma_weights", lambda s, d: rounded(search.ewma_weights(_members(s, d), _HL).select("symbol", "dt", "member", "weight"), ["symbol", "dt", "member"], 4), bars_cte(f"{_CONFIGS}, mb AS (SELECT symbol, dt, config, ret FROM cfg)" + _ewm_weights_sql("symbol, config", 10)))
add("ensemble", lambda s, d: rounded(metrics.summary(search.ensemble(weekly(s, d), [("ts_momentum", {"lookback": 4}), ("ts_momentum", {"lookback": 16})], "equal")).select("symbol", "total_return", "sharpe"), ["symbol"], 5),
    bars_cte(f"{_CONFIGS}, bl AS (SELECT b.symbol, b.dt, b.close, (x.signal + y.signal) / 2 AS signal FROM bars b JOIN cf4 x ON b.symbol = x.symbol AND b.dt = x.dt JOIN cf16 y ON b.symbol = y.symbol AND b.dt = y.dt), p0 AS (SELECT symbol, dt, coalesce(lag(signal) {_S}, 0.0) AS position, coalesce(close / lag(close) {_S} - 1, 0.0) AS ar FROM bl), "
             f"p1 AS (SELECT symbol, position * ar - abs(position - coalesce(lag(position) {_S}, 0)) * 2 / 1e4 AS ret FROM p0) SELECT symbol, {r('product(1 + ret) - 1', 'total_return', 5)}, {r(_SHARPE.format('ret'), 'sharpe', 5)} FROM p1 GROUP BY symbol"))  # fmt: skip


def _regime_members(s, d):
    states = weekly(s, d).select("symbol", "dt", risk.trend_regime(40).alias("state"))
    return search.regime_weights(_members(s, d), states, _HL, least=20)


add("regime_weights", lambda s, d: rounded(_regime_members(s, d).select("symbol", "dt", "member", "weight"), ["symbol", "dt", "member"], 4),
    bars_cte(f"{_CONFIGS}, stt AS (SELECT symbol, dt, coalesce(sign(close - ({full('close', 40, f'avg(close) {over(40)}')})), 0) AS state FROM bars), mb AS (SELECT c.symbol, c.dt, config, ret, state FROM cfg c JOIN stt ON c.symbol = stt.symbol AND c.dt = stt.dt)" + _ewm_weights_sql("symbol, config, state", 20)))


def _clusters(s, d):
    rets = risk.returns(weekly(s, d)).withColumnRenamed("symbol", "trial")
    labels, medoids = search.cluster_trials(rets, 4)
    return s.createDataFrame([(t, int(c), t in medoids) for t, c in labels.items()], "trial string, cluster int, is_medoid boolean")


add("trial_clusters", _clusters)
add("bandit_research", lambda s, d: s.createDataFrame([(t["family"], t["config"], t["oos_sharpe"]) for t in search.research(weekly(s, d), "Brand#11", 12, ["ts_momentum", "zscore_reversion"], {"ts_momentum": _GRID, "zscore_reversion": {"n": [10, 20], "entry": [1.0]}})], "family string, config string, oos_sharpe double"))
add("selection_robustness", lambda s, d: s.createDataFrame(sorted(search.selection_robustness(risk.returns(weekly(s, d)).withColumnRenamed("symbol", "trial")).items()), "what string, value double"))
add("warm_start", lambda s, d: rounded(search.warm_start(weekly(s, d), [("ts_momentum", {"lookback": 8})]), ["symbol", "family", "config"], 5), bars_cte(f"{_MOM(8)} SELECT symbol, 'ts_momentum' AS family, config, {r(_SHARPE.format('ret'), 'sharpe', 5)} FROM cf8 GROUP BY symbol, config"))

# overfitting in SQL: all halves of six blocks
_BLOCKS = 6


def _pbo(s, d):
    return s.createDataFrame([("pbo", float(validation.pbo(risk.returns(weekly(s, d)).withColumnRenamed("symbol", "trial"), _BLOCKS)))], "what string, value double")


add("overfit_probability", _pbo,
    bars_cte(f"{_RET}, e AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT dt FROM j)), b AS (SELECT symbol, least(floor(i / greatest(floor(nd / {_BLOCKS}), 1)), {_BLOCKS - 1})::INT AS k, count(rt) AS n, sum(rt) AS s, sum(rt * rt) AS q FROM j JOIN e ON j.dt = e.dt GROUP BY ALL), "
             f"mk AS (SELECT x::INT AS mask FROM range(0, {1 << _BLOCKS}) t(x) WHERE bit_count(x::INT) = {_BLOCKS // 2}), h AS (SELECT mask, symbol, (mask >> k) & 1 AS half, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM mk, b GROUP BY ALL), z AS (SELECT mask, symbol, half, CASE WHEN sqrt(greatest(q / n - (s / n) ** 2, 0)) > 1e-15 THEN s / n / sqrt(greatest(q / n - (s / n) ** 2, 0)) ELSE 0 END AS sr FROM h), "
             f"w AS (SELECT mask, arg_max(symbol, sr) AS best FROM z WHERE half = 1 GROUP BY mask), u AS (SELECT z.mask, (count(*) FILTER (z.sr < y.sr) + (count(*) FILTER (z.sr = y.sr) + 1) / 2.0) / (count(*) + 1) AS rk FROM z JOIN w ON z.mask = w.mask JOIN z y ON y.mask = w.mask AND y.symbol = w.best AND y.half = 0 WHERE z.half = 0 GROUP BY z.mask, y.sr) SELECT 'pbo' AS what, avg((rk < 0.5)::INT)::DOUBLE AS value FROM u"))  # fmt: skip


# scorecards and models
def _as_preds(s, d):
    return panel(s, d).select("dt", "symbol", F.col("mom").alias("pred"), F.col("fwd").alias("target"))


_CARD = f"""pv AS (SELECT *, count(*) {_D} AS n, row_number() OVER (PARTITION BY dt ORDER BY pred DESC, symbol) AS u, row_number() OVER (PARTITION BY dt ORDER BY pred, symbol DESC) AS w, row_number() OVER (PARTITION BY dt ORDER BY pred, symbol) AS qn, rank() OVER (PARTITION BY dt ORDER BY pred) + (count(*) OVER (PARTITION BY dt, pred) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dt ORDER BY target) + (count(*) OVER (PARTITION BY dt, target) - 1) / 2.0 AS rb FROM pr WHERE pred IS NOT NULL AND target IS NOT NULL),
cd AS (SELECT dt, count(*) AS n, corr(pred, target) AS ic, corr(ra, rb) AS ric, avg(target) FILTER (u <= greatest(round_even(n * 0.2, 0), 1)) - avg(target) FILTER (w <= greatest(round_even(n * 0.2, 0), 1)) - 4 / 1e4 AS ls FROM pv WHERE n >= 3 GROUP BY dt),
qb AS (SELECT b, rank() OVER (ORDER BY avg(t)) AS rk FROM (SELECT dt, floor((qn - 1) / n::DOUBLE * 5)::INT AS b, avg(target) AS t FROM pv GROUP BY ALL) GROUP BY b)"""
_CARD_OUT = lambda h: f"""SELECT count(*) AS dates, {r('avg(n)', 'names', 4)}, {r('avg(ic)', 'mean_ic', 4)}, {r('avg(ic) / (stddev_pop(ic) + 1e-9)', 'icir', 4)}, {r('avg((coalesce(ic, 0) > 0)::INT)', 'ic_hit', 4)}, {r('avg(ric)', 'rank_ic', 4)}, {r('avg(ric) / (stddev_pop(ric) + 1e-9)', 'rank_icir', 4)}, {r('avg(ls)', 'ls_mean', 4)}, {r(f'avg(ls) * 252.0 / {h}', 'ls_ann', 4)}, {r(f'avg(ls) / (stddev_pop(ls) + 1e-9) * sqrt(252.0 / {h})', 'ls_sharpe', 4)},
 {r('(SELECT corr(b, rk) FROM qb)', 'monotonicity', 4)}, CASE WHEN avg(ric) IS NULL THEN 'too few dates' WHEN avg(ric) >= 0.03 AND avg(ric) / (stddev_pop(ric) + 1e-9) >= 0.3 THEN 'usable' WHEN avg(ric) > 0.01 THEN 'weak' ELSE 'none' END AS verdict FROM cd"""  # noqa: E731
add("xsec_scorecard", lambda s, d: rounded(learners.scorecard(_as_preds(s, d), 21), [], 4), suppliers(f"{_P}, pr AS (SELECT dt, symbol, mom AS pred, fwd AS target FROM p), {_CARD} {_CARD_OUT(21)}"))
add("xsec_scorecard_days", lambda s, d: rounded(learners.scorecard_days(_as_preds(s, d)), ["dt"], 5), suppliers(f"{_P}, pr AS (SELECT dt, symbol, mom AS pred, fwd AS target FROM p), {_CARD} SELECT dt, n, {r('ic', 'ic', 5)}, {r('ric', 'rank_ic', 5)}, {r('ls', 'ls', 5)} FROM cd"))


def _one_factor(s, d):
    return models.walk_forward_ridge(panel(s, d), ["mom"], "fwd", 1, BT.rebalance_dates(monthly(s, d), "quarter"), 24, 10)


_RIDGE = f"""{_P}, di AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM p)), st AS (SELECT p.dt, i, count(*) AS n, sum(fwd) AS sy, sum(mom) AS sx, sum(mom * mom) AS q, sum(mom * fwd) AS xy FROM p JOIN di ON p.dt = di.dt WHERE mom IS NOT NULL AND fwd IS NOT NULL GROUP BY ALL),
tg AS (SELECT dt AS t, i AS ti FROM di WHERE dt IN (SELECT max(dt) FROM bars GROUP BY date_trunc('quarter', dt))), su AS (SELECT t, sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, sum(q) AS q, sum(xy) AS xy FROM st JOIN tg ON i >= ti - 24 AND i + 1 < ti GROUP BY t HAVING count(*) >= 10),
wt AS (SELECT t, (xy - sx / n * sy) / (greatest(q / n - (sx / n) ** 2, 0) * (n + 1)) AS w, sy / n AS my, sx / n AS mu FROM su), pr AS (SELECT dt, symbol, my + w * (mom - mu) AS pred, fwd AS target FROM p JOIN wt ON p.dt = wt.t WHERE mom IS NOT NULL)"""
add("ridge_one_factor", lambda s, d: rounded(_one_factor(s, d), ["dt", "symbol"], 5), suppliers(f"{_RIDGE} SELECT dt, symbol, {r('pred', 'pred', 5)}, {r('target', 'target', 5)} FROM pr"))
add("ridge_one_factor_scorecard", lambda s, d: rounded(learners.scorecard(_one_factor(s, d), 21), [], 4), suppliers(f"{_RIDGE}, {_CARD} {_CARD_OUT(21)}"))


def _cross(s, d, model):
    df = panel(s, d).withColumn("sector", F.substring("symbol", 1, 1))
    return learners.evaluate_cross_section(df, ["mom", "vol", "rev"], model, 1, "quarter", 24, 10, "sector")


for _m in ("ridge", "stacking", "listnet", "listmle", "ls_list", "boosted"):
    add(f"evaluate_cross_section_{_m}", lambda s, d, m=_m: rounded(_cross(s, d, m)[0], [], 4))
add("ensemble_top", lambda s, d: rounded(learners.scorecard(learners.rank_average([_cross(s, d, "ridge")[1], _one_factor(s, d)]), 21), [], 4))
add("rank_average", lambda s, d: rounded(learners.rank_average([_as_preds(s, d), panel(s, d).select("dt", "symbol", F.col("vol").alias("pred"), F.col("fwd").alias("target"))]), ["dt", "symbol"], 5),
    suppliers(f"{_P}, a AS (SELECT dt, symbol, fwd, (rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(*) {_D} AS rk FROM p WHERE mom IS NOT NULL UNION ALL SELECT dt, symbol, fwd, (rank() OVER (PARTITION BY dt ORDER BY vol) + (count(*) OVER (PARTITION BY dt, vol) - 1) / 2.0) / count(*) {_D} FROM p WHERE vol IS NOT NULL) SELECT dt, symbol, {r('avg(rk)', 'pred', 5)}, {r('max(fwd)', 'target', 5)} FROM a GROUP BY dt, symbol"))
add("model_portfolio", lambda s, d: rounded(learners.model_portfolio(monthly(s, d), _one_factor(s, d)).drop("equity"), ["dt"], 5))
add("sequences", lambda s, d: learners.sequences(panel(s, d), ["mom", "rev"], 6).select("symbol", "dt", F.size("x").alias("length"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x[0]) + 3.7e-8, 5).alias("total")),
    suppliers(f"{_P}, w AS (SELECT symbol, dt, count(CASE WHEN mom IS NOT NULL AND rev IS NOT NULL THEN 1 END) {over(6)} AS n, sum(mom) {over(6)} AS t FROM p) SELECT symbol, dt, 6 AS length, round(t::DOUBLE + 3.7e-8, 5) AS total FROM w WHERE n = 6"))
add("robust_scale", lambda s, d: rounded(learners.robust_scale(panel(s, d), ["mom", "vol"], "dt < DATE'1999-01-01'").select("symbol", "dt", "mom", "vol"), ["symbol", "dt"], 4),
    suppliers(f"{_P}, t AS (SELECT median(mom) AS a, median(vol) AS b FROM p WHERE dt < DATE '1999-01-01'), m AS (SELECT median(abs(mom - a)) * 1.4826 + 1e-9 AS c, median(abs(vol - b)) * 1.4826 + 1e-9 AS e FROM p, t WHERE dt < DATE '1999-01-01') SELECT symbol, dt, {r('CASE WHEN mom IS NOT NULL THEN least(greatest((mom - a) / c, -5), 5) END', 'mom', 4)}, {r('CASE WHEN vol IS NOT NULL THEN least(greatest((vol - b) / e, -5), 5) END', 'vol', 4)} FROM p, t, m"))

# calendars, reports, comparisons
add("exchange_sessions", lambda s, d: calendars.calendar(s, "HK", "2025-01-01", "2026-06-30"), "SELECT x::DATE AS dt FROM range(DATE '2025-01-01', DATE '2026-07-01', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 AND x::DATE::VARCHAR NOT IN (" + ", ".join(f"'{h}'" for h in calendars.HONG_KONG) + ")")
add("tearsheet_ic", lambda s, d: rounded(R.tearsheet(panel(s, d), "mom", (1, 3))["ic"], ["horizon"], 5),
    suppliers(f"{_P}, f AS (SELECT dt, 1::INT AS horizon, mom, lead(close, 1) {_S} / close - 1 AS t FROM p UNION ALL SELECT dt, 3, mom, lead(close, 3) {_S} / close - 1 FROM p), x AS ({ranks('f', 'mom', 't', 'dt, horizon')}), i AS (SELECT horizon, dt, corr(ra, rb) AS ic FROM x GROUP BY ALL HAVING count(*) >= 5) SELECT horizon, count(ic) AS dates, {r('avg(ic)', 'mean_ic', 5)}, {r('avg(ic) / (stddev_pop(ic) + 1e-9)', 'icir', 5)}, {r('avg((ic > 0)::INT)', 'hit', 5)} FROM i GROUP BY horizon"))
add("tearsheet_curves", lambda s, d: rounded(R.tearsheet(panel(s, d), "mom", (1,))["curves"].withColumn("growth", F.ln("growth")), ["dt", "bucket"], 4),
    suppliers(f"{_P}, k AS (SELECT dt, fwd, floor((row_number() OVER (PARTITION BY dt ORDER BY mom, symbol) - 1) / count(*) OVER (PARTITION BY dt)::DOUBLE * 5)::INT + 1 AS bucket FROM p WHERE mom IS NOT NULL AND fwd IS NOT NULL), g AS (SELECT dt, bucket, avg(fwd) AS ret FROM k GROUP BY ALL) SELECT dt, bucket, {r('ret', 'ret', 4)}, {r('ln(product(1 + ret) OVER (PARTITION BY bucket ORDER BY dt ROWS UNBOUNDED PRECEDING))', 'growth', 4)} FROM g"))
add("compare_names", lambda s, d: rounded(R.compare(weekly(s, d), ["Brand#11", "Brand#23", "Brand#5"], 26), ["symbol"], 5),
    bars_cte(f"x AS (SELECT symbol, close, close / lag(close) {_S} - 1 AS rt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS i FROM bars WHERE symbol IN ('Brand#11', 'Brand#23', 'Brand#5')), g AS (SELECT symbol, max(close) FILTER (i = 1) AS c, max(close) FILTER (i = 1) / max(close) FILTER (i = 27) - 1 AS ret, stddev_pop(rt) FILTER (i <= 26) * sqrt(252) AS v FROM x GROUP BY symbol) SELECT symbol, {r('c', 'close', 5)}, {r('ret', 'ret', 5)}, {r('v', 'vol', 5)}, {r('rank() OVER (ORDER BY ret) / count(*) OVER ()::DOUBLE', 'strength_rank', 5)} FROM g"))
add("position_spans", lambda s, d: rounded(A.spans(BT.backtest(strategies.ts_momentum(weekly(s, d), 8))), ["symbol", "entry_dt"], 5),
    bars_cte(f"{_MOM(8)}, i AS (SELECT *, (coalesce(lag(sign(position)) {_S}, 0) <> sign(position))::INT AS nw FROM cf8), k AS (SELECT *, sum(nw) {_RUN} AS id FROM i) SELECT symbol, min(sign(position))::DOUBLE AS side, min(dt) AS entry_dt, max(dt) AS exit_dt, count(*) AS bars, {r('product(1 + ret) - 1', 'ret', 5)} FROM k WHERE position <> 0 GROUP BY symbol, id"))


# compositions
def _health(s, d):
    weights = weekly(s, d).groupBy("symbol").agg(F.sum("volume").alias("weight"))
    figures, said = risk.portfolio_health(weekly(s, d), weights, weekly(s, d).select("symbol", F.substring("symbol", 1, 7).alias("sector")).distinct())
    return s.createDataFrame([(k, round(float(v), 5)) for k, v in figures.items()] + [("warnings", float(len(said)))], "what string, value double")


add("portfolio_health", _health)
add("mixture_regime", lambda s, d: risk.mixture_regime(weekly(s, d), "Brand#11").select("dt", F.round("vol", 6).alias("vol"), "state"))
add("lenses", lambda s, d: rounded(ratings.lenses(weekly(s, d)), ["symbol", "dt"], 4))
add("leaderboard", lambda s, d: rounded(learners.leaderboard(panel(s, d), learners.subsets(["mom", "vol"], {"mom": 0.2, "vol": 0.1}), ["ridge"], 1, "quarter", 24, 10), ["factors", "model"], 4))
_FACTOR = lambda b: b.withColumn("factor", F.col("close") / F.col("vwap") - 1)
add("custom_factor", lambda s, d: rounded(metrics.summary(L.backtest_factor(_FACTOR, weekly(s, d), None, 20, "reversion")).select("symbol", "win_rate", "sharpe"), ["symbol"], 4),
    bars_cte(f"x AS (SELECT *, close / vwap - 1 AS x FROM bars), z AS (SELECT *, {full('x', 20, f'(x - avg(x) {over(20)}) / nullif(stddev_pop(x) {over(20)}, 0)')} AS z FROM x), sg AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE -least(greatest(z, -2), 2) / 2 END AS signal FROM z), "
             f"p0 AS (SELECT symbol, dt, coalesce(lag(signal) {_S}, 0.0) AS position, coalesce(close / lag(close) {_S} - 1, 0.0) AS ar FROM sg), p1 AS (SELECT symbol, position * ar - abs(position - coalesce(lag(position) {_S}, 0)) * 2 / 1e4 AS ret FROM p0) SELECT symbol, {r('coalesce(avg(CASE WHEN ret <> 0 THEN (ret > 0)::INT END), 0)', 'win_rate', 4)}, {r(_SHARPE.format('ret'), 'sharpe', 4)} FROM p1 GROUP BY symbol"))  # fmt: skip
add("conformal", lambda s, d: rounded(learners.conformal(_as_preds(s, d).where("pred is not null")).groupBy("dt").agg(F.max("width").alias("width")), ["dt"], 5),
    suppliers(f"{_P}, q AS (SELECT dt, abs(mom - fwd) AS r FROM p WHERE mom IS NOT NULL AND fwd IS NOT NULL), dd AS (SELECT DISTINCT dt FROM p WHERE mom IS NOT NULL), k AS (SELECT dd.dt, list_sort(list(q.r) FILTER (q.r IS NOT NULL)) AS a FROM dd LEFT JOIN q ON q.dt < dd.dt GROUP BY dd.dt), e AS (SELECT DISTINCT dt FROM q) "
              f"SELECT k.dt, {r('CASE WHEN e.dt IS NOT NULL AND len(a) >= 8 THEN a[least(ceil((len(a) + 1) * 0.9), len(a))::INT] END', 'width', 5)} FROM k LEFT JOIN e ON k.dt = e.dt"))  # fmt: skip


# pairs, orders and small readings
def _pair(s, d):
    rows = weekly(s, d)
    return rows.where("symbol <> 'Brand#11'"), rows.where("symbol = 'Brand#11'").select("dt", F.col("close").alias("partner_close"))


_PAIR = f"""a AS (SELECT x.symbol, x.dt, x.close AS c, last_value(y.close IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.dt ROWS UNBOUNDED PRECEDING) AS q FROM bars x LEFT JOIN bars y ON y.symbol = 'Brand#11' AND x.dt = y.dt WHERE x.symbol <> 'Brand#11'),
b AS (SELECT *, CASE WHEN count(c + q) {over(20)} = 20 THEN covar_samp(c, q) {over(20)} / nullif(var_samp(q) {over(20)}, 0) END AS hedge FROM a), e AS (SELECT *, c - hedge * q AS spread FROM b),
z AS (SELECT *, {full('spread', 20, f'(spread - avg(spread) {over(20)}) / nullif(stddev_pop(spread) {over(20)}, 0)')} AS z FROM e)"""
add("pair_spread", lambda s, d: rounded(strategies.pair_spread(*_pair(s, d), 20).select("symbol", "dt", "hedge", "spread", "spread_z"), ["symbol", "dt"], 4), bars_cte(f"{_PAIR} SELECT symbol, dt, {r('hedge', 'hedge', 4)}, {r('spread', 'spread', 4)}, {r('z', 'spread_z', 4)} FROM z"))
add("pairs_reversion", lambda s, d: strategies.pairs_reversion(*_pair(s, d), 20, 1.5, 0.5).select("symbol", "dt", "signal"),
    bars_cte(f"{_PAIR}, g AS (SELECT symbol, dt, CASE WHEN z <= -1.5 THEN 1.0 WHEN z >= -0.5 THEN 0.0 END AS u, CASE WHEN z >= 1.5 THEN -1.0 WHEN z <= 0.5 THEN 0.0 END AS w FROM z) SELECT symbol, dt, (coalesce(last_value(u IGNORE NULLS) {_RUN}, 0) + coalesce(last_value(w IGNORE NULLS) {_RUN}, 0))::DOUBLE AS signal FROM g"))


def _b():
    return F.col("s_acctbal")


add("order_sizes", lambda s, d: B.table(s, d, "supplier").select("s_suppkey", X.shares_to_trade(_b() / 10000, _b() / 30000, F.lit(1e6), F.when(_k() % 5 > 0, _k() / 3.0).otherwise(0.0)).alias("shares"), X.order_style(F.abs("s_acctbal") / 400, F.when(_k() % 6 == 0, "high").otherwise("low")).alias("style"), F.round(risk.kelly_fraction(F.abs("s_acctbal") / 10000, (_k() + 1) / 20.0), 6).alias("kelly")),
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN round_even((s_acctbal / 10000 - s_acctbal / 30000) * 1e6 / (s_suppkey / 3.0::DOUBLE), 0)::BIGINT ELSE 0 END AS shares, CASE WHEN s_suppkey % 6 = 0 OR abs(s_acctbal) / 400 <= 3 THEN 'marketable' WHEN abs(s_acctbal) / 400 >= 20 THEN 'patient' ELSE 'middle' END AS style, round(least(greatest(abs(s_acctbal) / 10000 - (1 - abs(s_acctbal) / 10000) / ((s_suppkey + 1) / 20.0::DOUBLE), 0), 0.5), 6) AS kelly FROM supplier")
_NAMES = ("AAPL", "0700.HK", "600519.SS", "005930.KS", "7203", "285A", "00700", "600519", "7203.T")
add("market_of", lambda s, d: B.table(s, d, "part").select("p_partkey", S.market_of(F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))).alias("market")), f"SELECT p_partkey, ['US', 'HK', 'CN', 'KR', 'JP', 'JP', 'HK', 'CN', 'JP'][p_partkey % {len(_NAMES)} + 1] AS market FROM part")
_REL = ("CPI", "GDP", "unemployment", "retail sales", "weather")
add("release_readings", lambda s, d: rounded(B.table(s, d, "part").select("p_partkey", S.econ_surprise(F.get(F.array(*map(F.lit, _REL)), (F.col("p_partkey") % 5).cast("int")), F.col("p_size") / 10.0, F.lit(2.5)).alias("surprise"), S.pre_event_risk(F.get(F.array(*map(F.lit, _REL)), (F.col("p_partkey") % 5).cast("int")), F.col("p_size") % 8).alias("risk")), ["p_partkey"]),
    f"SELECT p_partkey, {r('[-1.0, 0.7, -1.0, 0.5, 0.0][p_partkey % 5 + 1] * tanh((p_size / 10.0::DOUBLE - 2.5) / 2.5 * 5)', 'surprise')}, {r('CASE WHEN p_partkey % 5 < 3 AND p_size % 8 <= 4 THEN -0.5 * (1 - (p_size % 8) / 5.0::DOUBLE) ELSE 0 END', 'risk')} FROM part")


def _betas(s, d):
    rets = risk.returns(weekly(s, d))
    market = rets.groupBy("dt").agg(F.avg("ret").alias("ret"))
    return rets.where("symbol = 'Brand#11'"), market


add("beta_to_market", lambda s, d: rounded(risk.beta_to(*_betas(s, d)), [], 5), bars_cte(f"{_RET} SELECT {r('covar_samp(rt, mr) / var_samp(mr)', 'beta', 5)}, count(*) AS n FROM j WHERE symbol = 'Brand#11'"))
add("stress_loss", lambda s, d: rounded(risk.stress(B.table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") / 1e5).alias("weight")), B.table(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") / 10.0).alias("beta")), -0.1), []), f"SELECT {r('sum(s_acctbal / 1e5 * CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey / 10.0 ELSE 1 END) * -0.1', 'loss')} FROM supplier")
