"""DuckDB twins: bar views and formulas of the expression language as SQL, for checks against another engine."""

from __future__ import annotations

from marlstone.functions import dsl

#: Added before rounding, so that no value that is exactly between two rounded ones goes one way here and the other way there.
NUDGE = 3.7e-8

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


def bars_sql(period: str = "week", by: str = "p_brand") -> str:
    """CTE bars."""
    source = "lineitem JOIN part ON l_partkey = p_partkey" if by == "p_brand" else "lineitem"
    return f"""ticks AS (SELECT CAST({by} AS VARCHAR) AS symbol, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS dt, l_extendedprice / l_quantity AS px, l_quantity AS q,
  row_number() OVER (PARTITION BY {by}, date_trunc('{period}', l_shipdate) ORDER BY {_ORDER}) AS o FROM {source}),
bars AS (SELECT symbol, dt, min_by(px, o) AS open, max(px) AS high, min(px) AS low, max_by(px, o) AS close, sum(q) AS volume, sum(px * q) / sum(q) AS vwap FROM ticks GROUP BY symbol, dt)"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_S = "OVER (PARTITION BY symbol ORDER BY dt)"
_D = "OVER (PARTITION BY dt)"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


def _roll(fn: str):
    return lambda x, n: _full(x, n, f"{fn}({x}) {over(n)}")


def _wma(x: str, n: int) -> str:
    return _full(x, n, " + ".join(f"lag({x}, {k}) {_S} * {(n - k) * 2.0 / (n * (n + 1))!r}::DOUBLE" for k in range(n)))


def _corr(x: str, y: str, n: int) -> str:
    v = f"corr({x}, {y}) {over(n)}"
    return f"CASE WHEN count({x} + {y}) {over(n)} = {n} AND stddev_pop({x}) {over(n)} > 0 AND stddev_pop({y}) {over(n)} > 0 AND isfinite({v}) THEN round({v}, 9) END"


def _ranked(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, ({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END"


def _place(fn: str):
    return lambda x, n: _full(x, n, f"(list_position(list({x}) {over(n)}, {fn}({x}) {over(n)}) - 1)::DOUBLE")


_I = "_i::DOUBLE"
TS = {
    "delay ref": lambda x, n: f"lag({x}, {n}) {_S}",
    "delta": lambda x, n: f"({x}) - lag({x}, {n}) {_S}",
    "ts_mean sma mean": _roll("avg"),
    "ts_std std": _roll("stddev_samp"),
    "ts_sum sum": _roll("sum"),
    "ts_max max": _roll("max"),
    "ts_min min": _roll("min"),
    "ts_skew skew": _roll("skewness"),
    "ts_kurt kurt": _roll("kurtosis"),
    "ts_median": _roll("median"),
    "wma decay_linear ts_decay_linear": _wma,
    "ts_rank": lambda x, n: _full(x, n, f"len(list_filter(list({x}) {over(n)}, lambda v: v <= {x})) / {n}.0::DOUBLE"),
    "ts_zscore": lambda x, n: _full(x, n, f"(({x}) - avg({x}) {over(n)}) / (stddev_samp({x}) {over(n)} + 1e-12)"),
    "ts_arg_max ts_argmax imax idxmax": _place("max"),
    "ts_arg_min ts_argmin imin idxmin": _place("min"),
    "ts_corr corr": _corr,
    "ts_cov cov": lambda x, y, n: f"CASE WHEN count({x} + {y}) {over(n)} = {n} THEN covar_samp({x}, {y}) {over(n)} END",
    "ts_quantile": lambda x, n, q: _full(x, n, f"quantile_cont({x}, {q}) {over(n)}"),
    "roc": lambda x, n: f"({x}) / nullif(lag({x}, {n}) {_S}, 0) - 1",
    "slope": lambda x, n: _full(x, n, f"regr_slope({x}, {_I}) {over(n)}"),
    "rsquare rsqr": lambda x, n: _full(x, n, f"CASE WHEN stddev_pop({x}) {over(n)} = 0 THEN 0 ELSE regr_r2({x}, {_I}) {over(n)} END"),
    "resi": lambda x, n: _full(x, n, f"({x}) - (regr_intercept({x}, {_I}) {over(n)} + regr_slope({x}, {_I}) {over(n)} * _i)"),
}
CS = {
    "rank": lambda x: _ranked(x, "dt"),
    "zscore": lambda x: f"(({x}) - avg({x}) {_D}) / (stddev_samp({x}) {_D} + 1e-12)",
    "scale": lambda x, a=1.0: f"({x}) * {a} / nullif(sum(abs({x})) {_D}, 0)",
    "quantile": lambda x, q: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {q}) {_D}), quantile_cont({x}, {1 - q}) {_D}) END",
}
GROUP = {"group_rank": lambda x, g: _ranked(x, f"dt, {g}"), "group_neutralize": lambda x, g: f"({x}) - avg({x}) OVER (PARTITION BY dt, {g})"}
ROW = {
    "abs": lambda x: f"abs({x})",
    "sign": lambda x: f"sign({x})::DOUBLE",
    "log": lambda x: f"CASE WHEN ({x}) > 0 THEN ln({x}) END",
    "sqrt": lambda x: f"sqrt(abs({x}))",
    "exp": lambda x: f"exp({x})",
    "power pow": lambda x, p: f"CASE WHEN isfinite(pow({x}, {p})) THEN pow({x}, {p}) END",
    "signedpower": lambda x, p: f"sign({x}) * pow(abs({x}), {p})",
    "greater": lambda x, y: f"CASE WHEN ({x}) >= ({y}) THEN ({x}) ELSE ({y}) END",
    "less": lambda x, y: f"CASE WHEN ({x}) <= ({y}) THEN ({x}) ELSE ({y}) END",
    "where if": lambda c, a, b: f"CASE WHEN ({c}) IS NULL THEN NULL WHEN ({c}) <> 0 THEN ({a}) ELSE ({b}) END",
}
BINARY = {
    "/": lambda x, y: f"({x}) / nullif({y}, 0)",
    "**": lambda x, y: f"CASE WHEN isfinite(pow({x}, {y})) THEN pow({x}, {y}) END",
    "%": lambda x, y: f"({x}) - ({y}) * floor(({x}) / nullif({y}, 0))",
}
_by = lambda t: {n: f for names, f in t.items() for n in names.split()}
TS, CS, GROUP, ROW = map(_by, (TS, CS, GROUP, ROW))


class Twin:
    """Like the compiler's stages, as a chain of CTEs over bars."""

    def __init__(self, group: str | None = None):
        self.group, self.stages, self.done = group, [], {}

    def value(self, tree):
        if tree not in self.done:
            self.done[tree] = self._make(tree)
        return self.done[tree]

    def _put(self, at: int, sql: str):
        while len(self.stages) <= at:
            self.stages.append({})
        name = f"w{sum(map(len, self.stages))}"
        self.stages[at][name] = sql
        return name, at + 1

    def _make(self, t):
        kind = t[0]
        if kind == "num":
            return f"{t[1]!r}::DOUBLE", 0
        if kind == "var":
            return t[1], 0
        if kind == "neg":
            x, r = self.value(t[1])
            return f"(-({x}))", r
        if kind in ("bin", "cmp"):
            (x, a), (y, b) = self.value(t[2]), self.value(t[3])
            if kind == "cmp":
                op = {"==": "=", "!=": "<>"}.get(t[1], t[1])
                return f"((({x}) {op} ({y}))::INT::DOUBLE)", max(a, b)
            return f"({BINARY[t[1]](x, y) if t[1] in BINARY else f'({x}) {t[1]} ({y})'})", max(a, b)
        given = [self.value(a) if isinstance(a, tuple) else (a, 0) for a in t[2]]
        ready, args = max(r for _, r in given), [a for a, _ in given]
        if kind == "row":
            return f"({ROW[t[1]](*args)})", ready
        # an argument of a window is a column of its own, so that SQL stays short
        plain = []
        for a in args:
            if isinstance(a, str) and not a.isidentifier():
                a, ready_ = self._put(ready, a)
                plain.append((a, ready_))
            else:
                plain.append((a, ready))
        ready, args = max(r for _, r in plain), [a for a, _ in plain]
        if kind == "ema":
            x, n = args
            q = 1 - 2.0 / (n + 1)
            first = f"min(CASE WHEN {x} IS NOT NULL THEN _i END) OVER (PARTITION BY symbol)"
            f, r = self._put(ready, first)
            at = f"(_i - {f})"
            sums = f"pow({q!r}, {at}) * sum(CASE WHEN {at} = 0 THEN {x} ELSE {1 - q!r} * {x} * pow({q!r}, -{at}) END) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"
            return self._put(r, f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) >= {n} THEN {sums} END")
        fn = {"ts": TS, "cs": CS}.get(kind, GROUP)[t[1]]
        return self._put(ready, fn(*args, self.group) if kind == "grp" else fn(*args))

    def sql(self, formulas: dict[str, str], keep: str = "symbol, dt", digits: int = 6, base: str | None = None, group: str | None = None) -> str:
        values = {n: self.value(dsl.parse(f))[0] for n, f in formulas.items()}
        extra = f", {group} AS grp" if group else ""
        parts = [base or bars_sql(), f"s0 AS (SELECT *, close / nullif(lag(close) {_S}, 0) - 1 AS returns, row_number() {_S} AS _i{extra} FROM bars)"]
        for k, stage in enumerate(self.stages):
            cols = "".join(f", {sql} AS {n}" for n, sql in stage.items())
            parts.append(f"s{k + 1} AS (SELECT *{cols} FROM s{k})")
        out = ", ".join(f"round(CASE WHEN isfinite({v}) THEN {v} END + {NUDGE}, {digits}) + 0.0::DOUBLE AS {n}" for n, v in values.items())
        return "WITH " + ",\n".join(parts) + f"\nSELECT {keep}, {out} FROM s{len(self.stages)}"
