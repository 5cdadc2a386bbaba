"""The factor expression language: a safe formula over bars, compiled to stages of window expressions.

A formula is parsed to a tree of a few node kinds; anything else is refused. Spark has no window functions inside window functions, so each
window result is a column of a stage, and its arguments only use columns of earlier stages. Equal sub-formulas of all formulas compiled
together are one column. Within a stage, Catalyst merges windows of the same axis (series or date) into one operator.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K

VARIABLES = ("open", "high", "low", "close", "volume", "vwap", "returns")
TS, CS, GROUP, ROW = (K.by_name(t) for t in (K.TIME_SERIES, K.CROSS_SECTION, K.GROUPED, K.ROW))
#: Formulas that stand for a name; {n} is the argument.
MACROS = {
    "kmid": "(close-open)/open",
    "klen": "(high-low)/open",
    "kmid2": "(close-open)/(high-low+1e-12)",
    "kup": "(high-greater(open,close))/open",
    "kup2": "(high-greater(open,close))/(high-low+1e-12)",
    "klow": "(less(open,close)-low)/open",
    "klow2": "(less(open,close)-low)/(high-low+1e-12)",
    "ksft": "(2*close-high-low)/open",
    "ksft2": "(2*close-high-low)/(high-low+1e-12)",
    "wvma": "ts_std(abs(returns)*volume,{n})/(ts_mean(abs(returns)*volume,{n})+1e-12)",
    "qtlu": "ts_quantile(close,{n},0.8)",
    "qtld": "ts_quantile(close,{n},0.2)",
}
_BIN = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.Mod: "%"}
_CMP = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_COLUMNS_OF = {"ts_corr": 2, "corr": 2, "ts_cov": 2, "cov": 2}


class FormulaError(ValueError):
    """The formula isn't in the language, or doesn't fit the data."""


def available_operators() -> list[str]:
    return sorted({*TS, *CS, *GROUP, *ROW, *MACROS, "ema"})


def parse(text: str):
    """A tree of tuples: ('num', x), ('var', name), ('neg', t), ('bin', op, a, b), ('cmp', op, a, b), ('row' | 'ts' | 'cs' | 'grp' | 'ema', name, args)."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {text!r}") from e
    return _read(body)


def _number(node, what: str) -> float:
    got = _read(node)
    if got[0] == "neg" and got[1][0] == "num":
        return -got[1][1]
    if got[0] != "num":
        raise FormulaError(f"{what} must be a number")
    return got[1]


def _read(node):
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return ("num", float(node.value))
    if isinstance(node, ast.Name):
        name = node.id.lower()
        if name in MACROS and "{n}" not in MACROS[name]:
            return parse(MACROS[name])
        if name not in VARIABLES:
            raise FormulaError(f"unknown name {node.id!r}")
        return ("var", name)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _read(node.operand)
        return ("neg", inner) if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp) and type(node.op) in _BIN:
        return ("bin", _BIN[type(node.op)], _read(node.left), _read(node.right))
    if isinstance(node, ast.Compare):
        if len(node.ops) != 1 or type(node.ops[0]) not in _CMP:
            raise FormulaError("comparisons can't be chained")
        return ("cmp", _CMP[type(node.ops[0])], _read(node.left), _read(node.comparators[0]))
    if isinstance(node, ast.IfExp):
        return ("row", "where", (_read(node.test), _read(node.body), _read(node.orelse)))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        return _call(node.func.id.lower(), node.args)
    raise FormulaError(f"{type(node).__name__} is not allowed in a formula")


def _window(node) -> int:
    n = _number(node, "a window")
    if n != int(n) or n < 1:
        raise FormulaError("a window must be a positive whole number")
    return int(n)


def _call(name: str, args: list):
    if name in MACROS and "{n}" in MACROS[name] and len(args) == 1:
        return parse(MACROS[name].replace("{n}", str(_window(args[0]))))
    if name in MACROS and not args:
        return parse(MACROS[name])
    if name == "ema" and len(args) == 2:
        return ("ema", "ema", (_read(args[0]), _window(args[1])))
    if name in TS:
        k = _COLUMNS_OF.get(name, 1)
        want = k + 2 if name == "ts_quantile" else k + 1
        if len(args) != want:
            raise FormulaError(f"{name} takes {want} arguments")
        rest = [_window(args[k])] + [_number(a, "a quantile") for a in args[k + 1 :]]
        return ("ts", name, (*map(_read, args[:k]), *rest))
    if name in CS:
        if not 1 <= len(args) <= (2 if name in ("scale", "quantile") else 1):
            raise FormulaError(f"{name}: wrong number of arguments")
        rest = [_number(a, "a level") for a in args[1:]] or ([0.05] if name == "quantile" else [])
        return ("cs", name, (_read(args[0]), *rest))
    if name in GROUP:
        if len(args) not in (1, 2):
            raise FormulaError(f"{name}: wrong number of arguments")
        return ("grp", name, (_read(args[0]),))
    if name in ROW:
        want = {"greater": 2, "less": 2, "power": 2, "pow": 2, "signedpower": 2, "where": 3, "if": 3}.get(name, 1)
        if len(args) != want:
            raise FormulaError(f"{name} takes {want} arguments")
        return ("row", name, tuple(map(_read, args)))
    raise FormulaError(f"unknown function {name!r}")


def axes(tree) -> set[str]:
    """Which of ts, ema, cs and grp a formula uses."""
    found = {tree[0]} & {"ts", "ema", "cs", "grp"}
    for part in tree:
        if isinstance(part, tuple):
            found |= axes(part) if part and isinstance(part[0], str) else set().union(*(axes(p) for p in part if isinstance(p, tuple)), set())
    return found


def depth(tree) -> int:
    below = [depth(p) for part in tree if isinstance(part, tuple) for p in ([part] if part and isinstance(part[0], str) else part) if isinstance(p, tuple)]
    return 1 + max(below, default=0)


def constants(tree) -> int:
    if tree[0] == "num":
        return 1
    inner = [p for part in tree if isinstance(part, tuple) for p in ([part] if part and isinstance(part[0], str) else part)]
    return sum(constants(p) if isinstance(p, tuple) else 1 for p in inner if isinstance(p, (tuple, int, float)))


def complexity_ok(text: str, max_depth: int = 5, max_constants: int = 3) -> bool:
    tree = parse(text)
    return depth(tree) <= max_depth and constants(tree) <= max_constants


class Compiler:
    """Collects the stages of a set of formulas; add() gives the column that holds a formula once apply() has run."""

    def __init__(self, group_col: str | None = None, panel: bool = True):
        self.group_col, self.panel = group_col, panel
        self.stages: list[dict[str, Column]] = []
        self.folds: list[dict[str, tuple[Column, int]]] = []
        self.done: dict = {}

    def add(self, text: str) -> tuple[Column, int]:
        value, ready = self._value(parse(text))
        return K.clean(value.cast("double")), ready

    def _value(self, tree) -> tuple[Column, int]:
        if tree not in self.done:
            self.done[tree] = self._make(tree)
        return self.done[tree]

    def _put(self, stage: int, made) -> tuple[Column, int]:
        for kept in (self.stages, self.folds):
            while len(kept) <= stage:
                kept.append({})
        name = f"_w{sum(map(len, self.stages)) + sum(map(len, self.folds))}"
        (self.folds if isinstance(made, tuple) else self.stages)[stage][name] = made
        return F.col(name), stage + 1

    def _make(self, tree) -> tuple[Column, int]:
        kind = tree[0]
        if kind == "num":
            return F.lit(tree[1]), 0
        if kind == "var":
            return F.col(tree[1]), 0
        if kind == "neg":
            x, r = self._value(tree[1])
            return -x, r
        if kind in ("bin", "cmp"):
            (x, a), (y, b) = self._value(tree[2]), self._value(tree[3])
            return (K.BINARY[tree[1]](x, y) if kind == "bin" else K.COMPARE[tree[1]](x, y).cast("double")), max(a, b)
        given = [self._value(a) if isinstance(a, tuple) else (a, 0) for a in tree[2]]
        ready = max(r for _, r in given)
        args = [c for c, _ in given]
        if kind == "row":
            return ROW[tree[1]](*args), ready
        if kind == "ts":
            return self._put(ready, TS[tree[1]](*args))
        if kind == "ema":
            return self._put(ready, (args[0], args[1]))
        if not self.panel:
            raise FormulaError(f"{tree[1]} needs several symbols")
        if kind == "grp":
            if self.group_col is None:
                raise FormulaError(f"{tree[1]} needs a group column")
            return self._put(ready, GROUP[tree[1]](*args, self.group_col))
        return self._put(ready, CS[tree[1]](*args))

    def apply(self, bars: DataFrame) -> DataFrame:
        df = with_variables(bars)
        for windows, folds in zip(self.stages, self.folds):
            if windows:
                df = df.withColumns(windows)
            if folds:
                df = with_ema(df, folds)
        return df


def with_variables(bars: DataFrame) -> DataFrame:
    """Bars with all variables: missing prices are the close, a missing vwap is (high + low + close) / 3; and _i, the bar's number."""
    have = set(bars.columns)
    df = bars
    for c in ("open", "high", "low"):
        if c not in have:
            df = df.withColumn(c, F.col("close"))
    if "volume" not in have:
        df = df.withColumn("volume", F.lit(None).cast("double"))
    if "vwap" not in have:
        df = df.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return df.withColumns({"returns": K.divide(F.col("close"), F.lag("close").over(K.SERIES)) - 1, "_i": F.row_number().over(K.SERIES)})


def with_ema(df: DataFrame, wanted: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with exponential means of span n: y = (1 - a) y + a x with a = 2 / (n + 1), from the n-th known value on. After a gap the old mean
    weighs less by (1 - a) for each bar. All are folded over one sorted array of a symbol's bars."""
    return with_ewm(df, {name: (x, 2.0 / (n + 1), n) for name, (x, n) in wanted.items()})


#: A fold's output is gathered in runs of so many rows, so that a row copies one run and not all that came before it.
RUN = 128


def grown(acc: Column, row: Column) -> list[Column]:
    """Fields out (finished runs) and run of a fold's next state."""
    whole = F.size(acc["run"]) >= RUN
    return [F.when(whole, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"]).alias("out"), F.when(whole, F.array(row)).otherwise(F.concat(acc["run"], F.array(row))).alias("run")]


def with_ewm(df: DataFrame, wanted: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """As with_ema, for name -> (column, a, least number of known values)."""
    names = list(wanted)
    rows = df.select("symbol", "dt", *(x.alias(n) for n, (x, _, _) in wanted.items()))
    series = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("dt", *names))).alias("s"))
    none = F.slice(F.transform("s", lambda b: F.struct(b["dt"].alias("dt"), *(b[n].alias(n) for n in names))), 1, 0)
    start = F.struct(*(F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("w"), F.lit(0).alias("k")).alias(n) for n in names), F.slice(F.array(none), 1, 0).alias("out"), none.alias("run"))

    def step(acc, bar):
        new, out = [], [bar["dt"].alias("dt")]
        for n in names:
            _, a, least = wanted[n]
            x, m, w, k = bar[n], acc[n]["m"], acc[n]["w"], acc[n]["k"]
            old = w * (1 - a)
            mean = F.when(x.isNull(), m).when(m.isNull(), x).otherwise((old * m + a * x) / (old + a))
            count = k + x.isNotNull().cast("int")
            new.append(F.struct(mean.alias("m"), F.when(x.isNull(), old).otherwise(1.0).alias("w"), count.alias("k")).alias(n))
            out.append(F.when(count >= least, mean).alias(n))
        return F.struct(*new, *grown(acc, F.struct(*out)))

    folded = series.select("symbol", F.explode(F.aggregate("s", start, step, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["run"]))))).alias("o")).select("symbol", "o.*")
    return df.join(folded, ["symbol", "dt"], "left")


def eval_expr(text: str, bars: DataFrame, group_col: str | None = None, panel: bool = True, out: str = "value") -> DataFrame:
    """bars with the formula's value in column out."""
    c = Compiler(group_col, panel)
    value, _ = c.add(text)
    df = c.apply(bars)
    return df.select(*bars.columns, value.alias(out))


def compute_library(formulas: dict[str, str], bars: DataFrame, group_col: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(symbol, dt and a column for each formula; what was wrong with those that can't be compiled). All share their stages."""
    c, values, wrong = Compiler(group_col), {}, {}
    for name, text in formulas.items():
        try:
            values[name] = c.add(text)[0]
        except FormulaError as e:
            wrong[name] = str(e)
    df = c.apply(bars)
    return df.select("symbol", "dt", *(v.alias(n) for n, v in values.items())), wrong


def causal(text: str, bars: DataFrame, cut, tolerance: float = 1e-9) -> bool:
    """Whether the formula's values up to `cut` stay the same when later bars are taken away."""
    whole = eval_expr(text, bars).where(F.col("dt") <= F.lit(cut)).select("symbol", "dt", F.col("value").alias("a"))
    part = eval_expr(text, bars.where(F.col("dt") <= F.lit(cut))).select("symbol", "dt", F.col("value").alias("b"))
    differ = (F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tolerance)
    return whole.join(part, ["symbol", "dt"]).where(differ).isEmpty()


def edit_distance(a: Iterable, b: Iterable) -> float:
    """Levenshtein distance of two token sequences over the longer length."""
    a, b = list(a), list(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def tokens(tree) -> list[str]:
    found = [str(p) for p in tree if not isinstance(p, tuple)]
    for part in tree:
        if isinstance(part, tuple):
            for p in [part] if part and isinstance(part[0], str) else part:
                found += tokens(p) if isinstance(p, tuple) else [str(p)]
    return found


def novelty(text: str, library: Iterable[str]) -> float:
    """Least edit distance to the formulas of a library; over 0.25 counts as novel."""
    own = tokens(parse(text))
    return min((edit_distance(own, tokens(parse(other))) for other in library), default=1.0)


__all__ = ["Compiler", "FormulaError", "Window", "available_operators", "causal", "complexity_ok", "compute_library", "eval_expr", "novelty", "parse"]
