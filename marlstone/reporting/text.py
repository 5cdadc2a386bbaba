"""Results as text: what is rendered is a few rows that a query has already reduced."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import _ranked, divide
from marlstone.operators import cross_section as CS

ROWS = (
    ("Total return", "total_return", "+.2%"), ("CAGR", "cagr", "+.2%"), ("Volatility", "volatility", ".2%"), ("Sharpe", "sharpe", ".2f"), ("Sortino", "sortino", ".2f"),
    ("Max drawdown", "max_drawdown", ".2%"), ("Calmar", "calmar", ".2f"), ("Win rate", "win_rate", ".2%"), ("Profit factor", "profit_factor", ".2f"), ("Exposure", "exposure", ".2%"),
)


def cell(figures: dict, key: str, spec: str) -> str:
    """A figure in its format; a dash if it isn't known."""
    v = figures.get(key)
    return "—" if v is None or (isinstance(v, float) and not math.isfinite(v)) else format(v, spec)


def summary_text(figures: dict) -> str:
    width = max(len(label) for label, _, _ in ROWS)
    return "\n".join(f"{label:<{width}}  {cell(figures, key, spec)}" for label, key, spec in ROWS)


def markdown(name: str, figures: dict, benchmark: dict | None = None, params: dict | None = None) -> str:
    """A strategy's figures beside those of a benchmark."""
    out = [f"# {name}", ""]
    if params:
        out += ["Parameters: " + ", ".join(f"`{k}={v}`" for k, v in params.items()), ""]
    out += ["| Figure | Strategy |" + (" Benchmark |" if benchmark else ""), "|---|---|" + ("---|" if benchmark else "")]
    for label, key, spec in ROWS:
        out.append(f"| {label} | {cell(figures, key, spec)} |" + (f" {cell(benchmark, key, spec)} |" if benchmark else ""))
    return "\n".join(out)


def table_markdown(rows: list[dict], digits: int = 4) -> str:
    if not rows:
        return "(no rows)"
    show = lambda v: "—" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(show(v) for v in r.values()) + " |" for r in rows)])


def safe(value):
    """value for JSON: what isn't finite becomes null, keys and other objects become text."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def page(title: str, sections: list[tuple[str, object]]) -> str:
    """One HTML page: a section is a heading and a text, a list of rows, or a dict of figures; all of it is escaped, the data is in it as JSON."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font:15px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:right}}</style><h1>{html.escape(title)}</h1>"]
    for heading, body in sections:
        out.append(f"<h2>{html.escape(heading)}</h2>")
        if isinstance(body, dict):
            body = [{"figure": k, "value": v} for k, v in body.items()]
        if isinstance(body, list) and body:
            head = "".join(f"<th>{html.escape(str(k))}</th>" for k in body[0])
            lines = "".join("<tr>" + "".join(f"<td>{html.escape('—' if safe(v) is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r.values()) + "</tr>" for r in body)
            out.append(f"<table><tr>{head}</tr>{lines}</table>")
        else:
            out.append(f"<p>{html.escape(str(body))}</p>")
    data = json.dumps(safe(dict(sections)), ensure_ascii=False).replace("</", "<\\/")
    return "".join(out) + f"<script type=application/json>{data}</script>"


def tearsheet(df: DataFrame, factor: str, horizons=(1, 5, 10, 21), buckets: int = 5) -> dict[str, DataFrame]:
    """quantiles (mean and deviation of each bucket's next return), curves (their growth by date), ic (mean, ratio and hits by horizon) and
    churn (by month, of the top bucket)."""
    df = df.withColumns({f"_h{h}": CS.forward_return(h) for h in horizons})
    ic = None
    for h in horizons:
        one = CS.ic_summary(CS.daily_rank_ic(df, factor, f"_h{h}")).withColumn("horizon", F.lit(h))
        ic = one if ic is None else ic.unionByName(one)
    first = f"_h{horizons[0]}"
    rows = df.where(F.col(factor).isNotNull() & F.col(first).isNotNull())
    r = F.row_number().over(Window.partitionBy("dt").orderBy(factor, "symbol"))
    days = rows.withColumn("bucket", F.floor((r - 1) / F.count(F.lit(1)).over(Window.partitionBy("dt")) * buckets).cast("int") + 1).groupBy("dt", "bucket").agg(F.avg(first).alias("ret"))
    growth = F.product(1 + F.col("ret")).over(Window.partitionBy("bucket").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    month_ends = df.groupBy(F.date_trunc("month", "dt").alias("m")).agg(F.max("dt").alias("dt")).select("dt")
    return {"quantiles": CS.quantile_returns(df, factor, first, buckets), "curves": days.withColumn("growth", growth), "ic": ic, "churn": CS.churn(df.join(F.broadcast(month_ends), "dt", "left_semi"), factor)}


def compare(bars: DataFrame, symbols: list[str], lookback: int = 63) -> DataFrame:
    """(symbol, close, ret, vol, strength_rank) of some names over their last bars, side by side."""
    back = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    rows = bars.where(F.col("symbol").isin(symbols)).withColumn("_r", divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("dt"))) - 1).withColumn("_i", F.row_number().over(back))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("close")))
    one = rows.groupBy("symbol").agg(at(1).alias("close"), (divide(at(1), at(lookback + 1)) - 1).alias("ret"), (F.stddev_pop(F.when(F.col("_i") <= lookback, F.col("_r"))) * math.sqrt(252)).alias("vol"))
    return one.withColumn("strength_rank", _ranked(F.col("ret")))


def curve_svg(values: list[float], width: int = 640, height: int = 160) -> str:
    """A line through values as SVG; nothing for fewer than two."""
    if len(values) < 2:
        return ""
    low, high = min(values), max(values)
    y = lambda v: height - (v - low) / ((high - low) or 1.0) * height
    points = " ".join(f"{i * width / (len(values) - 1):.1f},{y(v):.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def build_research(bars: DataFrame, symbol: str, families: list[str] | None = None, grids: dict | None = None) -> str:
    """A page on one symbol: every family's best configuration, the best one's figures, its worst quarter, its worth at other costs, robustness."""
    from marlstone.operators import backtest as BT
    from marlstone.operators import metrics, search, strategies

    own = bars.where(F.col("symbol") == symbol)
    found = search.screen(own, families, grids).orderBy(F.col("oos_sharpe").desc_nulls_last(), "family").collect()  # a row a family
    best = found[0]
    tested = BT.backtest(strategies.REGISTRY[best.family](own, **json.loads(best.config))).cache()
    trials = search.config_returns(own, best.family, (grids or {}).get(best.family)).select("dt", F.col("config").alias("trial"), "ret")
    sections = [
        ("Families", [{"family": r.family, "parameters": r.config, "sharpe": r.sharpe, "out of sample": r.oos_sharpe} for r in found]),
        ("Best", {k: v for k, v in metrics.summary(tested).first().asDict().items() if k != "symbol"}),
        ("Worst quarter", metrics.downturn(tested, "ret").first().asDict()),
        ("Costs", [r.asDict() for r in BT.cost_sensitivity(tested).orderBy("bps").collect()]),
        ("Robustness", search.selection_robustness(trials)),
    ]
    return page(f"{symbol}: strategies", sections)
