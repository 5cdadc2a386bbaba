"""Definitions against plain Python on small panels, causality, refusals, and query twins."""

import datetime as dt
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import dsl, scalars
from marlstone.functions.library import ALPHA101, ALPHA158
from marlstone.operators import backtest as BT
from marlstone.operators import indicators as I
from marlstone.operators import metrics as M
from marlstone.operators import risk, validation
from marlstone.sources import bars as B
from marlstone.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    rnd, rows = random.Random(3), []
    for s in ("AAA", "BBB", "CCC"):
        c = 100.0
        for i in range(40):
            c *= 1 + rnd.gauss(0, 0.02)
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(i), c * 0.99, c * 1.02, c * 0.98, c, float(rnd.randint(100, 900))))
    return spark.createDataFrame(rows, B.BARS).cache()


def closes(panel, symbol="AAA"):
    return [r.close for r in panel.where(F.col("symbol") == symbol).orderBy("dt").collect()]


def values(df, symbol="AAA", col="value"):
    return [r[col] for r in df.where(F.col("symbol") == symbol).orderBy("dt").collect()]


def test_rolling_mean_and_delta(panel):
    c = closes(panel)
    got = values(dsl.eval_expr("ts_mean(close, 5)", panel))
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx([sum(c[i - 4 : i + 1]) / 5 for i in range(4, 40)])
    assert values(dsl.eval_expr("delta(close, 2)", panel))[2:] == pytest.approx([c[i] - c[i - 2] for i in range(2, 40)])


def test_ema(panel):
    c = closes(panel)
    want, m = [], None
    for i, x in enumerate(c):
        m = x if m is None else m + 2 / 6 * (x - m)
        want.append(m if i >= 4 else None)
    got = values(dsl.eval_expr("ema(close, 5)", panel))
    assert got[:4] == want[:4] and got[4:] == pytest.approx(want[4:])


def test_cross_section_rank(panel):
    got = dsl.eval_expr("rank(close)", panel).groupBy("dt").agg(F.sort_array(F.collect_list("value")).alias("v")).first().v
    assert got == pytest.approx([1 / 3, 2 / 3, 1])
    with pytest.raises(dsl.FormulaError):
        dsl.eval_expr("rank(close)", panel, panel=False)


@pytest.mark.parametrize("text", ["__import__('os')", "close.open", "lambda x: x", "foo(close)", "1 < close < 2", "ts_mean(close, -3)", "'a'", "ts_mean(close, n=3)", "close +"])
def test_refused(text):
    with pytest.raises(dsl.FormulaError):
        dsl.parse(text)


@pytest.mark.parametrize("text", ["ts_corr(rank(open), rank(volume), 5)", "ema(close, 5) / close", "ts_rank(close, 6) - ts_arg_max(high, 4)"])
def test_causal(panel, text):
    assert dsl.causal(text, panel, dt.date(2024, 1, 30))


def test_libraries(panel):
    assert len(ALPHA101) == 30 and len(ALPHA158) == 84
    df, wrong = dsl.compute_library({k: v for k, v in ALPHA101.items() if "100" not in v}, panel)
    assert not wrong
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns[2:])).first().asDict()
    assert sum(n > 0 for n in counts.values()) >= 0.9 * len(counts)


def test_rsi_edges(spark):
    rows = [("UP", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0, 1.0, 1.0, 100.0 + i, 1.0) for i in range(20)]
    rows += [("FLAT", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0, 1.0, 1.0, 100.0, 1.0) for i in range(20)]
    got = {r.symbol: r.rsi for r in I.with_rsi(spark.createDataFrame(rows, B.BARS)).groupBy("symbol").agg(F.max_by("rsi", "dt").alias("rsi")).collect()}
    assert got == {"UP": 100.0, "FLAT": 50.0}


def test_canonicalize(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day, 10.0, 10.05, 9.9, 10.1, 5.0, 1), ("A", day, 10.0, 11.0, 9.0, 10.5, 5.0, 2), ("B", day, 10.0, 5.0, 4.0, 10.0, 1.0, 1), ("C", day, 10.0, 11.0, 9.0, 0.0, 1.0, 1), ("D", day, 10.0, 10.05, 9.9, 10.1, 1.0, 1)]
    got = {r.symbol: r for r in B.canonicalize(spark.createDataFrame(rows, "symbol string, dt date, Open double, High double, Low double, Close double, Volume double, seq int"), "seq").collect()}
    assert set(got) == {"A", "D"} and got["A"].close == 10.5 and got["D"].high == 10.1


def test_backtest_by_hand(spark):
    closes_, signals = [100.0, 110.0, 99.0, 99.0], [1.0, 1.0, 0.0, 0.0]
    rows = [("A", dt.date(2024, 1, i + 1), c, s) for i, (c, s) in enumerate(zip(closes_, signals))]
    got = BT.backtest(spark.createDataFrame(rows, "symbol string, dt date, close double, signal double")).orderBy("dt").collect()
    assert [r.position for r in got] == [0.0, 1.0, 1.0, 0.0]
    assert [r.ret for r in got] == pytest.approx([0.0, 0.1 - 2e-4, -0.1, -2e-4])


def test_costs_only_hurt(panel):
    t = BT.backtest(panel.withColumn("signal", (F.dayofmonth("dt") % 3 == 0).cast("double")))
    rows = BT.cost_sensitivity(t).where("symbol = 'AAA'").orderBy("bps").collect()
    assert all(a.total_return >= b.total_return for a, b in zip(rows, rows[1:]))


def test_summary_of_no_moves(spark):
    rows = [("A", dt.date(2024, 1, i + 1), 0.0, 0.0) for i in range(5)]
    got = M.summary(spark.createDataFrame(rows, "symbol string, dt date, ret double, position double")).first()
    assert (got.sharpe, got.calmar, got.exposure, got.profit_factor) == (0.0, 0.0, 0.0, None)


def test_portfolio_algebra():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 5))
    cov = np.cov(a, rowvar=False)
    w = risk.risk_parity(cov)
    assert w.sum() == pytest.approx(1) and np.ptp(risk.contributions(cov, w)) < 1e-6
    m = risk.min_variance(cov, 0.4)
    assert m.sum() == pytest.approx(1) and m.max() <= 0.4 + 1e-9 and m.min() >= 0
    assert m @ cov @ m <= np.full(5, 0.2) @ cov @ np.full(5, 0.2) + 1e-12
    assert risk.effective_bets(np.eye(4), np.full(4, 0.25)) == pytest.approx(4)


def test_sharpe_probabilities():
    assert validation.psr(100, 0.0, 0.0, 3.0) == pytest.approx(0.5)
    assert validation.deflated_sharpe(250, 0.1, 0.0, 3.0, 50) < validation.psr(250, 0.1, 0.0, 3.0)
    assert math.isnan(validation.psr(2, 0.1, 0.0, 3.0))


def test_sentiment(spark):
    texts = ["Profit surges", "no growth here", "shares plunge", "nothing", None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.sentiment(F.col("t")).alias("s")).collect()]
    assert got == pytest.approx([1.25 / 1.6, -1 / 1.6, -1.0, 0.0, 0.0])


def test_asof(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 1, 2), ("B", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("A", 2, 10.0), ("A", 5, 20.0)], "k string, day int, v double")
    got = {r.id: r.v for r in files.asof(left, right, "k", "t", "day", "v").collect()}
    assert got == {1: 20.0, 2: None, 3: None}


def test_first_json():
    assert scalars.first_json('so {x} then {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert scalars.first_json("none") is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["bars_d", "dsl_ts_skew", "dsl_rank", "strategy_breakout", "backtest_bars", "brinson", "headline_sentiment"])
def test_twins(spark, name):
    from marlstone.plans import registry

    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.execute(registry.ORACLES[name])
    cols = sorted(c[0] for c in r.description)
    at = [[c[0] for c in r.description].index(c) for c in cols]
    want = sorted(str([row[i] for i in at]) for row in r.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(str([row[c] for c in cols]) for row in df.collect()) == want
