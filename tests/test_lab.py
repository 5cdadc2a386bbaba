"""The factor lab, searches, learners, readers and reports on small data with known answers."""

import json
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import calendars, prompts
from marlstone.functions import scalars as S
from marlstone.operators import attribution as A
from marlstone.operators import backtest as BT
from marlstone.operators import cross_section as CS
from marlstone.operators import execution as X
from marlstone.operators import factor_lab as L
from marlstone.operators import learners, models, ratings, risk, search, strategies
from marlstone.operators import multi_factor as MF
from marlstone.reporting import text as R
from marlstone.sources import files, vendors

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def walk():
    """Closes of 8 names over 150 days, whose next move follows a slow signal."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(8):
        signal, price = rng.normal(), 100.0
        for t in range(150):
            signal = 0.9 * signal + 0.3 * rng.normal()
            rows.append((f"s{k}", DAY + timedelta(t), price * 0.999, price * 1.01, price * 0.99, price, 1000.0 + 10 * rng.random(), signal, rng.normal()))
            price *= 1 + 0.01 * signal + 0.01 * rng.normal()
    return pd.DataFrame(rows, columns=["symbol", "dt", "open", "high", "low", "close", "volume", "sig", "noise"])


@pytest.fixture(scope="module")
def bars(spark, walk):
    return spark.createDataFrame(walk).cache()


def test_orthogonalize_on_two_references(spark, bars, walk):
    df = bars.withColumn("mix", F.col("sig") * 2 + F.col("noise") + F.col("volume") / 50)
    got = L.orthogonalize(df, "mix", ["sig", "noise"]).select("symbol", "dt", "orthogonal").toPandas().set_index(["dt", "symbol"]).orthogonal
    day = walk[walk.dt == DAY + timedelta(9)].set_index("symbol")
    y = day.sig * 2 + day.noise + day.volume / 50
    x = np.column_stack([np.ones(len(day)), day.sig, day.noise])
    rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(got.loc[DAY + timedelta(9)].sort_index(), rest.sort_index(), atol=1e-8)
    assert L.orthogonalize(df.where("symbol < 's5'"), "mix", ["sig", "noise"]).where("orthogonal is not null").count() == 0


def test_incremental_ic_of_a_copy_is_nothing(bars):
    df = bars.withColumns({"copy": F.col("sig") * 3 + 1, "fwd": CS.forward_return(1)})
    one = L.incremental_ic(df, "sig", ["noise"], "fwd").first()
    assert one.raw_ic > 0.3 and one.incremental_ratio > 0.7
    days = L.orthogonalize(df, "copy", ["sig"]).agg(F.max(F.abs("orthogonal"))).first()[0]
    assert days < 1e-9


def test_half_life_of_a_slow_signal(bars):
    one = L.half_life(bars, "sig").first()
    assert 3 < one.ar1 < 14


def test_prescreen_gates(bars):
    df = bars.withColumns({"clone": F.col("sig") + F.col("noise") * 0.01, "flat": F.lit(1.0)})
    rows = {r["name"]: r for r in L.prescreen(df, ["sig", "clone", "noise", "flat"], horizon=1, least_ic=0.05, rebalance=None)}
    assert {rows["sig"]["decision"], rows["clone"]["decision"]} == {"selected", "redundant"} and rows["noise"]["decision"] == rows["flat"]["decision"] == "weak"
    few = {r["name"]: r["decision"] for r in L.prescreen(df.withColumn("other", F.col("sig") * 0.6 + F.col("noise")), ["sig", "other"], 1, most=1, least_ic=0.05, rebalance=None)}
    assert sorted(few.values()) == ["capacity", "selected"]
    fast = L.prescreen(df, ["sig"], 1, least_ic=0.05, rebalance=1000)
    assert fast[0]["decision"] == "fast_decay"


def test_causality(bars):
    cut = DAY + timedelta(100)
    assert L.is_causal(lambda b: b.withColumn("factor", F.col("close") / F.lag("close", 5).over(L.SERIES)), bars, [cut])
    assert not L.is_causal(lambda b: b.withColumn("factor", F.lead("close", 1).over(L.SERIES)), bars, [cut])


def test_volatility_target_and_drift_use_the_past_only(spark, walk):
    jump = walk[walk.symbol == "s0"].copy()
    other = jump.copy()
    other.loc[other.index[-1], "close"] *= 3
    for run in (lambda df: risk.vol_target(risk.returns(df), n=10), lambda df: risk.drift_regime(df, 10, 0.5)):
        a, b = (run(spark.createDataFrame(x)).orderBy("dt").toPandas() for x in (jump, other))
        last = a.columns[-1]
        assert a[last].iloc[-1] == b[last].iloc[-1] and a[last].nunique() > 1
    long, short = (risk.drift_regime(spark.createDataFrame(jump), n, 0.5).toPandas().drift.tolist() for n in (40, 5))
    assert long != short


def test_vwap_without_volume(spark):
    df = spark.createDataFrame([(10, [0.0, 0.0, 0.0]), (10, [1.0, 3.0]), (0, [1.0]), (7, [])], "t long, p array<double>")
    rows = [r[0] for r in df.select(X.vwap(F.col("t"), F.col("p"))).collect()]
    assert rows[0] == [4, 3, 3] and sum(rows[1]) == 10 and rows[2] == [] and rows[3] == [2, 1, 1, 1, 1, 1]


def test_quality_by_time_slots(spark):
    orders = spark.createDataFrame([(1, "a", "buy"), (2, "a", "sell")], "order_id long, symbol string, side string")
    fills = spark.createDataFrame([(1, 10.0, 5.0, 101.0), (1, 9000.0, 5.0, 103.0), (2, 20.0, 4.0, 99.0)], "order_id long, time double, qty double, price double")
    ticks = [(float(t), 100.0 + (t % 7), 1.0 + t % 3) for t in range(0, 10000, 100)]
    market = spark.createDataFrame([("a", *t) for t in ticks], "symbol string, time double, price double, volume double")
    got = {r.order_id: r for r in X.quality(fills, market, orders).collect()}
    inside = [t for t in ticks if 10 <= t[0] <= 9000]
    vwap = sum(p * v for _, p, v in inside) / sum(v for *_, v in inside)
    assert got[1].vwap == pytest.approx(vwap) and got[1].vs_vwap_bps == pytest.approx((102 - vwap) / vwap * 1e4) and got[2].vwap is None


def test_snapshots_round_trip(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(DAY, "0700", 0.5), (DAY, "285A", -0.2), (DAY + timedelta(1), "0700", 0.1)], "day date, symbol string, score double")
    files.save_snapshot(rows, store, "sentiment")
    (tmp_path / "store" / "env").mkdir()
    (tmp_path / "store" / "env" / "2024-03-01.json").write_text('{"x": 1}')
    (tmp_path / "store" / "sentiment" / "2024-02-01.json").write_text('{"0005": 0.3}')
    got = {(r.day, r.symbol): r.score for r in files.sentiment_archive(spark, store).collect()}
    assert got == {(DAY, "0700"): 0.5, (DAY, "285A"): -0.2, (DAY + timedelta(1), "0700"): 0.1, (date(2024, 2, 1), "0005"): 0.3}
    cover = {r.kind: (r.days, r["first"]) for r in files.coverage(spark, store).collect()}
    assert cover == {"sentiment": (3, DAY), "env": (1, date(2024, 3, 1))}
    figures = spark.createDataFrame([(DAY, "0700", 12.0, 0.2)], "day date, symbol string, pe double, roe double")
    files.save_snapshot(figures, store, "fundamentals")
    one = files.fundamentals_archive(spark, store).first()
    assert (one.symbol, one.pe, one.roe, one.pb) == ("0700", 12.0, 0.2, None)
    assert files.sentiment_archive(spark, f"{store}/none").count() == 0


def test_vendor_readers(spark, tmp_path):
    (tmp_path / "0700.json").write_text(json.dumps({"trailingPE": "15.5", "debtToEquity": 150.0, "returnOnEquity": None, "shortName": "T", "priceToBook": "n/a"}))
    one = vendors.fundamentals(spark, f"file://{tmp_path}/0700.json").first()
    assert (one.symbol, one.name, one.pe, one.debt_to_equity, one.roe, one.pb) == ("0700", "T", 15.5, 1.5, None, None)
    (tmp_path / "a.news").write_text(json.dumps([{"headline": "H", "source": "P", "publishedAt": "2024-05-01T10:00:00Z"}]))
    (tmp_path / "b.news").write_text(json.dumps({"results": [{"title": "T", "link": "u", "snippet": "s", "time": "bad"}]}))
    rows = {r.title: r for r in vendors.news(spark, f"file://{tmp_path}/*.news").collect()}
    assert rows["H"].publisher == "P" and rows["H"].time.hour == 10 and rows["T"].url == "u" and rows["T"].time is None and rows["T"].summary == "s"
    (tmp_path / "g.payload").write_text(json.dumps({"symbol": "X", "data": [{"t": 1704067200000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 9}]}))
    bar = vendors.payload_bars(spark, f"file://{tmp_path}/g.payload").first()
    assert (bar.symbol, bar.dt, bar.close) == ("X", DAY, 1.5)
    (tmp_path / "s.scores").write_text('{"A": 0.5, "B": -1}')
    assert {r.symbol: r.score for r in vendors.external_scores(spark, f"file://{tmp_path}/s.scores").collect()} == {"A": 0.5, "B": -1.0}
    panel = f"file://{tmp_path}/panel"
    vendors.save_panel(spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + timedelta(1), 2.0), ("B", DAY, 3.0)], "symbol string, dt date, close double"), panel)
    assert vendors.load(spark, panel, ["A", "C"], last=str(DAY)).count() == 1
    texts = prompts.headlines(spark.createDataFrame([("", "s", None, "u1"), ("T", "x", None, "u2")], "title string, summary string, time timestamp, url string"))
    scored = prompts.with_scores(texts, spark.createDataFrame([(1, 0.7)], "id int, score double")).orderBy("id").collect()
    assert [(r.text, r.sentiment_llm) for r in scored] == [("s", 0.0), ("T", 0.7)]
    answer = spark.createDataFrame([('well: {"relevance": 0.4, "why": "x"} ok',), ("none",)], "a string").select(prompts.answer_field(F.col("a"), "relevance").alias("x")).collect()
    assert [r.x for r in answer] == [0.4, None]
    assert "1. a" in prompts.debate("q", ["a"]) and "(none)" in prompts.factor_reasoning("f", "US", []) and prompts.evidence(["x" * 999] * 40).count("\n") == 14
    items = spark.createDataFrame([("h", None, None, None), ("", "x", "y", "z")], "headline string, level string, signal string, symbol string")
    assert [tuple(r) for r in vendors.news_rows(items).collect()] == [("h", "mid", "watch", "news")]


def test_calendars():
    shut = calendars.new_york(2024)
    assert date(2024, 3, 29) in shut and date(2024, 6, 19) in shut and date(2024, 11, 28) in shut and len(shut) == 10
    assert calendars.easter(2025) == date(2025, 4, 20) and date(2021, 12, 31) not in calendars.new_york(2022) and len(calendars.new_york(2022)) == 9
    last = calendars.sessions("US", "2024-07-05", 3)
    assert last == [date(2024, 7, 2), date(2024, 7, 3), date(2024, 7, 5)]
    assert calendars.sessions("HK", "2025-01-31", 1) == [date(2025, 1, 28)] and len(calendars.sessions("US", "2024-12-31", 252)) == 252


def test_bandit_and_clusters(spark, bars):
    arm = search.UCB1(["a", "b"])
    for _ in range(60):
        pick = arm.select()
        arm.update(pick, search.reward(2.0 if pick == "b" else -2.0))
    assert arm.pulls["b"] > arm.pulls["a"] and search.reward(None) == 0 and search.reward(0.0) == 0.5
    d = np.array([[0, 0.1, 1, 1], [0.1, 0, 1, 1], [1, 1, 0, 0.2], [1, 1, 0.2, 0]])
    labels, medoids = search.k_medoids(d, 2)
    assert labels[0] == labels[1] != labels[2] == labels[3] and len(medoids) == 2
    trials = bars.select("dt", F.col("symbol").alias("trial"), F.col("sig").alias("ret"))
    twins = trials.unionByName(trials.withColumns({"trial": F.concat("trial", F.lit("x")), "ret": F.col("ret") * 2}))
    found, centers = search.cluster_trials(twins, 8)
    assert all(found[t] == found[t + "x"] for t in found if not t.endswith("x")) and len(centers) == 8
    best = search.research(bars, "s0", 8, ["ts_momentum"], {"ts_momentum": {"lookback": [5, 10]}})
    assert len(best) == 8 and best[0]["oos_sharpe"] >= best[-1]["oos_sharpe"]
    with pytest.raises(ValueError):
        L.factor_to_signal(bars, "sig", mode="other")


def test_ewma_weights_against_pandas(spark, walk):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(0.001, 0.01, (60, 3)), index=[DAY + timedelta(i) for i in range(60)], columns=["a", "b", "c"])
    long = wide.stack().rename("ret").reset_index().set_axis(["dt", "member", "ret"], axis=1).assign(symbol="x")
    got = search.ewma_weights(spark.createDataFrame(long), 12).toPandas().pivot(index="dt", columns="member", values="weight")
    mu, sd = (getattr(wide.ewm(halflife=12, min_periods=10), f)() for f in ("mean", "std"))
    z = np.exp(((mu / sd) * math.sqrt(252)).shift(1).fillna(0).clip(-10, 10))
    assert np.allclose(got.to_numpy(), z.div(z.sum(axis=1), axis=0).to_numpy(), atol=1e-9)


def test_listwise_gradients_and_learning():
    rng = np.random.default_rng(6)
    for model in (learners.ListNet(), learners.ListMLE(), learners.LeastSquaresList()):
        s, y = rng.normal(size=6), rng.normal(size=6)
        _, g = model.loss(s, y)
        for i in range(6):
            up, down = s.copy(), s.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert g[i] == pytest.approx((model.loss(up, y)[0] - model.loss(down, y)[0]) / 2e-6, abs=1e-5)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([1.0, -0.5, 0.0]) + 0.5 * rng.normal(size=400)
    for name, make in learners.MODELS.items():
        fitted = make().fit(x[:300], y[:300], np.repeat(np.arange(30), 10))
        assert np.corrcoef(fitted.predict(x[300:]), y[300:])[0, 1] > 0.6, name
    with pytest.raises(ValueError):
        learners.Stacking().fit(x[:6], y[:6])


def test_walk_forward_models_agree_with_sums(bars):
    df = bars.withColumn("y", CS.forward_return(2))
    every = BT.rebalance_dates(df)
    a = models.walk_forward_ridge(df, ["sig", "noise"], "y", 2, every, 60, 20).toPandas()
    b = learners.walk_forward(df, ["sig", "noise"], "y", 2, every, learners.Ridge(1.0), 60, 20).toPandas()
    both = a.merge(b, on=["dt", "symbol"])
    assert len(a) == len(b) == len(both) > 0 and np.allclose(both.pred_x, both.pred_y, atol=1e-9)
    card, preds = learners.evaluate_cross_section(bars, ["sig", "noise"], "listnet", 2, "month", 60, 20)
    assert card.first().rank_ic > 0 and preds.count() > 0


def test_smoothing_keeps_the_gross(spark):
    rows = [(DAY + timedelta(t), s, w) for t, ws in enumerate([(0.5, 0.5, 0), (0, 0.5, 0.5), (0, 0, 1)]) for s, w in zip("abc", map(float, ws))]
    got = MF.smooth(spark.createDataFrame(rows, "dt date, symbol string, weight double"), 0.5).toPandas().pivot(index="dt", columns="symbol", values="weight").to_numpy()
    assert np.allclose(got.sum(1), 1) and np.allclose(got[1], [0.25, 0.5, 0.25])


def test_ratings_read_the_last_bar(spark):
    up = [("u", DAY + timedelta(i), 99.0 + i, 101.0 + i, 98.0 + i, 100.0 + i, 10.0) for i in range(260)]
    down = [("d", *r[1:2], *(500 - x for x in (r[2], r[4], r[3], r[5])), 10.0) for r in up]
    df = spark.createDataFrame(up + down, "symbol string, dt date, open double, high double, low double, close double, volume double")
    rate = {r.symbol: r for r in ratings.tech_rating(df).collect()}
    assert rate["u"].means == 1.0 and rate["d"].means == -1.0
    strong = {r.symbol: r for r in ratings.strength(df).collect()}
    assert strong["u"].strength > strong["d"].strength
    line = ratings.rsi_isolines(df.where("symbol = 'u'")).orderBy(F.desc("dt")).first()
    assert line.rsi_price_30 < line.rsi_price_70
    assert {r.symbol for r in ratings.trade_levels(df.where("dt < '2024-02-10'")).collect()} == set()


def test_reports(bars):
    tested = BT.backtest(strategies.ts_momentum(bars, 10))
    figures = {"total_return": 0.123, "sharpe": float("nan"), "cagr": None, "max_drawdown": -0.5}
    text = R.markdown("Test", figures, {"sharpe": 1.0}, {"n": 10})
    assert "+12.30%" in text and "—" in text and "`n=10`" in text and "Sharpe" in R.summary_text(figures)
    page = R.page("T <1>", [("a", [{"x": 1.5, "y": float("nan")}]), ("b", {"k": "</script>"}), ("c", "t & u")])
    assert "T &lt;1&gt;" in page and "</script>" == page[-9:] and page.count("</script>") == 1 and "null" in page
    assert R.table_markdown([]) == "(no rows)" and "| a |" in R.table_markdown([{"a": 1.0}])
    assert A.spans(tested).count() > 0
    sheet = R.tearsheet(bars, "sig", (1, 5))
    assert sheet["quantiles"].count() == 5 and sheet["churn"].count() > 0


def test_small_readings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.market_of(F.lit("0700.HK"))) == "HK" and value(S.market_of(F.lit("AAPL"))) == "US" and value(S.market_of(F.lit("600519.SS"))) == "CN"
    assert value(S.econ_surprise(F.lit("CPI"), F.lit(3.0), F.lit(3.0))) == 0 and value(S.econ_surprise(F.lit("CPI"), F.lit(4.0), F.lit(3.0))) < 0
    assert value(S.pre_event_risk(F.lit("fomc"), F.lit(0))) == -0.5 and value(S.pre_event_risk(F.lit("fomc"), F.lit(9))) == 0
    assert value(risk.kelly_fraction(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.4)
    assert value(X.order_style(F.lit(1.0), F.lit("low"))) == "marketable" and value(X.shares_to_trade(F.lit(0.5), F.lit(0.2), F.lit(1000.0), F.lit(10.0))) == 30


def test_compositions(spark, bars, walk):
    weights = bars.select("symbol").distinct().withColumn("weight", F.lit(0.125))
    sectors = bars.select("symbol", F.lit("one").alias("sector")).distinct()
    figures, said = risk.portfolio_health(bars.where("not (symbol = 's7' and dt > '2024-05-20')"), weights, sectors)
    assert figures["names"] == 8 and any("without a full history" in x for x in said) and any("half" in x for x in said) and figures["cvar"] <= figures["var"]
    states = risk.mixture_regime(bars, "s0", 2).groupBy("state").agg(F.avg("ret").alias("m")).orderBy("state").collect()
    assert len(states) == 2
    choices = learners.subsets(["a", "b", "c"], {"a": 0.1, "b": -0.3})
    assert choices[0] == ("a", "b", "c") and choices[1] == ("b",) and len(choices) == len(set(choices))
    board = learners.leaderboard(bars, [("sig",), ("noise",)], ["ridge"], 2, "month", 60, 20).collect()
    assert board[0].factors == "sig"
    widths = learners.conformal(bars.select("dt", "symbol", F.col("sig").alias("pred"), F.col("noise").alias("target"))).toPandas()
    day = DAY + timedelta(20)
    past = np.sort(np.abs(walk.sig - walk.noise)[walk.dt < day])
    assert widths[widths.dt == day].width.iloc[0] == pytest.approx(past[min(math.ceil((len(past) + 1) * 0.9), len(past)) - 1])
    assert X.schedule(-10, 4, lambda left, i, n: 0.5) == [-5, -2, -2, -1] and sum(X.schedule(7, 3, lambda *_: 9)) == 7
    with pytest.raises(ValueError):
        L.register("ahead", lambda b: b.withColumn("factor", F.lead("close").over(L.SERIES)), bars, [DAY + timedelta(60)])
    assert R.curve_svg([1.0]) == "" and "polyline" in R.curve_svg([1.0, 2.0])
    page = R.build_research(bars, "s0", ["ts_momentum"], {"ts_momentum": {"lookback": [5, 20]}})
    assert "Robustness" in page and "ts_momentum" in page
    frame = spark.createDataFrame([("2024-01-02 00:00:00", 1.0, 2.0)], "Date string, Close double, `Adj Close` double")
    one = vendors.vendor_bars(frame, "600519.SS", strip=True).first()
    assert (one.symbol, str(one.dt), one.adj_close) == ("600519", "2024-01-02", 2.0)
    assert ratings.lenses(bars).count() == 8


def test_entry_needs_no_session():
    """Queries are listed before there is a session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-500:]
    assert int(got.stdout.split()[-2]) > 100
