"""Readings of a symbol's last bar: technical votes, strength, levels to act on, and a rule's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.dsl import with_ewm
from marlstone.functions.kernels import SERIES, divide, frame, full

from . import indicators as I

MEANS = (10, 20, 30, 50, 100, 200)


def _last(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    df = df.withColumns(cols).withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))))
    return df.where("_i = 1").drop("_i")


def _vote(up: Column, down: Column, x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(up, 1.0).when(down, -1.0).otherwise(0.0))


def _mean(votes: list[Column]) -> Column:
    known = sum((v.isNotNull().cast("double") for v in votes), F.lit(0.0))
    return F.coalesce(divide(sum((F.coalesce(v, F.lit(0.0)) for v in votes), F.lit(0.0)), known), F.lit(0.0))


def tech_rating(bars: DataFrame) -> DataFrame:
    """A row per symbol: means (votes of 12 moving averages), oscillators (RSI, stochastic, CCI, Williams %R, MACD, rate of change), score and label."""
    c = F.col("close")
    df = I.with_macd(I.with_rsi(with_ewm(bars, {f"_e{n}": (c, 2.0 / (n + 1), n) for n in MEANS}), 14, "_rsi"))
    low, high = full(F.col("low"), 14, F.min("low").over(frame(14))), full(F.col("high"), 14, F.max("high").over(frame(14)))
    df = df.withColumns({"_ll": low, "_hh": high, "_tp": (F.col("high") + F.col("low") + c) / 3, **{f"_m{n}": I.sma(c, n) for n in MEANS}})
    df = df.withColumn("_tm", I.sma(F.col("_tp"), 20)).withColumn("_ta", F.abs(F.col("_tp") - F.col("_tm")))
    df = df.withColumns({"_md": full(F.col("_ta"), 20, F.avg("_ta").over(frame(20))), "_roc": divide(c, F.lag(c, 10).over(SERIES)) - 1})
    df = _last(df, {})
    k, wr = divide(c - F.col("_ll"), F.col("_hh") - F.col("_ll")) * 100, divide(F.col("_hh") - c, F.col("_hh") - F.col("_ll")) * -100
    cci = divide(F.col("_tp") - F.col("_tm"), F.col("_md") * 0.015)
    means = [F.when(F.col(x).isNotNull(), F.when(c > F.col(x), 1.0).otherwise(-1.0)) for n in MEANS for x in (f"_m{n}", f"_e{n}")]
    osc = [
        _vote(F.col("_rsi") < 30, F.col("_rsi") > 70, F.col("_rsi")), _vote(k < 20, k > 80, k), _vote(cci < -100, cci > 100, cci), _vote(wr < -80, wr > -20, wr),
        F.when(F.col("macd") > F.col("macd_signal"), 1.0).otherwise(-1.0), F.when(F.col("_roc").isNotNull(), F.when(F.col("_roc") > 0, 1.0).otherwise(-1.0)),
    ]
    score = (F.col("means") + F.col("oscillators")) / 2
    s = F.col("score")
    label = F.when(s >= 0.5, "strong buy").when(s >= 0.1, "buy").when(s > -0.1, "neutral").when(s > -0.5, "sell").otherwise("strong sell")
    return df.select("symbol", "dt", _mean(means).alias("means"), _mean(osc).alias("oscillators")).withColumn("score", score).withColumn("label", label)


def strength(bars: DataFrame) -> DataFrame:
    """A row per symbol: strength 0 to 100 from distances to two means, two momenta as percentiles of their own history, RSI and place in the
    20-bar range, by weights over the parts that are known; and its label."""
    c = F.col("close")
    whole = Window.partitionBy("symbol")
    df = I.with_rsi(bars, 14, "_rsi").withColumns({"_m200": I.sma(c, 200), "_m50": I.sma(c, 50), "_r125": divide(c, F.lag(c, 125).over(SERIES)) - 1, "_r63": divide(c, F.lag(c, 63).over(SERIES)) - 1})
    df = df.withColumns({"_lo": full(c, 20, F.min(c).over(frame(20))), "_hi": full(c, 20, F.max(c).over(frame(20)))})
    df = df.withColumn("_newest", F.max("dt").over(whole))
    df = df.withColumns({f"_now{n}": F.max(F.when(F.col("dt") == F.col("_newest"), F.col(f"_r{n}"))).over(whole) for n in (125, 63)})
    held = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))
    pct = lambda n: F.when((F.count(f"_r{n}") >= 20) & F.max(f"_now{n}").isNotNull(), F.avg((F.col(f"_r{n}") <= F.col(f"_now{n}")).cast("double")) * 100)
    last = lambda x: F.max_by(x, "dt")
    one = df.groupBy("symbol").agg(
        held(50 + (divide(last("close"), last("_m200")) - 1) * 100).alias("p1"), pct(125).alias("p2"), held(50 + (divide(last("close"), last("_m50")) - 1) * 250).alias("p3"), pct(63).alias("p4"), last("_rsi").alias("p5"),
        F.when(last("_hi") > last("_lo"), held(divide(last("close") - last("_lo"), last("_hi") - last("_lo")) * 100)).otherwise(50.0).alias("p6"),
    )
    parts = list(zip(("p1", "p2", "p3", "p4", "p5", "p6"), (0.25, 0.20, 0.20, 0.15, 0.10, 0.10)))
    top = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    one = one.withColumn("strength", divide(top, weight))
    label = F.when(F.col("strength") >= 80, "very strong").when(F.col("strength") >= 60, "strong").when(F.col("strength") >= 40, "neutral").when(F.col("strength") >= 20, "weak").otherwise("very weak")
    return one.select("symbol", "strength", label.alias("label"))


def trade_levels(bars: DataFrame, atr_mult: float = 2.0, reward: float = 2.0, least: int = 60) -> DataFrame:
    """A row per symbol with `least` bars or more: nearest supports and resistances, buy zone, stop, targets and reward over risk at the last bar."""
    c = F.col("close")
    df = I.with_atr(bars).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    edge = lambda col, fn, n: full(F.col(col), n, fn(col).over(frame(n)))
    year = SERIES.rowsBetween(-251, 0)
    bb = I.bollinger(c, 20, 2.0)
    cols = {
        "_s1": I.sma(c, 20), "_s2": I.sma(c, 50), "_s3": I.sma(c, 200), "_s4": bb["bb_lower"], "_s5": edge("low", F.min, 20), "_s6": edge("low", F.min, 60), "_s7": F.min("low").over(year),
        "_t1": bb["bb_upper"], "_t2": edge("high", F.max, 20), "_t3": edge("high", F.max, 60), "_t4": F.max("high").over(year),
    }
    df = _last(df, cols).where((F.col("_n") >= least) & F.col("atr").isNotNull() & (c > 0))
    down, up = F.array(*(f"_s{i}" for i in range(1, 8))), F.array(*(f"_t{i}" for i in range(1, 5)))
    below = lambda p: F.array_max(F.filter(down, lambda x: x < p))
    above = lambda p: F.array_min(F.filter(up, lambda x: x > p))
    df = df.withColumns({"support1": below(c), "resistance1": above(c)})
    df = df.withColumns({"support2": below(F.col("support1")), "resistance2": above(F.col("resistance1"))})
    a, b = F.greatest(F.coalesce("support1", c - 1.5 * F.col("atr")), c - 1.5 * F.col("atr")), c - 0.5 * F.col("atr")
    df = df.withColumns({"buy_low": F.least(a, b), "buy_high": F.greatest(a, b)})
    entry = (F.col("buy_low") + F.col("buy_high")) / 2
    df = df.withColumn("stop_loss", F.least(entry - atr_mult * F.col("atr"), F.coalesce(F.col("support1") - 0.3 * F.col("atr"), entry - atr_mult * F.col("atr"))))
    risk = entry - F.col("stop_loss")
    df = df.withColumn("target2", entry + reward * risk).withColumn("target1", F.coalesce("resistance1", "target2"))
    df = df.withColumn("reward_risk", F.when(risk > 0, divide(F.col("target1") - entry, risk)))
    keep = ["support1", "support2", "resistance1", "resistance2", "buy_low", "buy_high", "stop_loss", "target1", "target2"]
    return df.select("symbol", "dt", c.alias("price"), "atr", *keep, "reward_risk", *((divide(F.col(k), c) - 1).alias(f"{k}_pct") for k in keep))


def classify_signal(rsi: Column, reward_risk: Column, trend: Column, in_zone: Column, event: Column, leveraged: Column, overbought: float = 70.0, least_reward: float = 1.5) -> Column:
    """long, watch or short from a trend's sign and guards; what isn't known counts as neutral."""
    r, q, t = F.coalesce(rsi, F.lit(50.0)), F.coalesce(reward_risk, F.lit(0.0)), F.coalesce(trend, F.lit(0.0))
    guard = F.coalesce(event, F.lit(False)) | F.coalesce(leveraged, F.lit(False))
    return F.when(t < 0, F.when(r <= 30, "watch").otherwise("short")).when(guard, "watch").when((t > 0) & (r < overbought) & (q >= least_reward) & F.coalesce(in_zone, F.lit(False)), "long").otherwise("watch")


def rsi_isolines(bars: DataFrame, levels=(30.0, 70.0), n: int = 14) -> DataFrame:
    """bars with rsi_price_<level>: the next close at which Wilder's RSI would stand at each level, from its smoothed gains and losses."""
    move = F.col("close") - F.lag("close").over(SERIES)
    df = bars.withColumns({"_up": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_dn": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})
    df = with_ewm(df, {"_au": (F.col("_up"), 1.0 / n, n), "_ad": (F.col("_dn"), 1.0 / n, n)})
    for level in levels:
        ratio = level / (100 - level)
        rise = (ratio * F.col("_ad") - F.col("_au")) * (n - 1)
        df = df.withColumn(f"rsi_price_{level:.0f}", F.col("close") + F.when(rise >= 0, rise).otherwise(rise / ratio))
    return df.drop("_up", "_dn", "_au", "_ad")


def lenses(bars: DataFrame) -> DataFrame:
    """A row per symbol: what the rules say of its last bar side by side (rating, strength, crossover, breakout, momentum), and their mean vote."""
    from . import strategies

    out = tech_rating(bars).select("symbol", "dt", F.col("score").alias("rating"), "label").join(strength(bars).select("symbol", "strength"), "symbol", "left")
    votes = []
    for name, df in (("crossover", strategies.ma_crossover(bars, 20, 50, "sma", True)), ("breakout", strategies.breakout(bars, allow_short=True)), ("momentum", strategies.ts_momentum(bars, allow_short=True))):
        out = out.join(df.groupBy("symbol").agg(F.max_by("signal", "dt").alias(name)), "symbol", "left")
        votes.append(F.col(name))
    return out.withColumn("vote", _mean([F.col("rating"), (F.col("strength") - 50) / 50, *votes]))
