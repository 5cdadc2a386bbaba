"""Universes: scores of candidates from fundamentals and bars, gates, places by sector, and membership as it was known at each date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.kernels import SERIES, divide
from marlstone.sources.files import asof

# Weights of the parts of a score, and the horizons of the momentum part in bars.
SCORE_WEIGHTS = {"size": 0.20, "liq": 0.15, "hot": 0.30, "hi52": 0.15, "lead": 0.20}
HOT_HORIZONS = (63, 126)


def _z(x: Column) -> Column:
    w = Window.partitionBy()
    return F.coalesce(divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w)), F.when(x.isNotNull(), 0.0))


def last_moves(bars: DataFrame, horizons=HOT_HORIZONS) -> DataFrame:
    """(symbol, m<h>: the return over the last h bars, if there are more than h, off_high: the last close over the highest)."""
    back = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    rows = bars.where("close is not null").withColumn("_i", F.row_number().over(back) - 1)
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("close")))
    return rows.groupBy("symbol").agg(*((divide(at(0), at(h)) - 1).alias(f"m{h}") for h in horizons), divide(at(0), F.max("close")).alias("off_high"))


def compute_scores(meta: DataFrame, bars: DataFrame | None = None, weights: dict | None = None, horizons=HOT_HORIZONS) -> DataFrame:
    """meta (symbol, mktcap, adv_usd, sector, price, high52, avg200) with hot, hi52, rs, their z-scores and score.

    hot: mean of the known returns over `horizons`, else price over its 200-day mean; hi52: price over its 52-week high, else the last
    close over the highest; rs: the longest return (of the price over its mean for a symbol without bars), less its sector's median in the
    z-score. Unknown values take the median. Candidates are a dimension table: global windows over them are small.
    """
    w = {**SCORE_WEIGHTS, **(weights or {})}
    df = meta.withColumn("sector", F.coalesce("sector", F.lit("")))
    if bars is not None:
        df = df.join(last_moves(bars, horizons).withColumn("_has", F.lit(True)), "symbol", "left")
    else:
        df = df.withColumns({**{f"m{h}": F.lit(None).cast("double") for h in horizons}, "off_high": F.lit(None).cast("double"), "_has": F.lit(None).cast("boolean")})
    over200 = F.when((F.col("price") != 0) & (F.col("avg200") != 0), divide(F.col("price"), F.col("avg200")) - 1)
    known = sum((F.col(f"m{h}").isNotNull().cast("double") for h in horizons), F.lit(0.0))
    mean = divide(sum((F.coalesce(f"m{h}", F.lit(0.0)) for h in horizons), F.lit(0.0)), known)
    df = df.withColumns({
        "hot": F.coalesce(mean, over200), "hi52": F.coalesce(F.when((F.col("price") != 0) & (F.col("high52") != 0), divide(F.col("price"), F.col("high52"))), F.col("off_high")),
        "rs": F.when(F.col("_has"), F.col(f"m{max(horizons)}")).otherwise(over200),
    })
    everyone, sector = Window.partitionBy(), Window.partitionBy("sector")
    filled = lambda c: F.coalesce(F.col(c), F.median(c).over(everyone))
    df = df.withColumns({"_hot": filled("hot"), "_hi": filled("hi52"), "_rs": filled("rs")})
    df = df.withColumn("_lead", F.col("_rs") - F.median("_rs").over(sector))
    log = lambda c: F.log10(F.greatest(F.col(c).cast("double"), F.lit(1.0)))
    df = df.withColumns({"size_z": _z(log("mktcap")), "liq_z": _z(log("adv_usd")), "hot_z": _z(F.col("_hot")), "hi52_z": _z(F.col("_hi")), "_lz": _z(F.col("_lead"))})
    df = df.withColumn("lead_z", F.col("_lz") * 0.6 + F.col("size_z") * 0.4)
    score = F.col("size_z") * w["size"] + F.col("liq_z") * w["liq"] + F.col("hot_z") * w["hot"] + F.col("hi52_z") * w["hi52"] + F.col("lead_z") * w["lead"]
    return df.withColumn("score", score).drop("_has", "_hot", "_hi", "_rs", "_lead", "_lz", "off_high", *(f"m{h}" for h in horizons))


def scored_universe(scores: DataFrame, per_sector: int = 10, least_cap: float | None = 2e9, least_adv: float | None = 2e7, indexes: list[str] | None = None) -> DataFrame:
    """scores with gate (cap, dollar volume, member of any of the indexes), place (by score in its sector, of those that pass) and selected."""
    gate = F.lit(True)
    if least_cap:
        gate = gate & F.coalesce(F.col("mktcap") >= least_cap, F.lit(False))
    if least_adv:
        gate = gate & F.coalesce(F.col("adv_usd") >= least_adv, F.lit(False))
    if indexes:
        gate = gate & F.coalesce(F.arrays_overlap("in_index", F.array(*map(F.lit, indexes))), F.lit(False))
    df = scores.withColumn("gate", gate)
    place = F.row_number().over(Window.partitionBy("sector", "gate").orderBy(F.col("score").desc_nulls_last(), "symbol"))
    return df.withColumn("place", F.when(F.col("gate"), place)).withColumn("selected", F.coalesce(F.col("place") <= per_sector, F.lit(False)))


def merge_manual(universe: DataFrame, manual: DataFrame) -> DataFrame:
    """The selected rows and those named in manual (symbol) that have a score, with source (data or manual) and rank: own choice first, then
    the manual ones by score."""
    named = manual.select("symbol").distinct().withColumn("_m", F.lit(True))
    df = universe.join(named, "symbol", "left").where("selected or _m").withColumn("source", F.when(F.col("selected"), "data").otherwise("manual")).drop("_m")
    order = Window.orderBy("source", F.when(F.col("source") == "data", F.col("sector")), F.col("score").desc_nulls_last(), "symbol")  # a dimension table
    return df.withColumn("rank", F.row_number().over(order))


def breadth_warnings(universe: DataFrame, least: int = 30) -> DataFrame:
    """One row: names, sectors, and whether the choice is too narrow to tell skill from chance."""
    found = universe.agg(F.countDistinct("symbol").alias("names"), F.countDistinct("sector").alias("sectors"))
    return found.withColumn("is_few", F.col("names") < least).withColumn("is_one_sector", F.col("sectors") <= 1)


def anti_survivorship(meta: DataFrame, asof_date, listed: str = "list_date", delisted: str = "delist_date", known: str | None = None) -> DataFrame:
    """meta of the symbols that were listed and not yet delisted at a date; what isn't known keeps a symbol, and warning says so.

    A null delisting date means still listed; `known` names a column that is false where the source says nothing about it.
    """
    day = F.lit(asof_date).cast("date")
    rows = meta.where(F.coalesce(F.col(listed) <= day, F.lit(True)) & F.coalesce(F.col(delisted) > day, F.lit(True)))
    silent = ~F.coalesce(F.col(known), F.lit(False)) if known else F.lit(False)
    return rows.withColumn("warning", F.concat_ws("; ", F.when(F.col(listed).isNull(), f"no {listed}"), F.when(silent, f"no {delisted}")))


def rolling_universe(bars: DataFrame, dates: DataFrame, least_days: int = 60, least_adv: float | None = None, window: int = 63, caps: DataFrame | None = None, least_cap: float | None = None) -> DataFrame:
    """(dt, symbol) of the names that pass at each date of `dates` (dt) by what was known then: bars so far, mean dollar volume of the last
    `window` bars, market cap. A figure that isn't known keeps a name."""
    so_far, last = SERIES.rowsBetween(Window.unboundedPreceding, 0), SERIES.rowsBetween(1 - window, 0)
    known = bars.select("symbol", "dt", F.struct(F.count(F.lit(1)).over(so_far).alias("n"), F.avg(F.col("close") * F.col("volume")).over(last).alias("adv")).alias("k"))
    asked = bars.select("symbol").distinct().crossJoin(F.broadcast(dates.select(F.col("dt").alias("day"))))  # the result is of this size
    rows = asof(asked, known, "symbol", "day", "dt", "k").where(F.col("k.n") >= least_days)
    if least_adv is not None:
        rows = rows.where(F.coalesce(F.col("k.adv") >= least_adv, F.lit(True)))
    if caps is not None and least_cap is not None:
        rows = rows.join(caps.select("symbol", "mktcap"), "symbol", "left").where(F.coalesce(F.col("mktcap") >= least_cap, F.lit(True)))
    return rows.select(F.col("day").alias("dt"), "symbol")
