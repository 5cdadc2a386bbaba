"""Price bars: the canonical panel (symbol, dt, open, high, low, close, volume, ...) and how to get it from raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("dt", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
PRICES = ("open", "high", "low", "close")
#: A bar whose range is broken by more than this share of its close is dropped; smaller faults are repaired.
REPAIR_LIMIT = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c: Column) -> Column:
    """The one mark for what is missing is NULL: NaN and infinities become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def canonicalize(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Raw rows to clean bars, one for each (symbol, dt).

    Columns are matched in lower case. Of rows with the same symbol and time the last by `order` stays (without one, by all values).
    Rows without time or close, or with a close that isn't positive, go. A bar whose high is below, or low above, its open or close is
    repaired if the fault is at most REPAIR_LIMIT of its close, else dropped.
    """
    df = raw.toDF(*(c.lower() for c in raw.columns))
    df = df.select([finite(F.col(c)).alias(c) if c in (*PRICES, "volume", "adj_close") else F.col(c) for c in df.columns])
    df = df.where("dt is not null and close > 0")
    last = F.col(order.lower()) if order else F.struct(*PRICES)
    w = Window.partitionBy("symbol", "dt").orderBy(last.desc())
    df = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    top, bottom = F.greatest(*PRICES), F.least(*PRICES)
    fault = F.greatest(top - F.col("high"), F.col("low") - bottom, F.lit(0.0)) / F.col("close")
    return df.withColumn("_fault", fault).where(F.col("_fault") <= REPAIR_LIMIT).withColumn("high", top).withColumn("low", bottom).drop("_fault")


def resample(ticks: DataFrame, symbol: Column, when: Column, price: Column, size: Column, order: list[str]) -> DataFrame:
    """OHLCV bars and vwap of ticks. Open and close are the first and last price by `order`, found in one aggregation without a window."""
    rank = F.struct(*order)
    rows = ticks.select(symbol.alias("symbol"), when.alias("dt"), price.alias("px"), size.alias("q"), rank.alias("o"))
    return rows.groupBy("symbol", "dt").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"),
        F.sum("q").alias("volume"), (F.sum(F.col("px") * F.col("q")) / F.sum("q")).alias("vwap"),
    )


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_bars(spark: SparkSession, sf_dir: str, period: str = "week", by: str = "p_brand") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if by == "p_brand":
        lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), lines.l_partkey == F.col("p_partkey"))
    when = F.date_trunc(period, "l_shipdate").cast("date")
    return resample(lines, F.col(by).cast("string"), when, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), _LINE_ORDER)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return resample(rows, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.lit(1.0), ["ts", "event_id"])


def densify(bars: DataFrame) -> DataFrame:
    """Every symbol on every date of the union calendar; bars that aren't there have NULL values. Calendar and symbols are small beside bars."""
    grid = bars.select("dt").distinct().join(bars.select("symbol").distinct(), how="cross")
    return grid.join(bars, ["symbol", "dt"], "left")


def filled_returns(w) -> Column:
    """Return on the last known close before: a hole counts as no move, and the move lands on the next real bar."""
    held = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(held, before) - 1
