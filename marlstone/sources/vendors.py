"""Readers of what vendors and brokers deliver: fundamentals, news, payloads, scores and folders of bars. Fetching is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FUNDAMENTALS, csv_bars, stem

# Bar sizes and history lengths that a broker's gateway takes.
PERIODS = ("1d", "1w", "1m", "3m", "6m", "1y", "2y", "5y")
STEPS = ("1min", "5min", "15min", "30min", "1h", "1d", "1w", "1m")
# Names under which vendors deliver a figure.
ALIASES = {
    "market_cap": ("marketCap",), "pe": ("trailingPE",), "pb": ("priceToBook",), "ps": ("priceToSalesTrailing12Months",), "dividend_yield": ("dividendYield",), "roe": ("returnOnEquity",), "roa": ("returnOnAssets",),
    "gross_margin": ("grossMargins",), "net_margin": ("profitMargins",), "debt_to_equity": ("debtToEquity",), "revenue_growth": ("revenueGrowth",), "earnings_growth": ("earningsGrowth",),
}
# Names under which sources deliver the fields of a news item.
NEWS = {"title": ("title", "headline"), "publisher": ("publisher", "source"), "time": ("time", "publishedAt", "date"), "url": ("url", "link"), "summary": ("summary", "snippet", "description")}


def finite(text: Column) -> Column:
    """A figure that may be a text; null if it is none, not finite, or missing."""
    y = text.try_cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """A row per JSON file of one object with canonical or vendor names: symbol (or the file's stem), name, the canonical fields, as_of.

    A vendor's debtToEquity is a percentage and becomes a fraction; a canonical one is left as it is. What can't be read is null.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), stem(F.input_file_name()).alias("stem"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    cols = []
    for c in FUNDAMENTALS:
        vendor = F.coalesce(*(finite(get(a)) for a in ALIASES[c]))
        cols.append(F.coalesce(finite(get(c)), vendor / 100 if c == "debt_to_equity" else vendor).alias(c))
    name = F.coalesce(get("name"), get("shortName"), get("longName"))
    return raw.select(F.coalesce(get("symbol"), F.col("stem")).alias("symbol"), name.alias("name"), *cols, get("as_of").alias("as_of"))


def debt_to_equity(debt_to_assets: Column) -> Column:
    """From a share of assets d: d / (1 - d)."""
    return F.when((debt_to_assets >= 0) & (debt_to_assets < 1), debt_to_assets / (1 - debt_to_assets))


def news(spark: SparkSession, path: str) -> DataFrame:
    """(title, publisher, time in UTC, url, summary) from JSON files: a list of items, or an object with one under results, news, items or data."""
    raw = spark.read.text(path, wholetext=True)
    items = "array<map<string,string>>"
    inner = [F.from_json(F.get_json_object("value", f"$.{k}"), items) for k in ("results", "news", "items", "data")]
    rows = raw.select(F.explode(F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", items)), *inner)).alias("m"))
    field = lambda names: F.coalesce(*(F.when(F.try_element_at("m", F.lit(n)) != "", F.try_element_at("m", F.lit(n))) for n in names))
    return rows.select(*((F.try_to_timestamp(field(n)) if c == "time" else field(n)).alias(c) for c, n in NEWS.items()))


def payload_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from a gateway's JSON files {symbol, data: [{t (milliseconds), o, h, l, c, v}]}."""
    raw = spark.read.schema("symbol string, data array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>").option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("symbol", stem(F.input_file_name())).alias("symbol"), F.explode("data").alias("b"))
    return rows.select("symbol", F.timestamp_millis("b.t").cast("date").alias("dt"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"))


def external_scores(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, score) from a JSON object of symbols."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return text.select(F.explode("m").alias("symbol", "score"))


def load(spark: SparkSession, folder: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars of a folder of Parquet (partitioned by symbol or not) or CSV files, one panel for all symbols; filters reach the scan. Symbols
    without data are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    is_csv = any(f.getPath().getName().endswith(".csv") for f in found)
    bars = csv_bars(spark, f"{folder}/*.csv") if is_csv else spark.read.parquet(folder)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if first is not None:
        bars = bars.where(F.col("dt") >= F.lit(first).cast("date"))
    return bars if last is None else bars.where(F.col("dt") <= F.lit(last).cast("date"))


def save_panel(bars: DataFrame, folder: str) -> None:
    """Bars as Parquet by symbol; the symbols in bars replace what there is of them."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(folder)


def news_rows(items: DataFrame) -> DataFrame:
    """Curated items as report alerts: those with a headline, with level, signal and symbol filled in where missing."""
    return items.where("headline is not null and headline <> ''").withColumns({"level": F.coalesce("level", F.lit("mid")), "signal": F.coalesce("signal", F.lit("watch")), "symbol": F.coalesce("symbol", F.lit("news"))})


# Endings by which vendors mark markets, and columns under other names.
SUFFIXES = r"\.(SS|SZ|SH|BJ|HK|KS|KQ|T)$"
COLUMNS = {"date": "dt", "time": "dt", "adj close": "adj_close", "vol": "volume"}


def vendor_bars(df: DataFrame, symbol: str | None = None, strip: bool = False) -> DataFrame:
    """Bars from a vendor's frame: lower-case columns, other names mapped, dates without time; symbols stay strings, on wish without ending."""
    df = df.toDF(*(COLUMNS.get(c.lower(), c.lower().replace(" ", "_")) for c in df.columns))
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    name = F.regexp_replace("symbol", SUFFIXES, "") if strip else F.col("symbol")
    return df.withColumns({"symbol": name, "dt": F.to_date("dt")})
