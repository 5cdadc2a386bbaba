"""Readers and writers of the other inputs: JSON bars, dated snapshots, logs, universes, and as-of joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The canonical numeric fields of a fundamentals snapshot; ratios and margins are fractions.
FUNDAMENTALS = ("market_cap", "pe", "pb", "ps", "dividend_yield", "roe", "roa", "gross_margin", "net_margin", "debt_to_equity", "revenue_growth", "earnings_growth")


def columnar_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from JSON files of parallel arrays {time: [...], open: [...], ...}; the symbol is the file's stem unless given."""
    lists = "time array<string>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>, symbol string"
    raw = spark.read.schema(lists).option("multiLine", True).json(path).withColumn("_stem", stem(F.input_file_name()))
    rows = raw.select(F.coalesce("symbol", "_stem").alias("symbol"), F.explode(F.arrays_zip("time", "open", "high", "low", "close", "volume")).alias("b"))
    return rows.select("symbol", F.to_date(F.substring("b.time", 1, 10)).alias("dt"), "b.open", "b.high", "b.low", "b.close", "b.volume")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)*$", 1)


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from a folder of CSV files, one a symbol, with columns dt, open, high, low, close, volume; symbols stay strings."""
    schema = "dt date, open double, high double, low double, close double, volume double"
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("symbol", stem(F.input_file_name()))


DAY = r"(\d{4}-\d{2}-\d{2})(\.json|/[^/]*)$"


def _snapshot_files(spark: SparkSession, folder: str, kind: str):
    """A reader for the files of a kind, or None if the store has no such kind."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.json,part-*}")


def snapshots(spark: SparkSession, folder: str, kind: str, schema: str = "map<string,double>") -> DataFrame:
    """(day, body) of the snapshots of a kind under a point-in-time store: folder/kind/YYYY-MM-DD.json, or folder/kind/day=YYYY-MM-DD/part-*."""
    files = _snapshot_files(spark, folder, kind)
    if files is None:
        return spark.createDataFrame([], f"day date, body {schema}")
    text = files.text(f"{folder}/{kind}", wholetext=True)
    return text.select(F.to_date(F.regexp_extract(F.input_file_name(), DAY, 1)).alias("day"), F.from_json("value", schema).alias("body"))


def sentiment_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(day, symbol, score); symbols stay strings, leading zeros too."""
    return snapshots(spark, folder, "sentiment").select("day", F.explode("body").alias("symbol", "score"))


def fundamentals_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(day, symbol, and the canonical fields)."""
    fields = ", ".join(f"{c}: double" for c in FUNDAMENTALS)
    return snapshots(spark, folder, "fundamentals", f"map<string,struct<{fields}>>").select("day", F.explode("body").alias("symbol", "f")).select("day", "symbol", "f.*")


def coverage(spark: SparkSession, folder: str, kinds=("fundamentals", "sentiment", "env")) -> DataFrame:
    """(kind, days, first, last) of the kinds that the store has."""
    out = spark.createDataFrame([], "kind string, day date")
    for kind in kinds:
        if (files := _snapshot_files(spark, folder, kind)) is not None:
            path = files.format("binaryFile").load(f"{folder}/{kind}").select("path")
            out = out.unionByName(path.select(F.lit(kind).alias("kind"), F.to_date(F.regexp_extract("path", DAY, 1)).alias("day")))
    return out.groupBy("kind").agg(F.countDistinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))


def save_snapshot(df: DataFrame, folder: str, kind: str) -> None:
    """Writes rows (day, symbol, one or more values) as one JSON object of symbols a day; a day's file replaces an older one."""
    values = [c for c in df.columns if c not in ("day", "symbol")]
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    body = df.groupBy("day").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", value.alias("v")))))).alias("value"))
    body.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").text(f"{folder}/{kind}")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, place) of a file with one symbol a line: trimmed, upper case, first places kept."""
    lines = spark.read.text(path).select(F.upper(F.trim("value")).alias("symbol"), F.monotonically_increasing_id().alias("place"))
    return lines.where("symbol <> '' and symbol not like '#%'").groupBy("symbol").agg(F.min("place").alias("place"))


def sector_of(df: DataFrame, override: DataFrame | None, builtin: DataFrame | None) -> DataFrame:
    """df with sector: of the override, else the built-in map, else 'other'. Both maps: (symbol, sector), dimension tables."""
    out, found = df, []
    for i, m in enumerate(x for x in (override, builtin) if x is not None):
        out = out.join(m.select("symbol", F.col("sector").alias(f"_s{i}")), "symbol", "left")
        found.append(f"_s{i}")
    return out.withColumn("sector", F.coalesce(*map(F.col, found), F.lit("other"))).drop(*found)


def universe_meta(quotes: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Quotes with sector and indexes; the dollar volume falls back from average to present volume."""
    index = members.groupBy("symbol").agg(F.sort_array(F.collect_set("index")).alias("in_index"))
    out = quotes.join(profiles, "symbol", "left").join(index, "symbol", "left")
    return out.withColumn("adv_usd", F.col("price") * F.coalesce("avg_volume", "volume"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, day: str, value: str) -> DataFrame:
    """left with the value of right's latest row of the same key at or before left's time: one pass over the union, no range join."""
    a = left.withColumn("_t", F.col(at)).withColumn("_k", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(key), F.col(day).alias("_t"), F.lit(0).alias("_k"), F.struct(F.col(value).alias("x")).alias("_v2"))
    a = a.withColumn("_v2", F.lit(None).cast(b.schema["_v2"].dataType)).drop("_v")
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v2", F.last("_v2", ignorenulls=True).over(w)).where("_k = 1").withColumn(value, F.col("_v2.x")).drop("_t", "_k", "_v2")


def evaluate_signals(signals: DataFrame, bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Signals (symbol, day, score) with the return over the next `horizon` bars from the last bar at or before their day; unripe ones go."""
    w = Window.partitionBy("symbol").orderBy("dt")
    ahead = bars.select("symbol", "dt", F.col("close").alias("entry"), F.lead("close", horizon).over(w).alias("exit")).withColumn("bar", F.struct("dt", "entry", "exit"))
    joined = asof(signals, ahead.select("symbol", "dt", "bar"), "symbol", "day", "dt", "bar")
    out = joined.where("bar.exit is not null").withColumn("fwd", F.try_divide(F.col("bar.exit"), F.col("bar.entry")) - 1)
    return out.withColumn("hit", (F.signum("fwd") == F.signum("score")).cast("int")).drop("bar")
