"""Streams: bars from ticks with watermarks, sessions, and indicators with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """OHLCV bars of a stream (symbol, ts, price, size), complete when the watermark passes their end. Works on batches too."""
    order = F.struct("ts", "price")
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    rows = ticks.withWatermark("ts", late).groupBy("symbol", window.alias("w"))
    return rows.agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("ticks"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): stretches of a user's events without a gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stream_ewm(bars: DataFrame, alpha: float, cusum: float = 0.05) -> DataFrame:
    """(symbol, ts, close, ewm, change): the exponential mean of closes, and +1 or -1 where a two-sided cumulative sum of returns crosses
    its threshold (it then starts anew). State is three numbers a symbol; bars of a batch are taken in time order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        mean, up, down, last = state.get if state.exists else (None, 0.0, 0.0, None)
        pdf = pd.concat(list(batches)).sort_values("ts")
        rows = []
        for ts, close in zip(pdf.ts, pdf.close):
            mean = float(close) if mean is None else (1 - alpha) * mean + alpha * float(close)
            r = 0.0 if last is None or last == 0 else float(close) / last - 1
            last, up, down, mark = float(close), max(0.0, up + r), min(0.0, down + r), 0
            if up > cusum or down < -cusum:
                mark, up, down = (1 if up > cusum else -1), 0.0, 0.0
            rows.append((key[0], ts, float(close), mean, mark))
        state.update((mean, up, down, last))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "close", "ewm", "change"])

    out, kept = "symbol string, ts timestamp, close double, ewm double, change int", "mean double, up double, down double, last double"
    return bars.groupBy("symbol").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def replay(spark, make, folder: str, schema, name: str) -> DataFrame:
    """Runs make(stream) over the parquet files of a folder as a stream until they are used up, and returns what came out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination(300)
    finally:
        query.stop()
    return spark.table(name)


def dedup_last(ticks: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of (symbol, ts, seq, price, size) with the row of the largest seq of each symbol and time, once the watermark has passed."""
    rows = ticks.withWatermark("ts", watermark).groupBy("symbol", "ts").agg(F.max_by(F.struct("price", "size"), "seq").alias("b"))
    return rows.select("symbol", "ts", "b.price", "b.size")


def stream_signal_log(spark, path: str, schema: str):
    """The appended lines of a signal log as a stream."""
    return spark.readStream.schema(schema).json(path)
