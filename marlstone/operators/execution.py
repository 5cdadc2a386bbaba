"""Execution planning and cost analysis as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.kernels import divide


def shares_to_trade(target: Column, current: Column, account: Column, price: Column) -> Column:
    return F.when(price > 0, F.rint((target - current) * account / price)).otherwise(0.0).cast("long")


def order_style(spread_bps: Column, urgency: Column) -> Column:
    return F.when((urgency == "high") | (spread_bps <= 3), "marketable").when(spread_bps >= 20, "patient").otherwise("middle")


def twap(total: Column, slices: Column) -> Column:
    """Equal whole child orders, the remainder on the first ones."""
    base = F.floor(total / slices)
    rest = total - base * slices
    parts = F.transform(F.sequence(F.lit(0), slices.cast("int") - 1), lambda i: (base + F.when(i < rest, 1).otherwise(0)).cast("long"))
    return F.when((total == 0) | (slices <= 0), F.array().cast("array<bigint>")).otherwise(parts)


def vwap(total: Column, profile: Column) -> Column:
    """Whole child orders in proportion to a volume profile, the remainder on the largest fraction; equal ones where the profile has no volume."""
    whole = F.aggregate(profile, F.lit(0.0), lambda s, x: s + x)
    raw = F.transform(profile, lambda x: F.coalesce(F.try_divide(total * x, whole), F.lit(0.0)))
    low = F.transform(raw, lambda x: F.floor(x).cast("long"))
    left = total - F.aggregate(low, F.lit(0).cast("long"), lambda s, x: s + x)
    fraction = F.transform(raw, lambda x: x - F.floor(x))
    top = F.array_position(fraction, F.array_max(fraction)) - 1
    parts = F.transform(low, lambda x, i: x + F.when(i == top, left).otherwise(0))
    return F.when((whole > 0) & (total != 0), parts).otherwise(twap(total, F.when(F.size(profile) > 0, F.size(profile)).otherwise(6)))


def capped_order(shares: Column, adv: Column, participation: float = 0.10) -> tuple[Column, Column]:
    """(shares a day, days) under a share of the average daily volume."""
    most = F.greatest(F.floor(adv * participation), F.lit(1))
    return F.least(F.abs(shares), most) * F.signum(shares.cast("double")), F.greatest(F.ceil(F.abs(shares) / most), F.lit(1))


def shortfall(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Implementation shortfall of each order, in basis points of its decision price.

    fills: order_id, time, qty, price. orders: order_id, side (buy or sell), decision_price, and arrival_price, final_price, target_qty,
    each of which may be null: the first fill, the last fill and the filled quantity stand in.
    """
    f = fills.groupBy("order_id").agg(F.sum(F.abs("qty")).alias("filled"), divide(F.sum(F.abs("qty") * F.col("price")), F.sum(F.abs("qty"))).alias("avg_fill"), F.min_by("price", "time").alias("first"), F.max_by("price", "time").alias("last"))
    o = orders.join(f, "order_id", "left").withColumn("s", F.when(F.col("side") == "sell", -1.0).otherwise(1.0))
    dec = F.col("decision_price")
    arr, fin = F.coalesce("arrival_price", "first", dec), F.coalesce("final_price", "last", dec)
    filled = F.coalesce("filled", F.lit(0.0))
    rate = F.coalesce(F.least(divide(filled, F.coalesce("target_qty", filled)), F.lit(1.0)), F.lit(0.0))
    bps = lambda share, move: share * F.col("s") * divide(move, dec) * 1e4
    parts = o.withColumns({"fill_rate": rate, "delay_bps": bps(rate, arr - dec), "execution_bps": F.coalesce(bps(rate, F.col("avg_fill") - arr), F.lit(0.0)), "opportunity_bps": bps(1 - rate, fin - dec)})
    return parts.select("order_id", "fill_rate", "delay_bps", "execution_bps", "opportunity_bps", (F.col("delay_bps") + F.col("execution_bps") + F.col("opportunity_bps")).alias("shortfall_bps"))


def quality(fills: DataFrame, market: DataFrame, orders: DataFrame, width: float = 3600.0) -> DataFrame:
    """Each order's average fill against the volume- and time-weighted market price while it was worked. market: symbol, time, price, volume.

    Ticks meet an order by symbol and time slot of `width` (seconds, or units of a numeric time), so not every tick meets every order.
    """
    slot = lambda c: F.floor((F.col(c).cast("timestamp") if fills.schema["time"].dataType.typeName().startswith("timestamp") else F.col(c)).cast("double") / width)
    f = fills.join(orders.select("order_id", "symbol", "side"), "order_id").groupBy("order_id", "symbol", "side").agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.sum(F.abs("qty")).alias("filled"), divide(F.sum(F.abs("qty") * F.col("price")), F.sum(F.abs("qty"))).alias("avg_fill"))
    slots = f.select("order_id", "symbol", "t0", "t1", F.explode(F.sequence(slot("t0"), slot("t1"))).alias("slot"))
    m = slots.join(market.withColumn("slot", slot("time")), ["symbol", "slot"]).where("time >= t0 and time <= t1").groupBy("order_id").agg(divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), F.avg("price").alias("twap"), F.sum("volume").alias("traded"))
    s = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
    out = f.join(m, "order_id", "left")
    return out.select("order_id", "avg_fill", "vwap", "twap", (s * divide(F.col("avg_fill") - F.col("vwap"), F.col("vwap")) * 1e4).alias("vs_vwap_bps"), (s * divide(F.col("avg_fill") - F.col("twap"), F.col("twap")) * 1e4).alias("vs_twap_bps"), divide(F.col("filled"), F.col("traded")).alias("participation"))


def schedule(total: int, steps: int, policy) -> list[int]:
    """Child orders from policy(remaining, step, steps) -> a share of what remains, held to what is left; the last step takes the rest."""
    out, left, sign = [], abs(total), 1 if total >= 0 else -1
    for i in range(steps):
        share = 1.0 if i == steps - 1 else min(max(float(policy(left, i, steps)), 0.0), 1.0)
        part = min(left, round(left * share))
        out.append(sign * part)
        left -= part
    return out
