"""Scalar functions: headline sentiment, macro readings, options and alternative data. All are columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.kernels import divide

# Polarities of English finance words.
POSITIVE = {
    "beat": 1.5, "beats": 1.5, "surge": 1.5, "surges": 1.5, "soar": 1.6, "soars": 1.6, "jump": 1.2, "jumps": 1.2, "rally": 1.3, "rallies": 1.3,
    "gain": 1.0, "gains": 1.0, "rise": 0.9, "rises": 0.9, "record": 1.2, "upgrade": 1.4, "upgraded": 1.4, "outperform": 1.4, "strong": 1.1,
    "growth": 1.0, "profit": 1.0, "profitable": 1.1, "bullish": 1.5, "boost": 1.1, "boosts": 1.1, "raises": 1.0, "raised": 1.0, "expansion": 1.0,
    "buyback": 1.1, "dividend": 0.7, "approval": 1.2, "approved": 1.2, "wins": 1.1, "win": 1.0, "breakthrough": 1.4, "exceeds": 1.4, "topped": 1.3,
    "optimistic": 1.1, "recovery": 1.0, "rebound": 1.2, "accelerate": 1.0,
}
NEGATIVE = {
    "miss": -1.5, "misses": -1.5, "missed": -1.5, "plunge": -1.7, "plunges": -1.7, "tumble": -1.5, "tumbles": -1.5, "drop": -1.0, "drops": -1.0,
    "fall": -0.9, "falls": -0.9, "slump": -1.4, "crash": -1.8, "crashes": -1.8, "decline": -1.0, "downgrade": -1.4, "downgraded": -1.4,
    "underperform": -1.4, "weak": -1.1, "loss": -1.2, "losses": -1.2, "bearish": -1.5, "cut": -1.0, "cuts": -1.0, "warning": -1.3, "warn": -1.2,
    "warns": -1.2, "lawsuit": -1.2, "probe": -1.1, "investigation": -1.2, "fraud": -1.8, "bankruptcy": -1.9, "default": -1.7, "recall": -1.2,
    "layoff": -1.2, "layoffs": -1.2, "halt": -1.1, "halted": -1.1, "delay": -0.9, "delayed": -0.9, "concern": -0.9, "concerns": -0.9, "risk": -0.7,
    "slowdown": -1.2, "fears": -1.2, "selloff": -1.4, "slashes": -1.3,
}
NEGATORS = ("no", "not", "never", "without", "fails", "fail", "failed", "less", "lower")
# Polarities of Chinese finance terms.
POSITIVE_CN = {
    "大涨": 1.6, "涨停": 1.8, "上涨": 1.0, "拉升": 1.2, "走高": 1.0, "新高": 1.3, "增长": 1.0, "增持": 1.2, "回购": 1.1, "盈利": 1.0, "扭亏": 1.4, "超预期": 1.5,
    "利好": 1.5, "突破": 1.2, "中标": 1.2, "获批": 1.3, "批准": 1.2, "签约": 1.0, "提价": 1.0, "强劲": 1.1, "复苏": 1.0, "反弹": 1.2, "看好": 1.2, "买入": 1.2,
    "推荐": 1.0, "评级上调": 1.4, "业绩预增": 1.5, "分红": 0.7, "创纪录": 1.3, "订单": 0.8, "扩产": 1.0, "放量": 0.6, "翻倍": 1.5,
}
NEGATIVE_CN = {
    "大跌": -1.6, "跌停": -1.8, "下跌": -1.0, "跳水": -1.6, "走低": -1.0, "新低": -1.3, "下滑": -1.1, "减持": -1.3, "亏损": -1.3, "暴跌": -1.8, "利空": -1.5, "预亏": -1.5,
    "业绩预减": -1.5, "下调": -1.2, "评级下调": -1.4, "退市": -1.9, "违约": -1.7, "诉讼": -1.2, "处罚": -1.3, "罚款": -1.2, "调查": -1.2, "立案": -1.4, "造假": -1.9,
    "停牌": -1.0, "商誉减值": -1.5, "爆雷": -1.8, "质押": -0.8, "风险": -0.7, "警示": -1.2, "问询": -1.0, "减产": -1.1, "裁员": -1.2, "解禁": -0.8, "套现": -1.0,
}
NEGATORS_CN = ("不", "未", "无", "没有", "难以", "下降", "低于")
SCALE = 1.6


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def english_hits(text: Column) -> Column:
    """Array of the polarities of known words; one of the three words before a word may turn it over."""
    table, negators = _lookup({**POSITIVE, **NEGATIVE}), F.array(*map(F.lit, NEGATORS))
    # one pass of the expression takes each known word with up to three words before it, whatever the text's length; only these are looked up
    known = "|".join(sorted({**POSITIVE, **NEGATIVE}, key=lambda w: (-len(w), w)))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    at = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(f"^(?:{known})$"), i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.try_element_at(table, F.get(words, i)) * F.when(F.arrays_overlap(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), negators) & (i > 0), -1.0).otherwise(1.0))


def sentiment(text: Column) -> Column:
    """Mean polarity of an English text over SCALE, in [-1, 1]; 0 without known words."""
    hits = english_hits(F.coalesce(text, F.lit("")))
    mean = divide(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x), F.size(hits).cast("double"))
    return F.coalesce(clip(mean / SCALE), F.lit(0.0))


def with_bilingual_sentiment(df: DataFrame, text: str, out: str = "sentiment") -> DataFrame:
    """Like sentiment, with Chinese terms: the longest term at each place counts, turned over by a negator in the two characters before it."""
    schema = df.select("*", F.lit(0.0).cast("double").alias(out)).schema

    def run(batches) -> Iterator:
        import re

        cn = {**POSITIVE_CN, **NEGATIVE_CN}
        en = {**POSITIVE, **NEGATIVE}
        terms = re.compile("|".join(map(re.escape, sorted(cn, key=len, reverse=True))))
        for pdf in batches:
            values = []
            for t in pdf[text].fillna(""):
                hits = [(-1 if any(n in t[max(0, m.start() - 2) : m.start()] for n in NEGATORS_CN) else 1) * cn[m[0]] for m in terms.finditer(t)]
                words = re.findall("[a-z]+", t.lower())
                hits += [(-1 if set(words[max(0, i - 3) : i]) & set(NEGATORS) else 1) * en[w] for i, w in enumerate(words) if w in en]
                values.append(max(-1.0, min(1.0, sum(hits) / len(hits) / SCALE)) if hits else 0.0)
            pdf[out] = values
            yield pdf

    return df.mapInPandas(run, schema)


def sentiment_summary(df: DataFrame, score: str, *by: str) -> DataFrame:
    s = F.col(score)
    return df.groupBy(*by).agg(F.avg(s).alias("mean_sentiment"), F.count(s).alias("n"), F.sum((s > 0.05).cast("long")).alias("n_pos"), F.sum((s < -0.05).cast("long")).alias("n_neg"), F.max(s).alias("max"), F.min(s).alias("min"))


def time_weighted(df: DataFrame, score: str, age_hours: str, half_life: float = 48.0) -> DataFrame:
    """Mean with weights that halve each half-life; a missing age is the median one, a negative one is 0."""
    median = df.agg(F.coalesce(F.percentile(age_hours, F.lit(0.5)), F.lit(0.0)).alias("_m"))
    w = F.pow(F.lit(0.5), F.greatest(F.coalesce(F.col(age_hours), F.col("_m")), F.lit(0.0)) / half_life)
    rows = df.crossJoin(F.broadcast(median)).withColumn("_w", w)
    return rows.agg(divide(F.sum(F.col("_w") * F.col(score)), F.sum("_w")).alias("mean_sentiment"), F.count(score).alias("n"), F.sum("_w").alias("eff_n"))


def clip(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))  # least and greatest skip nulls


def blend(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the parts that are known; 0 if none is."""
    top = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    return F.coalesce(divide(top, bottom), F.lit(0.0))


# Weights of layers of news and of macro readings, and which way a release points for equities.
NEWS_WEIGHTS = {"stock": 0.5, "sector": 0.3, "market": 0.2}
MACRO_WEIGHTS = {"vix": 0.28, "rates": 0.18, "curve": 0.14, "econ": 0.18, "geo": 0.12, "event": 0.10}
INDICATOR_SIGN = {
    "cpi": -1.0, "core_cpi": -1.0, "ppi": -1.0, "pce": -1.0, "nfp": -0.3, "nonfarm": -0.3, "unemployment": -1.0, "gdp": 0.7, "retail_sales": 0.5, "ism": 0.6, "consumer_confidence": 0.4,
}
HIGH_IMPACT = ("cpi", "core_cpi", "ppi", "pce", "core_pce", "nfp", "nonfarm", "payrolls", "fomc", "rate_decision", "fed", "unemployment", "jobs", "gdp", "jackson_hole")


def composite_sentiment(stock: Column, sector: Column, market: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(stock) * 0.5 + zero(sector) * 0.3 + zero(market) * 0.2


def vix_signal(level: Column, median: Column) -> Column:
    base = F.when(level < 14, 0.4).when(level < 18, 0.15).when(level < 22, 0.0).when(level < 28, -0.35).when(level < 35, -0.7).otherwise(-1.0)
    return clip(base * 0.6 + F.tanh((median - level) / F.greatest(median * 0.5, F.lit(1e-6))) * 0.4)


def rates_signal(change: Column) -> Column:
    return clip(-F.tanh(change / 0.5))


def curve_signal(slope: Column) -> Column:
    return clip(F.tanh(slope / 0.5))


def econ_surprise(name: Column, actual: Column, consensus: Column) -> Column:
    """One release's reading; releases are averaged and clipped. NULL where nothing can be said."""
    sign = F.coalesce(F.try_element_at(_lookup(INDICATOR_SIGN), F.replace(F.lower(name), F.lit(" "), F.lit("_"))), F.lit(0.0))
    return sign * F.tanh(divide(actual - consensus, F.abs(consensus)) * 5)


def pre_event_risk(name: Column, days: Column, window: int = 4) -> Column:
    known = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    near = (days >= 0) & (days <= window) & F.greatest(*(known.contains(x) for x in HIGH_IMPACT))
    return F.when(near, (1 - days / (window + 1.0)) * -0.5).otherwise(0.0)


def regime_of(score: Column) -> Column:
    return F.when(score < -0.25, "risk-off").when(score > 0.25, "risk-on").otherwise("neutral")


def expected_move(price: Column, iv: Column, days: Column) -> Column:
    return price * iv * F.sqrt(F.greatest(days, F.lit(0)) / 365.0)


def iv_skew_signal(put_iv: Column, call_iv: Column) -> Column:
    base = (put_iv + call_iv) * 0.5
    return -F.tanh((put_iv - call_iv) / F.when(base != 0, base).otherwise(1e-6) * 4)


def put_call_signal(ratio: Column, contrarian: bool = False) -> Column:
    return F.tanh((ratio - 0.9) / 0.4) * (1.0 if contrarian else -1.0)


def insider_signal(net: Column, cap: Column | None = None) -> Column:
    return F.tanh(divide(net, cap * 0.0005) if cap is not None else net / 5e6)


def short_interest_signal(share: Column, change: Column) -> Column:
    return F.tanh((share - 5) / 8) * -0.6 - F.tanh(change / 3) * 0.4


def northbound_signal(inflow: Column) -> Column:
    return F.tanh(inflow / 50)


def trends_signal(now: Column, mean: Column) -> Column:
    return F.coalesce(F.tanh(divide(now, mean) - 1), F.lit(0.0))


def market_of(symbol: Column) -> Column:
    """Market by the form of a ticker."""
    s = F.upper(F.trim(symbol))
    return (
        F.when(s.rlike(r"\.(KS|KQ)$"), "KR").when(s.rlike(r"\.HK$|^\d{5}$"), "HK").when(s.rlike(r"\.(SS|SZ|SH|BJ)$|^\d{6}$"), "CN").when(s.rlike(r"\.T$|^\d{3}[0-9A-Z]$"), "JP").otherwise("US")
    )


def first_json(text: str) -> str | None:
    """The first balanced JSON object in a text with other words around it."""
    import json

    at = text.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(text[at:])
            return json.dumps(value)
        except ValueError:
            at = text.find("{", at + 1)
    return None
