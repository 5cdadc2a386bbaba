"""Two libraries of factor formulas."""

# Published formulaic alphas in the terms of this language.
ALPHA101 = {
    "alpha001": "rank(ts_arg_max(signedpower(where(returns < 0, ts_std(returns, 20), close), 2.0), 5)) - 0.5",
    "alpha002": "-1 * ts_corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    "alpha003": "-1 * ts_corr(rank(open), rank(volume), 10)",
    "alpha004": "-1 * ts_rank(rank(low), 9)",
    "alpha005": "rank(open - ts_mean(vwap, 10)) * (-1 * abs(rank(close - vwap)))",
    "alpha006": "-1 * ts_corr(open, volume, 10)",
    "alpha012": "sign(delta(volume, 1)) * (-1 * delta(close, 1))",
    "alpha014": "-1 * rank(delta(returns, 3)) * ts_corr(open, volume, 10)",
    "alpha018": "-1 * rank(ts_std(abs(close - open), 5) + (close - open) + ts_corr(close, open, 10))",
    "alpha022": "-1 * delta(ts_corr(high, volume, 5), 5) * rank(ts_std(close, 20))",
    "alpha023": "where(ts_mean(high, 20) < high, -1 * delta(high, 2), 0)",
    "alpha024": "where(delta(ts_mean(close, 100), 100) / delay(close, 100) <= 0.05, -1 * (close - ts_min(close, 100)), -1 * delta(close, 3))",
    "alpha026": "-1 * ts_max(ts_corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    "alpha028": "scale(ts_corr(ts_mean(volume, 20), low, 5) + (high + low) / 2 - close)",
    "alpha033": "rank(-1 * (1 - open / close))",
    "alpha034": "rank(2 - rank(ts_std(returns, 2) / ts_std(returns, 5)) - rank(delta(close, 1)))",
    "alpha035": "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    "alpha038": "-1 * rank(ts_rank(close, 10)) * rank(close / open)",
    "alpha040": "-1 * rank(ts_std(high, 10)) * ts_corr(high, volume, 10)",
    "alpha041": "power(high * low, 0.5) - vwap",
    "alpha042": "rank(vwap - close) / rank(vwap + close)",
    "alpha043": "ts_rank(volume / ts_mean(volume, 20), 20) * ts_rank(-1 * delta(close, 7), 8)",
    "alpha044": "-1 * ts_corr(high, rank(volume), 5)",
    "alpha045": "-1 * rank(ts_mean(delay(close, 5), 20)) * ts_corr(close, volume, 2) * rank(ts_corr(ts_sum(close, 5), ts_sum(close, 20), 2))",
    "alpha051": "where((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10 < -0.05, 1, -1 * (close - delay(close, 1)))",
    "alpha053": "-1 * delta(((close - low) - (high - close)) / (close - low), 9)",
    "alpha054": "-1 * (low - close) * power(open, 5) / ((low - high) * power(close, 5))",
    "alpha055": "-1 * ts_corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    "alpha060": "-1 * (2 * scale(rank(((close - low) - (high - close)) / (high - low) * volume)) - scale(rank(ts_arg_max(close, 10))))",
    "alpha101": "(close - open) / (high - low + 0.001)",
}

# Families of formulas by name, and the windows {w} of each.
_FAMILIES = {
    "ROC{w}": ("roc(close, {w})", (5, 10, 20, 30, 60)),
    "MA{w}": ("ts_mean(close, {w}) / close", (5, 10, 20, 30, 60)),
    "STD{w}": ("ts_std(close, {w}) / close", (5, 10, 20, 30, 60)),
    "EMA{w}": ("ema(close, {w}) / close", (5, 20)),
    "SLOPE{w}": ("slope(close, {w}) / close", (10, 30, 60)),
    "RSQR{w}": ("rsquare(close, {w})", (10, 30, 60)),
    "RESI{w}": ("resi(close, {w}) / close", (10, 30, 60)),
    "MAX{w}": ("ts_max(high, {w}) / close", (5, 20, 60)),
    "MIN{w}": ("ts_min(low, {w}) / close", (5, 20, 60)),
    "QTLU{w}": ("qtlu({w}) / close", (5, 20, 60)),
    "QTLD{w}": ("qtld({w}) / close", (5, 20, 60)),
    "TSRANK{w}": ("ts_rank(close, {w})", (5, 20, 60)),
    "RSV{w}": ("(close - ts_min(low, {w})) / (ts_max(high, {w}) - ts_min(low, {w}) + 1e-12)", (5, 20, 60)),
    "IMAX{w}": ("ts_arg_max(high, {w}) / {w}", (10, 60)),
    "IMIN{w}": ("ts_arg_min(low, {w}) / {w}", (10, 60)),
    "IMXD{w}": ("(ts_arg_max(high, {w}) - ts_arg_min(low, {w})) / {w}", (10, 60)),
    "CORR{w}": ("ts_corr(close, log(volume + 1), {w})", (5, 20, 60)),
    "CORD{w}": ("ts_corr(close / delay(close, 1), log(volume / delay(volume, 1) + 1), {w})", (5, 20)),
    "CNTP{w}": ("ts_mean(close > delay(close, 1), {w})", (5, 20)),
    "CNTN{w}": ("ts_mean(close < delay(close, 1), {w})", (5, 20)),
    "CNTD{w}": ("ts_mean(close > delay(close, 1), {w}) - ts_mean(close < delay(close, 1), {w})", (20,)),
    "SUMP{w}": ("ts_sum(greater(close - delay(close, 1), 0), {w}) / (ts_sum(abs(close - delay(close, 1)), {w}) + 1e-12)", (5, 20)),
    "VMA{w}": ("ts_mean(volume, {w}) / (volume + 1e-12)", (5, 20, 60)),
    "VSTD{w}": ("ts_std(volume, {w}) / (volume + 1e-12)", (5, 20)),
    "WVMA{w}": ("wvma({w})", (5, 20)),
    "VSUMP{w}": ("ts_sum(greater(volume - delay(volume, 1), 0), {w}) / (ts_sum(abs(volume - delay(volume, 1)), {w}) + 1e-12)", (5, 20)),
}
ALPHA158 = {
    **{k.upper(): k for k in ("kmid", "klen", "kmid2", "kup", "kup2", "klow", "klow2", "ksft", "ksft2")},
    **{f"{f.upper()}0": f"{f} / close" for f in ("open", "high", "low", "vwap")},
    **{name.format(w=w): text.format(w=w) for name, (text, windows) in _FAMILIES.items() for w in windows},
}


def lag_features(length: int = 60) -> dict[str, str]:
    """Six fields at lags 0 to length - 1, prices over the present close and volume over the present volume."""
    out = {}
    for f in ("close", "open", "high", "low", "vwap", "volume"):
        base = "volume" if f == "volume" else "close"
        out |= {f"{f.upper()}{k}": (f"delay({f}, {k}) / {base}" if k else f"{f} / {base}") for k in range(length)}
    return out


def load_factor_library(name: str) -> dict[str, str]:
    found = {"alpha101": ALPHA101, "alpha158": ALPHA158, "alpha360": lag_features()}
    if name.lower() not in found:
        raise KeyError(f"no library {name!r}; there are {', '.join(found)}")
    return dict(found[name.lower()])
