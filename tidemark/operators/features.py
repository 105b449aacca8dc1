"""The 56 scale-free features of a bar: window expressions in Catalyst, recursive lines from one pass over each series."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import kernels as K
from tidemark.functions.windows import Panel, finite, log, ratio

#: Names by family, in the order of the result.
FAMILIES = {
    "momentum": ("mom_5", "mom_21", "mom_63", "mom_126", "mom_252", "mom_252_21", "tsi", "kst"),
    "volatility": ("vol_20", "vol_ratio", "vol_of_vol", "parkinson_ratio", "gk_ratio", "rs_ratio", "yz_ratio", "atr_pct", "bb_width"),
    "trend_strength": ("adx", "er_10", "er_63", "chop", "lr_tstat_63", "lr_r2_63", "lr_r2_126"),
    "trend_direction": ("di_diff", "aroon_osc", "macd_hist", "macd_line", "trix", "vortex_diff", "dist_sma50", "dist_sma200", "sma50_200", "ichimoku_dist", "psar_dist", "supertrend_dist", "kama_dist", "hma_slope"),
    "oscillator": ("rsi", "stoch_k", "cci"),
    "channel": ("bb_pctb", "donch_pos_20", "donch_pos_55", "keltner_pos"),
    "serial_dependence": ("var_ratio_5", "autocorr_1"),
    "distribution": ("skew_63", "kurt_63"),
    "drawdown": ("dd_252", "days_since_high", "ulcer_14"),
    "volume": ("vol_z", "obv_slope", "cmf", "mfi"),
}
NAMES = [n for names in FAMILIES.values() for n in names]
LIMIT = 20.0
_LINES = ("dvol", "atr", "pdi", "mdi", "adx_", "rsi_", "macd_", "hist", "trix_", "tsi_", "sar", "st", "kama_", "kel_mid", "kel_up")


def _lines(f: pd.DataFrame) -> dict:
    c = K.series(f, "close")
    plus, minus, adx = K.dmi(f, 14)
    line, _, hist = K.macd(c)
    mid, up, _ = K.keltner(f, 20, 10, 2)
    values = (K.ew_std(_log(c).diff(), 60, 20), K.atr(f, 14), plus, minus, adx, K.rsi(c, 14), line, hist, _z(K.trix(c, 15)), K.tsi(c), K.psar(f)[0], K.supertrend(f, 10, 3)[1], K.kama(c, 10, 2, 30), mid, up)
    return {f"_{n}": v for n, v in zip(_LINES, values, strict=True)}


def _z(x: pd.Series, n: int = 252, least: int = 60) -> pd.Series:
    w = x.rolling(n, min_periods=least)
    return K.over(x - w.mean(), w.std())


def _log(x: pd.Series) -> pd.Series:
    import numpy as np

    return np.log(x.where(x > 0))


def features(bars: DataFrame, keys=("ticker",), order=("ts",), annual: int = 252) -> DataFrame:
    """Keys, order and NAMES as floats, each within LIMIT of 0 and NULL where it isn't known."""
    p = Panel(bars, keys, order)
    c, dvol, atr = F.col("close"), F.col("_dvol"), F.nullif(F.col("_atr"), F.lit(0.0))
    lc = p.let(log("close"))
    lr = p.diff(lc)
    per = lambda x, n: ratio(x, dvol * math.sqrt(n))
    f = {f"mom_{n}": per(p.diff(lc, n), n) for n in (5, 21, 63, 126, 252)}
    f["mom_252_21"] = per(p.lag(lc, 21) - p.lag(lc, 252), 231)
    rv = I.realized_vol(p, "close", 20, annual)
    f |= {"vol_20": rv, "vol_ratio": ratio(rv, I.realized_vol(p, "close", 120, annual)), "vol_of_vol": ratio(p.std(rv, 60), p.mean(rv, 60))}
    f |= {f"{n}_ratio": ratio(v(p, 20, annual), rv) for n, v in (("parkinson", I.parkinson_vol), ("gk", I.garman_klass_vol), ("rs", I.rogers_satchell_vol), ("yz", I.yang_zhang_vol))}
    f |= {"atr_pct": ratio(atr, c), "adx": F.col("_adx_") / 100, "di_diff": ratio(F.col("_pdi") - F.col("_mdi"), F.col("_pdi") + F.col("_mdi"))}
    up, down = I.aroon(p, 25)
    f |= {"aroon_osc": (up - down) / 100, "rsi": F.col("_rsi_") / 100 - 0.5, "macd_hist": ratio("_hist", atr), "macd_line": ratio("_macd_", atr), "stoch_k": I.stochastic(p, 14)[0] / 100 - 0.5, "cci": I.cci(p, 20) / 100, "trix": F.col("_trix_")}
    vip, vim = I.vortex(p, 14)
    f |= {"vortex_diff": vip - vim, "er_10": I.efficiency_ratio(p, "close", 10), "er_63": I.efficiency_ratio(p, "close", 63), "chop": I.choppiness(p, 14) / 100}
    _, r2, t = I.linreg(p, lc, 63)
    f |= {"lr_tstat_63": t / 10, "lr_r2_63": r2, "lr_r2_126": I.linreg(p, lc, 126)[1]}
    s50, s200 = I.sma(p, "close", 50), I.sma(p, "close", 200)
    f |= {"dist_sma50": ratio(c - s50, atr), "dist_sma200": ratio(c - s200, atr), "sma50_200": per(ratio(s50, s200) - 1, 150)}
    mid, top, bottom = I.bollinger(p, "close", 20, 2)
    width = p.let(ratio(top - bottom, mid))
    f |= {"bb_pctb": ratio(c - bottom, top - bottom) - 0.5, "bb_width": ratio(width, p.median(width, 252, 60))}
    for n in (20, 55):
        hi, lo = p.high("high", n), p.low("low", n)
        f[f"donch_pos_{n}"] = ratio(c - lo, hi - lo) - 0.5
    _, _, a, b = I.ichimoku(p)
    f |= {"keltner_pos": ratio(c - F.col("_kel_mid"), F.col("_kel_up") - F.col("_kel_mid")), "ichimoku_dist": ratio(c - (a + b) / 2, atr)}
    f |= {"psar_dist": ratio(c - F.col("_sar"), atr), "supertrend_dist": ratio(c - F.col("_st"), atr), "kama_dist": ratio(c - F.col("_kama_"), atr), "hma_slope": ratio(p.diff(I.hma(p, "close", 55), 5), atr), "tsi": F.col("_tsi_") / 100}
    k, trail = I.kst(p)
    f["kst"] = I.rolling_z(p, p.let(k - trail))
    skew, kurt = I.skew_kurt(p, lr, 63)
    f |= {"var_ratio_5": I.variance_ratio(p, 5, 126), "autocorr_1": I.autocorr(p, lr, 63), "skew_63": skew, "kurt_63": kurt / 10}
    f |= {"dd_252": per(I.drawdown(p), 252), "days_since_high": p.since_extreme("close", 252, least=60) / 252, "ulcer_14": ratio(I.ulcer(p), 100 * dvol * math.sqrt(14))}
    traded = p.let(F.coalesce(p.total("volume", 60, 1), F.lit(0.0)) > 0)
    lv, obv = p.let(F.log1p(F.col("volume").cast("double"))), I.obv(p)
    of_volume = {"vol_z": ratio(lv - p.mean(lv, 20), p.std(lv, 20)), "obv_slope": ratio(p.diff(obv, 20), p.total("volume", 20)), "cmf": I.cmf(p, 20), "mfi": I.mfi(p, 14) / 100 - 0.5}
    f |= {n: F.when(traded, v).otherwise(0.0) for n, v in of_volume.items()}
    # everything windowed is staged by now; the pass comes last, and what needs its lines is said row by row
    f = {n: p.let(v, f"_x_{n}") if not any(f"_{x}" in str(v) for x in _LINES) else v for n, v in f.items()}
    needed = sorted({m for v in f.values() for m in re.findall(r"_w\d+_|_x_\w+", str(v))})
    df = K.fold(p.df.select(*bars.columns, *needed), {f"_{n}": "double" for n in _LINES}, _lines, keys=keys, order=order)
    df = df.withColumns({f"_{n}": finite(f"_{n}") for n in _LINES})
    bounded = {n: F.greatest(F.least(finite(f[n]), F.lit(LIMIT)), F.lit(-LIMIT)) for n in NAMES}
    # greatest and least pass over what is missing, so that is said apart
    return df.select(*keys, *order, *[F.when(finite(f[n]).isNotNull(), bounded[n]).cast("float").alias(n) for n in NAMES])


def returns(bars: DataFrame) -> DataFrame:
    """bars with plain and log returns."""
    p = Panel(bars)
    p.let(p.change("close"), "ret")
    p.let(I.log_return(p), "log_ret")
    return p.drop_temporary()


def rolling(bars: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """bars with means and deviations of the close."""
    p = Panel(bars)
    for n in windows:
        p.let(p.mean("close", n), f"mean_{n}")
        p.let(p.std("close", n), f"std_{n}")
    return p.drop_temporary()


def lags(bars: DataFrame, x: str = "close", ks=(1, 2, 3)) -> DataFrame:
    """bars with earlier values."""
    p = Panel(bars)
    for k in ks:
        p.let(p.lag(x, k), f"{x}_lag_{k}")
    return p.drop_temporary()


def cyclical_time(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """bars with the hour and the weekday (Monday 0) on circles."""
    h, d = F.hour(ts) * (2 * math.pi / 24), F.weekday(F.col(ts)) * (2 * math.pi / 7)
    return bars.withColumns({"hour_sin": F.sin(h), "hour_cos": F.cos(h), "weekday_sin": F.sin(d), "weekday_cos": F.cos(d)})


def microstructure(bars: DataFrame) -> DataFrame:
    """bars with range and body shares and the change of volume against its instrument's mean; 0 where unknown."""
    p = Panel(bars)
    mean = F.avg("volume").over(Window.partitionBy(*p.keys))
    out = {"range_pct": ratio(F.col("high") - F.col("low"), "close"), "body_pct": ratio(F.col("close") - F.col("open"), "open"), "volume_change": p.change("volume"), "volume_ratio": ratio("volume", mean)}
    for n, v in out.items():
        p.let(F.coalesce(finite(v), F.lit(0.0)), n)
    return p.drop_temporary()
