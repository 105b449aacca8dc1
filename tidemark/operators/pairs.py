"""Two-legged spreads, exits on finer bars, and a test for a unit root."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.windows import Panel, ratio
from tidemark.operators.joins import asof


def hedge_kernel(frame: pd.DataFrame, y: str = "y", x: str = "x", drift: float = 1e-5, noise: float = 1e-3) -> dict[str, np.ndarray]:
    """A Kalman filter of (slope, level) in y = slope * x + level: both, the error before the update and its deviation."""
    ys, xs = K.series(frame, y).to_numpy(), K.series(frame, x).to_numpy()
    state, cov = np.zeros(2), np.eye(2)
    out = np.full((4, len(ys)), np.nan)
    for i, (b, a) in enumerate(zip(ys, xs, strict=True)):
        if math.isnan(a) or math.isnan(b):
            continue
        h = np.array([a, 1.0])
        cov = cov + drift * np.eye(2)
        error, spread = b - h @ state, h @ cov @ h + noise
        gain = cov @ h / spread
        state, cov = state + gain * error, cov - np.outer(gain, h @ cov)
        out[:, i] = state[0], state[1], error, math.sqrt(spread)
    return {"slope": out[0], "level": out[1], "error": out[2], "deviation": out[3]}


def hedge_ratio(pairs: DataFrame, keys=("pair",), order=("ts",), **kw) -> DataFrame:
    """pairs (y, x) with a time-varying hedge ratio and the spread's error and deviation."""
    return K.fold(pairs, dict.fromkeys(("slope", "level", "error", "deviation"), "double"), lambda f: hedge_kernel(f, **kw), keys=keys, order=order)


def spread_positions(frame: pd.DataFrame, enter: float, leave: float) -> dict[str, np.ndarray]:
    """Short the spread over `enter`, long under -enter, until it is back within `leave`."""
    z = K.series(frame, "z")
    flag = lambda c: c.fillna(False).to_numpy(bool)
    return {"position": K.hold(flag(z < -enter), flag(z > enter), flag(z >= -leave), flag(z <= leave))}


def pair_trading(pairs: DataFrame, n: int = 60, enter: float = 2.0, leave: float = 0.5, keys=("pair",), order=("ts",)) -> DataFrame:
    """pairs (y, x) with the spread's z-score, the position in it and the next row's result: one y against `slope` x of the row before."""
    p = Panel(hedge_ratio(pairs, keys, order), keys, order)
    spread = p.let(F.col("y") - F.col("slope") * F.col("x"))
    p.let(ratio(spread - p.mean(spread, n), p.std(spread, n)), "z")
    df = K.fold(p.drop_temporary(), {"position": "double"}, lambda f: spread_positions(f, enter, leave), keys=keys, order=order)
    p = Panel(df, keys, order)
    side, slope = p.lag("position"), p.lag("slope")
    p.let(F.coalesce(side * (p.diff("y") - slope * p.diff("x")), F.lit(0.0)), "pnl")
    return p.drop_temporary()


def fine_exits(fine: DataFrame, coarse: DataFrame, stop: float = 0.02, trail: float = 3.0, atr_n: int = 14, slip_bps: float = 2.0, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Trades of coarse signals that are entered and left on fine bars.

    A signal counts from the coarse bar after its own. The entry is the first fine open of that bar, worse by slippage; the stop is a share of the entry until the first coarse
    close after it, and then follows coarse closes at a distance in ranges, never back. It is touched by a fine low (high) and filled at its level, or at the open
    if that is beyond. There is one entry for each coarse bar.
    """
    p = Panel(coarse, (key,), (ts,))
    tr = p.let(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p.lag("close")), F.abs(F.col("low") - p.lag("close"))))
    p.let(p.mean(tr, atr_n), "_atr")
    p.let(F.lag("signal").over(p.base()), "_signal")
    p.let(F.lag("close").over(p.base()), "_close")
    p.let(F.lag("_atr").over(p.base()), "_range")
    levels = p.df.select(key, ts, F.col(ts).alias("_bar"), "_signal", "_close", "_range")
    joined = asof(fine.select(key, ts, "open", "high", "low", "close"), levels, ts, (key,), ("_bar", "_signal", "_close", "_range"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts, kind="stable").reset_index(drop=True)
        o, h, low, c, close, wide = (K.series(frame, x).to_numpy() for x in ("open", "high", "low", "close", "_close", "_range"))
        bar, signal, when = frame["_bar"].to_numpy(), frame["_signal"].fillna(0).to_numpy(int), frame[ts].to_numpy()
        new = np.concatenate(([True], bar[1:] != bar[:-1])) if len(bar) else np.zeros(0, bool)
        rows, side, entry, level, at = [], 0, 0.0, 0.0, 0
        for i in range(len(o)):
            if side and new[i] and not math.isnan(wide[i]):
                level = side * max(side * level, side * close[i] - trail * wide[i])
            if side and side * (low[i] if side > 0 else h[i]) <= side * level:
                px = o[i] if side * o[i] < side * level else level
                rows.append((when[at], when[i], side, entry, px, "stop"))
                side = 0
            elif not side and new[i] and signal[i] and not pd.isna(bar[i]):
                side, at = int(np.sign(signal[i])), i
                entry = o[i] * (1 + side * slip_bps / 1e4)
                level = entry * (1 - side * stop)
        if side:
            rows.append((when[at], when[-1], side, entry, c[-1], "eod"))
        out = pd.DataFrame(rows, columns=["entry_ts", "exit_ts", "direction", "entry_price", "exit_price", "reason"])
        out["ret"] = out["direction"] * (out["exit_price"] - out["entry_price"]) / out["entry_price"]
        out.insert(0, key, frame[key].iloc[0])
        return out.astype({"direction": "int32", "entry_price": float, "exit_price": float, "ret": float})

    kind = fine.schema[key].dataType.simpleString()
    return joined.groupBy(key).applyInPandas(run, f"{key} {kind}, entry_ts timestamp_ntz, exit_ts timestamp_ntz, direction int, entry_price double, exit_price double, reason string, ret double")


def unit_root(df: DataFrame, x: str, keys=("ticker",), order=("ts",), lags: int = 1) -> dict[tuple, float]:
    """The augmented Dickey-Fuller t statistic (with a constant) of each series, from sums made in Spark. Under about -2.86 a unit root is unlikely at 5 %."""
    p = Panel(df, keys, order)
    step, level = p.diff(x), p.lag(x)
    terms = [F.lit(1.0), level, *[p.lag(step, k) for k in range(1, lags + 1)]]
    known = p.let(sum((t.isNotNull().cast("int") for t in [step, *terms]), F.lit(0)) == len(terms) + 1)
    k = len(terms)
    rows = p.df.filter(known).groupBy(*keys)
    got = rows.agg(*[F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)], *[F.sum(a * step).alias(f"b{i}") for i, a in enumerate(terms)], F.sum(step * step).alias("yy"), F.count("*").alias("n")).collect()
    out = {}
    for r in got:
        cross, moment = np.array(r[len(keys) : len(keys) + k * k], float).reshape(k, k), np.array(r[len(keys) + k * k : len(keys) + k * k + k], float)
        if r.n > k and abs(np.linalg.det(cross)) > 0:
            beta = np.linalg.solve(cross, moment)
            rest = max(r.yy - beta @ moment, 0.0) / (r.n - k)
            error = math.sqrt(rest * np.linalg.inv(cross)[1, 1])
            out[tuple(r[: len(keys)])] = float(beta[1] / error) if error else math.nan
        else:
            out[tuple(r[: len(keys)])] = math.nan
    return out


def margin_call(drawdown, capital: float, leverage: float, threshold: float = 1.0) -> tuple[Column, Column]:
    """(whether what is left is under the margin in use, what is left)."""
    left = F.lit(capital) * (1 - F.col(drawdown))
    return left < threshold * capital / leverage, left


def expected_loss(default, recovery: float = 0.1) -> Column:
    return F.col(default) * (1 - recovery)


def merge_funding(bars: DataFrame, funding: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """bars with the last funding rate at or before each; 0 before the first."""
    return asof(bars, funding, ts, (key,), ("rate",)).withColumn("rate", F.coalesce("rate", F.lit(0.0)))
