"""Whole runs: a strategy grid over a universe, and the position overlay over folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from importlib import import_module
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import backtest, metrics, portfolio
from tidemark.operators.positions import simulate
from tidemark.operators.rules import RULES, positions

SignalFn = Callable[..., DataFrame]


def bind(name: str) -> SignalFn:
    """A signal function by its dotted name."""
    module, _, function = name.rpartition(".")
    return getattr(import_module(module), function)


def _sets(grid: dict[str, list]) -> list[tuple[str, dict]]:
    """(param_id, parameters) of every combination."""
    return [(",".join(f"{k}={v}" for k, v in zip(grid, values, strict=True)), dict(zip(grid, values, strict=True))) for values in product(*grid.values())]


def signal_grid(bars: DataFrame, signal: SignalFn | str, grid: dict[str, list]) -> DataFrame:
    """bars with signals for every combination of parameters, told apart by param_id.

    A signal function with a kernel runs all combinations in one pass over each series. Of others each combination is a branch of one plan.
    """
    fn, sets = bind(signal) if isinstance(signal, str) else signal, _sets(grid)
    kernel = getattr(fn, "kernel", None)
    if kernel is None:
        return reduce(DataFrame.unionByName, [fn(bars, **params).withColumn("param_id", F.lit(name)) for name, params in sets])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        return pd.concat([frame.assign(signal=np.nan_to_num(np.asarray(kernel(frame, **params), float)).astype("int32"), param_id=name) for name, params in sets])

    schema = T.StructType([*bars.schema.fields, T.StructField("signal", T.IntegerType()), T.StructField("param_id", T.StringType())])
    return bars.groupBy("ticker").applyInPandas(run, schema)


def run_grid(bars: DataFrame, signal: SignalFn | str, grid: dict[str, list], stops=backtest.STOP_GRID, spread: int = 1) -> DataFrame:
    """Trades of every ticker, parameter set and stop; the signal is made once for all stops.

    With a kernel the whole grid of a ticker is one pass, and only trades leave it: one scan and one shuffle however large the grid is. `spread` deals the
    combinations of a ticker to so many tasks, for grids that are large against the number of tickers.
    """
    fn = bind(signal) if isinstance(signal, str) else signal
    if getattr(fn, "kernel", None) is None:
        return backtest.backtest_grid(signal_grid(bars, fn, grid), stops=stops)
    sets, kernel = _sets(grid), fn.kernel
    dealt = bars.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(spread, len(sets)) - 1)))) if spread > 1 else bars.withColumn("_part", F.lit(0))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        parts = []
        for name, params in sets[int(frame["_part"].iloc[0]) :: max(spread, 1)]:
            own = frame.assign(signal=np.nan_to_num(np.asarray(kernel(frame, **params), float)).astype("int32"))
            parts += [backtest.trades_of(own, s, t).assign(ticker=frame["ticker"].iloc[0], param_id=name, stop_mult=float(s), target_mult=float(t)) for s, t in stops]
        return pd.concat(parts)[["ticker", "param_id", "stop_mult", "target_mult", *names]]

    names = [c.split()[0] for c in backtest.TRADES.split(", ")]
    kind = bars.schema["ticker"].dataType.simpleString()
    return dealt.groupBy("ticker", "_part").applyInPandas(run, f"ticker {kind}, param_id string, stop_mult double, target_mult double, {backtest.TRADES}")


def resume(grid: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], key: str = "param_id") -> DataFrame:
    """All results of a grid: those that the table at `path` has, and the others, made by `run` and added to it. A run that was cut off goes on where it was."""
    from tidemark.operators.joins import missing_work

    spark = grid.sparkSession
    missing = missing_work(grid, spark.read.parquet(path), [key])
    run(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def gated(signals: DataFrame, regime: bool = False, volume: bool = False, market: DataFrame | None = None, signal: str = "signal") -> DataFrame:
    """Signals that pass the gates asked for: a strong trend, money flow on their side, and times that `market` (ts, open) has as open; other times count as shut."""
    from tidemark.functions.windows import Panel, true
    from tidemark.operators.signals import regime_filter, volume_filter

    p, x = Panel(signals), F.col(signal)
    if regime:
        x = regime_filter(p, x)
    if volume:
        x = volume_filter(p, x)
    p.let(x, "_gated")
    df = p.drop_temporary() if "_gated" in p.df.columns else p.df
    if market is not None:
        df = df.join(market.select("ts", F.col("open").alias("_open")), "ts", "left").withColumn("_gated", F.when(true(F.col("_open")), F.col("_gated")).otherwise(0)).drop("_open")
    return df.withColumn(signal, F.col("_gated").cast("int")).drop("_gated")


def walk_forward(bars: DataFrame, signal: SignalFn | str, grid: dict[str, list], splits: int = 5, objective: str = "sharpe", stop: float = 1.5, target: float = 3.0) -> DataFrame:
    """The best parameters of each split by an objective, and their figures in the next split."""
    parts = portfolio.chronological_split(bars, splits).withColumn("series", F.concat_ws("|", "ticker", F.col("split").cast("string")))
    own = signal_grid(parts.withColumn("_t", F.col("ticker")).withColumn("ticker", F.col("series")), signal, grid)
    book = backtest.backtest_grid(own, by=("ticker", "param_id"), stops=((stop, target),))
    stats = metrics.trade_stats(book, ("ticker", "param_id"), entry="entry_ts", exit="exit_ts")
    cut = stats.withColumns({"split": F.element_at(F.split("ticker", r"\|"), -1).cast("int"), "ticker": F.regexp_replace("ticker", r"\|\d+$", "")})
    return portfolio.walk_forward(cut, objective=objective)


def evaluate_rules(bars: DataFrame, rules: list[str] | None = None, execution: str = "next_open", bps: float = 7.0) -> DataFrame:
    """The figures of each rule on each instrument: positions in one pass, then one simulation over (rule, instrument) series."""
    rules = rules or list(RULES)
    wide = positions(bars, rules)
    long = wide.unpivot(["ticker", "ts", "open", "close"], rules, "rule", "position")
    return metrics.series_metrics(simulate(long, execution=execution, bps=bps, keys=("rule", "ticker")), ("rule", "ticker"))


def overlay(bars: DataFrame, rule: str, fold_list: list[dict], model: str = "logreg", horizon: int = 20, embargo: int = 2, threshold: float = 0.5, stride: int = 5, most: int = 150_000, seed: int = 0) -> DataFrame:
    """Out-of-sample positions of a rule, gated by a model of trending regimes that is fitted anew for each fold on labels known before its validation.

    One row per bar of the test years: base and gated position, and the score.
    """
    from tidemark.functions.windows import Panel
    from tidemark.operators import overlay as ml
    from tidemark.operators.features import NAMES, features
    from tidemark.operators.positions import gate_stage

    p = Panel(positions(bars, [rule]))
    p.let(ml.regime_label(p, horizon), "er_ahead")
    p.let(ml.label_date(p, horizon, embargo), "label_date")
    df = p.drop_temporary().join(features(bars), ["ticker", "ts"])
    df = df.filter(ml.live_share(df, NAMES) > 0.8).persist()
    parts = []
    for f in fold_list:
        train = ml.subsample(ml.train_rows(df.filter("er_ahead IS NOT NULL"), f), ("ticker",), ("ts",), stride, most, seed)
        middle = train.agg(F.percentile("er_ahead", 0.5)).first()[0]
        train = train.withColumn("y", (F.col("er_ahead") > middle).cast("int"))
        test = df.filter((F.col("ts") >= F.lit(f["test_start"]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(f["test_end"]).cast("timestamp_ntz")))
        (scored,) = ml.fit_predict(model, train, [test], NAMES, seed=seed)
        parts.append(scored.select("ticker", "ts", F.lit(f["label"]).alias("fold"), F.col(rule).alias("base"), "q", gate_stage(rule, "q", threshold).alias("gated")))
    return reduce(DataFrame.unionByName, parts)
