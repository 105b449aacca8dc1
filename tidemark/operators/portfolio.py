"""Sleeves of daily returns, their combination, and walk-forward choices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import RISK_FREE


#: Rows of a dimension that may be broadcast.
LIMIT = 100_000


def daily_returns(trades: DataFrame, by=("sleeve",), exit="exit_ts", ret="ret") -> DataFrame:
    """The mean return of the trades that end on each day."""
    return trades.groupBy(*by, F.to_date(exit).alias("date")).agg(F.avg(ret).alias("ret"))


def fit_eval(daily: DataFrame, share: float = 0.7) -> DataFrame:
    """daily with a column `part`: fit for the first share of all dates, eval for the rest."""
    dates = daily.select("date").distinct()
    w = Window.orderBy("date")
    cut = dates.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    part = cut.select("date", F.when(F.col("_i") < F.floor(F.col("_n") * share), "fit").otherwise("eval").alias("part"))
    return daily.join(part, "date")


def sleeve_moments(daily: DataFrame, sleeves: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariances, days) of sleeves over all dates that any has; a day without is 0. One aggregation of pairs by date: only sums leave Spark."""
    own = daily.filter(F.col("sleeve").isin(sleeves)).groupBy("date", "sleeve").agg(F.coalesce(F.sum("ret"), F.lit(0.0)).alias("ret"))
    # a sleeve without a name, of 1 on each date: its sums with others are their totals, with itself the days
    own = own.unionByName(daily.select("date").distinct().select("date", F.lit(None).cast("string").alias("sleeve"), F.lit(1.0).alias("ret")))
    pairs = own.select("date", F.col("sleeve").alias("a"), F.col("ret").alias("x")).join(own.select("date", F.col("sleeve").alias("b"), F.col("ret").alias("y")), "date")
    sums = {(r.a, r.b): r.xy for r in pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy")).collect()}
    n = int(sums.get((None, None), 0))
    mean = np.array([sums.get((s, None), 0.0) for s in sleeves]) / (n or np.nan)
    both = np.array([sums.get((a, b), 0.0) for a in sleeves for b in sleeves]).reshape(len(sleeves), len(sleeves))
    return mean, (both - n * np.outer(mean, mean)) / (n - 1 if n > 1 else np.nan), n


def weights(mean: np.ndarray, cov: np.ndarray, mode: str = "tangency", risk_free: float = RISK_FREE / 252) -> np.ndarray:
    """Shares that add up to 1: tangency (none short: the worst is dropped until none is), equal_weight, or inverse_vol (also equal_risk)."""
    k = len(mean)
    if mode == "equal_weight":
        raw = np.ones(k)
    elif mode in ("inverse_vol", "equal_risk"):
        sd = np.sqrt(np.diag(cov))
        raw = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    elif mode == "tangency":
        raw, active = np.zeros(k), list(range(k))
        excess = mean - risk_free
        while active:
            own = cov[np.ix_(active, active)]
            try:
                w = np.linalg.solve(own, excess[active])
            except np.linalg.LinAlgError:
                var = np.diag(own)
                w = np.where(var > 0, excess[active] / np.where(var > 0, var, 1), 0.0)
            if (w >= 0).all():
                raw[active] = w
                break
            active.pop(int(w.argmin()))
        if raw.sum() <= 0:
            raise ValueError("no sleeve earns more than the risk-free rate")
    else:
        raise ValueError(f"unknown mode {mode}")
    return raw / raw.sum()


def combine(daily: DataFrame, shares: dict[str, float], target_vol: float | None = None) -> DataFrame:
    """(date, ret) of the weighted sleeves, scaled to a volatility if given."""
    share = F.coalesce(*[F.when(F.col("sleeve") == s, F.lit(float(w))) for s, w in shares.items()], F.lit(0.0))
    out = daily.groupBy("date").agg(F.sum(F.col("ret") * share).alias("ret"))
    if target_vol is None:
        return out
    sd = out.agg(F.stddev_pop("ret")).first()[0]
    return out.withColumn("ret", F.col("ret") * (target_vol / sd)) if sd and sd > 1e-12 else out


def portfolio_metrics(daily: DataFrame, periods: int = 252) -> DataFrame:
    """Sharpe, CAGR, drawdown, Calmar (infinite without a drawdown), volatility and days of one daily series."""
    from tidemark.operators.metrics import equity

    rows = equity(daily.withColumn("_one", F.lit(1)), "ret", ("_one",), ("date",))
    g = rows.agg(F.count("ret").alias("n_days"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.max_by("equity", "date").alias("e"), F.min("drawdown").alias("max_drawdown"))
    cagr = F.pow("e", periods / F.col("n_days")) - 1
    return g.select(
        F.when((F.col("s") == 0) | (F.col("n_days") < 2), 0.0).otherwise((F.col("m") - RISK_FREE / periods) / F.nullif("s", F.lit(0.0)) * math.sqrt(periods)).alias("sharpe"),
        cagr.alias("cagr"), "max_drawdown", F.when(F.col("max_drawdown") < 0, cagr / F.abs(F.nullif("max_drawdown", F.lit(0.0)))).when(cagr != 0, F.signum(cagr) * float("inf")).otherwise(0.0).alias("calmar"), (F.col("s") * math.sqrt(periods)).alias("annual_vol"), "n_days",
    )


def chronological_split(df: DataFrame, n: int, keys=("ticker",), order=("ts",), out: str = "split") -> DataFrame:
    """df with a split number: equal parts in time order; the rows that are left over at the end go."""
    w = Window.partitionBy(*keys)
    i, size = F.row_number().over(w.orderBy(*order)) - 1, F.floor(F.count("*").over(w) / n)
    return df.withColumns({"_i": i, "_size": size}).withColumn(out, F.floor(F.col("_i") / F.nullif("_size", F.lit(0))).cast("int")).filter(F.col(out) < n).drop("_i", "_size")


def best_in_sample(scores: DataFrame, by, objective: str = "sharpe", tie: str = "param_id") -> DataFrame:
    """The best row of each group; the first in order of a tie-breaker."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(objective), tie)
    return scores.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def finalists(scores: DataFrame, by, least: int = 10, objective: str = "mean", count: str = "n", tie: str = "param_id") -> DataFrame:
    """The best parameters of each group among those with enough trades; the first in order of a tie-breaker."""
    return best_in_sample(scores.filter(F.col(count) >= least), by, objective, tie)


def walk_forward(scores: DataFrame, by=("ticker",), split: str = "split", objective: str = "sharpe", param: str = "param_id") -> DataFrame:
    """For each split the best parameters of it, and their figures in the next. scores: one row per group, split and parameters."""
    figures = [c for c in scores.columns if c not in {*by, split, param}]
    best = best_in_sample(scores, [*by, split], objective, param).select(*by, F.col(split).alias("fold"), param)
    after = scores.select(*by, (F.col(split) - 1).alias("fold"), param, *[F.col(c).alias(f"oos_{c}") for c in figures])
    return best.join(after, [*by, "fold", param])


def folds(first: int, last: int, val_years: int = 2, every: int = 1, kind: str = "wf_expanding", train_years: int = 8, until: str | None = None) -> list[dict]:
    """Train, validation and test dates: expanding or rolling training, or one hold-out that ends at `until`."""
    day = lambda y: f"{y:04d}-01-01"
    if kind == "holdout":
        return [{"train_start": None, "val_start": day(first - val_years), "test_start": day(first), "test_end": until or day(last + 1), "label": f"{first}-end"}]
    out = []
    for y in range(first, last + 1, every):
        if until and day(y) > until:
            break
        end = min(day(y + every), until) if until else day(y + every)
        out.append({"train_start": day(y - val_years - train_years) if kind == "wf_rolling" else None, "val_start": day(y - val_years), "test_start": day(y), "test_end": end, "label": str(y)})
    return out


def month_folds(start: str, months: int, train: int, test: int, anchored: bool = False):
    """SQL-ready (fold, train_start, train_end, test_end) rows by months."""
    import pandas as pd

    t0, out, k = pd.Timestamp(start), [], 0
    while train + (k + 1) * test <= months:
        a = t0 if anchored else t0 + pd.DateOffset(months=k * test)
        b = t0 + pd.DateOffset(months=train + k * test)
        out.append((k, a.date(), b.date(), (b + pd.DateOffset(months=test)).date()))
        k += 1
    return out


def rebalance(book: DataFrame, periods: DataFrame, by=("ticker",), exit="exit_ts", ret="ret") -> DataFrame:
    """For each period the instruments whose score from strictly earlier trades is at or over the median. periods: (period, start)."""
    few = periods.limit(LIMIT + 1).count() <= LIMIT
    past = book.join(F.broadcast(periods) if few else periods, F.col(exit) < F.col("start"))
    score = past.groupBy("period", *by).agg((F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    mid = score.groupBy("period").agg(F.percentile("score", 0.5).alias("mid"))
    return score.join(mid, "period").filter("score >= mid").drop("mid")
