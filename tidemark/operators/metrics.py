"""Performance figures by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, col, correlation, ratio

RISK_FREE = 0.06


def equity(df: DataFrame, ret="ret", keys=("ticker",), order=("ts",)) -> DataFrame:
    """df with the compounded value of its returns, its peak so far and the drawdown from it.

    Values are summed in logs, so drawdowns stay right where the value itself is too large for a double and infinite, as after a million trades. A return of -1 ends in 0,
    and one below turns the sign.
    """
    p = Panel(df, keys, order)
    factor = p.let(1 + col(ret))
    size = p.let(F.sum(F.when(factor != 0, F.log(F.abs(factor)))).over(p.so_far()))
    side = p.let(F.when(F.count_if(factor == 0).over(p.so_far()) > 0, 0.0).otherwise(1.0 - 2 * (F.count_if(factor < 0).over(p.so_far()) % 2)))
    value = p.let(F.when(side == 0, 0.0).otherwise(side * F.exp(size)), "equity")
    top = p.let(F.max(F.when(side > 0, size)).over(p.so_far()))
    peak = p.let(F.max(value).over(p.so_far()), "peak")
    below = F.when(side == 0, -1.0).otherwise(side * F.exp(size - top) - 1)
    p.let(F.when(top.isNotNull(), below).otherwise(ratio(value, peak) - 1), "drawdown")
    return p.drop_temporary()


def trade_stats(trades: DataFrame, keys=("ticker",), ret="ret", entry="entry", exit="exit", order=None) -> DataFrame:
    """Count, win rate, mean, total, Sharpe and Sortino by trades a year, drawdown and profit factor of each group."""
    rows = equity(trades, ret, keys, tuple(order or (exit, entry)))
    r = col(ret)
    g = rows.groupBy(*keys).agg(
        F.count(ret).alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.avg(r).alias("avg_ret"),
        F.stddev_pop(r).alias("_sd"),
        F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum(F.when(r > 0, r)).alias("_won"),
        F.sum(F.when(r < 0, -r)).alias("_lost"),
        (F.datediff(F.max(exit), F.min(entry)) / 365.25).alias("_years"),
    )
    periods = F.when((F.col("_years") > 0) & (F.col("n_trades") > 1), F.col("n_trades") / F.col("_years")).otherwise(252.0)
    g = g.withColumn("_p", periods)
    return g.select(
        *keys,
        "n_trades",
        "win_rate",
        "total_return",
        "avg_ret",
        F.when((F.col("_sd") == 0) | (F.col("n_trades") < 2), 0.0).otherwise(F.sqrt("_p") * (F.col("avg_ret") - RISK_FREE / F.col("_p")) / F.nullif("_sd", F.lit(0.0))).alias("sharpe"),
        F.when((F.col("_down") == 0) | (F.col("n_trades") < 2), 0.0).otherwise(F.sqrt("_p") * F.col("avg_ret") / F.nullif("_down", F.lit(0.0))).alias("sortino"),
        "max_drawdown",
        profit_factor("_won", "_lost").alias("profit_factor"),
    )


def profit_factor(won, lost):
    """Won over lost; 0 with neither, infinite with no loss."""
    won, lost = F.coalesce(col(won), F.lit(0.0)), F.coalesce(col(lost), F.lit(0.0))
    return F.when(lost < 1e-10, F.when(won > 1e-10, F.lit(float("inf"))).otherwise(0.0)).otherwise(won / F.nullif(lost, F.lit(0.0)))


def series_metrics(frame: DataFrame, keys=("ticker",), order=("ts",), least: int = 20) -> DataFrame:
    """The figures of a simulated series (net, held, cost, turnover); all but the count are NULL under `least` rows."""
    ts = order[0]
    rows = equity(frame.filter("net IS NOT NULL"), "net", keys, order)
    p = Panel(rows, keys, order)
    at, run = p.let(p.ordinal(), "_at"), p.runs(p.let(F.signum("held"), "_side"))
    p.let(run, "_run")
    p.let(F.log(F.greatest("equity", F.lit(1e-12))), "_le")
    df = p.df
    per_trade = df.filter("_side <> 0").groupBy(*keys, "_run").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("_tr"), F.count("*").alias("_bars"))
    t = per_trade.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg((F.col("_tr") > 0).cast("double")).alias("win_rate_trades"),
        ratio(F.sum(F.when(F.col("_tr") > 0, F.col("_tr"))), F.sum(F.when(F.col("_tr") < 0, -F.col("_tr")))).alias("profit_factor_trades"), (F.sum("_bars") / F.count("*")).alias("avg_hold_bars"),
    )
    year = df.groupBy(*keys, F.year(ts).alias("_y")).agg((F.product(1 + F.col("net")) - 1).alias("_yr"))
    y = year.groupBy(*keys).agg(F.avg((F.col("_yr") > 0).cast("double")).alias("pct_pos_years"))
    net, active = F.col("net"), F.col("held") != 0
    n = F.col("n_bars")
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n_bars"), (F.datediff(F.max(ts), F.min(ts)) / 365.25).alias("years"), F.max_by("equity", ts).alias("_end"), F.avg(net).alias("_mu"), F.stddev_samp(net).alias("_sd"),
        F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), 2))).alias("_dd"), F.min("drawdown").alias("max_drawdown"), ratio(F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, -net))).alias("profit_factor"),
        F.skewness(net).alias("_g1"), F.avg(active.cast("double")).alias("exposure"), F.avg(F.when(active, (net > 0).cast("double"))).alias("win_rate_days"), F.sum("turnover").alias("_to"), F.sum("cost").alias("_c"), correlation("_at", "_le").alias("_corr"),
    )
    ann = F.when(F.col("years") > 0, n / F.col("years")).otherwise(252.0)
    g = g.join(t, list(keys), "left").join(y, list(keys), "left").withColumn("_ann", ann)
    cagr = F.when((F.col("years") > 0) & (F.col("_end") > 0), F.pow("_end", 1 / F.nullif("years", F.lit(0.0))) - 1)
    out = {
        "cagr": cagr, "total_return": F.col("_end") - 1, "ann_vol": F.col("_sd") * F.sqrt("_ann"),
        "sharpe": F.when(F.col("_sd") > 0, F.col("_mu") / F.nullif("_sd", F.lit(0.0)) * F.sqrt("_ann")).otherwise(0.0), "sortino": F.when(F.col("_dd") > 0, F.col("_mu") / F.nullif("_dd", F.lit(0.0)) * F.sqrt("_ann")).otherwise(0.0),
        "calmar": F.when(F.col("max_drawdown") < 0, cagr / F.abs(F.nullif("max_drawdown", F.lit(0.0)))), "max_drawdown": F.col("max_drawdown"), "win_rate_days": F.col("win_rate_days"), "win_rate_trades": F.col("win_rate_trades"),
        "profit_factor": F.col("profit_factor"), "profit_factor_trades": F.col("profit_factor_trades"), "turnover": ratio("_to", "years"), "cost_drag": ratio("_c", "years"), "exposure": F.col("exposure"), "n_trades": F.coalesce("n_trades", F.lit(0)).cast("double"),
        "avg_hold_bars": F.col("avg_hold_bars"), "stability_r2": F.coalesce(F.pow("_corr", 2) * F.when(F.col("_corr") >= 0, 1.0).otherwise(-1.0), F.lit(0.0)), "pct_pos_years": F.col("pct_pos_years"),
        "skew": F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)), "years": F.col("years"),
    }
    return g.select(*keys, "n_bars", *[F.when(n >= least, v).alias(k) for k, v in out.items()])


def quarterly_hpr(returns: DataFrame, ret="ret", keys=("ticker",), ts="ts") -> DataFrame:
    """Last over first equity of each quarter, less 1; the first period's own return is not in it."""
    rows = equity(returns, ret, keys, (ts,)).withColumn("quarter", F.date_trunc("quarter", ts))
    return rows.groupBy(*keys, "quarter").agg((ratio(F.max_by("equity", ts), F.min_by("equity", ts)) - 1).alias("hpr"))


#: Share of each figure in the composite score; a smaller drawdown is better.
WEIGHTS = {"sharpe": 0.4, "total_return": 0.3, "win_rate": 0.2, "max_drawdown": 0.1}


def rank_and_score(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Figures scaled between their least and largest (0.5 where those are equal) and added by weight. For tables of results: the range is global."""
    weights = weights or WEIGHTS
    ends = table.agg(*[F.struct(F.min(k).alias("a"), F.max(k).alias("b")).alias(f"_{k}") for k in weights])
    df = table.join(F.broadcast(ends))  # one row
    score = None
    for k, w in weights.items():
        a, b = F.col(f"_{k}.a"), F.col(f"_{k}.b")
        unit = F.when(b == a, 0.5).otherwise((F.col(k) - a) / F.nullif(b - a, F.lit(0.0)))
        unit = F.when(b == a, 0.5).otherwise(1 - unit) if k == "max_drawdown" else unit
        score = w * unit if score is None else score + w * unit
    return df.withColumn("composite_score", score).drop(*[f"_{k}" for k in weights])


def pivot_month(df: DataFrame, value: str, ts: str = "ts", key: str | None = None) -> DataFrame:
    """Sums by year, a column for each month."""
    keys = [key] if key else []
    wide = df.groupBy(*keys, F.year(ts).alias("year")).pivot("_m", list(range(1, 13))) if "_m" in df.columns else df.withColumn("_m", F.month(ts)).groupBy(*keys, F.year(ts).alias("year")).pivot("_m", list(range(1, 13)))
    out = wide.agg(F.sum(value))
    return out.select(*keys, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def quantile_bins(df: DataFrame, x: str, value: str, n: int = 10) -> DataFrame:
    """Mean of a value by bins between quantiles, right-closed; the least value is in the first."""
    shares = F.array(*[F.lit(k / n) for k in range(n + 1)])
    edges = df.agg(F.percentile(x, shares).alias("_e"))
    own = df.join(F.broadcast(edges))  # one row
    bin_ = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(x))) - 1, F.lit(0))
    return own.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def top_k(df: DataFrame, keys, order, k: int) -> DataFrame:
    """The first k rows of each group by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def pair_correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every two columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(*[correlation(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("corr")) for a, b in pairs])).alias("r")).select("r.*")
