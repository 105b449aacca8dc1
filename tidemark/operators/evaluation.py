"""A strategy's configurations compared with its base at several levels, over one simulated table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, col, correlation, ratio
from tidemark.operators.metrics import equity
from tidemark.operators.positions import simulate

FIGURES = ("n", "mean", "vol", "sharpe", "total_return", "max_drawdown")


def with_levels(returns: DataFrame, periods: dict[str, tuple[str, str]] | None = None, group: str = "market", key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Each row once for every level that it counts in: the whole portfolio, its market, its instrument, and the named periods that hold its time."""
    at = F.col(ts)
    levels = [("portfolio", F.lit("ALL")), ("market", F.col(group)), ("instrument", F.col(key))]
    inside = [F.when((at >= F.lit(a).cast("timestamp_ntz")) & (at < F.lit(b).cast("timestamp_ntz")), F.struct(F.lit("subperiod").alias("level"), F.lit(n).alias("part"))) for n, (a, b) in (periods or {}).items()]
    each = F.array_compact(F.array(*[F.struct(F.lit(n).alias("level"), v.cast("string").alias("part")) for n, v in levels], *inside))
    return returns.withColumn("_l", F.explode(each)).select("*", "_l.level", "_l.part").drop("_l")


def pooled(rows: DataFrame, by=("config", "level", "part"), ts: str = "ts", net: str = "net", key: str = "ticker") -> DataFrame:
    """One return a time: the sum over instruments divided by how many there are then."""
    return rows.groupBy(*by, ts).agg((F.sum(net) / F.count_distinct(key)).alias("ret"))


def figures(series: DataFrame, by=("config", "level", "part"), ts: str = "ts", annual: float = 252.0) -> DataFrame:
    """Count, mean, volatility, Sharpe ratio, total return and drawdown of each series."""
    g = equity(series, "ret", by, (ts,)).groupBy(*by).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
    )
    return g.withColumn("sharpe", F.coalesce(ratio("mean", "vol") * math.sqrt(annual), F.lit(0.0))).select(*by, *FIGURES)


def against_base(table: DataFrame, base: str = "base", on=("level", "part"), config: str = "config", compared=("sharpe", "total_return", "max_drawdown")) -> DataFrame:
    """table with the differences of some figures to those of the base configuration at the same level."""
    own = table.filter(F.col(config) == base).select(*on, *[F.col(c).alias(f"_{c}") for c in compared])
    return table.join(own, list(on), "left").select(*table.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in compared])


def evaluate(returns: DataFrame, periods: dict[str, tuple[str, str]] | None = None, base: str = "base", annual: float = 252.0) -> DataFrame:
    """Figures and differences to the base of every configuration at every level. returns: config, market, ticker, ts, net."""
    return against_base(figures(pooled(with_levels(returns, periods)), annual=annual), base)


def sensitivity(bars: DataFrame, position: str = "position", mechanisms=(("next_open", 0.0), ("next_open", 7.0), ("next_open", 21.0), ("next_close", 7.0), ("same_close", 7.0))) -> DataFrame:
    """(config, market, ticker, ts, net) of one position under several executions and costs, the first of them as told by its name."""
    df, nets = bars, []
    for i, how in enumerate(dict.fromkeys(how for how, _ in mechanisms)):  # all in one pass over the bars
        df = simulate(df, position, execution=how, bps=0.0).withColumnsRenamed({"gross": f"_g{i}", "turnover": f"_t{i}"}).drop("held", "cost", "net")
        nets += [F.struct(F.lit(f"{how}|{bps:g}").alias("config"), (F.col(f"_g{i}") - F.col(f"_t{i}") * float(bps) / 1e4).alias("net")) for which, bps in mechanisms if which == how]
    return df.select("ticker", "ts", F.explode(F.array(*nets)).alias("_r")).select("_r.config", "ticker", "ts", "_r.net")


def agreement(a: DataFrame, b: DataFrame, x: str = "close", on=("ticker", "ts"), annual: float = 252.0) -> DataFrame:
    """How well two sources of the same instruments agree: rows in common, correlation and annual tracking error of their returns, and the correlation of weekly returns."""
    key, ts = on
    both = a.select(*on, F.col(x).alias("_x")).join(b.select(*on, F.col(x).alias("_y")), list(on))
    weekly = both.groupBy(key, F.date_trunc("week", ts).alias(ts)).agg(F.max_by("_x", ts).alias("_x"), F.max_by("_y", ts).alias("_y"))

    def moved(df: DataFrame) -> DataFrame:
        p = Panel(df, (key,), (ts,))
        p.let(p.change("_x"), "rx")
        p.let(p.change("_y"), "ry")
        return p.drop_temporary().filter("rx IS NOT NULL AND ry IS NOT NULL")

    day = moved(both).groupBy(key).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("corr"), (F.stddev_samp(F.col("rx") - F.col("ry")) * math.sqrt(annual)).alias("tracking_error"))
    return day.join(moved(weekly).groupBy(key).agg(correlation("rx", "ry").alias("weekly_corr")), key, "left")


def overlap(book: DataFrame, key: str = "ticker", entry: str = "entry_ts") -> DataFrame:
    """(a, b, shared): times at which trades of both instruments begin."""
    own = book.select(F.col(key).alias("k"), F.col(entry).alias("t")).distinct()
    return own.withColumnRenamed("k", "a").join(own.withColumnRenamed("k", "b"), "t").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def with_benchmark(daily: DataFrame, market: DataFrame, ts: str = "ts", close: str = "close") -> DataFrame:
    """(date, ret, benchmark, excess): a daily series beside the return from one day's last close to the next's."""
    last = market.groupBy(F.to_date(ts).alias("date")).agg(F.max_by(close, ts).alias("c")).withColumn("_one", F.lit(1))
    p = Panel(last, ("_one",), ("date",))  # one row a day
    own = p.select(benchmark=p.change("c")).select("date", "benchmark")
    return daily.join(own, "date").select("date", "ret", "benchmark", (F.col("ret") - F.col("benchmark")).alias("excess"))


def shuffled(scores: DataFrame, score: str, keys=("ticker",), order=("ts",), seed: int = 0) -> DataFrame:
    """scores with a placebo: each series' scores in another order, by a seeded hash, so their distribution stays and their timing goes."""
    w = Window.partitionBy(*keys)
    named = scores.withColumn("_i", F.row_number().over(w.orderBy(*order)))
    other = scores.select(*keys, F.col(score).alias(f"placebo_{score}"), F.row_number().over(w.orderBy(F.xxhash64(*[col(o) for o in (*keys, *order)], F.lit(seed)), *order)).alias("_i"))
    return named.join(other, [*keys, "_i"]).drop("_i")


def live_years(bars: DataFrame, least: float = 3.0, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """The instruments with at least so many years between their first and last bar."""
    return bars.groupBy(key).agg(F.count("*").alias("n"), (F.datediff(F.max(ts), F.min(ts)) / 365.25).alias("years")).filter(F.col("years") >= least)
