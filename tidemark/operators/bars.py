"""From ticks to clean bars."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, col, log

WIDTHS = {"1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "daily": "1 day"}


def bucket(ts, timeframe: str):
    """The label of the bar that a time falls in: its left edge, or for weeks the Sunday that ends them."""
    if timeframe == "weekly":
        return F.date_add(F.date_trunc("week", col(ts)).cast("date"), 6).cast("timestamp_ntz")
    return F.window(col(ts), WIDTHS[timeframe])["start"].cast("timestamp_ntz")


def _place(ticks: DataFrame, ts, tie) -> Column:
    """What orders ticks. A time and one whole number become one decimal: aggregates keep that in place and hash by bar, where a struct has all ticks of a series sorted first."""
    kinds = dict(ticks.dtypes)
    if len(tie) == 1 and kinds.get(str(ts)) in ("timestamp_ntz", "timestamp") and kinds.get(str(tie[0])) in ("tinyint", "smallint", "int", "bigint"):
        micros = F.unix_micros(ts)
        if kinds[ts] == "timestamp_ntz":  # by its fields, as a cast would go through the session's time zone
            minutes = (F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)) * 60 + F.minute(ts)
            micros = minutes * 60_000_000 + (F.expr(f"extract(SECOND FROM `{ts}`)") * 1_000_000).cast("bigint")
        number = F.coalesce(F.col(tie[0]).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))  # a missing one comes first
        return F.coalesce(micros, F.lit(0)).cast("decimal(18,0)") * F.lit(Decimal(2**65)) + number
    return F.struct(col(ts), *[col(t) for t in tie])


def from_ticks(ticks: DataFrame, timeframe: str, key="ticker", ts="ts", price="price", size=None, tie=()) -> DataFrame:
    """Bars of ticks; `tie` orders ticks of the same time. Empty bars are left out."""
    at = _place(ticks, ts, tie)
    volume = F.sum(col(size)) if size is not None else F.count("*").cast("double")
    aggs = [F.min_by(col(price), at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(col(price), at).alias("close"), volume.alias("volume")]
    return ticks.groupBy(col(key).alias("ticker"), bucket(ts, timeframe).alias("ts")).agg(*aggs)


def resample(bars: DataFrame, timeframe: str, strict: bool = True) -> DataFrame:
    """Coarser bars of bars. strict drops bars with any missing figure, otherwise those with no close."""
    aggs = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]
    # the first and the last value that are there, as an empty one isn't a price
    aggs[0] = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open")
    aggs[3] = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close")
    out = bars.groupBy("ticker", bucket("ts", timeframe).alias("bin")).agg(*aggs).withColumnRenamed("bin", "ts")
    return out.na.drop(subset=["open", "high", "low", "close", "volume"] if strict else ["close"])


def session_bins(bars: DataFrame, start: int = 555, width: int = 75, bins: int = 5) -> DataFrame:
    """Bars of fixed minutes within a session: left open and right closed."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    k = F.ceil((minute - start) / width) - 1
    own = bars.withColumns({"day": F.to_date("ts"), "bin": k.cast("int")}).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    aggs = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]
    return own.groupBy("ticker", "day", "bin").agg(*aggs)


def in_session(df: DataFrame, start: str, end: str, ts="ts") -> DataFrame:
    """Rows whose time of day lies between two times, both included; a session may pass midnight."""
    t = F.date_format(col(ts), "HH:mm:ss")
    return df.filter(t.between(start, end) if start <= end else (t >= start) | (t <= end))


def keep_one(df: DataFrame, keys, order, last: bool = False) -> DataFrame:
    """The first row of each key by an order (or the last)."""
    by = [F.desc(o) if isinstance(o, str) else o.desc() for o in order] if last else list(order)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def validate(bars: DataFrame) -> DataFrame:
    """Bars that can be: positive prices, a high over and a low under the rest to 1e-9, and no negative volume."""
    ok = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0) & (F.col("high") >= F.greatest("open", "low", "close") - 1e-9)
    ok &= (F.col("low") <= F.least("open", "high", "close") + 1e-9) & (F.coalesce("volume", F.lit(0.0)) >= 0)
    return bars.filter(ok)


def _repaired() -> dict[str, Column]:
    """Open, high and low of a bar with a positive close."""
    own = {c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("close")) for c in ("open", "high", "low")}
    return own | {"high": F.greatest(*own.values(), "close"), "low": F.least(*own.values(), "close")}


def repair(bars: DataFrame) -> DataFrame:
    """Bars with a positive close; other prices that can't be become the close, and high and low are widened to hold all."""
    return bars.filter("close > 0").withColumns(_repaired())


def drop_spikes(bars: DataFrame, k: float = 12.0, rounds: int = 3) -> DataFrame:
    """Without bars whose return is over k median deviations and turns back in the next bar; up to three times."""
    whole = Window.partitionBy("ticker")
    for _ in range(rounds):
        p = Panel(bars)
        r = p.diff(p.let(log("close")))
        away = p.let(r - p.let(F.percentile(r, 0.5).over(whole)))
        z = p.let(F.try_divide(away, F.nullif(p.let(F.percentile(F.abs(away), 0.5).over(whole)) * 1.4826, F.lit(0.0))))
        after = p.lead(z)
        spike = (F.abs(z) > k) & (F.abs(after) > k / 2) & (F.signum(z) != F.signum(after))
        bars = p.df.filter(~F.coalesce(spike, F.lit(False))).select(*bars.columns)
    return bars


def _after_gaps(bars: DataFrame, days: float) -> DataFrame:
    """bars, and as `_kept` whether they lie after the last long gap."""
    p = Panel(bars)
    gap = p.let((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(p.lag("ts").cast("timestamp"))) / 86_400e6)
    cut = p.let(F.max(F.when(gap > days, F.col("ts"))).over(Window.partitionBy("ticker")))
    return p.df.select(*bars.columns, (cut.isNull() | (F.col("ts") >= cut)).alias("_kept"))


def trim_gaps(bars: DataFrame, days: float = 31) -> DataFrame:
    """The part of each series after its last gap of more than so many days."""
    return _after_gaps(bars, days).filter("_kept").drop("_kept")


def clean(bars: DataFrame, tie=("open", "high", "low", "close"), k: float = 12.0, days: float = 31) -> tuple[DataFrame, DataFrame]:
    """(clean bars, counters): one bar a time, prices repaired, spikes dropped, and what lies before the last long gap cut off.

    counters has a row per instrument: bars that came in, that were doubles, without a price, changed by the repair, spikes, before the gap, and that are left.
    They are counted in two passes: what single rows tell, and what is left after the spikes.
    """
    calm = drop_spikes(repair(keep_one(bars, ("ticker", "ts"), tie)), k)
    marked = _after_gaps(calm, days)
    numbered = bars.withColumn("_n", F.row_number().over(Window.partitionBy("ticker", "ts").orderBy(*tie)))
    single, priced = F.col("_n") == 1, (F.col("_n") == 1) & (F.col("close") > 0)
    changed = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(v) for c, v in _repaired().items()])
    before = numbered.groupBy("ticker").agg(F.count("*").alias("bars_in"), F.count_if(single).alias("singles"), F.count_if(priced).alias("priced"), F.count_if(priced & changed).alias("fixed"))
    after = marked.groupBy("ticker").agg(F.count("*").alias("calm"), F.count_if("_kept").alias("bars_out"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = before.join(after, "ticker", "left")
    kept = marked.filter("_kept").drop("_kept")
    return kept, counts.select("ticker", "bars_in", (z("bars_in") - z("singles")).alias("doubles"), (z("singles") - z("priced")).alias("unpriced"), "fixed", (z("priced") - z("calm")).alias("spikes"), (z("calm") - z("bars_out")).alias("before_gap"), z("bars_out").alias("bars_out"))


def resample_all(bars: DataFrame, timeframes=("4h", "daily", "weekly")) -> DataFrame:
    """Bars of several timeframes in one table, told apart by a column."""
    parts = [resample(bars, t).withColumn("timeframe", F.lit(t)) for t in timeframes]
    return reduce(DataFrame.unionByName, parts)


def calendar(bars: DataFrame, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """A row for every step between each series' ends, empty where there is no bar."""
    ends = bars.groupBy("ticker").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    slots = ends.select("ticker", F.explode(F.expr(f"sequence(a, b, {step})")).alias("ts"))
    return slots.join(bars, ["ticker", "ts"], "left")


def fill_forward(bars: DataFrame, columns) -> DataFrame:
    p = Panel(bars)
    filled = {c: p.fill(c) for c in columns}
    return p.df.withColumns(filled).select(*bars.columns)


def interpolate(bars: DataFrame, x: str, out: str) -> DataFrame:
    """Missing values on the line between their neighbours in time."""
    p = Panel(bars)
    at = p.let(F.when(F.col(x).isNotNull(), F.unix_micros(F.col("ts").cast("timestamp"))))
    a, b, s, e = p.fill(x), p.back_fill(x), p.fill(at), p.back_fill(at)
    now = F.unix_micros(F.col("ts").cast("timestamp"))
    value = F.when(F.col(x).isNotNull(), F.col(x)).otherwise(a + (b - a) * F.try_divide((now - s).cast("double"), (e - s).cast("double")))
    return p.df.withColumn(out, value).select(*[c for c in bars.columns if c != out], out)


def adjust_dividends(bars: DataFrame, adjusted: str = "adj_close") -> DataFrame:
    """All prices times adjusted close over close; days without the factor take the last one, or the next at the start."""
    p = Panel(bars)
    factor = p.let(F.when(F.col(adjusted) > 0, F.try_divide(F.col(adjusted), F.nullif("close", F.lit(0.0)))))
    factor = p.let(F.coalesce(p.fill(factor), p.back_fill(factor)))
    return p.df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")}).select(*bars.columns)


def repair_epoch(ts):
    """A time from milliseconds, or from microseconds where the number is too large for that."""
    c = col(ts)
    return F.timestamp_millis(F.when(c > 100_000_000_000_000, F.floor(c / 1000)).otherwise(c).cast("bigint"))


def quarterly_features(bars: DataFrame) -> DataFrame:
    """Per quarter: last close, mean and deviation of returns, their mean rolling Sharpe, mean volume, the mean month-end close, and the next quarter's return."""
    p = Panel(bars)
    r = p.change("close")
    sharpe = p.let(F.try_divide(p.mean(r, 21), F.nullif(p.std(r, 21), F.lit(0.0))))
    daily = p.df.select("ticker", "ts", "close", "volume", r.alias("r"), sharpe.alias("s")).withColumn("quarter", F.date_trunc("quarter", "ts"))
    quarter = daily.groupBy("ticker", "quarter").agg(
        F.max_by("close", "ts").alias("close_last"), F.avg("r").alias("return_mean"), F.stddev_samp("r").alias("return_std"), F.avg("s").alias("rolling_sharpe_mean"), F.avg("volume").alias("volume_mean")
    )
    month = daily.groupBy("ticker", F.date_trunc("month", "ts").alias("m")).agg(F.max_by("close", "ts").alias("c"))
    monthly = month.groupBy("ticker", F.date_trunc("quarter", "m").alias("quarter")).agg(F.avg("c").alias("monthly_close_mean"))
    p = Panel(quarter.join(monthly, ["ticker", "quarter"]), order=("quarter",))
    ahead = p.let(F.try_divide(p.lead("close_last"), F.nullif("close_last", F.lit(0.0))) - 1)
    return p.df.withColumn("forward_return", ahead).select(*quarter.columns, "monthly_close_mean", "forward_return").na.drop()
