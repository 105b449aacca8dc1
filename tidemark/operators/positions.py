"""From positions to returns, and the decisions of an overlay on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, col, ratio


def simulate(bars: DataFrame, position="position", execution: str = "next_open", bps=7.0, keys=("ticker",), order=("ts",)) -> DataFrame:
    """bars with held, gross, cost, net and turnover. A position is decided at a row's close.

    next_open: the old position earns the gap to the next open, the new one the rest. next_close: it counts a row later, from
    close to close. same_close: it counts at once. Costs are charged where the position moves. bps may be a column.
    """
    p = Panel(bars, keys, order)
    bps = bps if isinstance(bps, Column) else F.lit(float(bps))
    target = p.let(F.coalesce(col(position).cast("double"), F.lit(0.0)))
    one, two = (p.let(F.coalesce(F.lag(target, k).over(p.base()), F.lit(0.0))) for k in (1, 2))
    before = p.lag("close")
    whole = F.coalesce(ratio("close", before) - 1, F.lit(0.0))
    if execution == "next_open":
        gap, rest = F.coalesce(ratio("open", before) - 1, F.lit(0.0)), F.coalesce(ratio("close", "open") - 1, F.lit(0.0))
        held, gross, moved = one, two * gap + one * rest, F.abs(one - two)
    elif execution == "next_close":
        held, gross, moved = two, two * whole, F.abs(one - two)
    elif execution == "same_close":
        held, gross, moved = one, one * whole, F.abs(target - one)
    else:
        raise ValueError(f"unknown execution {execution}")
    first = F.row_number().over(p.base()) == 1
    p.let(held, "held")
    gross = p.let(F.when(first, 0.0).otherwise(gross), "gross")
    moved = p.let(moved, "turnover")
    cost = p.let(moved * bps / 1e4, "cost")
    p.let(gross - cost, "net")
    return p.drop_temporary()


def forward_return(p: Panel, net="net", rows: int = 21) -> Column:
    """The sum of the next rows; NULL where there aren't so many."""
    return p.roll("sum", net, rows, ahead=rows)


def per_live(returns: DataFrame, instruments: DataFrame, at="ts", value="net", first="first_ts", last="last_ts") -> DataFrame:
    """Summed returns by time over the number of instruments live then, at least 1."""
    from tidemark.operators.joins import live_count

    total = returns.groupBy(at).agg(F.sum(value).alias("total"))
    live = live_count(total, instruments, at, first, last)
    return live.select(at, "live", (F.col("total") / F.greatest(F.coalesce("live", F.lit(0)), F.lit(1))).alias("ret"))


def trades(frame: DataFrame, held="held", net="net", keys=("ticker",), order=("ts",)) -> DataFrame:
    """One row per maximal run of one sign: its side, ends, rows and compounded return."""
    p = Panel(frame, keys, order)
    side = p.let(F.signum(col(held)), "side")
    run = p.let(p.runs(side), "trade")
    at = order[0]
    own = p.df.filter("side <> 0").groupBy(*keys, run)
    return own.agg(F.first("side").alias("side"), F.min(at).alias("entry"), F.max(at).alias("exit"), F.count("*").alias("bars"), (F.exp(F.sum(F.log1p(col(net)))) - 1).alias("ret"))


def starts(p: Panel, position) -> Column:
    """Whether a row begins a trade: a side other than 0 that the row before didn't have."""
    side = p.let(F.signum(col(position)))
    before = p.let(F.coalesce(F.lag(side).over(p.base()), F.lit(0.0)))
    return p.let((side != 0) & (side != before))


def _kept(p: Panel, start: Column, value: Column) -> Column:
    """A value taken at starts and kept until the next."""
    return p.let(F.last(F.when(start, value), ignorenulls=True).over(p.so_far()))


def filter_stage(p: Panel, position, score, threshold: float) -> Column:
    """Trades whose score at entry reaches the threshold; a missing score has no say, and the trade is taken."""
    start = starts(p, position)
    good = F.coalesce(col(score) >= threshold, F.lit(True)).cast("int")
    return p.let(F.when(_kept(p, start, good) == 1, col(position)).otherwise(0.0))


def gate_stage(position, score, threshold: float) -> Column:
    """The position in rows whose score reaches the threshold, or has none."""
    return F.when(F.coalesce(col(score) >= threshold, F.lit(True)), col(position)).otherwise(0.0)


def exit_stage(p: Panel, position, score, threshold: float) -> Column:
    """The position until its score first falls under the threshold, then none until the next trade."""
    side = p.let(F.signum(col(position)))
    run = p.let(p.runs(side))
    w = Window.partitionBy(*p.keys, run).orderBy(*p.order).rowsBetween(Window.unboundedPreceding, 0)
    out = p.let(F.max(F.coalesce(col(score) < threshold, F.lit(False)).cast("int")).over(w))
    return p.let(F.when(out == 1, 0.0).otherwise(col(position)))


def variant_stage(p: Panel, variants: list[str], scores: list[str], every: int = 21, default: int = 0) -> Column:
    """The variant with the best score at every so many rows, held until the next choice; the default where scores are missing."""
    at = p.let(F.row_number().over(p.base()) - 1)
    best = F.greatest(*[col(s) for s in scores])
    pick = F.when(col(scores[0]).isNull(), F.lit(default)).otherwise(F.coalesce(*[F.when(col(s) == best, F.lit(i)) for i, s in enumerate(scores)]))
    chosen = p.let(F.last(F.when(at % every == 0, pick), ignorenulls=True).over(p.so_far()))
    return p.let(F.coalesce(*[F.when(chosen == i, col(v)) for i, v in enumerate(variants)]))


def sizing_stage(position, rank: Column) -> Column:
    """The position times twice the rank of its score among reference scores; as it is where the score is missing."""
    return col(position) * F.coalesce(2 * rank, F.lit(1.0))


def past_share(scores: DataFrame, reference: DataFrame, score="score", out="share", parts: int = 256) -> DataFrame:
    """scores with the share of reference values at or under each.

    Values are dealt to ranges between approximate quantiles, so each range is ordered by itself; how many reference values lie below a range is a sum over as many rows as there are ranges.
    """
    known = reference.filter(col(score).isNotNull()).select(col(score).cast("double").alias("_s"))
    cuts = sorted({float(x) for x in known.approxQuantile("_s", [i / parts for i in range(1, parts)], 0.5 / parts)})
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_s"))) if cuts else F.lit(0)
    a = known.groupBy("_s").agg(F.count("*").alias("_n"))
    b = scores.filter(col(score).isNotNull()).select(col(score).cast("double").alias("_s")).distinct()
    line = a.join(b, "_s", "full").select("_s", F.coalesce("_n", F.lit(0)).alias("_n"), at.alias("_part"))
    sizes = a.withColumn("_part", at).groupBy("_part").agg(F.sum("_n").alias("_own"))
    below = sizes.select(F.col("_part").alias("_below"), F.col("_own").alias("_less")).crossJoin(F.broadcast(spread(scores.sparkSession, len(cuts) + 1)))  # ranges by ranges
    base = below.groupBy("_part").agg(F.sum(F.when(F.col("_below") < F.col("_part"), F.col("_less")).otherwise(0)).alias("_before"), F.sum("_less").alias("_total"))
    w = Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = line.withColumn("_n", F.sum("_n").over(w)).join(F.broadcast(base), "_part", "left")  # a row for each range
    ranked = ranked.select("_s", ((F.col("_before") + F.col("_n")) / F.col("_total")).alias(out))
    return scores.withColumn("_s", col(score).cast("double")).join(ranked, "_s", "left").drop("_s")


def spread(spark, n: int) -> DataFrame:
    """(_part): the numbers of n ranges."""
    return spark.range(n).select(F.col("id").cast("int").alias("_part"))


def percent_rank_average(p_df: DataFrame, at: str, value: str, out: str = "rank") -> DataFrame:
    """The rank of each value among those of its time, as a share; equal values have the mean of their ranks."""
    w = Window.partitionBy(at)
    ties = Window.partitionBy(at, value)
    rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return p_df.withColumn(out, F.when(F.col(value).isNotNull(), rank / F.count(value).over(w)))


def long_short(ranked: DataFrame, at: str, rank: str = "rank", top: float = 0.8, bottom: float = 0.2) -> DataFrame:
    """Weights: 1 over the number of longs for ranks at or over top, less for ranks at or under bottom."""
    w = Window.partitionBy(at)
    up, down = true_(F.col(rank) >= top), true_(F.col(rank) <= bottom)
    n_up, n_down = F.sum(up.cast("int")).over(w), F.sum(down.cast("int")).over(w)
    return ranked.withColumn("weight", F.when(up, F.lit(1.0) / n_up).otherwise(0.0) - F.when(down, F.lit(1.0) / n_down).otherwise(0.0))


def true_(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def hold_weights(weights: DataFrame, every: int, at: str = "ts", key: str = "ticker") -> DataFrame:
    """Weights of every so-manieth time, kept in between, and counted from the next time on."""
    times = weights.select(at).distinct().withColumn("_i", F.row_number().over(Window.orderBy(at)) - 1)
    p = Panel(weights.join(times, at), (key,), (at,))
    kept = p.let(F.last(F.when(F.col("_i") % every == 0, F.col("weight")), ignorenulls=True).over(p.so_far()))
    lagged = p.lag(kept)
    return p.df.withColumn("held", lagged).drop("_i", *[c for c in p.df.columns if c.startswith("_w")])
