"""Joins that series need and SQL joins don't give directly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by=(), values=(), lag_rows: int = 0) -> DataFrame:
    """left with the values of the last right row at or before each time, per `by`. Union and a running last: one shuffle, no pairs.

    lag_rows takes the right row so many before that one, for values that are known only after their label. Without `by`
    a global order is needed: then one task holds all rows, so give a key wherever there is one.
    """
    if lag_rows:
        w = Window.partitionBy(*by).orderBy(on)
        right = right.select(*by, on, *[F.lag(v, lag_rows).over(w).alias(v) for v in values])
    order = Window.partitionBy(*by).orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in left.columns if c not in {*by, on}]
    found = right.select(*by, on, F.lit(0).alias("_left"), F.struct(*values).alias("_v"))
    asked = left.select(*by, on, F.lit(1).alias("_left"), F.struct(*rest).alias("_l") if rest else F.lit(None).alias("_l"))
    both = found.unionByName(asked, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    out = both.filter("_left = 1")
    return out.select(*by, on, *[F.col("_l")[c].alias(c) for c in rest], *[F.col("_last")[v].alias(v) for v in values])


def live_count(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """points with the number of spans that hold each (both ends included): running sums of starts and ends instead of a range join.

    Starts and ends are first summed by date, so what is ordered globally is one row per date.
    """
    steps = spans.groupBy(F.col(start).alias("_t")).agg(F.count("*").alias("_a")).withColumns({"_b": F.lit(0).cast("bigint"), "_k": F.lit(0)})
    stops = spans.groupBy(F.col(end).alias("_t")).agg(F.count("*").alias("_b")).withColumns({"_a": F.lit(0).cast("bigint"), "_k": F.lit(2)})
    marks = points.select(F.col(at).alias("_t")).distinct().withColumns({"_a": F.lit(0).cast("bigint"), "_b": F.lit(0).cast("bigint"), "_k": F.lit(1)})
    order = Window.orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    line = steps.unionByName(stops).unionByName(marks).withColumn("live", F.sum("_a").over(order) - F.sum("_b").over(order)).filter("_k = 1")
    return points.join(line.select(F.col("_t").alias(at), "live"), at, "left")


def lookup(facts: DataFrame, dimension: DataFrame, on, columns, limit: int = 100_000) -> DataFrame:
    """facts with a dimension's columns; the dimension is broadcast only if it has at most `limit` rows, else the planner chooses."""
    dim = dimension.select(*([on] if isinstance(on, str) else on), *columns)
    small = dim.limit(limit + 1).count() <= limit
    return facts.join(F.broadcast(dim) if small else dim, on, "left")


def outer_align(frames: dict[str, DataFrame], on: str, value: str, fill: float | None = 0.0) -> DataFrame:
    """One row per time with a column per named series, missing ones filled."""
    long = reduce(DataFrame.unionByName, [f.select(on, F.lit(n).alias("_n"), value) for n, f in frames.items()])
    wide = long.groupBy(on).pivot("_n", sorted(frames)).agg(F.first(value))
    return wide if fill is None else wide.na.fill(fill, sorted(frames))


def grid(spark, **parameters) -> DataFrame:
    """Every combination of some lists of values, numbered."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in parameters.items()]
    out = reduce(lambda a, b: a.crossJoin(b), frames)
    return out.withColumn("param_id", F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in parameters]))


def missing_work(planned: DataFrame, done: DataFrame, on) -> DataFrame:
    """What is planned and not done yet."""
    return planned.join(done, on, "left_anti")


def merge_latest(old: DataFrame, new: DataFrame, keys, version: str) -> DataFrame:
    """Rows of both, the newest of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")
