"""A model overlay: labels known in time, purged folds, Spark ML models, and context of the trade that a row is in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, col, ratio

MODELS = ("logreg", "forest", "extra", "boosted", "mlp")


def live_share(df: DataFrame, names: list[str]) -> Column:
    """The share of a row's features that are known, among those that any row knows."""
    live = [n for n, v in zip(names, df.agg(*[F.count(n) for n in names]).first(), strict=True) if v]
    return sum((F.col(n).isNotNull().cast("int") for n in live), F.lit(0)) / max(len(live), 1)


def regime_label(p: Panel, h: int = 20) -> Column:
    """The efficiency of the next h rows: how far the close gets over how far it travels."""
    step = p.let(F.abs(p.diff("close")))
    return p.let(ratio(F.abs(p.lead("close", h) - F.col("close")), p.roll("sum", step, h, ahead=h)))


def label_date(p: Panel, h: int, embargo: int, ts: str = "ts") -> Column:
    """When a label of h rows ahead is known, with an embargo; NULL past the end."""
    return p.lead(ts, h + embargo)


def train_rows(df: DataFrame, fold: dict, known: str = "label_date", ts: str = "ts") -> DataFrame:
    """Rows whose label was known before validation starts."""
    out = df.filter(F.col(known).isNotNull() & (F.col(known) < F.lit(fold["val_start"]).cast("timestamp_ntz")))
    return out.filter(F.col(ts) >= F.lit(fold["train_start"]).cast("timestamp_ntz")) if fold.get("train_start") else out


def subsample(df: DataFrame, keys, order, stride: int, most: int, seed: int = 0) -> DataFrame:
    """Every stride-th row of each series, and of those at most so many by a seeded hash; a training set, not a result."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_i", i).filter(F.col("_i") % stride == 0).drop("_i").orderBy(F.xxhash64(*keys, *order, F.lit(seed))).limit(most)


def model(name: str, seed: int = 0, inputs: int = 56, classes: int = 2):
    """The estimator of a name over a column `x`."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier

    cols = {"featuresCol": "x", "labelCol": "y"}
    if name == "logreg":
        return LogisticRegression(regParam=0.05, maxIter=50, **cols)
    if name == "forest":
        return RandomForestClassifier(numTrees=60, maxDepth=6, minInstancesPerNode=20, seed=seed, **cols)
    if name == "extra":
        return RandomForestClassifier(numTrees=60, maxDepth=8, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=seed + 1, **cols)
    if name == "boosted":
        gbt = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed, **cols)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, **cols)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[inputs, 32, 16, classes], maxIter=60, seed=seed, **cols)
    raise ValueError(f"unknown model {name}")


def fit_predict(name: str, train: DataFrame, frames: list[DataFrame], names: list[str], label: str = "y", out: str = "q", seed: int = 0, classes: int = 2) -> list[DataFrame]:
    """frames with the probability of label 1, or with more classes a column of each one's score. Missing features take the training median; all are scaled."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"_f_{n}" for n in names]
    as_double = lambda d: d.withColumns({f: F.col(n).cast("double") for f, n in zip(filled, names, strict=True)})
    known = [f for f, v in zip(filled, as_double(train).agg(*[F.count(f) for f in filled]).first(), strict=True) if v]
    steps = [
        Imputer(inputCols=known, outputCols=[f"{f}_" for f in known], strategy="median"),
        VectorAssembler(inputCols=[f"{f}_" for f in known], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="x", withMean=True),
        model(name, seed, len(known), classes),
    ]
    fitted = Pipeline(stages=steps).fit(as_double(train).withColumn("y", F.col(label).cast("double")))
    if classes == 2:
        return [fitted.transform(as_double(f)).withColumn(out, vector_to_array("probability")[1]).select(*f.columns, out) for f in frames]
    # models of one class against the rest give margins instead of probabilities; a class that training never saw has none
    scores = vector_to_array("probability" if name != "boosted" else "rawPrediction")
    each = {f"{out}{k}": F.coalesce(F.get(scores, F.lit(k)), F.lit(0.0)) for k in range(classes)}
    return [fitted.transform(as_double(f)).withColumns(each).select(*f.columns, *each) for f in frames]


def trade_context(p: Panel, position, close="close", vol="dvol") -> tuple[Column, Column, Column, Column]:
    """(age, open result, previous result, previous length) of the trade that each row is in, results in volatilities.

    A trade is a run of one sign; islands and running windows say all of it, so nothing is recursive."""
    side = p.let(F.signum(col(position)))
    run = p.let(p.runs(side))
    inside = Window.partitionBy(*p.keys, run).orderBy(*p.order)
    age = p.let((F.row_number().over(inside) - 1).cast("double"))
    entry = p.let(F.first(col(close)).over(inside))
    v = p.let(F.when(col(vol) > 0, col(vol)).otherwise(0.01))
    result = lambda price, n, width: F.log(price / entry) / (width * F.sqrt(n + 1.0))
    open_ = p.let(F.when(side != 0, side * result(col(close), age, v)).otherwise(0.0))
    # the row that follows a trade closes it, at its own close
    before_side, before_entry, before_age = p.lag(side), p.lag(entry), p.lag(age)
    ends = p.let(F.coalesce((before_side != 0) & (before_side != side), F.lit(False)))
    length = p.let(before_age + 1)
    closed = p.let(F.when(ends, before_side * F.log(col(close) / before_entry) / (v * F.sqrt(length + 1.0))))
    past, past_len = p.fill(closed), p.fill(p.let(F.when(ends, length)))
    return p.let(F.when(side != 0, age).otherwise(0.0)), open_, p.let(F.coalesce(past, F.lit(0.0))), p.let(F.coalesce(past_len, F.lit(0.0)))


def label_trades(bars: DataFrame, book: DataFrame, on=("ticker", "ts"), ret: str = "ret") -> DataFrame:
    """bars with the outcome of the trade that starts there: 1 for a gain, 0 for a loss, NULL with none."""
    own = book.select(*on, (F.col(ret) > 0).cast("int").alias("label"))
    return bars.join(own, list(on), "left")


def top_models(scores: DataFrame, by, n: int, score: str = "score", tie: str = "model") -> DataFrame:
    """The n best by group."""
    from tidemark.operators.metrics import top_k

    return top_k(scores, by, [F.desc_nulls_last(score), tie], n)


def entropy_of_histogram(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """The entropy of a column's equal-width histogram."""
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    own = df.join(F.broadcast(ends)).filter(f"`{x}` IS NOT NULL")  # one row
    at = F.least(F.floor((F.col(x) - F.col("a")) * bins / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))), F.lit(bins - 1))
    share = own.groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL where one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def per_bar_annual(frequency: str) -> float:
    """Bars a year of a frequency."""
    return {"daily": 252.0, "4h": 252.0 * 6, "1h": 252.0 * 24, "weekly": 52.0}.get(frequency, 252.0) if frequency else math.nan
