"""The position overlay from end to end: a rule's positions, labels, models fitted anew for each fold, and what five stages make of the positions.

filter: trades whose entry scores badly aren't taken. gate: no position while the regime score is low. sizing: positions scaled by the rank of their score among
validation scores. exit: a trade ends where its score falls. variant: of slow, base and fast parameters those that score best, chosen anew at every rebalance.
Models learn from rows whose label was known before validation begins; thresholds are quantiles of validation scores, and the intensity and the
model are those with the best validation Sharpe ratio of the volatility-targeted portfolio. Test years see only what was chosen before them.

All series go through one plan: one pass for recursive lines, windows for labels and context, written once to the shared folder; each fold and stage then reads from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import kernels as K
from tidemark.functions.windows import Panel, true
from tidemark.operators import evaluation as EV
from tidemark.operators import overlay as ML
from tidemark.operators import positions as P
from tidemark.operators.features import NAMES, features
from tidemark.operators.rules import RULES, positions
from tidemark.sources import store

# Quantiles of validation scores that are tried as thresholds, and the speeds of the variants.
INTENSITY = {"filter": (0.2, 0.35, 0.5), "gate": (0.2, 0.35, 0.5), "sizing": (None,), "exit": (0.1, 0.2, 0.3), "variant": (None,)}
FACTORS = (2.0, 1.0, 0.5)
BASE = 1
CONTEXT = ("_side", "_size", "_age", "_open", "_past", "_past_len")


@dataclass(frozen=True)
class Settings:
    """Horizons in rows, and how positions are simulated."""

    horizon: int = 10
    rebalance: int = 21
    embargo: int = 5
    smooth: int = 5
    bps: float = 7.0
    annual: float = 252.0
    target_vol: float = 0.10
    stride: int | None = None
    most: int = 150_000
    least: int = 200
    seed: int = 0
    models: tuple[str, ...] = ("logreg",)
    stages: tuple[str, ...] = field(default=tuple(INTENSITY))


def prepare(bars: DataFrame, rule: str, s: Settings) -> DataFrame:
    """One row per bar with the rule's variants, features, the context of its trade, and every stage's label with the time at which that is known."""
    r = RULES[rule]
    variants = {f"v{i}": (rule, r.variant(f) if f != 1.0 else dict(r.params)) for i, f in enumerate(FACTORS)}
    own = positions(bars, variants).join(features(bars, annual=int(s.annual)), ["ticker", "ts"])
    own = K.fold(own, {"weight": "double"}, lambda f: {"weight": K.vol_target(K.series(f, "close"), s.target_vol, s.annual)})
    live = ML.live_share(own, NAMES)
    p = Panel(own)
    p.let(F.col("vol_20") / s.annual**0.5, "dvol")
    base = F.col(f"v{BASE}")
    side = p.let(F.signum(base), "_side")
    age, opened, past, past_len = ML.trade_context(p, f"v{BASE}")
    clip = lambda x: F.greatest(F.least(x, F.lit(10.0)), F.lit(-10.0))
    for name, value in (("_size", F.abs(base)), ("_age", F.log1p(age)), ("_open", clip(opened)), ("_past", clip(past)), ("_past_len", F.log1p(past_len))):
        p.let(value, name)
    p.let(P.starts(p, f"v{BASE}"), "_start")
    at = p.let(F.row_number().over(p.base()) - 1, "_row")
    known = lambda h: p.lead("ts", h + s.embargo)
    entry = p.let(F.lead("open", 1).over(p.base()))
    # the position's direction over the next rows
    p.let(side * F.log(p.lead("close", s.horizon) / entry), "_bar_gain")
    p.let(known(s.horizon), "_bar_known")
    # the trade that starts here, from the open after its start to the open after its end
    run = p.let(p.runs(side))
    whole = Window.partitionBy(*p.keys, run).orderBy(*p.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leave, told = p.let(F.last(entry).over(whole)), p.let(F.last(known(1)).over(whole))
    p.let(side * F.log(leave / entry) - 2 * s.bps / 1e4, "_trade_gain")
    p.let(told, "_trade_known")
    # how straight the way ahead is
    p.let(ML.regime_label(p, s.horizon), "_straight")
    df = p.df.withColumn("_ready", live > 0.8)
    # the best variant over the next rows; none of them stands out: the base
    nets = []
    for i in range(len(FACTORS)):
        df = P.simulate(df.drop("held", "gross", "cost", "net", "turnover").withColumn("_p", F.col(f"v{i}") * F.col("weight")), "_p", bps=s.bps).withColumn(f"_n{i}", F.col("net"))
        nets.append(f"_n{i}")
    p = Panel(df.drop("held", "gross", "cost", "net", "turnover", "_p"))
    ahead = [P.forward_return(p, n, s.rebalance) for n in nets]
    best, worst = p.let(F.greatest(*ahead)), p.let(F.least(*ahead))
    first = F.coalesce(*[F.when(a == best, F.lit(i)) for i, a in enumerate(ahead)])
    p.let(F.when(ahead[0].isNull(), None).when(best - worst <= 1e-8, F.lit(BASE)).otherwise(first), "_variant")
    p.let(p.lead("ts", s.rebalance + s.embargo), "_variant_known")
    p.let(at % s.rebalance == 0, "_rebalance")
    return p.drop_temporary().drop(*nets)


def _stage(stage: str, s: Settings):
    """(who is learned from, label, known when, inputs, who is scored) of a stage."""
    ready, held = F.col("_ready"), F.col("_side") != 0
    bar = (ready & held & F.col("_bar_gain").isNotNull(), (F.col("_bar_gain") > 0).cast("int"), "_bar_known", [*NAMES, *CONTEXT], held)
    return {
        "filter": (ready & F.col("_start") & F.col("_trade_gain").isNotNull(), (F.col("_trade_gain") > 0).cast("int"), "_trade_known", [*NAMES, *CONTEXT], F.col("_start")),
        "gate": (ready & F.col("_straight").isNotNull(), None, "_bar_known", list(NAMES), F.lit(True)),
        "sizing": bar,
        "exit": bar,
        "variant": (ready & F.col("_variant").isNotNull(), F.col("_variant"), "_variant_known", [*NAMES, *[f"v{i}" for i in range(len(FACTORS))]], F.col("_rebalance")),
    }[stage]


def _scores(df: DataFrame, stage: str, model: str, fold: dict, s: Settings) -> DataFrame | None:
    """(ticker, ts, q or q0, q1, ...) of the rows of validation and test that a stage scores; None with too little to learn from."""
    who, label, known, inputs, asked = _stage(stage, s)
    rows = ML.train_rows(df.filter(who), fold, known)
    if stage != "filter":
        step = s.stride or (s.rebalance if stage == "variant" else s.horizon)
        rows = rows.filter(F.col("_row") % step == 0)
    rows = rows.orderBy(F.xxhash64("ticker", "ts", F.lit(s.seed))).limit(s.most)
    if label is None:
        middle = rows.agg(F.percentile("_straight", 0.5)).first()[0]
        label = (F.col("_straight") > F.lit(middle)).cast("int")
    rows = rows.withColumn("y", label)
    kinds = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if sum(kinds.values()) < s.least or len(kinds) < 2:
        return None
    window = df.filter(F.col("_part").isNotNull() & asked)
    if stage == "variant":
        (out,) = ML.fit_predict(model, rows, [window], inputs, seed=s.seed, classes=len(FACTORS))
        return out.select("ticker", "ts", *[f"q{i}" for i in range(len(FACTORS))])
    (out,) = ML.fit_predict(model, rows, [window], inputs, seed=s.seed)
    return out.select("ticker", "ts", "q")


def _candidates(df: DataFrame, stage: str, scores: DataFrame | None, s: Settings) -> tuple[DataFrame, list[str]]:
    """df with a column c0, c1, ... of changed positions for each intensity of a stage."""
    base = f"v{BASE}"
    names = [f"c{i}" for i in range(len(INTENSITY[stage]))]
    if scores is None:
        return df.withColumns({n: F.col(base) for n in names}), names
    own = df.join(scores, ["ticker", "ts"], "left")
    if stage == "variant":
        p = Panel(own)
        p.let(P.variant_stage(p, [f"v{i}" for i in range(len(FACTORS))], [f"q{i}" for i in range(len(FACTORS))], every=s.rebalance, default=BASE), names[0])
        return p.drop_temporary(), names
    if stage != "filter" and s.smooth > 1:
        own = K.fold(own, {"q_": "double"}, lambda f: {"q_": K.smooth_by_run(K.series(f, "q"), s.smooth)}).withColumn("q", F.col("q_")).drop("q_")
    checked = own.filter("_part = 'val' AND q IS NOT NULL" + ("" if stage in ("filter", "gate") else " AND _side <> 0"))
    if stage == "sizing":
        ranked = P.past_share(own.withColumnRenamed("q", "score"), checked.withColumnRenamed("q", "score"))
        return ranked.withColumn(names[0], P.sizing_stage(base, F.col("share"))), names
    cuts = checked.agg(*[F.percentile("q", i) for i in INTENSITY[stage]]).first()
    p = Panel(own)
    for n, cut in zip(names, cuts, strict=True):
        least = float("-inf") if cut is None else float(cut)
        value = P.gate_stage(base, "q", least) if stage == "gate" else P.filter_stage(p, base, "q", least) if stage == "filter" else P.exit_stage(p, base, "q", least)
        p.let(value, n)
    return p.drop_temporary(), names


def validation_sharpe(df: DataFrame, names: list[str], s: Settings) -> dict[str, float]:
    """The Sharpe ratio of the volatility-targeted portfolio of each position column over the validation rows, in one job."""
    rows = df.filter("_part = 'val'").select("ticker", "ts", "open", "close", "weight", *names)
    long = rows.unpivot(["ticker", "ts", "open", "close", "weight"], names, "config", "position").withColumn("position", F.col("position") * F.col("weight"))
    net = P.simulate(long, bps=s.bps, keys=("config", "ticker"))
    g = EV.pooled(net, by=("config",)).groupBy("config").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd")).collect()
    return {r.config: r.m / r.sd * s.annual**0.5 if r.n > 20 and r.sd else float("-inf") for r in g}


def run(bars: DataFrame, rule: str, folds: list[dict], settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, choices). positions: ticker, ts, fold, stage, base and changed position of every test row; choices: fold, stage, model, intensity, val_sharpe, base_sharpe, selected."""
    s = settings or Settings()
    spark = bars.sparkSession
    place = store.scratch(spark)
    prepare(bars, rule, s).write.parquet(place)
    table = spark.read.parquet(place)
    out, choices = [], []
    for fold in folds:
        when = [F.lit(fold[k]).cast("timestamp_ntz") for k in ("val_start", "test_start", "test_end")]
        part = F.when((F.col("ts") >= when[0]) & (F.col("ts") < when[1]), "val").when((F.col("ts") >= when[1]) & (F.col("ts") < when[2]), "test")
        df = table.withColumn("_part", part)
        window = df.filter("_part IS NOT NULL")
        base = validation_sharpe(window, [f"v{BASE}"], s).get(f"v{BASE}", float("-inf"))
        learned: dict[str, DataFrame | None] = {}
        for stage in s.stages:
            tried = []
            for model in s.models:
                # sizing and exit ask the same question, so one model answers both
                key = f"{'bar' if stage in ('sizing', 'exit') else stage}:{model}"
                if key not in learned:
                    found = _scores(df, stage, model, fold, s)
                    if found is not None:
                        held = store.scratch(spark)
                        found.write.parquet(held)
                        found = spark.read.parquet(held)
                    learned[key] = found
                changed, names = _candidates(window, stage, learned[key], s)
                score = validation_sharpe(changed, names, s)
                best = max(names, key=lambda n: (score.get(n, float("-inf")), -names.index(n)))
                tried.append((score.get(best, float("-inf")), model, INTENSITY[stage][names.index(best)], changed.withColumn("changed", F.col(best))))
            chosen = max(range(len(tried)), key=lambda i: tried[i][0])
            choices += [(fold["label"], stage, m, i, float(v), float(base), k == chosen) for k, (v, m, i, _) in enumerate(tried)]
            out.append(tried[chosen][3].filter("_part = 'test'").select("ticker", "ts", F.lit(fold["label"]).alias("fold"), F.lit(stage).alias("stage"), F.col(f"v{BASE}").alias("base"), F.coalesce("changed", F.lit(0.0)).alias("position")))
    told = spark.createDataFrame(choices, "fold string, stage string, model string, intensity double, val_sharpe double, base_sharpe double, selected boolean")
    return reduce(DataFrame.unionByName, out), told
