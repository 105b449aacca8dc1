"""Operators of sources, gates, evaluation and inference that SQL doesn't state."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import evaluation as EV
from tidemark.operators import positions as P
from tidemark.operators import signals as SG
from tidemark.plans import campaign
from tidemark.sources import store

T0 = dt.datetime(2024, 1, 1)


def walk(n, seed=0, ticker="a", step=dt.timedelta(hours=1)):
    g = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))
    o = np.concatenate(([100.0], c[:-1]))
    return [(ticker, T0 + i * step, float(a), float(max(a, b) * 1.002), float(min(a, b) * 0.998), float(b), float(g.integers(100, 1000))) for i, (a, b) in enumerate(zip(o, c, strict=True))]


BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def test_curvature_is_that_of_the_components(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=(60, 4)) * 0.01, axis=0)
    rows = [(T0 + dt.timedelta(hours=i), *[float(v) for v in np.exp(r)]) for i, r in enumerate(x)] + [(T0 - dt.timedelta(hours=1), None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, p double, q double, r double, `s t` double")
    got = [r.curvature for r in SG.curvature(df, ["p", "q", "r", "s t"]).orderBy("ts").collect()]
    path = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3].T
    v = np.gradient(path, axis=0)
    want = np.linalg.norm(np.cross(v, np.gradient(v, axis=0)), axis=1) / np.linalg.norm(v, axis=1) ** 3
    assert np.allclose(got, want, rtol=1e-6)
    assert SG.curvature(df.filter("p < 0"), ["p", "q"]).count() == 0


def test_past_share_against_counts(spark):
    g = np.random.default_rng(2)
    a, b = [float(round(v, 1)) for v in g.normal(size=400)], [float(round(v, 1)) for v in g.normal(size=300)]
    scores = spark.createDataFrame([(i, v) for i, v in enumerate(a)] + [(1000, None)], "id int, score double")
    reference = spark.createDataFrame([(v,) for v in b] + [(None,)], "score double")
    for parts in (2, 16, 256):
        got = {r.id: r.share for r in P.past_share(scores, reference, parts=parts).collect()}
        assert len(got) == 401 and got[1000] is None
        assert all(np.isclose(got[i], np.mean([x <= v for x in b])) for i, v in enumerate(a))
    one = P.past_share(scores, spark.createDataFrame([(0.0,)] * 5, "score double")).collect()
    assert all(r.share == (r.score >= 0) for r in one if r.score is not None)


def test_placebo_keeps_values_and_moves_them(spark):
    rows = [(t, T0 + dt.timedelta(hours=i), float(i)) for t in "ab" for i in range(50)]
    got = EV.shuffled(spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, q double"), "q", seed=3).collect()
    for t in "ab":
        own = sorted((r for r in got if r.ticker == t), key=lambda r: r.ts)
        assert sorted(r.placebo_q for r in own) == [float(i) for i in range(50)] and sum(r.placebo_q == r.q for r in own) < 10


def test_gates(spark):
    bars = spark.createDataFrame(walk(200), BARS).withColumn("signal", F.when(F.minute("ts") == 0, F.hour("ts") % 3 - 1).cast("int"))
    base = {r.ts: r.signal for r in bars.collect()}
    shut = bars.select("ts", (F.hour("ts") < 12).alias("open")).filter("hour(ts) <> 5")
    got = {r.ts: r.signal for r in campaign.gated(bars, market=shut).collect()}
    assert all(got[t] == (v if t.hour < 12 and t.hour != 5 else 0) for t, v in base.items())
    for way in ({"regime": True}, {"volume": True}, {"regime": True, "volume": True, "market": shut}):
        got = {r.ts: r.signal for r in campaign.gated(bars, **way).collect()}
        assert set(got) == set(base) and all(v in (0, base[t]) for t, v in got.items()) and any(got.values())
    assert campaign.gated(bars).select("signal").collect() == bars.select("signal").collect()


def test_resume_runs_what_is_missing(spark, tmp_path):
    grid, ran = spark.range(5).withColumnRenamed("id", "param_id"), []

    def run(todo):
        ran.append(sorted(r.param_id for r in todo.collect()))
        return todo.withColumn("v", F.col("param_id") * 2)

    run(grid.filter("param_id < 2")).write.parquet(f"{tmp_path}/g")
    for _ in range(2):
        assert sorted((r.param_id, r.v) for r in campaign.resume(grid, f"{tmp_path}/g", run).collect()) == [(i, 2 * i) for i in range(5)]
    assert ran == [[0, 1], [2, 3, 4], []]


def test_cache_is_made_anew_when_files_change(spark, tmp_path):
    made = []

    def make(raw):
        made.append(1)
        return raw.agg(F.sum("id").alias("s"))

    for n in (3, 3, 5):
        if n != 3 or not made:
            spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
        assert store.cached(spark, f"{tmp_path}/t", f"{tmp_path}/c", make).first().s == sum(range(n))
    assert len(made) == 2


def test_matching_rows_are_replaced(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "part string, id int, v int")
    store.write_by(df([("x", 1, 0), ("x", 2, 0), ("y", 3, 0)]), f"{tmp_path}/s", "part")
    store.replace_matching(df([("x", 2, 9), ("x", 4, 9)]), f"{tmp_path}/s", "part", "id")
    got = sorted((r.part, r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/s").collect())
    assert got == [("x", 1, 0), ("x", 2, 9), ("x", 4, 9), ("y", 3, 0)]


def test_report_and_suffixes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    store.write_report(df, f"{tmp_path}/out/r")
    assert (tmp_path / "out/r.md").read_text() == "| name | v |\n| --- | --- |\n| a | 1.5 |\n| b |  |\n" and (tmp_path / "out/r.csv").read_text() == "name,v\na,1.5\nb,\n"
    for kind in ("csv", "json", "orc", "parquet"):
        store.write(df, f"{tmp_path}/t.{kind}")
        assert sorted(store.read(spark, f"{tmp_path}/t.{kind}", "name string, v double").collect()) == sorted(df.collect())


def test_volatility_target():
    c = pd.Series([100.0 * (1.01 if i % 2 else 1.0) for i in range(200)])
    w = K.vol_target(c, 0.1)
    assert (w[:20] == 0).all() and 0 < w.iloc[-1] < 3 and (K.vol_target(pd.Series([5.0] * 50)) == 0).all()
    assert K.vol_target(c, 10.0).max() == 3.0


@pytest.mark.parametrize("way", [1, -1])
def test_ratchets(way):
    band = np.array([5.0, 4, 6, 3, 7, 8, 2])
    before = np.array([0.0, 0, 0, 0, 9, 0, 0])
    assert K.ratchet(band, before).tolist() == [5, 4, 4, 3, 7, 7, 2]
    n = 500
    g = np.random.default_rng(4)
    c = np.cumsum(g.normal(size=n)) * way
    trend, line = K.band_flip(c, c + 1.0, c - 1.0)
    assert set(trend) <= {-1.0, 1.0} and ((line <= c) == (trend > 0)).mean() > 0.9
