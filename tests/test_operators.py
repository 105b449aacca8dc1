"""What SQL doesn't cover: causality, accounting by hand, truth tables, figures and stores."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import kernels as K
from tidemark.functions.windows import Panel
from tidemark.operators import backtest as BT
from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import overlay as ML
from tidemark.operators import portfolio as PF
from tidemark.operators import positions as P
from tidemark.operators import signals as SG
from tidemark.operators import stats as ST
from tidemark.operators.features import LIMIT, NAMES, features
from tidemark.operators.rules import RULES, month_end, positions
from tidemark.plans import campaign
from tidemark.sources import store

BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(n=420, seed=3, ticker="A", start="2000-01-03"):
    g = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(g.normal(0, 0.012, n) + 0.01 * np.sin(np.arange(n) / 30)))
    opened = np.concatenate(([100.0], close[:-1])) * (1 + g.normal(0, 0.003, n))
    high, low = np.maximum(opened, close) * (1 + np.abs(g.normal(0, 0.004, n))), np.minimum(opened, close) * (1 - np.abs(g.normal(0, 0.004, n)))
    return pd.DataFrame({"ticker": ticker, "ts": pd.bdate_range(start, periods=n), "open": opened, "high": high, "low": low, "close": close, "volume": g.integers(0, 900, n).astype(float)})


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(pd.concat([frame(), frame(300, 5, "B")]), BARS).cache()


def cut(df, n):
    """The first n rows of each series."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("ts"))).filter(F.col("_n") <= n).drop("_n")


def by_key(df, names):
    return {(r.ticker, r.ts): tuple(r[n] for n in names) for r in df.collect()}


def close_enough(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))


def test_features_do_not_see_ahead(bars):
    whole, part = by_key(features(bars), NAMES), by_key(features(cut(bars, 290)), NAMES)
    bad = {(k, n) for k, v in part.items() for n, x, y in zip(NAMES, v, whole[k], strict=True) if not close_enough(x, y)}
    assert not bad
    last = [v for k, v in whole.items() if k[0] == "A"][-1]
    assert len(NAMES) == 56 and sum(x is not None for x in last) == 56 and all(abs(x) <= LIMIT for x in last)


def test_rules_do_not_see_ahead(bars):
    ids = list(RULES)
    whole, part = by_key(positions(bars), ids), by_key(positions(cut(bars, 290)), ids)
    assert len(ids) == 39
    assert all(part[k] == whole[k] for k in part)
    assert all(-1 <= x <= 1 for v in whole.values() for x in v)
    held = np.abs(np.array([v for k, v in whole.items() if k[0] == "A"])).sum(axis=0)
    assert {i for i, x in zip(ids, held, strict=True) if x == 0} == set()


def test_variants():
    assert RULES["sma_50_200"].variant(0.5) == {"fast": 25, "slow": 100}
    assert RULES["psar"].variant(2.0) == {"af": 0.01, "most": 0.1}
    assert RULES["kst"].variant(2.0) == {"scale": 2.0}


def test_month_end_knows_the_calendar():
    t = pd.Series(pd.to_datetime(["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-28"]))
    assert month_end(t).tolist() == [False, True, False, False]
    assert month_end(t[:2]).tolist() == [False, True]


def test_accounting_by_hand(spark):
    rows = [("A", dt.datetime(2020, 1, 1 + i), 10.0 + i, 15.0, 9.0, 10.5 + i, 1.0, float(p)) for i, p in enumerate([1, 1, 0, 0, 0])]
    df = spark.createDataFrame(rows, BARS + ", position double")
    net = {e: [r.net for r in P.simulate(df, execution=e, bps=10).orderBy("ts").collect()] for e in ("next_open", "same_close")}
    want = [0, 11.5 / 11 - 1 - 0.001, (12 / 11.5 - 1) + (12.5 / 12 - 1), (13 / 12.5 - 1) - 0.001, 0]
    assert np.allclose(net["next_open"], want)
    assert np.allclose(net["same_close"], [-0.001, 11.5 / 10.5 - 1, 12.5 / 11.5 - 1 - 0.001, 0, 0])
    gap = spark.createDataFrame([("A", dt.datetime(2020, 1, 1 + i), x, x, x, x, 1.0, 1.0) for i, x in enumerate([10.0, 20.0, 20.0])], BARS + ", position double")
    assert sum(r.net for r in P.simulate(gap, bps=0).collect()) == 0
    with pytest.raises(ValueError, match="execution"):
        P.simulate(gap, execution="never")


def test_trades_by_hand(spark):
    net, held = [0, 0.01, 0.02, 0, -0.01, -0.01, 0], [0, 1, 1, 0, -1, -1, 0]
    df = spark.createDataFrame([("A", dt.datetime(2020, 1, 1 + i), float(a), float(b)) for i, (a, b) in enumerate(zip(net, held, strict=True))], "ticker string, ts timestamp_ntz, net double, held double")
    got = P.trades(df).orderBy("entry").collect()
    assert [r.side for r in got] == [1, -1] and math.isclose(got[0].ret, 1.01 * 1.02 - 1)


def test_decisions(spark):
    p, q = [0, 1, 1, 1, 0, -1, -1, 1, 1], [None, 0.2, 0.9, 0.9, None, 0.8, 0.1, 0.6, 0.6]
    panel = Panel(spark.createDataFrame([("A", i, float(a), b) for i, (a, b) in enumerate(zip(p, q, strict=True))], "ticker string, ts int, p double, q double"))
    out = panel.select(f=P.filter_stage(panel, "p", "q", 0.5), x=P.exit_stage(panel, "p", "q", 0.5), g=P.gate_stage("p", "q", 0.5)).orderBy("ts").collect()
    assert [r.f for r in out] == [0, 0, 0, 0, 0, -1, -1, 1, 1]
    assert [r.g for r in out] == [0, 0, 1, 1, 0, -1, 0, 1, 1]
    # the first trade's score is under the threshold at once, so it is left at once
    assert [r.x for r in out] == [0, 0, 0, 0, 0, -1, 0, 1, 1]


def slow_scan(price, signal, atr, stop, target, trail):
    out, i, n = [], 0, len(price)
    while i < n - 1:
        s = signal[i]
        if not s or math.isnan(atr[i]):
            i += 1
            continue
        level, goal, done = price[i] - s * stop * atr[i], price[i] + s * (target or 0) * atr[i], None
        for j in range(i + 1, n):
            if trail is not None:
                a = atr[i] if math.isnan(atr[j]) else atr[j]
                level = max(level, price[j] - trail * a) if s > 0 else min(level, price[j] + trail * a)
            if s * (price[j] - level) <= 0:
                done = (j, level, "stop")
            elif trail is None and s * (price[j] - goal) >= 0:
                done = (j, goal, "target")
            if done:
                break
        j, px, why = done or (n - 1, price[-1], "eod")
        out.append((i, j, px, why))
        i = j + 1
    return out


def test_scan_against_a_walk():
    g = np.random.default_rng(4)
    for _ in range(60):
        n = int(g.integers(0, 120))
        price, signal, atr = 50 + np.cumsum(g.normal(0, 1, n)), g.choice([0, 0, 0, 1, -1], n), np.abs(g.normal(1, 0.3, n))
        atr[g.random(n) < 0.1] = np.nan
        for stop, target, trail in ((1.5, 3.0, None), (1.0, None, 2.0), (2.0, 1.0, None)):
            got, want = BT.scan(price, signal, atr, stop, target, trail), slow_scan(price, signal, atr, stop, target, trail)
            assert [(a, b, w) for a, b, _, w in got] == [(a, b, w) for a, b, _, w in want]
            assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_admission_and_leverage(spark):
    assert BT.admit(np.array([0, 1, 2, 5]), np.array([4, 6, 3, 9]), 2).tolist() == [True, True, False, True]
    rows = [("s", dt.datetime(2020, 1, 1 + i), dt.datetime(2020, 1, 2 + i), "stop" if i % 2 else "target", r) for i, r in enumerate([0.02, -0.01, 0.03, -0.01])]
    df = spark.createDataFrame(rows, "strategy string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, reason string, ret double")
    r = BT.leverage(df, 3.0, capital=100.0, paths=20).first()
    assert math.isclose(r.typical_stop, 0.01) and r.fraction == 1.0 and math.isclose(r.final_equity, 100 * 1.02 * 0.99 * 1.03 * 0.99) and not r.ruined
    assert BT.leverage(df, 200.0, mode="aggressive", paths=20).first().ruined
    assert BT.leverage(df, 200.0, mode="aggressive", paths=20).first() == BT.leverage(df, 200.0, mode="aggressive", paths=20).first()


def test_swaps_count_wednesdays(spark):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=a), dt.datetime(2024, 1, 1) + dt.timedelta(days=b)) for a, b in itertools.product(range(9), range(0, 25, 3))]
    df = spark.createDataFrame(days, "a timestamp_ntz, b timestamp_ntz").select("a", "b", *[c.alias(n) for c, n in zip(BT.nights("a", "b"), ("n", "w"), strict=True)])
    for r in df.collect():
        held = [r.a.date() + dt.timedelta(days=k) for k in range(1, max(0, (r.b - r.a).days) + 1)]
        assert (r.n, r.w) == (len(held), sum(x.weekday() == 2 for x in held))


def test_kernels():
    ramp = pd.Series(np.arange(1.0, 61))
    assert np.isclose(K.kalman(pd.Series(np.full(50, 7.0)))[-1], 7)
    assert K.mcginley(pd.concat([pd.Series(np.full(50, 100.0)), pd.Series(np.full(50, 20.0)), pd.Series(np.linspace(20, 60, 100))]))[-1] <= 100
    assert np.isnan(K.jma(ramp, 7)[:7]).all() and (np.diff(K.jma(ramp, 7)[10:]) > 0).all()
    assert K.strongest_cycle(np.sin(np.arange(300) * 2 * np.pi / 20)) == 20
    assert np.isnan(K.smooth_by_run(pd.Series([np.nan, 1.0, 2.0, np.nan, 5.0]))[[0, 3]]).all() and K.smooth_by_run(pd.Series([np.nan, 1.0, 2.0, np.nan, 5.0]))[4] == 5.0
    f = frame(200)
    assert set(np.unique(K.psar(f)[1])) <= {-1.0, 0.0, 1.0} and K.psar(f.head(2))[1].tolist() == [0, 0]
    assert np.isfinite(K.t3(ramp, 3).iloc[-1]) and np.isfinite(K.tema(ramp, 5).iloc[-1])


def test_nulls_zero_ranges_and_gaps(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i == 7 else 5.0, 5.0, 5.0, None if i == 7 else 5.0, 0.0) for i in range(40)]
    p = Panel(spark.createDataFrame(rows, BARS))
    out = p.select(s=I.stochastic(p)[0], c=I.cci(p), m=I.mfi(p), f=I.cmf(p), e=I.efficiency_ratio(p), r=I.linreg(p, "close", 10)[1], a=I.autocorr(p, I.log_return(p), 10), ch=I.choppiness(p), z=I.zscore(p), w=I.twiggs(p, 5)).collect()
    assert all(x is None or x == x for r in out for x in r[2:])
    assert features(p.df.select(*[c.split()[0] for c in BARS.split(", ")])).count() == 40


def test_empty_tables(spark):
    e = spark.createDataFrame([], BARS)
    assert positions(e).count() == features(e).count() == B.drop_spikes(e).count() == B.trim_gaps(e).count() == 0
    assert BT.backtest(e.withColumn("signal", F.lit(1))).count() == 0
    assert SG.cross_sectional_returns(e, 3, 5).count() == 0
    assert M.series_metrics(P.simulate(e.withColumn("position", F.lit(1.0)))).count() == 0


def test_series_metrics_against_pandas(spark, bars):
    s = P.simulate(positions(bars, ["ema_12_26"]), "ema_12_26", bps=5).cache()
    got = {r.ticker: r for r in M.series_metrics(s).collect()}
    for ticker, f in s.toPandas().sort_values("ts").groupby("ticker"):
        r, g = f["net"], got[ticker]
        years = (f["ts"].iloc[-1] - f["ts"].iloc[0]).days / 365.25
        eq = (1 + r).cumprod()
        assert math.isclose(g.sharpe, r.mean() / r.std() * math.sqrt(len(r) / years), rel_tol=1e-9)
        assert math.isclose(g.cagr, eq.iloc[-1] ** (1 / years) - 1, rel_tol=1e-9) and math.isclose(g.max_drawdown, (eq / eq.cummax() - 1).min(), rel_tol=1e-9)
        assert math.isclose(g["skew"], r.skew(), rel_tol=1e-6)
        assert math.isclose(abs(g.stability_r2), np.corrcoef(np.arange(len(r)), np.log(eq))[0, 1] ** 2, rel_tol=1e-6)
        side = np.sign(f["held"].to_numpy())
        assert g.n_trades == ((side != 0) & (side != np.concatenate(([0], side[:-1])))).sum()
    few = M.series_metrics(s.filter("ts < '2000-01-20'")).first()
    assert few.sharpe is None and few.n_bars < 20


def test_portfolio():
    mean, cov = np.array([0.001, 0.001, -0.002]), np.diag([1e-4, 4e-4, 1e-4])
    w = PF.weights(mean, cov, "tangency", risk_free=0.0)
    assert w[2] == 0 and np.isclose(w.sum(), 1) and np.isclose(w[0] / w[1], 4)
    assert np.allclose(PF.weights(mean, cov, "equal_weight"), 1 / 3) and np.isclose(PF.weights(mean, cov, "inverse_vol")[0], 2 / 5)
    with pytest.raises(ValueError, match="risk-free"):
        PF.weights(-mean * [1, 1, -1], cov)
    f = PF.folds(2010, 2013, kind="wf_rolling")
    assert [x["label"] for x in f] == ["2010", "2011", "2012", "2013"] and f[0] == {"train_start": "2000-01-01", "val_start": "2008-01-01", "test_start": "2010-01-01", "test_end": "2011-01-01", "label": "2010"}
    assert len(PF.folds(2010, 2013, kind="holdout", until="2012-05-05")) == 1
    assert PF.month_folds("2020-01-01", 12, 6, 3)[1][1:] == (dt.date(2020, 4, 1), dt.date(2020, 10, 1), dt.date(2021, 1, 1))


def test_sleeves(spark):
    rows = [(s, dt.date(2024, 1, d), r) for s, d, r in (("a", 1, 0.01), ("a", 2, -0.02), ("b", 2, 0.04), ("b", 3, 0.03))]
    daily = spark.createDataFrame(rows, "sleeve string, date date, ret double")
    mean, cov, n = PF.sleeve_moments(daily, ["a", "b"])
    wide = np.array([[0.01, 0], [-0.02, 0.04], [0, 0.03]])
    assert n == 3 and np.allclose(mean, wide.mean(axis=0)) and np.allclose(cov, np.cov(wide.T))
    both = PF.combine(daily, {"a": 0.5, "b": 0.5}, target_vol=0.1).toPandas().sort_values("date")["ret"].to_numpy()
    assert np.isclose(both.std(), 0.1) and np.allclose(both / both[0], (wide @ [0.5, 0.5]) / 0.005)


def test_combined_sleeves_takes_every_sleeve(spark, monkeypatch):
    from tidemark.plans import q_signals

    g = random.Random(5)
    rows = [(f"s{k:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=g.randrange(90)), g.gauss(0.001 * k, 0.01 + 0.002 * k)) for k in range(25) for _ in range(60)]
    monkeypatch.setattr(q_signals, "book", lambda spark, d: spark.createDataFrame(rows, "ticker string, exit_ts timestamp_ntz, ret double"))
    wide = pd.DataFrame(rows, columns=["s", "t", "r"]).groupby(["t", "s"])["r"].mean().unstack().fillna(0.0)
    daily = PF.daily_returns(q_signals.book(spark, "").withColumnRenamed("ticker", "sleeve"))
    mean, cov, n = PF.sleeve_moments(daily, list(wide.columns))
    assert n == len(wide) and np.allclose(mean, wide.mean(), atol=1e-12) and np.allclose(cov, wide.cov(), atol=1e-12)
    share = (1 / wide.std()) / (1 / wide.std()).sum()
    ret = (wide * share).sum(axis=1)
    equity = (1 + ret).cumprod()
    got = q_signals.combined_sleeves(spark, "").first()
    assert got.n_days == len(ret) and np.isclose(got.annual_vol, ret.std(ddof=0) * math.sqrt(252), atol=1e-5) and np.isclose(got.cagr, equity.iloc[-1] ** (252 / len(ret)) - 1, atol=1e-5)


def test_rebalance_looks_back_only(spark):
    book = spark.createDataFrame([(t, dt.datetime(2024, m, 5), r) for m in range(1, 7) for t, r in (("x", 0.01 * m), ("y", -0.01 * m), ("z", 0.001))], "ticker string, exit_ts timestamp_ntz, ret double")
    book = book.union(book.withColumn("exit_ts", F.col("exit_ts") + F.expr("INTERVAL 1 DAY")).withColumn("ret", F.col("ret") * 0.5))
    periods = spark.createDataFrame([(1, dt.datetime(2024, 3, 1)), (2, dt.datetime(2024, 5, 1))], "period int, start timestamp_ntz")
    got = {(r.period, r.ticker): r.n for r in PF.rebalance(book, periods).collect()}
    assert got[(1, "x")] == 4 and got[(2, "x")] == 8 and (1, "y") not in got


def test_statistics(spark):
    g = np.random.default_rng(5)
    base = g.normal(0, 0.01, 400)
    good, same = base + 0.004, base + g.normal(0, 0.001, 400)
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(good, same, strict=True))], "ts int, a double, b double")
    d, z, p = ST.sharpe_difference(t, "a", "b")
    m = np.column_stack([good, same, good**2, same**2])
    u, n = m - m.mean(axis=0), 400
    cov, lags = u.T @ u / n, math.floor(4 * 4 ** (2 / 9))
    for k in range(1, lags + 1):
        x = u[k:].T @ u[:-k] / n
        cov += (1 - k / (lags + 1)) * (x + x.T)
    v = m.mean(axis=0)[2:] - m.mean(axis=0)[:2] ** 2
    grad = np.array([m[:, 2].mean() / v[0] ** 1.5, -m[:, 3].mean() / v[1] ** 1.5, -m[:, 0].mean() / (2 * v[0] ** 1.5), m[:, 1].mean() / (2 * v[1] ** 1.5)])
    assert math.isclose(z, d / math.sqrt(grad @ cov @ grad / n), rel_tol=1e-6) and p < 0.01
    boot = ST.sharpe_difference_bootstrap(spark, good, same, draws=200)
    assert boot["p_two"] < 0.05 and boot["ci_lo"] > 0 and boot == ST.sharpe_difference_bootstrap(spark, good, same, draws=200)
    lo, hi = ST.paired_interval(spark, good, same, draws=200)
    assert lo < 0.004 < hi or lo > 0
    diffs = np.column_stack([good - base, g.normal(0, 0.01, 400), g.normal(-0.001, 0.01, 400)])
    spa = ST.superior_ability(spark, diffs + g.normal(0, 1e-4, diffs.shape), draws=200)
    assert spa["p_spa"] < 0.05 and spa["best"] == 0
    adjusted = ST.step_down(spark, diffs + g.normal(0, 1e-4, diffs.shape), draws=200)
    assert adjusted[0] < 0.05 < adjusted[2]
    assert ST.romano_wolf(spark, [good, g.normal(0, 0.01, 400)], draws=200) == [True, False]
    assert 0.9 < ST.deflated_sharpe(400, 0.002, 0.01, 0.0, 3.0) <= 1 and ST.deflated_sharpe(400, 0.002, 0.01, 0.0, 3.0, trials=1000) < ST.deflated_sharpe(400, 0.002, 0.01, 0.0, 3.0)
    assert ST.deflated_sharpe(2, 1, 1, 0, 3) == 0 and ST.deflated_sharpe_annual(2.0, 500, 10, 0.3) > 0.5


def test_overfitting(spark):
    g = np.random.default_rng(6)
    noise = g.normal(size=(6, 100))
    rows = [(f"s{i}", t, float(noise[i, t])) for i in range(6) for t in range(100)]
    b = ST.block_means(spark.createDataFrame(rows, "s string, ts int, ret double"), "s", "ts", "ret", 6).toPandas().sort_values(["s", "block"])
    sums, counts = (b.pivot(index="s", columns="block", values=c).to_numpy() for c in ("total", "n"))
    assert np.allclose(sums, [[x.sum() for x in np.array_split(r, 6)] for r in noise])
    assert 0 <= ST.overfitting(sums, counts) <= 1
    assert ST.overfitting(np.arange(6.0)[:, None] * np.ones((6, 6)), np.ones((6, 6))) == 0


def test_ols_and_random_market(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=200)
    rows = [(float(a), float(2 + 3 * a + e), int(k)) for a, e, k in zip(x, g.normal(size=200), np.arange(200) % 10, strict=True)]
    got = ST.clustered_ols(spark.createDataFrame(rows, "x double, y double, c int"), "y", ["x"], "c")
    assert np.allclose([got["const"][0], got["x"][0]], np.polyfit(x, [r[1] for r in rows], 1)[::-1]) and 0 < got["x"][1] < 1
    m = ST.random_market(spark, 3, 50).toPandas()
    assert len(m) == 150 and (m["high"] >= m[["open", "close"]].max(axis=1)).all() and (m["low"] > 0).all()


def test_context_and_labels(spark):
    p, c = [0, 1, 1, -1, -1, 0, 1], [10.0, 11.0, 12.0, 11.0, 10.0, 10.5, 11.0]
    panel = Panel(spark.createDataFrame([("A", i, float(a), b, 0.02) for i, (a, b) in enumerate(zip(p, c, strict=True))], "ticker string, ts int, p double, close double, dvol double"))
    age, open_, past, length = ML.trade_context(panel, "p")
    out = panel.select(a=age, o=open_, r=past, n=length).orderBy("ts").collect()
    assert [r.a for r in out] == [0, 0, 1, 0, 1, 0, 0] and [r.n for r in out] == [0, 0, 0, 2, 2, 2, 2]
    assert math.isclose(out[2].o, math.log(12 / 11) / (0.02 * math.sqrt(2))) and math.isclose(out[3].r, math.log(11 / 11) / (0.02 * math.sqrt(3)), abs_tol=1e-12)
    assert math.isclose(out[5].r, -math.log(10.5 / 11) / (0.02 * math.sqrt(3)))


def test_overlay_is_purged(spark):
    f = pd.concat([frame(900, s, t) for s, t in ((8, "A"), (9, "B"))])
    df = spark.createDataFrame(f, BARS)
    fold = {"train_start": None, "val_start": "2002-06-01", "test_start": "2002-09-01", "test_end": "2003-01-01", "label": "x"}
    p = Panel(df)
    p.let(ML.label_date(p, 20, 2), "label_date")
    kept = ML.train_rows(p.df, fold)
    assert kept.agg(F.max("label_date")).first()[0] < dt.datetime(2002, 6, 1) and kept.agg(F.max("ts")).first()[0] < dt.datetime(2002, 5, 2)
    for model in ("logreg", "forest"):
        out = campaign.overlay(df, "ema_12_26", [fold], model)
        rows = out.collect()
        assert rows and all(dt.datetime(2002, 9, 1) <= r.ts < dt.datetime(2003, 1, 1) and 0 <= r.q <= 1 and r.gated in (0, r.base) for r in rows)


def test_asof_and_live_counts(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 2, None)], "k string, t int, v string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 20), ("b", 3, 30)], "k string, t int, s int")
    got = sorted((r.k, r.t, r.v, r.s) for r in J.asof(left, right, "t", ("k",), ("s",)).collect())
    assert got == [("a", 1, "x", 10), ("a", 5, "y", 20), ("b", 2, None, None)]
    spans = spark.createDataFrame([(1, 3), (2, 2), (5, 9)], "a int, b int")
    points = spark.createDataFrame([(i,) for i in range(11)], "t int")
    assert [r.live for r in J.live_count(points, spans, "t", "a", "b").orderBy("t").collect()] == [sum(a <= i <= b for a, b in ((1, 3), (2, 2), (5, 9))) for i in range(11)]


def test_lookup_broadcasts_only_what_is_small(spark):
    facts, dim = spark.range(10).withColumnRenamed("id", "k"), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [J.lookup(facts, dim, "k", ["v"], limit=n)._jdf.queryExecution().toString() for n in (10, 9)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_store(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "runs"))
    s.write(spark.createDataFrame([(1, 0.5)], "i int, ret double"), "c1", "s1")
    s.write(spark.createDataFrame([(2, 0.7, "new")], "i int, ret double, note string"), "c1", "s2")
    s.write(spark.createDataFrame([(3, 0.9)], "i int, ret double"), "c1", "s1")
    assert sorted((r.i, r.note) for r in s.read("c1").collect()) == [(2, "new"), (3, None)]
    assert "PartitionFilters: [isnotnull(campaign_id" in s.read("c1", "s1")._jdf.queryExecution().executedPlan().toString()
    assert s.sql("SELECT count(*) AS n FROM {runs}").first().n == 2
    store.write_report(s.read("c1", "s2").select("i", "note"), str(tmp_path / "t" / "x"))
    assert (tmp_path / "t" / "x.md").read_text().splitlines()[2] == "| 2 | new |"


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk,Date,O,H,L,C,Vol\nx,2024-01-02 00:00:00+05:30,10,12,9,11,100\nx,2024-01-02 00:00:00+05:30,10,12,9,11,100\nx,2024-01-03 00:00:00+05:30,10,9,9,11,100\nx,2024-01-04 00:00:00+05:30,n/a,12,9,11,5\n")
    got = store.ingest(spark, [{"name": "a", "path": str(tmp_path / "a.csv"), "drop": ("junk",), "ticker": "T", "offset_minutes": 330}], str(tmp_path / "out")).first()
    assert (got.rows_in, got.rows_out) == (4, 1)
    row = spark.read.parquet(f"{tmp_path}/out/a").first()
    assert row.ts == dt.datetime(2024, 1, 1, 18, 30) and row.ticker == "T"
    with pytest.raises(KeyError, match="close"):
        store.resolve(spark.createDataFrame([(1,)], "date int"))
    assert [r["id"] for r in store.flatten_universe({"g": {"source": "x", "instruments": [{"id": "a"}, {"id": "b"}]}})] == ["a", "b"]
    with pytest.raises(ValueError, match="twice"):
        store.flatten_universe({"g": {"instruments": ["a", "a"]}})
    (tmp_path / "rf.csv").write_text("d,v\n2024-01-01,5.0\n2024-01-02,.\n")
    assert [r.rf for r in store.risk_free(spark, str(tmp_path / "rf.csv")).orderBy("ts").collect()] == [0.05, 0.05]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars, stream_ema

    g = random.Random(1)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), g.choice("ab"), float(g.randint(1, 99))) for i in range(200)]
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    src = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame(rows[100 * k : 100 * k + 100] + rows[:3] * k, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_bars(stream, late="10 days").writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars").count() == 0  # nothing has passed the watermark
    q = stream_bars(stream, late="10 minutes").writeStream.format("memory").queryName("bars2").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    batch = B.from_ticks(spark.createDataFrame(rows, schema).withColumnRenamed("event_type", "ticker"), "1h", price="value", tie=("event_id",))
    want = {(r.ticker, r.ts): (r.open, r.close, r.volume) for r in batch.collect()}
    got = {(r.ticker, r.ts): (r.open, r.close, r.volume) for r in spark.table("bars2").collect()}
    assert len(got) > 30 and all(want[k] == v for k, v in got.items())
    once = spark.readStream.schema(schema).parquet(str(src))
    q = stream_ema(once, 5).writeStream.format("memory").queryName("ema").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    ends = {r.ticker: r.ema for r in spark.table("ema").orderBy("event_id").collect()}
    assert set(ends) == {"a", "b"}


def test_grid_and_walk_forward(spark, bars):
    got = campaign.run_grid(bars, "tidemark.operators.signals.jma_signals", {"fast": [3, 5], "slow": [9]}, stops=((1.5, 3.0), (1.0, 2.0)))
    keys = {(r.ticker, r.param_id, r.stop_mult) for r in got.select("ticker", "param_id", "stop_mult").distinct().collect()}
    assert keys == {(t, f"fast={f},slow=9", s) for t in "AB" for f in (3, 5) for s in (1.5, 1.0)}
    wf = campaign.walk_forward(bars, SG.jma_signals, {"fast": [3, 5], "slow": [9]}, splits=3)
    assert {(r.ticker, r.fold) for r in wf.collect()} <= {(t, f) for t in "AB" for f in (0, 1)} and wf.count() > 0
    assert BT.bootstrap_paths(spark, [0.01, -0.01], 20, 5).count() == 20


def test_cleaning(spark):
    f = frame(120)
    f.loc[60, "close"] *= 3
    f.loc[60, "high"] *= 3
    df = spark.createDataFrame(f, BARS)
    left = {r.ts for r in B.drop_spikes(df).collect()}
    assert len(left) == 119 and f.loc[60, "ts"] not in left
    gap = pd.concat([f.head(30), f.tail(40).assign(ts=lambda x: x["ts"] + pd.Timedelta(days=200))])
    assert B.trim_gaps(spark.createDataFrame(gap, BARS)).count() == 40
    assert spark.createDataFrame([(1700000000000,), (1700000000000000,)], "t bigint").select(B.repair_epoch("t").cast("bigint")).distinct().count() == 1


def test_fine_exits_by_hand(spark):
    from tidemark.operators.pairs import fine_exits

    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    coarse = spark.createDataFrame([("A", t(4 * i), c, c + 1, c - 1, c, 1.0, s) for i, (c, s) in enumerate([(100.0, 0), (100.0, 1), (104.0, 0), (110.0, 0), (110.0, 0)])], BARS + ", signal int")
    rows = [(8, 0, 101, 102, 100), (9, 0, 104, 105, 103), (12, 0, 105, 106, 104.5), (13, 0, 105, 111, 103.4), (16, 0, 110, 111, 109)]
    fine = spark.createDataFrame([("A", t(h, m), float(o), float(hi), float(lo), float(o), 1.0) for h, m, o, hi, lo in rows], BARS)
    got = fine_exits(fine, coarse, stop=0.05, trail=0.25, atr_n=2, slip_bps=0).collect()
    # entered at 8:00 at 101 with a stop at 95.95; the close of 104 and a range of (2 + 5) / 2 lift it to 103.125, and 103.4 holds; the close of 110 lifts it to 108.625
    assert [(r.entry_ts, r.exit_ts, r.entry_price, r.reason) for r in got] == [(t(8), t(16), 101.0, "eod")]
    got = fine_exits(fine, coarse, stop=0.05, trail=0.1, atr_n=2, slip_bps=0).first()
    assert (got.exit_ts, got.reason) == (t(13), "stop") and math.isclose(got.exit_price, 104 - 0.1 * 3.5)


def test_pairs_and_unit_root(spark):
    from tidemark.operators.pairs import hedge_ratio, margin_call, pair_trading, unit_root

    g = np.random.default_rng(3)
    x = 50 + np.cumsum(g.normal(0, 1, 400))
    y = 2 * x + 5 + g.normal(0, 0.5, 400)
    df = spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "pair string, ts int, y double, x double")
    last = hedge_ratio(df).orderBy(F.desc("ts")).first()
    assert abs(last.slope * x[-1] + last.level - y[-1]) < 3
    out = pair_trading(df, n=30, enter=1.0).orderBy("ts").collect()
    assert {r.position for r in out} == {-1.0, 0.0, 1.0} and out[0].pnl == 0
    for i in range(1, 400):
        want = (out[i - 1].position or 0) * (y[i] - y[i - 1] - (out[i - 1].slope or 0) * (x[i] - x[i - 1]))
        assert math.isclose(out[i].pnl, want, abs_tol=1e-9)
    noise = spark.createDataFrame([("walk", i, float(v)) for i, v in enumerate(x)] + [("noise", i, float(v)) for i, v in enumerate(g.normal(size=400))], "ticker string, ts int, v double")
    t = unit_root(noise, "v")
    d = np.diff(x)
    design = np.column_stack([np.ones(398), x[1:-1], d[:-1]])
    beta, rest, *_ = np.linalg.lstsq(design, d[1:], rcond=None)
    error = math.sqrt(rest[0] / 395 * np.linalg.inv(design.T @ design)[1, 1])
    assert math.isclose(t[("walk",)], beta[1] / error, rel_tol=1e-6) and t[("noise",)] < -2.86
    row = spark.createDataFrame([(0.5,)], "d double").select(*margin_call("d", 100.0, 1.5)).first()
    assert row[0] and row[1] == 50


@pytest.mark.parametrize("dependent", [False, True])
def test_step_up_reads_each_p_value_once(spark, dependent):
    g = random.Random(3)
    rows = [(i, "ab"[i % 2] if i % 7 else None, None if i % 11 == 0 else g.choice([0.001, 0.02, 0.3]) if i % 3 else g.random() / 20) for i in range(900)]
    df = ST.benjamini_hochberg(spark.createDataFrame(rows, "id int, family string, p double"), by=("family",), dependent=dependent)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan.lower()
    got = {r.id: r.p_bh for r in df.collect()}
    assert len(got) == len(rows)
    for family in ("a", "b", None):
        own = sorted((p, i) for i, f, p in rows if f == family and p is not None)
        m, least = len(own), 1.0
        for rank in range(m, 0, -1):
            least = min(least, own[rank - 1][0] * m * (sum(1 / k for k in range(1, m + 1)) if dependent else 1) / rank)
            assert math.isclose(got[own[rank - 1][1]], least, rel_tol=1e-12)
    assert all(got[i] is None for i, _, p in rows if p is None)


def test_harmonic_sum_takes_no_loop(spark):
    m = [1, 2, 255, 256, 257, 10_000]
    got = spark.createDataFrame([(n,) for n in m], "m bigint").select("m", ST.harmonic(F.col("m").cast("double")).alias("h")).collect()
    assert all(math.isclose(r.h, math.fsum(1 / k for k in range(1, r.m + 1)), rel_tol=1e-14) for r in got)


def test_back_fill_reads_each_row_once(spark):
    p = Panel(spark.createDataFrame([("a", i, float(i) if i % 3 == 1 else None) for i in range(8)], "ticker string, ts int, x double"))
    df = p.select(x=p.back_fill("x"))
    assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.x for r in df.orderBy("ts").collect()] == [1.0, 1.0, 4.0, 4.0, 4.0, 7.0, 7.0, 7.0]


@pytest.mark.parametrize("name", ["parkinson_vol", "garman_klass_vol", "rogers_satchell_vol", "rogers_satchell_lagged", "yang_zhang_vol"])
def test_range_estimators_are_infinite_at_a_price_of_zero(spark, name):
    f = frame(70)
    f.loc[25, "low"] = 0.0
    p = Panel(spark.createDataFrame(f, BARS))
    x = p.select(x=getattr(I, name)(p)).orderBy("ts").toPandas()["x"]
    n, late = (14, 1) if name == "rogers_satchell_lagged" else (20, 0)
    held = range(25 + late, 25 + late + n)
    assert [i for i in range(70) if x[i] == math.inf] == list(held)
    assert np.isfinite(x[held[-1] + 1 :]).all()


def test_mean_reversion_is_not_calm_at_a_price_of_zero(spark):
    f = frame(300, seed=8)
    f.loc[200, "low"] = 0.0
    got = SG._rolling_mean(pd.Series([1.0, math.inf, 2.0, np.nan, 3.0, np.nan]), pd.Series([True, True, True, False, True, True]), 2)
    assert got.tolist() == [1.0, math.inf, math.inf, 2.0, 3.0, math.inf]
    assert SG._below_quantile(pd.Series([1.0, math.inf, math.inf, 2.0]), 0.5).tolist() == [True, False, False, True]
    signal = SG.mean_reversion(spark.createDataFrame(f, BARS)).orderBy("ts").toPandas()["signal"]
    assert (signal[200:224] == 0).all() and (signal != 0).any()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")


def test_ticks_are_hashed_by_bar_in_their_order(spark):
    at = dt.datetime(2024, 3, 31, 2, 30)  # an hour that some time zones leave out
    rows = [("a", at, 3, 1.0), ("a", at, -2, 2.0), ("a", at, None, 7.0), ("a", at + dt.timedelta(minutes=29), 2**63 - 1, 4.0), ("a", at + dt.timedelta(minutes=29), -(2**63), 5.0), ("a", at + dt.timedelta(microseconds=1), -9, 6.0)]
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, id bigint, price double")
    df = B.from_ticks(ticks, "1h", tie=("id",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert [(r.open, r.close, r.high, r.low, r.volume) for r in df.collect()] == [(7.0, 4.0, 7.0, 1.0, 6.0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        late = spark.createDataFrame([("a", dt.datetime(2024, 3, 31, 2, 59), 1, 1.0), ("a", dt.datetime(2024, 3, 31, 3, 1), 1, 2.0)], "ticker string, ts timestamp_ntz, id bigint, price double")
        assert [(r.open, r.close) for r in B.from_ticks(late, "daily", tie=("id",)).collect()] == [(1.0, 2.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cleaning_reads_bars_once(spark):
    f = frame(120)
    f.loc[60, ["close", "high"]] *= 3
    f.loc[90, "low"] = 0.0
    none = frame(5, ticker="B").assign(close=-1.0)
    bars = spark.createDataFrame(pd.concat([f, f, none]), BARS)
    assert scans(B.drop_spikes(bars)) == 1
    kept, counters = B.clean(bars)
    assert scans(kept) == 1 and scans(counters) == 2
    got = {r.ticker: tuple(r)[1:] for r in counters.collect()}
    assert got == {"A": (240, 120, 0, 1, 1, 0, 119), "B": (5, 0, 5, 0, 0, 0, 0)} and kept.count() == 119


def test_sensitivity_reads_bars_once(spark):
    from tidemark.operators import evaluation as EV

    bars = spark.createDataFrame(frame(60).assign(position=lambda x: np.sign(np.sin(np.arange(60) / 5))), f"{BARS}, position double")
    df = EV.sensitivity(bars)
    assert scans(df) == 1
    got = {(r.config, r.ts): r.net for r in df.collect()}
    assert len(got) == 300
    for how, bps in (("next_open", 0.0), ("next_open", 7.0), ("next_open", 21.0), ("next_close", 7.0), ("same_close", 7.0)):
        assert {r.ts: r.net for r in P.simulate(bars, execution=how, bps=bps).collect()} == {ts: v for (c, ts), v in got.items() if c == f"{how}|{bps:g}"}


def test_drawdowns_stay_right_beyond_a_double(spark):
    rets = [9.0] * 400 + [-0.5, -0.2, 9.0, -0.9]
    rows = [("a", i, r) for i, r in enumerate(rets)] + [("b", i, r) for i, r in enumerate([0.1, -0.2, None, -1.0, 0.3])] + [("c", i, r) for i, r in enumerate([0.5, -3.0, -1.5, 0.25])]
    e = M.equity(spark.createDataFrame(rows, "ticker string, ts int, ret double"))
    assert e.columns == ["ticker", "ts", "ret", "equity", "peak", "drawdown"]
    low = {r.ticker: r.low for r in e.groupBy("ticker").agg(F.min("drawdown").alias("low")).collect()}
    assert math.isclose(low["a"], -0.9) and low["b"] == -1.0
    tail = e.filter("ticker = 'a' AND ts >= 400").orderBy("ts").toPandas()["drawdown"]
    assert np.allclose(tail, [-0.5, -0.6, 0.0, -0.9])
    turned = np.cumprod([1.5, -2.0, -0.5, 1.25])
    got = e.filter("ticker = 'c'").orderBy("ts").toPandas()
    assert np.allclose(got["equity"], turned) and np.allclose(got["drawdown"], turned / np.maximum.accumulate(turned) - 1)
    t = M.trade_stats(e.filter("ticker = 'a'").select("ticker", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(ts)").alias("entry"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(ts)").alias("exit"), "ret")).first()
    assert math.isclose(t.max_drawdown, -0.9)


def test_calmar_without_drawdown_is_infinite(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, 1 + i), 0.001 + i / 1e5) for i in range(9)], "date date, ret double")
    assert PF.portfolio_metrics(daily).first().calmar == math.inf
    assert PF.portfolio_metrics(daily.withColumn("ret", F.lit(0.0))).first().calmar == 0.0


def test_sleeves_read_their_trades_once(spark):
    from tidemark.plans import q_study

    trades = spark.createDataFrame([("s", dt.datetime(2024, 1, d), r) for d, r in ((1, 0.1), (1, 0.3), (2, 0.5))], "ticker string, exit_ts timestamp_ntz, ret double")
    daily = q_study.sleeve_days(spark, trades)
    assert scans(daily) == 0 and "Aggregate" not in daily._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in daily.collect()) == [("s", dt.date(2024, 1, 1), 0.2), ("s", dt.date(2024, 1, 2), 0.5)]


def test_leverage_by_batches_is_that_of_whole_books(spark, monkeypatch):
    g = np.random.default_rng(4)
    n = 25_000
    start = np.datetime64("2020-01-01", "us") + np.arange(n) * np.timedelta64(1, "h")
    f = pd.DataFrame({"strategy": "s", "entry_ts": start, "exit_ts": start + g.integers(1, 40, n) * np.timedelta64(1, "h"), "reason": np.where(g.random(n) < 0.3, "stop", "target"), "ret": g.normal(0.0002, 0.01, n)})
    r = BT.leverage(spark.createDataFrame(f.sample(frac=1, random_state=1)).repartition(3), 5.0, cap=10, paths=20).first()
    keep = BT.admit(f["entry_ts"].to_numpy().astype("int64"), f["exit_ts"].to_numpy().astype("int64"), 10)
    typical = f.loc[f["reason"] == "stop", "ret"].abs().mean()
    own = f["ret"].to_numpy()[keep] * min(0.01 / typical, 5.0)
    curve = 100_000.0 * np.concatenate(([1.0], np.cumprod(1 + own)))
    seeded = np.random.default_rng(0)
    lost = np.mean([(np.cumsum(seeded.choice(own, len(own))) <= -1).any() for _ in range(20)])
    assert (r.n_trades, r.n_skipped) == (keep.sum(), n - keep.sum()) and math.isclose(r.typical_stop, typical)
    assert math.isclose(r.final_equity, curve[-1], rel_tol=1e-9) and math.isclose(r.max_drawdown, (curve / np.maximum.accumulate(curve) - 1).min(), rel_tol=1e-9) and r.ruin_probability == lost
    monkeypatch.setattr(BT, "CHUNK", 1000)
    seeded, again = np.random.default_rng(0), np.random.default_rng(0)
    assert [BT._lost(own, again) for _ in range(20)] == [bool((np.cumsum(seeded.choice(own, len(own))) <= -1).any()) for _ in range(20)]
    assert math.isclose(BT._curve(own, 100_000.0)[1], r.max_drawdown, rel_tol=1e-12)
