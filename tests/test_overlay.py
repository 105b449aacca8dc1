"""The overlay run: what each stage may do to a position, and what it may know."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import RULES, positions
from tidemark.plans import overlay_run as O

BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
FOLD = {"label": "f", "train_start": None, "val_start": "2002-01-01", "test_start": "2002-06-01", "test_end": "2002-10-01"}
RULE = "ema_12_26"


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for k in range(3):
        g = np.random.default_rng(k)
        c = 100 * np.exp(np.cumsum(g.normal(0, 0.012, 720) + 0.004 * np.sin(np.arange(720) / (15 + 5 * k))))
        o = np.concatenate(([100.0], c[:-1]))
        rows += [(f"t{k}", dt.datetime(2000, 11, 1) + dt.timedelta(days=i), float(a), float(max(a, b) * 1.003), float(min(a, b) * 0.997), float(b), float(g.integers(100, 900))) for i, (a, b) in enumerate(zip(o, c, strict=True))]
    return spark.createDataFrame(rows, BARS)


def test_what_stages_do_to_positions(spark, bars):
    moved, choices = O.run(bars, RULE, [FOLD], O.Settings(least=30))
    rows = moved.collect()
    assert {r.stage for r in rows} == set(O.INTENSITY) and {r.stage for r in choices.collect() if r.selected} == set(O.INTENSITY)
    assert all(dt.datetime(2002, 6, 1) <= r.ts < dt.datetime(2002, 10, 1) for r in rows)
    held = {f"v{i}": (RULE, RULES[RULE].variant(f) if f != 1.0 else dict(RULES[RULE].params)) for i, f in enumerate(O.FACTORS)}
    variants = {(r.ticker, r.ts): (r.v0, r.v1, r.v2) for r in positions(bars, held).collect()}
    by = {}
    for r in rows:
        by.setdefault((r.stage, r.ticker), []).append(r)
        assert r.base == variants[(r.ticker, r.ts)][O.BASE]
        if r.stage in ("filter", "gate", "exit"):
            assert r.position in (0.0, r.base)
        elif r.stage == "sizing":
            assert 0 <= r.position * r.base <= 2 * r.base * r.base + 1e-9
        else:
            assert r.position in variants[(r.ticker, r.ts)]
    for (stage, _), own in by.items():
        own.sort(key=lambda r: r.ts)
        runs = np.cumsum([i == 0 or own[i].base != own[i - 1].base for i in range(len(own))])
        for k in set(runs.tolist()):
            part = [r.position != 0 for r, n in zip(own, runs, strict=True) if n == k]
            if stage == "filter":
                assert len(set(part)) == 1
            elif stage == "exit":  # once out, out until the next trade
                assert part == sorted(part, reverse=True)
    assert any(r.position != r.base for r in rows if r.stage == "filter") or any(r.position != r.base for r in rows if r.stage == "exit")


def test_nothing_is_learned_from_later_rows(spark, bars):
    """Other prices after validation change no choice and no position before them."""
    late = F.col("ts") >= F.lit("2002-08-01").cast("timestamp_ntz")
    other = bars.withColumns({c: F.when(late, F.col(c) * (1.5 + F.sin(F.dayofyear("ts")) / 3)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    s = O.Settings(least=30, stages=("filter", "gate", "exit"))
    (a, ca), (b, cb) = (O.run(x, RULE, [FOLD], s) for x in (bars, other))
    # validation ends in June: with an embargo no label of a row before it looks past July
    assert [(r.stage, r.intensity, round(r.val_sharpe, 6)) for r in ca.collect()] == [(r.stage, r.intensity, round(r.val_sharpe, 6)) for r in cb.collect()]
    early = F.col("ts") < F.lit("2002-07-31").cast("timestamp_ntz")
    told = lambda df: sorted((r.stage, r.ticker, r.ts, r.position) for r in df.filter(early).collect())
    assert told(a) == told(b)


def test_too_little_to_learn_from_leaves_positions_alone(spark, bars):
    moved, choices = O.run(bars.limit(700), RULE, [FOLD], O.Settings(least=10**6, stages=("filter", "sizing", "variant")))
    assert all(r.position == r.base for r in moved.collect()) and choices.count() == 3
