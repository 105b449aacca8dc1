"""Queries: signals, rules and figures with several states at once, and SQL that follows them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as PF
from tidemark.operators import signals as SG
from tidemark.operators.positions import simulate
from tidemark.operators.rules import positions
from tidemark.plans import q_folds, q_positions, q_study
from tidemark.plans import sql as S
from tidemark.plans.q_bars import event_bars, rounded
from tidemark.plans.q_positions import book, crossing

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


B1, _e = S.BARS_1H, S.ema_step
_r21 = "(2.0::DOUBLE / 21)"
_y = _e("b.close", "y", _r21)
_dema = S.recursion(B1, {"y": "close", "z": "close"}, {"y": _y, "z": f"{_r21} * ({_y}) + (1 - {_r21}) * r.z"}, {"d": "2 * y - z"}, digits=None)


@query("normalized_dema", f"WITH q AS ({_dema}), w AS (SELECT ticker, ts, d, ({S.full('avg', 'd', 50)}) AS m, 2 * ({S.full('stddev_samp', 'd', 50)}) AS s FROM q) SELECT ticker, ts, round(100 * (d - m + s) / nullif(2 * s, 0), 4) AS x FROM w")
def normalized_dema(spark, d):
    return rounded(K.fold(event_bars(spark, d), {"x": "double"}, lambda f: {"x": K.normalized_dema(K.series(f, "close"))}).select("ticker", "ts", "x"), "x", digits=4)


_r172 = "(2.0::DOUBLE / 173)"
_off = S.recursion(B1, {"y": "close"}, {"y": _e("b.close", "y", _r172)}, {"off": "close - y", "v": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"}, digits=None)


@query("mean_reversion_signals", f"""WITH q AS ({_off}), w AS (SELECT ticker, ts, off, CASE WHEN count(off) OVER {S.w(148)} > 1 THEN stddev_samp(off) OVER {S.w(148)} END AS sd, sqrt(greatest(avg(v) OVER {S.w(24)}, 0)) AS rs, count(*) OVER (PARTITION BY ticker) AS n FROM q),
k AS (SELECT *, quantile_cont(rs, 0.15) OVER (PARTITION BY ticker) AS c FROM w) SELECT ticker, ts, CAST(CASE WHEN n < 172 THEN 0 WHEN off > sd AND rs < c THEN -1 WHEN off < -sd AND rs < c THEN 1 ELSE 0 END AS INTEGER) AS signal FROM k""")
def mean_reversion(spark, d):
    return SG.mean_reversion(event_bars(spark, d)).select("ticker", "ts", "signal")


_lx = [{"x": f"ln(nullif(abs({S.lag('close')} / nullif(close, 0)), 0))"}, {"step": f"abs(x - {S.lag('x')})"}, {"path": f"sum(step) OVER {S.w(10)}"}]
_lhp = S.recursion(B1, {"line": "0.0::DOUBLE"}, {"line": "CASE WHEN b.step IS NULL THEN r.line ELSE r.line + (b.step / CASE WHEN b.path = 0 THEN 1e-10 ELSE b.path END * (0.6 - 0.04) + 0.04) * (b.x - r.line) END"}, {"x": "x", "line": "line"}, _lx, digits=None)


@query("lhp_signals", f"""WITH q AS ({_lhp}), w AS (SELECT *, last_value(CASE WHEN x > line THEN line END IGNORE NULLS) OVER {S.CUM} AS up, last_value(CASE WHEN x < line THEN line END IGNORE NULLS) OVER {S.CUM} AS down FROM q)
SELECT ticker, ts, CAST(CASE WHEN x < down THEN -1 WHEN x > up THEN 1 ELSE 0 END AS INTEGER) AS signal FROM w""")
def lhp(spark, d):
    return SG.lhp_signals(event_bars(spark, d)).select("ticker", "ts", "signal")


_box = [S.TR, S.TR2, {"a": f"2 * ({S.full('avg', 'tr', 500)})", "m": S.full("avg", "close", 5), "vm": S.full("avg", "volume", 5)}, {"near": "CASE WHEN m IS NULL OR a IS NULL OR abs(close - m) <= a THEN 1 ELSE 0 END"}, {"quiet": f"coalesce(({S.full('sum', 'near', 5)}) = 5, false)", "up": "m + a", "down": "m - a"}]
_range = S.recursion(
    B1, {"t": "CASE WHEN quiet THEN up END", "u": "CASE WHEN quiet THEN down END", "inside": "quiet"},
    {"t": "CASE WHEN b.quiet AND NOT r.inside THEN b.up WHEN b.quiet THEN CASE WHEN r.t IS NOT NULL THEN greatest(r.t, coalesce(b.up, r.t)) END ELSE r.t END", "u": "CASE WHEN b.quiet AND NOT r.inside THEN b.down WHEN b.quiet THEN CASE WHEN r.u IS NOT NULL THEN least(r.u, coalesce(b.down, r.u)) END ELSE r.u END", "inside": "b.quiet"},
    {"signal": "CAST(CASE WHEN volume > 1.5 * vm AND close > t THEN 1 WHEN volume > 1.5 * vm AND close < u THEN -1 ELSE 0 END AS INTEGER)"}, _box, digits=None,
)


@query("range_breakout_signals", _range)
def range_breakout(spark, d):
    return SG.range_breakout(event_bars(spark, d)).select("ticker", "ts", "signal")


def _quad() -> str:
    """Every oscillator's marks by windows, and how many of them agree."""
    text, marks = [f"s0 AS ({B1})"], []
    for i, (n, d, smooth) in enumerate(((14, 3, 3), (21, 5, 3), (9, 3, 3), (28, 5, 5))):
        before = lambda k: f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        text += [
            f"a{i} AS (SELECT ticker, ts, close, CASE WHEN count(*) OVER {S.w(n)} >= {n} THEN 100 * (close - min(low) OVER {S.w(n)}) / nullif(max(high) OVER {S.w(n)} - min(low) OVER {S.w(n)}, 0) END AS raw FROM s0)",
            f"b{i} AS (SELECT *, {S.full('avg', 'raw', smooth)} AS k FROM a{i})", f"c{i} AS (SELECT *, {S.full('avg', 'k', d)} AS line FROM b{i})", f"d{i} AS (SELECT *, coalesce(line, 0) AS o, {S.lag('k')} AS bk, {S.lag('line')} AS bd FROM c{i})",
            f"e{i} AS (SELECT *, count(*) OVER {before(5)} >= 5 AND o < min(o) OVER {before(5)} AS low_, count(*) OVER {before(5)} >= 5 AND o > max(o) OVER {before(5)} AS high_, list({{'o': o, 'p': close}}) OVER {before(20)} AS past FROM d{i})",
            f"m{i} AS (SELECT ticker, ts, CAST(coalesce(low_ AND len(list_filter(past, lambda r: e{i}.o > r.o AND close < r.p)) > 0, false) AS INTEGER) AS bull, CAST(coalesce(high_ AND len(list_filter(past, lambda r: e{i}.o < r.o AND close > r.p)) > 0, false) AS INTEGER) AS bear, CAST(coalesce(bk < bd AND k > line, false) AS INTEGER) AS up, CAST(coalesce(bk > bd AND k < line, false) AS INTEGER) AS down FROM e{i})",
        ]
        marks.append(f"SELECT * FROM m{i}")
    return f"WITH {', '.join(text)}, t AS (SELECT ticker, ts, sum(bull) AS bull, sum(bear) AS bear, sum(up) AS up, sum(down) AS down FROM ({' UNION ALL '.join(marks)}) GROUP BY ALL) SELECT ticker, ts, CAST(CASE WHEN bull >= {{least}} AND up >= {{least}} THEN 1 WHEN bear >= {{least}} AND down >= {{least}} THEN -1 ELSE 0 END AS INTEGER) AS signal FROM t"


_QUAD = _quad()


def _quad_query(name: str, least: int) -> None:
    def run(spark, d):
        return SG.quad_stochastic(event_bars(spark, d), least=least).select("ticker", "ts", F.col("signal").cast("int").alias("signal"))

    query(name, _QUAD.replace("{least}", str(least)))(run)


_quad_query("quad_stochastic_signals", 2)
_quad_query("quad_stochastic_loose", 1)

_NET = "0.01 * (gross - turnover * 7.0 / 1e4) / (1 + abs(gross - turnover * 7.0 / 1e4))"
_BY = "PARTITION BY ticker ORDER BY ts"


@query("series_metrics", f"""WITH n AS (SELECT ticker, ts, held, turnover, turnover * 7.0 / 1e4 AS cost, {_NET} AS net FROM ({q_positions._sim('next_open')})),
e AS (SELECT *, exp(sum(ln(1 + net)) OVER ({_BY} ROWS UNBOUNDED PRECEDING)) AS eq, row_number() OVER ({_BY}) - 1 AS i, sign(held) AS side FROM n),
k AS (SELECT *, eq / max(eq) OVER ({_BY} ROWS UNBOUNDED PRECEDING) - 1 AS dd, CASE WHEN side = lag(side) OVER ({_BY}) THEN 0 ELSE 1 END AS fresh FROM e), q AS (SELECT *, sum(fresh) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS run FROM k),
t0 AS (SELECT ticker, run, exp(sum(ln(1 + net))) - 1 AS r, count(*) AS bars FROM q WHERE side <> 0 GROUP BY ALL), t AS (SELECT ticker, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS won, sum(r) FILTER (r > 0) / nullif(-sum(r) FILTER (r < 0), 0) AS pf, sum(bars) / count(*) AS hold FROM t0 GROUP BY ticker),
y AS (SELECT ticker, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS good FROM (SELECT ticker, year(ts), exp(sum(ln(1 + net))) - 1 AS r FROM q GROUP BY ALL) GROUP BY ticker),
g AS (SELECT ticker, count(*) AS n, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 365.25 AS years, last(eq ORDER BY ts) AS fin, avg(net) AS mu, stddev_samp(net) AS sd, sqrt(avg(pow(least(net, 0), 2))) AS down, min(dd) AS mdd, sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0) AS pf,
  skewness(net) AS skew, avg(CASE WHEN held <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS active, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (held <> 0) AS wind, sum(turnover) AS tov, sum(cost) AS cst, corr(i, ln(greatest(eq, 1e-12))) AS c FROM q GROUP BY ticker), z AS (SELECT *, sqrt(n / years) AS ann, pow(fin, 1 / years) - 1 AS cagr FROM g)
SELECT z.ticker, z.n AS n_bars, round(cagr, 5) AS cagr, round(fin - 1, 5) AS total_return, round(sd * ann, 5) AS ann_vol, round(mu / sd * ann, 4) AS sharpe, round(mu / down * ann, 4) AS sortino, round(cagr / abs(mdd), 4) AS calmar, round(mdd, 5) AS max_drawdown, round(wind::DOUBLE, 5) AS win_rate_days, round(t.won, 5) AS win_rate_trades,
round(z.pf, 4) AS profit_factor, round(t.pf, 4) AS profit_factor_trades, round(tov / years, 4) AS turnover, round(cst / years, 5) AS cost_drag, round(active, 5) AS exposure, CAST(t.trades AS DOUBLE) AS n_trades, round(t.hold, 5) AS avg_hold_bars, round(c * c * CASE WHEN c >= 0 THEN 1 ELSE -1 END, 5) AS stability_r2, round(y.good, 5) AS pct_pos_years, round(skew, 4) AS skew, round(years, 5) AS years
FROM z JOIN t USING (ticker) JOIN y USING (ticker)""")
def series_metrics(spark, d):
    own = simulate(crossing(spark, d)).withColumn("net", 0.01 * F.col("net") / (1 + F.abs("net")))
    g = M.series_metrics(own)
    four = ("sharpe", "sortino", "calmar", "profit_factor", "profit_factor_trades", "turnover", "skew")
    return rounded(rounded(g, *four, digits=4), *[c for c in g.columns if c not in {"ticker", "n_bars", "n_trades", *four}], digits=5)


def _sgn(x: str) -> str:
    return f"coalesce(sign({x}), 0)"


def _latch(up: str, down: str) -> str:
    return f"coalesce(last_value(CASE WHEN {up} THEN 1 WHEN {down} THEN -1 END IGNORE NULLS) OVER {S.CUM}, 0)"


_MEANS = ", ".join(f"({S.full('avg', 'close', n)}) AS m{n}" for n in (4, 9, 18, 50, 200))
_PASTS = ", ".join(f"close / nullif({S.lag('close', n)}, 0) - 1 AS c{n}" for n in (21, 63, 252))
_EXITS = f"SELECT *, {S.lag('hi')} AS ph, {S.lag('lo')} AS pl, {S.lag('xh')} AS qh, {S.lag('xl')} AS ql FROM (SELECT *, {S.full('max', 'high', 20)} AS hi, {S.full('min', 'low', 20)} AS lo, {S.full('max', 'high', 10)} AS xh, {S.full('min', 'low', 10)} AS xl FROM ({B1}))"
_turn = "CASE WHEN {c} > {p}ph AND NOT coalesce({c} < {p}pl, false) THEN 1.0 WHEN {c} < {p}pl AND NOT coalesce({c} > {p}ph, false) THEN -1.0"
_turtle = S.recursion(_EXITS, {"p": _turn.format(c="close", p="") + " ELSE 0.0 END"}, {"p": _turn.format(c="b.close", p="b.") + " WHEN r.p > 0 AND b.close < b.ql OR r.p < 0 AND b.close > b.qh THEN 0.0 ELSE r.p END"}, {"turtle_20_10": "p"}, digits=None)
_EMAS = S.recursion(B1, {"y": "close", "z": "close"}, {"y": _e("b.close", "y", "(2.0::DOUBLE / 13)"), "z": _e("b.close", "z", "(2.0::DOUBLE / 27)")}, {"ema_12_26": "CASE WHEN rn >= 26 THEN sign(y - z) ELSE 0 END"}, digits=None)
_SHOWN = ("sma_50_200", "triple_ma_4_9_18", "bll_vma_200", "tsmom_252", "tsmom_multi", "turtle_20_10", "ema_12_26", "macd_12_26_9", "psar", "supertrend_10_3")


@query("rule_values", f"""WITH w AS (SELECT *, {_MEANS}, {_PASTS} FROM ({B1})), v AS (SELECT ticker, ts, {_sgn('m50 - m200')} AS sma_50_200, CASE WHEN m4 > m9 AND m9 > m18 THEN 1 WHEN m4 < m9 AND m9 < m18 THEN -1 ELSE 0 END AS triple_ma_4_9_18, {_latch('close > m200 * 1.01', 'close < m200 * 0.99')} AS bll_vma_200,
{_sgn('c252')} AS tsmom_252, ({_sgn('c21')} + {_sgn('c63')} + {_sgn('c252')}) / 3 AS tsmom_multi FROM w)
SELECT v.ticker, v.ts, CAST(sma_50_200 AS DOUBLE) AS sma_50_200, CAST(triple_ma_4_9_18 AS DOUBLE) AS triple_ma_4_9_18, CAST(bll_vma_200 AS DOUBLE) AS bll_vma_200, CAST(tsmom_252 AS DOUBLE) AS tsmom_252, round(tsmom_multi, 6) AS tsmom_multi, CAST(turtle_20_10 AS DOUBLE) AS turtle_20_10, CAST(ema_12_26 AS DOUBLE) AS ema_12_26,
CAST({_sgn('hist')} AS DOUBLE) AS macd_12_26_9, CAST(p.trend AS DOUBLE) AS psar, CAST(s.trend AS DOUBLE) AS supertrend_10_3
FROM v JOIN ({_turtle}) t USING (ticker, ts) JOIN ({_EMAS}) e USING (ticker, ts) JOIN ({q_folds.ORACLE['macd']}) m USING (ticker, ts) JOIN ({q_folds.ORACLE['psar']}) p USING (ticker, ts) JOIN ({q_folds.ORACLE['supertrend']}) s USING (ticker, ts)""")
def rule_values(spark, d):
    return rounded(positions(event_bars(spark, d), list(_SHOWN)).select("ticker", "ts", *_SHOWN), "tsmom_multi")


_a6 = "(2.0::DOUBLE / 6)"


def _smooth(x: str, y: str, first: int) -> str:
    """The next value of an exponential mean y of x, which begins at a row."""
    return f"CASE WHEN b.rn < {first} THEN NULL WHEN r.{y} IS NULL THEN {x} ELSE {_a6} * ({x}) + (1 - {_a6}) * r.{y} END"


_e1 = _smooth("b.close", "e1", 1)
_e2 = _smooth(_e1, "e2", 5)
_e3 = _smooth(f"(1.7 * ({_e1}) - 0.7 * ({_e2}))", "e3", 9)
_e4 = _smooth(_e3, "e4", 13)
_e5 = _smooth(f"(1.7 * ({_e3}) - 0.7 * ({_e4}))", "e5", 17)
_e6 = _smooth(_e5, "e6", 21)
_reach = lambda n: f"(({S.full('max', 'high', n)}) - ({S.full('min', 'low', n)})) / {n}"
_rates = [
    {"h8": _reach(8), "w16": _reach(16), "ch": f"abs(close - {S.lag('close', 3)})", "st": f"abs(close - {S.lag('close')})"},
    {"hh": f"h8 + {S.lag('h8', 8)}", "er": S.div("ch", S.full("sum", "st", 3))},
    {"fr": "CASE WHEN hh > 0 AND w16 > 0 THEN least(greatest(pow(2.0::DOUBLE / 199, log2(hh / w16) - 1), 2.0::DOUBLE / 199), 1) END", "kr": "pow(er * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 51) + 2.0::DOUBLE / 51, 2)", "mid": "(high + low) / 2"},
]
_averages = S.recursion(
    B1, {**{f"e{k}": "close" if k == 1 else "CAST(NULL AS DOUBLE)" for k in range(1, 7)}, "fa": "CASE WHEN fr IS NOT NULL THEN mid END", "ka": "close"},
    {**dict(zip(("e1", "e2", "e3", "e4", "e5", "e6"), (_e1, _e2, _e3, _e4, _e5, _e6), strict=True)), "fa": "CASE WHEN b.fr IS NULL THEN r.fa WHEN r.fa IS NULL THEN b.mid ELSE r.fa + b.fr * (b.mid - r.fa) END", "ka": "CASE WHEN b.kr IS NULL THEN r.ka ELSE r.ka + b.kr * (b.close - r.ka) END"},
    {"t3": "CASE WHEN rn >= 25 THEN 1.7 * e5 - 0.7 * e6 END", "frama": "fa", "kama_core": "ka"}, _rates,
)


@query("adaptive_averages", _averages)
def adaptive_averages(spark, d):
    close = lambda f: K.series(f, "close")
    kernel = lambda f: {"t3": K.t3(close(f), 5), "frama": K.frama(f), "kama_core": K.kama(close(f), 3, 2, 50, at_once=True)}
    names = ("t3", "frama", "kama_core")
    return rounded(K.fold(event_bars(spark, d), dict.fromkeys(names, "double"), kernel).select("ticker", "ts", *names), *names)


_SLEEVES = q_study.ORACLE["sleeves_inverse_vol"].replace("round(sum(ret * v / vs), 6) AS ret", "sum(ret * v / vs) AS ret")


@query("combined_sleeves", f"""WITH p AS ({_SLEEVES}), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM p), k AS (SELECT *, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
g AS (SELECT count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS s, last(eq ORDER BY date) AS eq, min(dd) AS dd FROM k) SELECT round((m - 0.06 / 252) / s * sqrt(252), 4) AS sharpe, round(pow(eq, 252.0::DOUBLE / n) - 1, 5) AS cagr, round(dd, 5) AS max_drawdown, round((pow(eq, 252.0::DOUBLE / n) - 1) / abs(dd), 4) AS calmar, round(s * sqrt(252), 5) AS annual_vol, n AS n_days FROM g""")
def combined_sleeves(spark, d):
    daily = q_study.sleeve_days(spark, book(spark, d))
    names = [r[0] for r in daily.select("sleeve").distinct().orderBy("sleeve").collect()]
    mean, cov, _ = PF.sleeve_moments(daily, names)
    shares = PF.weights(mean, cov, "inverse_vol")
    g = PF.portfolio_metrics(PF.combine(daily, dict(zip(names, shares.tolist(), strict=True))))
    return rounded(rounded(g, "sharpe", "calmar", digits=4), "cagr", "max_drawdown", "annual_vol", digits=5)
