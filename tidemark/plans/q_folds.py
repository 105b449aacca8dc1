"""Queries: recursive indicators, trade scans, rules, features and campaigns. The recursive SQL walks row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import backtest as BT
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as PF
from tidemark.operators import signals as SG
from tidemark.operators.features import NAMES, features
from tidemark.operators.rules import RULES, positions
from tidemark.plans import campaign
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


def folded(name: str, kernel, out: dict[str, str], oracle: str, digits: int = S.DIGITS):
    """A query of one kernel over hourly bars: `out` names its columns and their types."""

    def run(spark, d):
        df = K.fold(event_bars(spark, d), out, lambda f: dict(zip(out, (np.asarray(x, float) for x in kernel(f)), strict=True)))
        reals = [n for n, t in out.items() if t == "double"]
        return rounded(df.select("ticker", "ts", *out), *reals, digits=digits)

    query(name, oracle)(run)


_c = lambda f: K.series(f, "close")
_e, B1 = S.ema_step, S.BARS_1H
folded("ema", lambda f: (K.ema(_c(f), 10),), {"ema": "double"}, S.recursion(B1, {"y": "close"}, {"y": _e("b.close", "y", "(2.0::DOUBLE / 11)")}, {"ema": "CASE WHEN rn >= 10 THEN y END"}))
folded("ema_no_warmup", lambda f: (K.ema(_c(f), 10, 1),), {"ema": "double"}, S.recursion(B1, {"y": "close"}, {"y": _e("b.close", "y", "(2.0::DOUBLE / 11)")}, {"ema": "y"}))
folded("wilder_atr", lambda f: (K.atr(f, 14),), {"atr": "double"}, S.recursion(B1, {"y": "tr"}, {"y": _e("b.tr", "y", "(1.0::DOUBLE / 14)")}, {"atr": "CASE WHEN rn >= 14 THEN y END"}, [S.TR, S.TR2]))
_gain = {"g": f"greatest(close - {S.lag('close')}, 0)", "l": f"greatest({S.lag('close')} - close, 0)", "has": f"{S.lag('close')} IS NOT NULL"}
_gain2 = {"g1": "CASE WHEN has THEN g END", "l1": "CASE WHEN has THEN l END"}
_nul = "CAST(NULL AS DOUBLE)"
folded("rsi", lambda f: (K.rsi(_c(f), 14),), {"rsi": "double"}, S.recursion(B1, {"y": _nul, "z": _nul}, {"y": _e("b.g1", "y", "(1.0::DOUBLE / 14)"), "z": _e("b.l1", "z", "(1.0::DOUBLE / 14)")}, {"rsi": "CASE WHEN rn >= 15 THEN 100 - 100 / (1 + y / nullif(z, 0)) END"}, [_gain, _gain2]))
folded("rsi_simple", lambda f: (K.rsi_simple(_c(f), 14),), {"rsi": "double"}, S.recursion(B1, {"y": _nul, "z": _nul}, {"y": _e("b.g1", "y", "(1.0::DOUBLE / 14)"), "z": _e("b.l1", "z", "(1.0::DOUBLE / 14)")}, {"rsi": "100 - 100 / (1 + y / CASE WHEN z = 0 THEN 1e-12 ELSE z END)"}, [_gain, _gain2], digits=4), 4)
_f26, _f12, _f9 = "(2.0::DOUBLE / 27)", "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 10)"
_line = f"({_e('b.close', 'y', _f12)}) - ({_e('b.close', 'z', _f26)})"
folded("macd", lambda f: K.macd(_c(f)), {"line": "double", "trail": "double", "hist": "double"},
       S.recursion(B1, {"y": "close", "z": "close", "s": _nul}, {"y": _e("b.close", "y", _f12), "z": _e("b.close", "z", _f26), "s": f"CASE WHEN b.rn < 26 THEN NULL WHEN r.s IS NULL THEN {_line} ELSE {_f9} * ({_line}) + (1 - {_f9}) * r.s END"},
                   {"line": "CASE WHEN rn >= 26 THEN y - z END", "trail": "CASE WHEN rn >= 34 THEN s END", "hist": "CASE WHEN rn >= 34 THEN y - z - s END"}))
folded("macd_adjusted", lambda f: K.macd(_c(f), adjust=True)[:1], {"line": "double"},
       S.recursion(B1, {"a": "close", "aw": "1.0::DOUBLE", "b2": "close", "bw": "1.0::DOUBLE"}, {"a": f"b.close + (1 - {_f12}) * r.a", "aw": f"1 + (1 - {_f12}) * r.aw", "b2": f"b.close + (1 - {_f26}) * r.b2", "bw": f"1 + (1 - {_f26}) * r.bw"}, {"line": "a / aw - b2 / bw"}))
_dm = {"up": f"high - {S.lag('high')}", "dn": f"{S.lag('low')} - low"}
_dm2 = {"pd": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "md": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}
_w14 = "(1.0::DOUBLE / 14)"
_step = {k: _e(f"b.{x}", k, _w14) for k, x in (("t", "tr"), ("p", "pd"), ("m", "md"))}
folded("dmi_adx", lambda f: K.dmi(f, 14), {"plus": "double", "minus": "double", "adx": "double"},
       S.recursion(f"""WITH RECURSIVE q0 AS ({B1}), q1 AS (SELECT *, {S.TR['pc']} AS pc, {_dm['up']} AS up, {_dm['dn']} AS dn FROM q0), q2 AS (SELECT *, {S.TR2['tr']} AS tr, {_dm2['pd']} AS pd, {_dm2['md']} AS md FROM q1), qb AS (SELECT *, row_number() OVER {S.WO} AS k FROM q2),
       qr AS (SELECT qb.*, tr AS t, pd AS p, md AS m FROM qb WHERE k = 1 UNION ALL SELECT b.*, {_step['t']}, {_step['p']}, {_step['m']} FROM qr r JOIN qb b ON b.ticker = r.ticker AND b.k = r.k + 1)
       SELECT ticker, ts, k, 100 * p / nullif(t, 0) AS plus, 100 * m / nullif(t, 0) AS minus, CASE WHEN k >= 14 THEN 100 * abs(100 * p / nullif(t, 0) - 100 * m / nullif(t, 0)) / nullif(100 * p / nullif(t, 0) + 100 * m / nullif(t, 0), 0) END AS dx FROM qr""",
                   {"y": "dx"}, {"y": _e("b.dx", "y", _w14)}, {"plus": "CASE WHEN rn >= 14 THEN plus END", "minus": "CASE WHEN rn >= 14 THEN minus END", "adx": "CASE WHEN rn >= 27 THEN y END"}))
_er = [{"ch": f"abs(close - {S.lag('close', 10)})", "st": f"abs(close - {S.lag('close')})"}, {"er": S.div("ch", S.full("sum", "st", 10))}, {"sc": "pow(er * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2)"}]
folded("kama", lambda f: (K.kama(_c(f), 10, 2, 30),), {"kama": "double"}, S.recursion(B1, {"y": "CASE WHEN sc IS NOT NULL THEN close END"}, {"y": "CASE WHEN r.y IS NULL THEN CASE WHEN b.sc IS NOT NULL THEN b.close END WHEN b.sc IS NULL THEN r.y ELSE r.y + b.sc * (b.close - r.y) END"}, {"kama": "y"}, _er))
_cm = [{"dx": f"close - {S.lag('close')}"}, {"u": "CASE WHEN dx IS NOT NULL THEN greatest(dx, 0) END", "v": "CASE WHEN dx IS NOT NULL THEN greatest(-dx, 0) END"}, {"su": S.full("sum", "u", 9), "sv": S.full("sum", "v", 9)}, {"sc": f"2.0::DOUBLE / 15 * abs({S.div('su - sv', 'su + sv')})"}]
folded("vidya", lambda f: (K.vidya(_c(f), 14),), {"vidya": "double"}, S.recursion(B1, {"y": "CASE WHEN sc IS NOT NULL THEN close END"}, {"y": "CASE WHEN r.y IS NULL THEN CASE WHEN b.sc IS NOT NULL THEN b.close END WHEN b.sc IS NULL THEN r.y ELSE r.y + b.sc * (b.close - r.y) END"}, {"vidya": "y"}, _cm))
folded("mcginley", lambda f: (K.mcginley(_c(f), 14),), {"mcginley": "double"}, S.recursion(B1, {"y": "close"}, {"y": "r.y + (b.close - r.y) / greatest(14 * pow(b.close / r.y, 4), 1)"}, {"mcginley": "y"}))
_jb = 0.45 * 6 / (0.45 * 6 + 2)
_ja = _jb**2
_m1 = f"((1 - {_ja!r}) * b.close + {_ja!r} * r.m1)"
_d0 = f"((b.close - {_m1}) * (1 - {_jb!r}) + {_jb!r} * r.d0)"
_d1 = f"(({_m1} + 1.5 * {_d0} - r.jm) * pow(1 - {_ja!r}, 2) + pow({_ja!r}, 2) * r.d1)"
folded("jma", lambda f: (K.jma(_c(f), 7),), {"jma": "double"}, S.recursion(B1, {"m1": "close", "d0": "close", "d1": "close", "jm": "close"}, {"m1": _m1, "d0": _d0, "d1": _d1, "jm": f"r.jm + {_d1}"}, {"jma": "CASE WHEN rn > 7 THEN jm END"}))
_gain_k = "((r.pe + 1e-5) / (r.pe + 1e-5 + 1e-2))"
folded("kalman", lambda f: (K.kalman(_c(f)),), {"estimate": "double"}, S.recursion(B1, {"y": "close", "pe": "1.0::DOUBLE"}, {"y": f"r.y + {_gain_k} * (b.close - r.y)", "pe": f"(1 - {_gain_k}) * (r.pe + 1e-5)"}, {"estimate": "y"}))
folded("heikin_ashi", K.heikin_ashi, {"ha_open": "double", "ha_close": "double"}, S.recursion(B1, {"o": "(open + close) / 2", "c": "(open + high + low + close) / 4"}, {"o": "(r.o + r.c) / 2", "c": "(b.open + b.high + b.low + b.close) / 4"}, {"ha_open": "o", "ha_close": "c"}))
_s1 = "(r.s + r.af * (r.ep - r.s))"
_su = f"least({_s1}, b.l1, coalesce(b.l2, b.l1))"
_sd = f"greatest({_s1}, b.h1, coalesce(b.h2, b.h1))"
_flip = f"(CASE WHEN r.up THEN b.low < {_su} ELSE b.high > {_sd} END)"
folded("psar", lambda f: K.psar(f), {"sar": "double", "trend": "int"},
       S.recursion(B1, {"up": "hn >= high", "ep": "CASE WHEN hn >= high THEN hn ELSE ln_ END", "s": "CASE WHEN hn >= high THEN low ELSE high END", "af": "0.02::DOUBLE"},
                   {"up": f"CASE WHEN {_flip} THEN NOT r.up ELSE r.up END", "ep": f"CASE WHEN {_flip} THEN CASE WHEN r.up THEN b.low ELSE b.high END WHEN r.up THEN greatest(r.ep, b.high) ELSE least(r.ep, b.low) END", "s": f"CASE WHEN {_flip} THEN r.ep WHEN r.up THEN {_su} ELSE {_sd} END",
                    "af": f"CASE WHEN {_flip} THEN 0.02 WHEN r.up AND b.high > r.ep OR NOT r.up AND b.low < r.ep THEN least(r.af + 0.02, 0.2) ELSE r.af END"},
                   {"sar": "CASE WHEN rn > 1 THEN s END", "trend": "CAST(CASE WHEN rn = 1 THEN 0 WHEN up THEN 1 ELSE -1 END AS INTEGER)"}, [{"hn": S.lead("high"), "ln_": S.lead("low"), "h1": S.lag("high"), "h2": S.lag("high", 2), "l1": S.lag("low"), "l2": S.lag("low", 2)}]))
_fu = "(CASE WHEN b.u < r.fu OR b.pc > r.fu THEN b.u ELSE r.fu END)"
_fl = "(CASE WHEN b.d > r.fl OR b.pc < r.fl THEN b.d ELSE r.fl END)"
_atr10 = f"""WITH RECURSIVE q0 AS ({B1}), q1 AS (SELECT *, {S.TR['pc']} AS pc FROM q0), q2 AS (SELECT *, {S.TR2['tr']} AS tr FROM q1), qb AS (SELECT *, row_number() OVER {S.WO} AS k FROM q2), qr AS (SELECT qb.*, tr AS a FROM qb WHERE k = 1 UNION ALL SELECT b.*, 0.1 * b.tr + 0.9 * r.a FROM qr r JOIN qb b ON b.ticker = r.ticker AND b.k = r.k + 1)
SELECT *, CASE WHEN k >= 10 THEN (high + low) / 2 + 3 * a END AS u, CASE WHEN k >= 10 THEN (high + low) / 2 - 3 * a END AS d FROM qr"""
_way = f"CASE WHEN b.u IS NULL THEN r.t WHEN r.fu IS NULL THEN CASE WHEN b.close >= (b.u + b.d) / 2 THEN 1 ELSE -1 END WHEN r.t <= 0 AND b.close > {_fu} THEN 1 WHEN r.t >= 0 AND b.close < {_fl} THEN -1 ELSE r.t END"
folded("supertrend", K.supertrend, {"trend": "int", "line": "double"}, S.recursion(_atr10, {"fu": _nul, "fl": _nul, "t": "0"}, {"fu": f"CASE WHEN b.u IS NULL THEN r.fu WHEN r.fu IS NULL THEN b.u ELSE {_fu} END", "fl": f"CASE WHEN b.u IS NULL THEN r.fl WHEN r.fl IS NULL THEN b.d ELSE {_fl} END", "t": _way}, {"trend": "CAST(CASE WHEN u IS NULL THEN 0 ELSE t END AS INTEGER)", "line": "CASE WHEN u IS NOT NULL THEN CASE WHEN t > 0 THEN fl ELSE fu END END"}, digits=5), 5)
_hw = lambda agg, x, n: f"{agg}({x}) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_ht = [{"hp": _hw("max", "high", 2), "lp": _hw("min", "low", 2), "hm": f"CASE WHEN row_number() OVER {S.WO} > 2 THEN {_hw('avg', 'high', 1)} ELSE {_hw('avg', 'high', 2)} END", "lm": f"CASE WHEN row_number() OVER {S.WO} > 2 THEN {_hw('avg', 'low', 1)} ELSE {_hw('avg', 'low', 2)} END", "ph": S.lag("high"), "pl": S.lag("low")}]
_top, _bot = "greatest(b.lp, r.top)", "least(b.hp, r.bot)"
_toDown, _toUp = f"(r.t = 0 AND b.hm < {_top} AND b.close < b.pl)", f"(r.t = 1 AND b.lm > {_bot} AND b.close > b.ph)"
_ntop = f"CASE WHEN r.t = 0 THEN {_top} WHEN {_toUp} THEN b.lp ELSE r.top END"
_nbot = f"CASE WHEN r.t = 1 THEN {_bot} WHEN {_toDown} THEN b.hp ELSE r.bot END"
_nt = f"CASE WHEN {_toDown} THEN 1 WHEN {_toUp} THEN 0 ELSE r.t END"
_nup = f"CASE WHEN ({_nt}) = 1 THEN r.up WHEN r.t = 1 THEN r.down ELSE greatest({_ntop}, r.up) END"
_ndn = f"CASE WHEN ({_nt}) = 0 THEN r.down WHEN r.t = 0 THEN r.up ELSE least({_nbot}, r.down) END"
folded("halftrend", lambda f: [K.halftrend(f)[k] for k in ("line", "trend", "flip")], {"line": "double", "trend": "int", "flip": "int"},
       S.recursion(B1, {"top": "low", "bot": "high", "up": "low", "down": "high", "t": "0", "fl": "0", "line0": "close"}, {"top": _ntop, "bot": _nbot, "up": _nup, "down": _ndn, "t": _nt, "fl": f"CASE WHEN {_toUp} THEN 1 WHEN {_toDown} THEN 2 ELSE 0 END", "line0": f"CASE WHEN ({_nt}) = 0 THEN {_nup} ELSE {_ndn} END"}, {"line": "line0", "trend": "CAST(t AS INTEGER)", "flip": "CAST(fl AS INTEGER)"}, _ht))
_alpha = "(2.0::DOUBLE / 61)"
_nm = f"((r.ow * (1 - {_alpha}) * r.mean + {_alpha} * b.lr) / (r.ow * (1 - {_alpha}) + {_alpha}))"
folded("ew_std", lambda f: (K.ew_std(np.log(_c(f)).diff()),), {"sd": "double"},
       S.recursion(f"SELECT *, row_number() OVER {S.WO} AS k FROM (SELECT ticker, ts, ln(close) - ln({S.lag('close')}) AS lr FROM ({B1})) WHERE lr IS NOT NULL", {"mean": "lr", "cov": "0.0::DOUBLE", "sw": "1.0::DOUBLE", "sw2": "1.0::DOUBLE", "ow": "1.0::DOUBLE"},
                   {"mean": _nm, "cov": f"(r.ow * (1 - {_alpha}) * (r.cov + pow(r.mean - {_nm}, 2)) + {_alpha} * pow(b.lr - {_nm}, 2)) / (r.ow * (1 - {_alpha}) + {_alpha})", "sw": f"r.sw * (1 - {_alpha}) + {_alpha}", "sw2": f"r.sw2 * pow(1 - {_alpha}, 2) + pow({_alpha}, 2)", "ow": f"r.ow * (1 - {_alpha}) + {_alpha}"},
                   {"sd": "CASE WHEN rn >= 20 THEN sqrt(cov * sw * sw / (sw * sw - sw2)) END"}) + f" UNION ALL SELECT ticker, min(ts), NULL FROM ({B1}) GROUP BY ticker")
folded("keltner", lambda f: K.keltner(f, 20, 10, 2.0), {"mid": "double", "upper": "double", "lower": "double"},
       S.recursion(B1, {"y": "close", "a": "tr"}, {"y": _e("b.close", "y", "(2.0::DOUBLE / 21)"), "a": _e("b.tr", "a", "0.1::DOUBLE")}, {"mid": "CASE WHEN rn >= 20 THEN y END", "upper": "CASE WHEN rn >= 20 THEN y + 2 * a END", "lower": "CASE WHEN rn >= 20 THEN y - 2 * a END"}, [S.TR, S.TR2]))
folded("trix", lambda f: (K.trix(_c(f), 5),), {"trix": "double"},
       S.recursion(f"""WITH RECURSIVE q0 AS (SELECT *, ln(close) AS x, row_number() OVER {S.WO} AS k FROM ({B1})), q AS (SELECT q0.*, x AS a, CAST(NULL AS DOUBLE) AS b1, CAST(NULL AS DOUBLE) AS c1 FROM q0 WHERE k = 1 UNION ALL
       SELECT b.*, b.x / 3 + r.a * 2 / 3, CASE WHEN b.k < 5 THEN NULL WHEN r.b1 IS NULL THEN b.x / 3 + r.a * 2 / 3 ELSE (b.x / 3 + r.a * 2 / 3) / 3 + r.b1 * 2 / 3 END, CASE WHEN b.k < 9 THEN NULL WHEN r.c1 IS NULL THEN (b.x / 3 + r.a * 2 / 3) / 3 + r.b1 * 2 / 3 ELSE ((b.x / 3 + r.a * 2 / 3) / 3 + r.b1 * 2 / 3) / 3 + r.c1 * 2 / 3 END FROM q r JOIN q0 b ON b.ticker = r.ticker AND b.k = r.k + 1)
       SELECT ticker, ts, k, CASE WHEN k >= 13 THEN c1 END AS c1 FROM q""", {"y": "0"}, {"y": "0"}, {"trix": "1e4 * (c1 - p)"}, [{"p": S.lag("c1")}], digits=4), 4)  # fmt: skip

_ATR = f"SELECT *, {S.full('avg', 'tr', 14)} AS a FROM (SELECT *, {S.TR2['tr']} AS tr FROM (SELECT *, {S.TR['pc']} AS pc, {S.lag('f')} AS pf, {S.lag('g')} AS pg FROM (SELECT *, ({S.full('avg', 'close', 5)}) AS f, ({S.full('avg', 'close', 20)}) AS g FROM ({B1}))))"
_SIG = f"SELECT *, CASE WHEN f > g AND pf <= pg THEN 1 WHEN f < g AND pf >= pg THEN -1 ELSE 0 END AS sig FROM ({_ATR})"


def signalled(spark, d):
    p = SG.Panel(event_bars(spark, d))
    p.let(SG.cross_signal(p, p.mean("close", 5), p.mean("close", 20)), "signal")
    return p.drop_temporary()


_ENTER = "b.sig <> 0 AND b.a IS NOT NULL AND b.rn < b.n"


def _scan_sql(trailing: bool) -> str:
    if trailing:
        stop = "(CASE WHEN r.pos = 1 THEN greatest(r.stop, b.close - 3 * coalesce(b.a, r.ea)) ELSE least(r.stop, b.close + 3 * coalesce(b.a, r.ea)) END)"
        hit, px, why = f"(r.pos = 1 AND b.close <= {stop} OR r.pos = -1 AND b.close >= {stop})", stop, "'stop'"
    else:
        stop = "r.stop"
        lost, won = "(r.pos = 1 AND b.close <= r.stop OR r.pos = -1 AND b.close >= r.stop)", "(r.pos = 1 AND b.close >= r.goal OR r.pos = -1 AND b.close <= r.goal)"
        hit, px, why = f"({lost} OR {won})", f"CASE WHEN {lost} THEN r.stop ELSE r.goal END", f"CASE WHEN {lost} THEN 'stop' ELSE 'target' END"
    ends = f"(r.pos <> 0 AND ({hit} OR b.rn = b.n))"
    keep = lambda name: f"CASE WHEN r.pos <> 0 AND NOT {ends} THEN r.{name} WHEN r.pos = 0 AND {_ENTER} THEN {{}} END"
    first = "sig <> 0 AND a IS NOT NULL AND rn < n"
    return S.recursion(
        _SIG,
        {"pos": f"CASE WHEN {first} THEN sig ELSE 0 END", "entry": f"CASE WHEN {first} THEN close END", "ets": f"CASE WHEN {first} THEN ts END", "stop": f"CASE WHEN {first} THEN close - sig * 1.5 * a END", "goal": f"CASE WHEN {first} THEN close + sig * 3 * a END", "ea": "a", "xp": _nul, "xw": "CAST(NULL AS VARCHAR)", "xd": "0", "xe": _nul, "xt": "CAST(NULL AS TIMESTAMP)"},
        {
            "pos": f"CASE WHEN r.pos <> 0 THEN CASE WHEN {ends} THEN 0 ELSE r.pos END WHEN {_ENTER} THEN b.sig ELSE 0 END", "entry": keep("entry").format("b.close"), "ets": keep("ets").format("b.ts"),
            "stop": f"CASE WHEN r.pos <> 0 AND NOT {ends} THEN {stop} WHEN r.pos = 0 AND {_ENTER} THEN b.close - b.sig * 1.5 * b.a END", "goal": keep("goal").format("b.close + b.sig * 3 * b.a"), "ea": keep("ea").format("b.a"),
            "xp": f"CASE WHEN {ends} THEN CASE WHEN {hit} THEN {px} ELSE b.close END END", "xw": f"CASE WHEN {ends} THEN CASE WHEN {hit} THEN {why} ELSE 'eod' END END", "xd": f"CASE WHEN {ends} THEN r.pos ELSE 0 END", "xe": f"CASE WHEN {ends} THEN r.entry END", "xt": f"CASE WHEN {ends} THEN r.ets END",
        },
        {"entry_price": "xe", "exit_price": "xp", "ret": "xd * (xp - xe) / xe - 0.0007"},
        where="WHERE xd <> 0", digits=5, keys="ticker, xt AS entry_ts, ts AS exit_ts, CAST(xd AS INTEGER) AS direction, xw AS reason",
    )


@query("trade_scan_fixed", _scan_sql(False))
def trade_scan_fixed(spark, d):
    return rounded(BT.backtest(signalled(spark, d)).drop("pnl"), "entry_price", "exit_price", "ret", digits=5)


@query("trade_scan_trailing", _scan_sql(True))
def trade_scan_trailing(spark, d):
    return rounded(BT.backtest(signalled(spark, d), trail=3.0).drop("pnl"), "entry_price", "exit_price", "ret", digits=5)


# without SQL: many states at once, resampling or fitted models; held by tests against brute force and by causality
@query("rule_positions")
def rule_positions(spark, d):
    return positions(event_bars(spark, d)).select("ticker", "ts", *RULES)


@query("features_56")
def features_56(spark, d):
    return features(event_bars(spark, d)).select("ticker", "ts", *NAMES)


@query("rule_metrics")
def rule_metrics(spark, d):
    return campaign.evaluate_rules(event_bars(spark, d, "4h"))


@query("campaign_grid")
def campaign_grid(spark, d):
    return M.trade_stats(campaign.run_grid(event_bars(spark, d), SG.jma_signals, {"fast": [5, 7], "slow": [15, 21]}), ("ticker", "param_id", "stop_mult", "target_mult"), entry="entry_ts", exit="exit_ts")


@query("campaign_walk_forward")
def campaign_walk_forward(spark, d):
    return campaign.walk_forward(event_bars(spark, d), SG.jma_signals, {"fast": [5, 7], "slow": [15, 21]}, splits=4)


@query("halftrend_session_signals")
def halftrend_session(spark, d):
    return SG.halftrend_signals(event_bars(spark, d)).select("ticker", "ts", "signal")


@query("ltp_kama_signals")
def ltp_kama(spark, d):
    return SG.ltp_kama_signals(event_bars(spark, d)).select("ticker", "ts", "signal")


@query("smc_signals")
def smc(spark, d):
    return SG.smc_signals(event_bars(spark, d), 20, 5, 50, 100).select("ticker", "ts", "signal")


@query("rainflow_signals")
def rainflow(spark, d):
    return SG.rainflow(event_bars(spark, d)).select("ticker", "ts", "signal")


@query("leverage_book")
def leverage_book(spark, d):
    return BT.leverage(book(spark, d).withColumnRenamed("ticker", "strategy"), 5.0, cap=10)


_r10 = "(2.0::DOUBLE / 11)"
_y = _e("b.close", "y", _r10)
_z = f"CASE WHEN b.rn < 10 THEN NULL WHEN r.z IS NULL THEN {_y} ELSE {_r10} * ({_y}) + (1 - {_r10}) * r.z END"
_x = f"CASE WHEN b.rn < 19 THEN NULL WHEN r.x IS NULL THEN {_z} ELSE {_r10} * ({_z}) + (1 - {_r10}) * r.x END"
folded("dema", lambda f: (K.dema(_c(f), 10),), {"dema": "double"}, S.recursion(B1, {"y": "close", "z": _nul}, {"y": _y, "z": _z}, {"dema": "CASE WHEN rn >= 19 THEN 2 * y - z END"}))
folded("tema", lambda f: (K.tema(_c(f), 10),), {"tema": "double"}, S.recursion(B1, {"y": "close", "z": _nul, "x": _nul}, {"y": _y, "z": _z, "x": _x}, {"tema": "CASE WHEN rn >= 28 THEN 3 * y - 3 * z + x END"}))
folded("zlema", lambda f: (K.zlema(_c(f), 9),), {"zlema": "double"}, S.recursion(B1, {"y": _nul}, {"y": _e("b.v", "y", "0.2::DOUBLE")}, {"zlema": "CASE WHEN rn >= 13 THEN y END"}, [{"v": f"2 * close - {S.lag('close', 4)}"}]))
_tsi = {"d": f"close - {S.lag('close')}"}
_a5, _a3 = "(2.0::DOUBLE / 6)", "0.5::DOUBLE"


def _double(x: str, y: str, z: str) -> dict[str, str]:
    first = _e(f"b.{x}", y, _a5)
    return {y: first, z: f"CASE WHEN b.rn < 6 THEN NULL WHEN r.{z} IS NULL THEN {first} ELSE {_a3} * ({first}) + (1 - {_a3}) * r.{z} END"}


folded("tsi", lambda f: (K.tsi(_c(f), 5, 3),), {"tsi": "double"}, S.recursion(B1, {"y": _nul, "z": _nul, "p": _nul, "q": _nul}, _double("d", "y", "z") | _double("ad", "p", "q"), {"tsi": "CASE WHEN rn >= 8 THEN 100 * z / nullif(q, 0) END"}, [_tsi, {"ad": "abs(d)"}], digits=5), 5)
_near = {"fu": f"CASE WHEN b.u IS NULL THEN r.fu WHEN r.fu IS NULL THEN b.u ELSE {_fu} END", "fl": f"CASE WHEN b.u IS NULL THEN r.fl WHEN r.fl IS NULL THEN b.d ELSE {_fl} END", "t": _way}
_chand = _atr10.replace("0.1 * b.tr + 0.9 * r.a", f"{_w14} * b.tr + (1 - {_w14}) * r.a").replace("SELECT *, CASE WHEN k >= 10 THEN (high + low) / 2 + 3 * a END AS u, CASE WHEN k >= 10 THEN (high + low) / 2 - 3 * a END AS d FROM qr", f"SELECT *, CASE WHEN k >= 14 THEN ({S.full('min', 'low', 14)}) + 3 * a END AS u, CASE WHEN k >= 14 THEN ({S.full('max', 'high', 14)}) - 3 * a END AS d FROM qr")
folded("chandelier", lambda f: K.chandelier(f, 14, 3.0)[:1], {"trend": "int"}, S.recursion(_chand, {"fu": _nul, "fl": _nul, "t": "0"}, _near, {"trend": "CAST(CASE WHEN u IS NULL THEN 0 ELSE t END AS INTEGER)"}))
_up0, _dn0 = "CASE WHEN up0 IS NOT NULL THEN up0 END", "dn0"
_bu = "CASE WHEN b.close > r.u OR b.close < r.d THEN b.up0 WHEN r.t = -1 AND r.u < b.up0 THEN r.u ELSE b.up0 END"
_bd = "CASE WHEN b.close > r.u OR b.close < r.d THEN b.dn0 WHEN r.t = 1 AND r.d > b.dn0 THEN r.d ELSE b.dn0 END"
_bt = "CASE WHEN b.close > r.u THEN 1 WHEN b.close < r.d THEN -1 ELSE r.t END"
folded("supertrend_bands", lambda f: K.supertrend_bands(f, 10, 3.0), {"line": "double", "trend": "int"},
       S.recursion(B1, {"u": "up0", "d": "dn0", "t": "1"}, {"u": _bu, "d": _bd, "t": _bt}, {"line": "CASE WHEN t = 1 THEN d ELSE u END", "trend": "CAST(t AS INTEGER)"}, [S.TR, S.TR2, {"up0": f"(high + low) / 2 + 3 * ({S.full('avg', 'tr', 10)})", "dn0": f"(high + low) / 2 - 3 * ({S.full('avg', 'tr', 10)})"}]))


@query("cycle_histogram")
def cycle_histogram(spark, d):
    return K.fold(event_bars(spark, d), {"x": "double"}, lambda f: {"x": K.cycle_histogram(_c(f))}).select("ticker", "ts", "x")


@query("strongest_cycle")
def strongest_cycle(spark, d):
    df = K.fold(event_bars(spark, d), {"period": "int"}, lambda f: {"period": np.full(len(f), K.strongest_cycle(_c(f).to_numpy()), float)})
    return df.groupBy("ticker").agg(F.max("period").alias("period"))


@query("pair_trading")
def pair_trading(spark, d):
    from tidemark.operators.pairs import pair_trading as run

    wide = event_bars(spark, d, "4h").groupBy("ts").pivot("ticker", ["click", "view"]).agg(F.first("close"))
    return run(wide.select(F.lit("click~view").alias("pair"), "ts", F.col("click").alias("y"), F.col("view").alias("x")), n=20).select("pair", "ts", "slope", "z", "position", "pnl")


@query("fine_exits")
def fine_exits(spark, d):
    from tidemark.operators.pairs import fine_exits as run

    p = SG.Panel(event_bars(spark, d, "4h"))
    p.let(SG.cross_signal(p, p.mean("close", 3), p.mean("close", 8)), "signal")
    return run(event_bars(spark, d, "15m"), p.drop_temporary(), stop=0.5)
