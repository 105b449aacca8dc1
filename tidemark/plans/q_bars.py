"""Queries: bars, cleaning and indicators of finite windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions.windows import Panel
from tidemark.operators import bars as B
from tidemark.plans import sql as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def load(spark, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def event_ticks(spark, d: str, key: str = "event_type") -> DataFrame:
    return load(spark, d, "events").select(F.col(key).cast("string").alias("ticker"), "ts", "event_id", F.col("value").alias("price"))


def event_bars(spark, d: str, timeframe: str = "1h", key: str = "event_type") -> DataFrame:
    """Bars of events, dealt by instrument before they are made: the windows that follow need no shuffle of their own."""
    ticks = event_ticks(spark, d, key).repartition("ticker")
    return B.from_ticks(ticks, timeframe, tie=("event_id",))


def rounded(df: DataFrame, *names: str, digits: int = S.DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


def bar_query(name: str, timeframe: str, oracle: str):
    query(name, oracle)(lambda spark, d: event_bars(spark, d, timeframe).select("ticker", "ts", "open", "high", "low", "close", "volume"))


for _name, _tf, _sql in (("bars_1h", "1h", S.BARS_1H), ("bars_4h", "4h", S.BARS_4H), ("bars_daily", "daily", S.BARS_1D), ("bars_weekly_sunday", "weekly", S.BARS_1W)):
    bar_query(_name, _tf, _sql)


@query("resample_1h_to_daily", f"WITH b AS ({S.BARS_1H}) SELECT ticker, date_trunc('day', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM b GROUP BY ticker, date_trunc('day', ts)")
def resample_daily(spark, d):
    return B.resample(event_bars(spark, d), "daily").select("ticker", "ts", "open", "high", "low", "close", "volume")


@query("bars_by_user_4h", S.bars(S.FOUR, "user_id"))
def bars_by_user(spark, d):
    return event_bars(spark, d, "4h", "user_id").select("ticker", "ts", "open", "high", "low", "close", "volume")


@query("session_bins_75m", f"""WITH b AS (SELECT *, CAST(ceil((hour(ts) * 60 + minute(ts) - 555) / 75.0) AS INTEGER) - 1 AS bin FROM ({S.ticks()}))
SELECT ticker, CAST(ts AS DATE) AS day, bin, first(price ORDER BY ts) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM b WHERE bin >= 0 AND bin < 5 GROUP BY ALL""")
def session_bins(spark, d):
    t = event_ticks(spark, d)
    return B.session_bins(t.select("ticker", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume")))


@query("session_filter", f"SELECT ticker, ts, close FROM ({S.BARS_1H}) WHERE CAST(ts AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00'")
def session_filter(spark, d):
    return B.in_session(event_bars(spark, d), "09:15:00", "15:30:00").select("ticker", "ts", "close")


@query("session_overnight", f"SELECT ticker, ts, close FROM ({S.BARS_1H}) WHERE CAST(ts AS TIME) >= TIME '22:00:00' OR CAST(ts AS TIME) <= TIME '05:00:00'")
def session_overnight(spark, d):
    return B.in_session(event_bars(spark, d), "22:00:00", "05:00:00").select("ticker", "ts", "close")


@query("time_slots_10m", f"SELECT ticker, time_bucket(INTERVAL 10 MINUTE, ts) AS slot, count(*) AS n, round(sum(price), 6) AS total FROM ({S.ticks()}) GROUP BY ALL")
def time_slots(spark, d):
    return event_ticks(spark, d).groupBy("ticker", F.window("ts", "10 minutes")["start"].cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 6).alias("total"))


_ORDERS = "SELECT o_orderpriority AS ticker, o_orderdate AS ts, o_orderkey, o_totalprice AS price FROM orders"


@query("dedupe_first", f"SELECT ticker, ts, o_orderkey, price FROM ({_ORDERS}) QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY o_orderkey) = 1")
def dedupe_first(spark, d):
    return B.keep_one(orders(spark, d), ("ticker", "ts"), ("o_orderkey",)).select("ticker", "ts", "o_orderkey", "price")


@query("dedupe_last", f"SELECT ticker, ts, o_orderkey, price FROM ({_ORDERS}) QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY o_orderkey DESC) = 1")
def dedupe_last(spark, d):
    return B.keep_one(orders(spark, d), ("ticker", "ts"), ("o_orderkey",), last=True).select("ticker", "ts", "o_orderkey", "price")


def orders(spark, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("price"))


#: Bars with faults: some highs under their close, some lows at 0, some closes below 0.
_FAULTY = f"SELECT ticker, ts, open, CASE WHEN hour(ts) = 3 THEN close * 0.5 ELSE high END AS high, CASE WHEN hour(ts) = 5 THEN 0 ELSE low END AS low, CASE WHEN hour(ts) = 7 THEN -close ELSE close END AS close, volume FROM ({S.BARS_1H})"


def faulty(spark, d: str) -> DataFrame:
    h = F.hour("ts")
    return event_bars(spark, d).withColumns({"high": F.when(h == 3, F.col("close") * 0.5).otherwise(F.col("high")), "low": F.when(h == 5, 0.0).otherwise(F.col("low")), "close": F.when(h == 7, -F.col("close")).otherwise(F.col("close"))})


@query("ohlc_validate", f"SELECT ticker, ts, close FROM ({_FAULTY}) WHERE least(open, high, low, close) > 0 AND high >= greatest(open, low, close) - 1e-9 AND low <= least(open, high, close) + 1e-9 AND volume >= 0")
def ohlc_validate(spark, d):
    return B.validate(faulty(spark, d)).select("ticker", "ts", "close")


@query("ohlc_repair", f"""WITH a AS (SELECT ticker, ts, close, volume, CASE WHEN open > 0 THEN open ELSE close END AS open, CASE WHEN high > 0 THEN high ELSE close END AS high, CASE WHEN low > 0 THEN low ELSE close END AS low FROM ({_FAULTY}) WHERE close > 0)
SELECT ticker, ts, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close FROM a""")
def ohlc_repair(spark, d):
    return B.repair(faulty(spark, d)).select("ticker", "ts", "open", "high", "low", "close")


def _spike_sql() -> str:
    text, at = [f"d0 AS ({S.BARS_1H})"], "d0"
    for i in range(3):
        text += [
            f"r{i} AS (SELECT *, ln(close) - lag(ln(close)) OVER {S.WO} AS r FROM {at})", f"m{i} AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY ticker) AS m FROM r{i})", f"k{i} AS (SELECT *, quantile_cont(abs(r - m), 0.5) OVER (PARTITION BY ticker) AS k FROM m{i})",
            f"z{i} AS (SELECT *, (r - m) / nullif(k * 1.4826, 0) AS z FROM k{i})", f"n{i} AS (SELECT *, lead(z) OVER {S.WO} AS nz FROM z{i})", f"d{i + 1} AS (SELECT ticker, ts, open, high, low, close, volume FROM n{i} WHERE NOT coalesce(abs(z) > 2 AND abs(nz) > 1 AND sign(z) <> sign(nz), false))",
        ]
        at = f"d{i + 1}"
    return f"WITH {', '.join(text)} SELECT ticker, ts, close FROM {at}"


@query("spike_filter", _spike_sql())
def spike_filter(spark, d):
    return B.drop_spikes(event_bars(spark, d), k=2.0).select("ticker", "ts", "close")


@query("gap_trim", f"""WITH b AS (SELECT *, date_diff('second', lag(ts) OVER {S.WO}, ts) AS gap FROM ({S.BARS_1H})), c AS (SELECT *, max(CASE WHEN gap > 7200 THEN ts END) OVER (PARTITION BY ticker) AS cut FROM b)
SELECT ticker, ts, close FROM c WHERE cut IS NULL OR ts >= cut""")
def gap_trim(spark, d):
    return B.trim_gaps(event_bars(spark, d), days=2 / 24).select("ticker", "ts", "close")


_CALENDAR = f"""WITH b AS ({S.BARS_1H}), e AS (SELECT ticker, min(ts) AS a, max(ts) AS z FROM b GROUP BY ticker), s AS (SELECT ticker, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM e),
c AS (SELECT s.ticker, s.ts, b.close FROM s LEFT JOIN b USING (ticker, ts))"""


@query("ffill_calendar", f"{_CALENDAR} SELECT ticker, ts, last_value(close IGNORE NULLS) OVER {S.CUM} AS close FROM c")
def ffill_calendar(spark, d):
    return B.fill_forward(B.calendar(event_bars(spark, d).select("ticker", "ts", "close")), ["close"])


@query("linear_interpolate", f"""{_CALENDAR}, f AS (SELECT *, last_value(close IGNORE NULLS) OVER {S.CUM} AS a, first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
last_value(CASE WHEN close IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER {S.CUM} AS s, first_value(CASE WHEN close IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM c)
SELECT ticker, ts, round(coalesce(close, a + (b - a) * (epoch(ts) - s) / nullif(e - s, 0)), 6) AS x FROM f""")
def linear_interpolate(spark, d):
    return rounded(B.interpolate(B.calendar(event_bars(spark, d).select("ticker", "ts", "close")), "close", "x"), "x").select("ticker", "ts", "x")


@query("dividend_adjust", f"""WITH b AS (SELECT *, CASE WHEN hour(ts) >= 6 THEN close * 0.98 END AS adj FROM ({S.BARS_1H})), f AS (SELECT *, adj / nullif(close, 0) AS q FROM b),
g AS (SELECT *, coalesce(last_value(q IGNORE NULLS) OVER {S.CUM}, first_value(q IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM f)
SELECT ticker, ts, round(open * k, 6) AS open, round(high * k, 6) AS high, round(low * k, 6) AS low, round(close * k, 6) AS close FROM g""")
def dividend_adjust(spark, d):
    b = event_bars(spark, d).withColumn("adj_close", F.when(F.hour("ts") >= 6, F.col("close") * 0.98))
    return rounded(B.adjust_dividends(b), "open", "high", "low", "close").select("ticker", "ts", "open", "high", "low", "close")


_ORDER_BARS = f"SELECT ticker, ts, first(price ORDER BY o_orderkey) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ({_ORDERS}) GROUP BY ticker, ts"


def order_bars(spark, d: str) -> DataFrame:
    return B.from_ticks(orders(spark, d).repartition("ticker"), "daily", tie=("o_orderkey",))


@query("quarterly_features", f"""WITH b AS ({_ORDER_BARS}), r AS (SELECT *, close / nullif(lag(close) OVER {S.WO}, 0) - 1 AS r, date_trunc('quarter', ts) AS quarter FROM b), s AS (SELECT *, {S.div(S.full('avg', 'r', 21), S.full('stddev_samp', 'r', 21))} AS s FROM r),
q AS (SELECT ticker, quarter, last(close ORDER BY ts) AS close_last, avg(r) AS return_mean, stddev_samp(r) AS return_std, avg(s) AS rolling_sharpe_mean, avg(volume) AS volume_mean FROM s GROUP BY ticker, quarter),
m AS (SELECT ticker, date_trunc('month', ts) AS m, last(close ORDER BY ts) AS c FROM b GROUP BY ALL), k AS (SELECT ticker, date_trunc('quarter', m) AS quarter, avg(c) AS monthly_close_mean FROM m GROUP BY ALL),
f AS (SELECT q.*, k.monthly_close_mean, lead(close_last) OVER (PARTITION BY ticker ORDER BY quarter) / nullif(close_last, 0) - 1 AS forward_return FROM q JOIN k USING (ticker, quarter))
SELECT ticker, CAST(quarter AS TIMESTAMP) AS quarter, round(close_last, 4) AS close_last, round(return_mean, 6) AS return_mean, round(return_std, 6) AS return_std, round(rolling_sharpe_mean, 6) AS rolling_sharpe_mean, round(volume_mean, 6) AS volume_mean, round(monthly_close_mean, 4) AS monthly_close_mean, round(forward_return, 6) AS forward_return
FROM f WHERE return_mean IS NOT NULL AND return_std IS NOT NULL AND rolling_sharpe_mean IS NOT NULL AND forward_return IS NOT NULL""")
def quarterly(spark, d):
    q = B.quarterly_features(order_bars(spark, d))
    q = rounded(q, "return_mean", "return_std", "rolling_sharpe_mean", "volume_mean", "forward_return")
    return rounded(q, "close_last", "monthly_close_mean", digits=4).withColumn("quarter", F.col("quarter").cast("timestamp_ntz"))


def indicator(name: str, build, *levels, out: dict[str, str], base: str = S.BARS_1H, timeframe: str = "1h", digits: int = S.DIGITS):
    """A query of window indicators: `build` gives the named columns of a panel, the rest the SQL."""

    def run(spark, d):
        p = Panel(event_bars(spark, d, timeframe))
        found = build(p)
        found = found if isinstance(found, tuple) else (found,)
        return rounded(p.select(**dict(zip(out, found, strict=True))), *out, digits=digits)

    query(name, S.stages(base, *levels, out=out, digits=digits))(run)


_f, _l, _d = S.full, S.lag, S.div
indicator("sma", lambda p: (I.sma(p, "close", 5), I.sma(p, "close", 20)), out={"sma5": _f("avg", "close", 5), "sma20": _f("avg", "close", 20)})
indicator("ohlc4", I.ohlc4, out={"x": "(open + high + low + close) / 4"})
indicator("wma", lambda p: I.wma(p, "close", 10), out={"wma": S.weighted("close", 10)})
indicator("zero_lag_ma", lambda p: I.zero_lag_ma(p, "close", 5), {"a": S.weighted("close", 5, False)}, out={"x": S.weighted("a", 5, False)})
indicator("hma", lambda p: I.hma(p, "close", 16), {"a": S.weighted("close", 8), "b": S.weighted("close", 16)}, {"c": "2 * a - b"}, out={"hma": S.weighted("c", 4)})
indicator("true_range", I.true_range, S.TR, S.TR2, out={"tr": "tr"})
indicator("atr_sma", lambda p: I.atr_sma(p, 14), S.TR, S.TR2, out={"atr": _f("avg", "tr", 14)})
indicator("atr_bands", lambda p: I.atr_bands(p, 14, 2.0), S.TR, S.TR2, {"a": _f("avg", "tr", 14)}, out={"upper": "close + 2 * a", "lower": "close - 2 * a"})
indicator("bollinger", lambda p: I.bollinger(p, "close", 20, 2.0), {"m": _f("avg", "close", 20), "s": _f("stddev_pop", "close", 20)}, out={"mid": "m", "upper": "m + 2 * s", "lower": "m - 2 * s"})
indicator("donchian", lambda p: I.donchian(p, 20), out={"upper": _f("max", "high", 20, ahead=-1), "lower": _f("min", "low", 20, ahead=-1)})
indicator("stochastic", lambda p: I.stochastic(p, 14, 3), {"lo": _f("min", "low", 14), "hi": _f("max", "high", 14)}, {"k0": f"100 * {_d('close - lo', 'hi - lo')}"}, out={"k": "k0", "d": _f("avg", "k0", 3)})


def _aroon_sql(x: str, kind: str) -> str:
    best = f"{kind}({x}) OVER {S.w(26)}"
    return f"CASE WHEN count({x}) OVER {S.w(26)} >= 26 THEN 100.0 * (list_position(list({x}) OVER {S.w(26)}, {best}) - 1) / 25 END"


indicator("aroon", lambda p: I.aroon(p, 25), out={"up": _aroon_sql("high", "max"), "down": _aroon_sql("low", "min")})
indicator("cci", lambda p: I.cci(p, 20), {"tp": "(high + low + close) / 3"}, {"m": _f("avg", "tp", 20), "l": f"list(tp) OVER {S.w(20)}"}, {"md": "CASE WHEN m IS NOT NULL THEN list_sum(list_transform(l, lambda v: abs(v - m))) / 20 END"}, out={"cci": _d("tp - m", "0.015 * md")})
indicator("choppiness", lambda p: I.choppiness(p, 14), S.TR, S.TR2, {"s": _f("sum", "tr", 14), "g": f"({_f('max', 'high', 14)}) - ({_f('min', 'low', 14)})"}, out={"chop": f"100 * log10(nullif({_d('s', 'g')}, 0)) / {math.log10(14)!r}"})
indicator("vortex", lambda p: I.vortex(p, 14), S.TR | {"pl": _l("low"), "ph": _l("high")}, S.TR2 | {"a": "abs(high - pl)", "b": "abs(low - ph)"}, {"sa": _f("sum", "a", 14), "sb": _f("sum", "b", 14), "st": _f("sum", "tr", 14)}, out={"vip": _d("sa", "st"), "vim": _d("sb", "st")})
_mid = lambda n: f"(({_f('max', 'high', n)}) + ({_f('min', 'low', n)})) / 2"
indicator("ichimoku", lambda p: I.ichimoku(p), {"t": _mid(9), "k": _mid(26), "m": _mid(52)}, {"a": "(t + k) / 2"}, out={"tenkan": "t", "kijun": "k", "span_a": _l("a", 26), "span_b": _l("m", 26)})
_sxx = 20 * (20 * 20 - 1) / 12
indicator("linreg_stats", lambda p: I.linreg(p, "close", 20), {"i": f"CAST(row_number() OVER {S.WO} - 1 AS DOUBLE)"}, {"slope": f"CASE WHEN count(close) OVER {S.w(20)} >= 20 THEN regr_slope(close, i) OVER {S.w(20)} END", "syy": f"({_f('var_pop', 'close', 20)}) * 20"},
          {"r2": f"CASE WHEN syy > 0 THEN least(greatest({_d(f'slope * slope * {_sxx}', 'syy')}, 0), 1) END", "rv": f"CASE WHEN syy IS NOT NULL THEN greatest(syy - slope * slope * {_sxx}, 0) END / 18"}, out={"slope_": "slope", "r2_": "r2", "t_": _d("slope", f"sqrt(rv / {_sxx})")}, digits=5)
indicator("rolling_r2", lambda p: I.rolling_r2(p, "close", 30), {"i": f"CAST(row_number() OVER {S.WO} - 1 AS DOUBLE)"}, out={"r2": f"CASE WHEN count(close) OVER {S.w(30, -1)} >= 30 THEN regr_r2(close, i) OVER {S.w(30, -1)} END"})
indicator("efficiency_ratio", lambda p: I.efficiency_ratio(p, "close", 10), {"a": f"abs(close - {_l('close', 10)})", "s": f"abs(close - {_l('close')})"}, out={"er": _d("a", _f("sum", "s", 10))})
indicator("cmo", lambda p: I.cmo(p, "close", 9), {"dx": f"close - {_l('close')}"}, {"u": "CASE WHEN dx IS NOT NULL THEN greatest(dx, 0) END", "v": "CASE WHEN dx IS NOT NULL THEN greatest(-dx, 0) END"}, {"su": _f("sum", "u", 9), "sv": _f("sum", "v", 9)}, out={"cmo": f"100 * {_d('su - sv', 'su + sv')}"})
_lr = {"lr": f"ln(close) - ln({_l('close')})"}
indicator("realized_vol", lambda p: I.realized_vol(p, "close", 20), _lr, out={"vol": f"({_f('stddev_samp', 'lr', 20)}) * sqrt(252)"})
indicator("historical_vol", lambda p: I.historical_vol(p, "close", 20), {"r": f"close / nullif({_l('close')}, 0) - 1"}, out={"vol": f"({_f('stddev_samp', 'r', 20)}) * sqrt(252)"}, digits=4)
indicator("parkinson_vol", lambda p: I.parkinson_vol(p, 20), {"x": "pow(ln(high / low), 2)"}, out={"vol": f"sqrt(({_f('avg', 'x', 20)}) / (4 * ln(2)) * 252)"})
indicator("garman_klass_vol", lambda p: I.garman_klass_vol(p, 20), {"x": "greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0)"}, out={"vol": f"sqrt(({_f('avg', 'x', 20)}) * 252)"})
_RS = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"
indicator("rogers_satchell_vol", lambda p: I.rogers_satchell_vol(p, 20), {"x": f"greatest({_RS}, 0)"}, out={"vol": f"sqrt(({_f('avg', 'x', 20)}) * 252)"})
indicator("rogers_satchell_lagged", lambda p: I.rogers_satchell_lagged(p, 14), {"x": _RS}, {"y": _l("x")}, out={"vol": f"({_f('avg', 'y', 14)}) * 1e6"}, digits=2)
_k = 0.34 / (1.34 + 21 / 19)
indicator("yang_zhang_vol", lambda p: I.yang_zhang_vol(p, 20), {"x": f"greatest({_RS}, 0)", "oc": f"ln(open / {_l('close')})", "co": "ln(close / open)"}, {"v": f"({_f('var_samp', 'oc', 20)}) + {_k!r} * ({_f('var_samp', 'co', 20)}) + (1 - {_k!r}) * ({_f('avg', 'x', 20)})"}, out={"vol": "sqrt(CASE WHEN v IS NOT NULL THEN greatest(v, 0) END * 252)"})
indicator("zscore", lambda p: I.zscore(p, "close", 20), out={"z": f"(close - ({_f('avg', 'close', 20, 10)})) / (({_f('stddev_pop', 'close', 20, 10)}) + 1e-8)"})
indicator("rolling_skew_kurt", lambda p: I.skew_kurt(p, I.log_return(p), 63), _lr, out={"skew": _f("skewness", "lr", 63), "kurt": _f("kurtosis", "lr", 63)})
indicator("rolling_corr", lambda p: I.autocorr(p, I.log_return(p), 63), _lr, {"pl": _l("lr")}, out={"corr": f"CASE WHEN count(CASE WHEN pl IS NOT NULL AND lr IS NOT NULL THEN 1 END) OVER {S.w(63)} >= 63 THEN corr(lr, pl) OVER {S.w(63)} END"})
indicator("variance_ratio", lambda p: I.variance_ratio(p, 5, 126), _lr | {"l5": f"ln(close) - ln({_l('close', 5)})"}, out={"vr": f"{_d(_f('var_samp', 'l5', 126), '5 * (' + _f('var_samp', 'lr', 126) + ')')} - 1"})
indicator("days_since_high", lambda p: p.since_extreme("close", 60, least=20), {"i": f"row_number() OVER {S.WO}", "m": f"max(close) OVER {S.w(60)}", "l": f"list(close) OVER {S.w(60)}"}, out={"age": "CASE WHEN len(l) >= 20 THEN CAST(len(l) - list_position(l, m) AS DOUBLE) END"})
indicator("drawdown_252", lambda p: I.drawdown(p, "close", 252, 60), out={"dd": f"close / nullif({_f('max', 'close', 252, 60)}, 0) - 1"})
indicator("ulcer", lambda p: I.ulcer(p, "close", 14), {"x": f"pow(100 * (close / nullif({_f('max', 'close', 14)}, 0) - 1), 2)"}, out={"ulcer": f"sqrt({_f('avg', 'x', 14)})"})
indicator("vwap", I.vwap, {"f": "(high + low + close) / 3 * volume"}, out={"vwap": _d(f"sum(f) OVER {S.CUM}", f"sum(volume) OVER {S.CUM}")})
indicator("obv", I.obv, {"s": f"coalesce(sign(close - {_l('close')}), 0) * volume"}, out={"obv": f"sum(s) OVER {S.CUM}"})
indicator("breadth", lambda p: tuple(c.cast("double") for c in I.breadth(p)), {"dx": f"close - {_l('close')}"}, out={"up": f"CAST(sum(CASE WHEN dx > 0 THEN 1 ELSE 0 END) OVER {S.CUM} AS DOUBLE)", "down": f"CAST(sum(CASE WHEN dx < 0 THEN 1 ELSE 0 END) OVER {S.CUM} AS DOUBLE)"})
_tp = {"tp": "(high + low + close) / 3"}
_flow = ({"ptp": _l("tp")}, {"u": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "v": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"})
indicator("mfi", lambda p: I.mfi(p, 14), _tp, *_flow, {"su": _f("sum", "u", 14), "sv": _f("sum", "v", 14)}, out={"mfi": f"100 - 100 / (1 + {_d('su', 'sv')})"})
indicator("mfi_partial", lambda p: I.mfi(p, 14, partial=True), _tp, *_flow, out={"mfi": f"100 - 100 / (1 + sum(u) OVER {S.w(14)} / (sum(v) OVER {S.w(14)} + 1e-10))"})
indicator("cmf", lambda p: I.cmf(p, 20), {"x": f"coalesce({_d('(close - low) - (high - close)', 'high - low')}, 0) * volume"}, out={"cmf": _d(_f("sum", "x", 20), _f("sum", "volume", 20))})
indicator("twiggs_flow", lambda p: I.twiggs(p, 10), {"pc": _l("close")}, {"th": "CASE WHEN pc IS NOT NULL THEN greatest(pc, high) END", "tl": "CASE WHEN pc IS NOT NULL THEN least(pc, low) END"}, {"adv": f"coalesce({_d('volume * ((close - tl) - (th - close))', 'th - tl')}, 0)"},
          {"wv": S.weighted("volume", 10), "wa": S.weighted("adv", 10)}, out={"tmf": f"CASE WHEN wv = 0 THEN 0 ELSE {_d('wa', 'wv')} END"})
_strict = {"tr": "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"}
indicator("volume_strength", lambda p: I.strength(p, 14, 14), S.TR, _strict, {"a": _f("avg", "tr", 14), "b": _f("avg", "tr", 14, 1), "v": _f("avg", "volume", 14)}, {"vms0": _d("volume - v", "v")}, out={"pvs": _d("close - pc", "a"), "vms": "vms0", "samx": "(close - pc) / CASE WHEN b = 0 THEN 2.220446049250313e-16 ELSE b END * vms0"}, digits=5)
_dm = {"up": f"high - {_l('high')}", "dn": f"{_l('low')} - low"}
_dm2 = {"pd": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "md": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}
indicator("adx_sma", lambda p: I.adx_sma(p, 14), S.TR | _dm, _strict | _dm2, {"ts_": _f("avg", "tr", 14, 1), "ps": _f("avg", "pd", 14, 1), "ms": _f("avg", "md", 14, 1)}, {"p_": f"100 * {_d('ps', 'ts_')}", "m_": f"100 * {_d('ms', 'ts_')}"}, {"dx": f"100 * {_d('abs(p_ - m_)', 'p_ + m_')}"}, out={"adx": _f("avg", "dx", 14, 1), "plus": "p_", "minus": "m_"})
_roc = lambda n: f"100 * (close / nullif({_l('close', n)}, 0) - 1)"
indicator("kst", lambda p: I.kst(p), {f"r{n}": _roc(n) for n in (10, 15, 20, 30)}, {"k": f"({_f('avg', 'r10', 10)}) + 2 * ({_f('avg', 'r15', 10)}) + 3 * ({_f('avg', 'r20', 10)}) + 4 * ({_f('avg', 'r30', 15)})"}, out={"kst": "k", "signal": _f("avg", "k", 9)}, digits=3)
indicator("spread_zscore", lambda p: I.spread_zscore(p, "close", 60), out={"z": _d(f"close - ({_f('avg', 'close', 60)})", _f("stddev_samp", "close", 60))})


@query("vwap_session", S.stages(S.BARS_1H, {"f": "(high + low + close) / 3 * volume", "day": "CAST(ts AS DATE)"}, out={"vwap": _d("sum(f) OVER (PARTITION BY ticker, day ORDER BY ts)", "sum(volume) OVER (PARTITION BY ticker, day ORDER BY ts)")}))
def vwap_session(spark, d):
    p = Panel(event_bars(spark, d).withColumn("day", F.to_date("ts")), ("ticker", "day"))
    return rounded(p.select(vwap=I.vwap(p)), "vwap").drop("day")
