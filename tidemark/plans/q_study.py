"""Queries: sources and sinks, folds and choices, sizing, evaluation and inference over whole results."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.windows import Panel
from tidemark.operators import backtest as BT
from tidemark.operators import bars as B
from tidemark.operators import evaluation as EV
from tidemark.operators import features as FE
from tidemark.operators import metrics as M
from tidemark.operators import overlay as ML
from tidemark.operators import pairs as PR
from tidemark.operators import portfolio as PF
from tidemark.operators import positions as P
from tidemark.operators import signals as SG
from tidemark.operators import stats as ST
from tidemark.plans import q_bars, q_folds, q_positions
from tidemark.plans import sql as S
from tidemark.plans.q_bars import event_bars, event_ticks, load, rounded
from tidemark.plans.q_positions import _BOOK, book, crossing
from tidemark.sources import store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


B1, B4, BD = S.BARS_1H, S.BARS_4H, S.BARS_1D
OHLCV = ("open", "high", "low", "close", "volume")


# ---- sources and sinks: what is written is read again
def _back(spark, df, path: str, schema: str | None = None):
    store.write(df, path)
    return store.read(spark, path, schema)


_PLAIN = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@query("csv_round_trip", B4)
def csv_round_trip(spark, d):
    return _back(spark, event_bars(spark, d, "4h"), f"{store.scratch(spark)}.csv", ", ".join(f"{c} {'string' if c == 'ticker' else 'timestamp_ntz' if c == 'ts' else 'double'}" for c in ("ticker", "ts", *OHLCV)))


@query("json_round_trip", B4)
def json_round_trip(spark, d):
    return _back(spark, event_bars(spark, d, "4h"), f"{store.scratch(spark)}.json", _PLAIN)


@query("orc_round_trip", B4)
def orc_round_trip(spark, d):
    return _back(spark, event_bars(spark, d, "4h"), f"{store.scratch(spark)}.orc")


@query("csv_directory", f"{B4} UNION ALL {BD}")
def csv_directory(spark, d):
    place = store.scratch(spark)
    for tf in ("4h", "daily"):
        store.write(event_bars(spark, d, tf).select("ticker", "ts", *OHLCV), f"{place}/{tf}.csv")
    return store.read(spark, f"{place}/*.csv", _PLAIN)


@query("normalise_csv", f"SELECT ticker, ts, open, high, low, close, volume FROM ({B4})")
def normalise_csv(spark, d):
    own = event_bars(spark, d, "4h")
    text = own.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("ticker").alias("Symbol"), *[F.col(c).alias(n) for c, n in zip(OHLCV, ("O", "High_Price", "l", "LTP", "Qty"), strict=True)], F.lit("x").alias("junk"))
    place = f"{store.scratch(spark)}.csv"
    store.write(text, place)
    return store.normalise(store.read(spark, place), drop=("junk",), pattern="yyyy-MM-dd HH:mm:ss").select("ticker", "ts", *OHLCV)


@query("normalise_parquet", f"SELECT 'view' AS ticker, ts - INTERVAL 330 MINUTE AS ts, open, high, low, close FROM ({B4}) WHERE ticker = 'view'")
def normalise_parquet(spark, d):
    place = store.scratch(spark)
    own = event_bars(spark, d, "4h").filter("ticker = 'view'")
    store.write(own.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")).alias("time"), "open", "high", "low", F.col("close").alias("last")), place)
    return store.normalise(store.read(spark, place), offset_minutes=330, ticker="view").select("ticker", "ts", "open", "high", "low", "close")


@query("one_file_per_ticker", f"SELECT ticker, ts, close FROM ({B4})")
def one_file_per_ticker(spark, d):
    place = store.scratch(spark)
    own = event_bars(spark, d, "4h")
    # a file is named after its instrument only by whoever exports it, so each is moved to such a name here
    from py4j.java_gateway import java_import

    java_import(spark._jvm, "org.apache.hadoop.fs.Path")
    for (name,) in own.select("ticker").distinct().collect():
        own.filter(F.col("ticker") == name).drop("ticker").coalesce(1).write.parquet(f"{place}-parts/{name}")
        folder = spark._jvm.Path(f"{place}-parts/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        fs.mkdirs(spark._jvm.Path(place))
        fs.rename(part, spark._jvm.Path(f"{place}/{name}.parquet"))
    return store.read_by_file(spark, place).select("ticker", "ts", "close")


@query("folder_per_ticker", f"SELECT ticker, ts, close FROM ({B1}) WHERE ticker = 'click'")
def folder_per_ticker(spark, d):
    place = store.scratch(spark)
    store.write_by(event_bars(spark, d), place, "ticker")
    return spark.read.parquet(place).filter("ticker = 'click'").select("ticker", "ts", "close")


@query("manifest_ingest", f"SELECT 'events' AS source, count(*) AS rows_in, count(*) AS rows_out FROM ({B1}) WHERE volume >= 0 UNION ALL SELECT 'doubled', 2 * count(*), count(*) FROM ({B1})")
def manifest_ingest(spark, d):
    place = store.scratch(spark)
    own = event_bars(spark, d).select("ticker", F.col("ts").alias("Date"), *OHLCV)
    store.write(own, f"{place}/a")
    store.write(own.union(own), f"{place}/b")
    return store.ingest(spark, [{"name": "events", "path": f"{place}/a"}, {"name": "doubled", "path": f"{place}/b"}], f"{place}/out")


@query("tick_passthrough", "SELECT CAST(event_type AS VARCHAR) AS ticker, ts, event_id, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1")
def tick_passthrough(spark, d):
    place = store.scratch(spark)
    store.pass_ticks(event_ticks(spark, d), place)
    return spark.read.parquet(place).select("ticker", "ts", "event_id", "price")


@query("signal_passthrough", f"SELECT ticker, ts, CAST(p AS DOUBLE) AS position, 'cross' AS strategy FROM ({q_positions._CROSS})")
def signal_passthrough(spark, d):
    place = store.scratch(spark)
    store.write_by(crossing(spark, d).select("ticker", "ts", "position", F.lit("cross").alias("strategy")), place, "strategy")
    return spark.read.parquet(place).select("ticker", "ts", "position", "strategy")


_RUNS = f"SELECT ticker, entry_ts, ret, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS strategy_id FROM ({_BOOK})"


@query("result_store", f"SELECT strategy_id, ticker, count(*) AS n, round(sum(ret), 6) AS total FROM ({_RUNS}) WHERE strategy_id = 'up' GROUP BY ALL")
def result_store(spark, d):
    runs = store.ResultStore(spark, store.scratch(spark))
    own = book(spark, d).select("ticker", "entry_ts", "ret")
    runs.write(own.filter("ret > 0"), "c1", "up")
    runs.write(own.filter("NOT ret > 0").withColumn("note", F.lit("later column")), "c1", "down")
    return rounded(runs.read("c1", "up").groupBy("strategy_id", "ticker").agg(F.count("*").alias("n"), F.sum("ret").alias("total")), "total")


@query("registry_sql", f"SELECT strategy_id, count(*) AS n FROM ({_RUNS}) GROUP BY strategy_id")
def registry_sql(spark, d):
    runs = store.ResultStore(spark, store.scratch(spark))
    own = book(spark, d).select("ticker", "entry_ts", "ret")
    runs.write(own.filter("ret > 0"), "c1", "up")
    runs.write(own.filter("NOT ret > 0"), "c1", "down")
    return runs.sql("SELECT strategy_id, count(*) AS n FROM {runs} GROUP BY strategy_id")


@query("provenance", f"SELECT ticker, count(*) AS n, 'events' AS market, '1h' AS timeframe, '2024-01-01 00:00:00' AS run_ts, '{json.dumps({'fast': 5, 'slow': 20})}' AS params FROM ({B1}) GROUP BY ticker")
def provenance(spark, d):
    place = store.scratch(spark)
    own = event_bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"))
    store.write(store.with_lineage(own, market="events", timeframe="1h", run_ts="2024-01-01 00:00:00", params={"slow": 20, "fast": 5}), place)
    return store.read(spark, place)


@query("registry_replace", "SELECT n_regionkey AS region, n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM nation")
def registry_replace(spark, d):
    place = store.scratch(spark)
    own = load(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("id"))
    store.write_by(own.withColumn("state", F.lit("old")), place, "region")
    store.replace_matching(own.filter("id % 2 = 0").withColumn("state", F.lit("new")), place, "region", "id")
    return spark.read.parquet(place).select("region", "id", "state")


@query("feature_cache", f"SELECT CAST(event_type AS VARCHAR) AS ticker, count(*) AS n, CAST(1 AS BIGINT) AS made FROM events GROUP BY event_type")
def feature_cache(spark, d):
    folder, made = store.scratch(spark), []

    def make(raw):
        made.append(1)
        return raw.groupBy(F.col("event_type").alias("ticker")).agg(F.count("*").alias("n"))

    for _ in range(2):
        df = store.cached(spark, f"{d}/events.parquet", folder, make)
    return df.withColumn("made", F.lit(len(made)).cast("bigint"))


@query("universe", "SELECT n_name AS id, 'R' || n_regionkey AS \"group\", regexp_replace(regexp_replace(n_name, '[^A-Za-z0-9.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file FROM nation")
def universe(spark, d):
    nested: dict = {}
    for r in load(spark, d, "nation").select("n_name", "n_regionkey").collect():  # a configuration: a few instruments
        nested.setdefault(f"R{r.n_regionkey}", {"currency": "X", "instruments": []})["instruments"].append({"id": r.n_name})
    rows = [(r["id"], r["group"]) for r in store.flatten_universe(nested)]
    return spark.createDataFrame(rows, "id string, group string").withColumn("file", store.safe_id("id"))


@query("risk_free_rate", "SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, round(avg(o_totalprice) / 1e7, 6) AS rf FROM orders GROUP BY o_orderdate")
def risk_free_rate(spark, d):
    place = f"{store.scratch(spark)}.csv"
    own = load(spark, d, "orders").groupBy("o_orderdate").agg((F.avg("o_totalprice") / 1e5).alias("rate"))
    store.write(own.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("DATE"), "rate"), place)
    return rounded(store.risk_free(spark, place), "rf")


@query("alias_resolution", "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS close FROM orders")
def alias_resolution(spark, d):
    own = load(spark, d, "orders").select(F.col("o_orderpriority").alias("Symbol"), F.col("o_orderdate").alias("DateTime"), F.col("o_totalprice").alias("LTP"))
    return store.resolve(own, required=("ts", "close")).select("ticker", "ts", "close")


@query("epoch_repair", "SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def epoch_repair(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, micros).otherwise(F.floor(micros / 1000)).cast("bigint").alias("t"))
    return own.select("event_id", B.repair_epoch("t").cast("timestamp_ntz").alias("ts"))


# ---- bars, features and filters
@query("resample_all", " UNION ALL ".join(f"SELECT ticker, ts, close, volume, '{n}' AS timeframe FROM ({b})" for n, b in (("4h", B4), ("daily", BD), ("weekly", S.BARS_1W))))
def resample_all(spark, d):
    return B.resample_all(event_bars(spark, d)).select("ticker", "ts", "close", "volume", "timeframe")


_F = q_bars._FAULTY
_FIXED = f"""SELECT ticker, ts, CASE WHEN open > 0 THEN open ELSE close END AS o, CASE WHEN high > 0 THEN high ELSE close END AS h, CASE WHEN low > 0 THEN low ELSE close END AS l, open, high, low, close FROM ({_F}) WHERE close > 0"""


def _clean_sql() -> str:
    text, at = [f"fx AS ({_FIXED})", f"d0 AS (SELECT ticker, ts, close FROM fx)"], "d0"
    for i in range(3):
        text += [
            f"r{i} AS (SELECT *, ln(close) - lag(ln(close)) OVER {S.WO} AS r FROM {at})", f"m{i} AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY ticker) AS m FROM r{i})", f"k{i} AS (SELECT *, quantile_cont(abs(r - m), 0.5) OVER (PARTITION BY ticker) AS k FROM m{i})",
            f"z{i} AS (SELECT *, (r - m) / nullif(k * 1.4826, 0) AS z FROM k{i})", f"n{i} AS (SELECT *, lead(z) OVER {S.WO} AS nz FROM z{i})", f"d{i + 1} AS (SELECT ticker, ts, close FROM n{i} WHERE NOT coalesce(abs(z) > 2 AND abs(nz) > 1 AND sign(z) <> sign(nz), false))",
        ]
        at = f"d{i + 1}"
    return f"""WITH {', '.join(text)}, g AS (SELECT *, date_diff('second', lag(ts) OVER {S.WO}, ts) AS gap FROM d3), c AS (SELECT *, max(CASE WHEN gap > 7200 THEN ts END) OVER (PARTITION BY ticker) AS cut FROM g),
    q0 AS (SELECT ticker, count(*) AS n FROM ({_F}) GROUP BY ticker), q1 AS (SELECT ticker, count(*) AS n, count(*) FILTER (o <> open OR greatest(o, h, l, close) <> high OR least(o, h, l, close) <> low) AS f FROM fx GROUP BY ticker),
    q2 AS (SELECT ticker, count(*) AS n FROM d3 GROUP BY ticker), q3 AS (SELECT ticker, count(*) AS n FROM c WHERE cut IS NULL OR ts >= cut GROUP BY ticker)
    SELECT ticker, 2 * q0.n AS bars_in, q0.n AS doubles, q0.n - coalesce(q1.n, 0) AS unpriced, coalesce(q1.f, 0) AS fixed, coalesce(q1.n, 0) - coalesce(q2.n, 0) AS spikes, coalesce(q2.n, 0) - coalesce(q3.n, 0) AS before_gap, coalesce(q3.n, 0) AS bars_out
    FROM q0 LEFT JOIN q1 USING (ticker) LEFT JOIN q2 USING (ticker) LEFT JOIN q3 USING (ticker)"""


@query("clean_counters", _clean_sql())
def clean_counters(spark, d):
    own = q_bars.faulty(spark, d)
    return B.clean(own.union(own), k=2.0, days=2 / 24)[1]


@query("live_three_years", "SELECT CAST(o_custkey AS VARCHAR) AS ticker, count(*) AS n, round(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25, 6) AS years FROM orders GROUP BY o_custkey HAVING date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25 >= 3")
def live_three_years(spark, d):
    return rounded(EV.live_years(load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderdate").alias("ts"))), "years")


@query("add_returns", f"SELECT ticker, ts, round(close / nullif({S.lag('close')}, 0) - 1, 6) AS ret, round(ln(close / nullif({S.lag('close')}, 0)), 6) AS log_ret FROM ({B1})")
def add_returns(spark, d):
    return rounded(FE.returns(event_bars(spark, d)).select("ticker", "ts", "ret", "log_ret"), "ret", "log_ret")


_ROLLING = ", ".join(f"round({S.full(a, 'close', n)}, 6) AS {b}_{n}" for n in (5, 10, 20) for a, b in (("avg", "mean"), ("stddev_samp", "std")))


@query("add_rolling_features", f"SELECT ticker, ts, {_ROLLING} FROM ({B1})")
def add_rolling_features(spark, d):
    names = [f"{b}_{n}" for n in (5, 10, 20) for b in ("mean", "std")]
    return rounded(FE.rolling(event_bars(spark, d)).select("ticker", "ts", *names), *names)


@query("microstructure", f"SELECT ticker, ts, round((high - low) / close, 6) AS range_pct, round((close - open) / open, 6) AS body_pct, round(coalesce(volume / {S.lag('volume')} - 1, 0), 6) AS volume_change, round(volume / avg(volume) OVER (PARTITION BY ticker), 6) AS volume_ratio FROM ({B1})")
def microstructure(spark, d):
    names = ("range_pct", "body_pct", "volume_change", "volume_ratio")
    return rounded(FE.microstructure(event_bars(spark, d)).select("ticker", "ts", *names), *names)


_ADX = q_bars.ORACLE["adx_sma"]


@query("regime_filter", f"SELECT s.ticker, s.ts, CAST(CASE WHEN a.adx >= 25 THEN s.sig ELSE 0 END AS INTEGER) AS signal FROM ({q_folds._SIG}) s JOIN ({_ADX}) a ON a.ticker = s.ticker AND a.ts = s.ts")
def regime_filter(spark, d):
    p = Panel(q_folds.signalled(spark, d))
    return p.select(signal=SG.regime_filter(p)).withColumn("signal", F.col("signal").cast("int"))


_MFI = q_bars.ORACLE["mfi_partial"]


@query("volume_filter", f"SELECT s.ticker, s.ts, CAST(CASE WHEN s.sig > 0 AND m.mfi > 50 OR s.sig < 0 AND m.mfi < 50 THEN s.sig ELSE 0 END AS INTEGER) AS signal FROM ({q_folds._SIG}) s JOIN ({_MFI}) m ON m.ticker = s.ticker AND m.ts = s.ts")
def volume_filter(spark, d):
    p = Panel(q_folds.signalled(spark, d))
    return p.select(signal=SG.volume_filter(p)).withColumn("signal", F.col("signal").cast("int"))


@query("label_trades", f"SELECT b.ticker, b.ts, CAST(CASE WHEN t.ret > 0 THEN 1 WHEN t.ret IS NOT NULL THEN 0 END AS INTEGER) AS label FROM ({B1}) b LEFT JOIN ({q_folds.ORACLE['trade_scan_fixed']}) t ON t.ticker = b.ticker AND t.entry_ts = b.ts")
def label_trades(spark, d):
    trades = BT.backtest(q_folds.signalled(spark, d)).select("ticker", F.col("entry_ts").alias("ts"), "ret")
    return ML.label_trades(event_bars(spark, d), trades).select("ticker", "ts", "label")


@query("chande_kroll", f"""WITH a AS (SELECT ticker, ts, k, a, max(high) OVER {S.w(10)} AS hh, min(low) OVER {S.w(10)} AS ll FROM ({q_folds._atr10.replace('SELECT *, CASE WHEN k >= 10 THEN (high + low) / 2 + 3 * a END AS u, CASE WHEN k >= 10 THEN (high + low) / 2 - 3 * a END AS d FROM qr', 'SELECT * FROM qr')})),
b AS (SELECT ticker, ts, CASE WHEN k >= 10 THEN hh - a END AS hs, CASE WHEN k >= 10 THEN ll + a END AS ls FROM a) SELECT ticker, ts, round({S.full('max', 'hs', 9)}, 5) AS short_stop, round({S.full('min', 'ls', 9)}, 5) AS long_stop FROM b""")
def chande_kroll(spark, d):
    own = K.fold(event_bars(spark, d), {"short_stop": "double", "long_stop": "double"}, lambda f: dict(zip(("short_stop", "long_stop"), K.chande_kroll(f, 10, 1.0, 9), strict=True)))
    return rounded(own.select("ticker", "ts", "short_stop", "long_stop"), "short_stop", "long_stop", digits=5)


# ---- sizing and risk
q_folds.folded("vol_target_weights", lambda f: (K.vol_target(K.series(f, "close")),), {"weight": "double"},
               q_folds.ORACLE["ew_std"].replace("round(CASE WHEN rn >= 20 THEN sqrt(cov * sw * sw / (sw * sw - sw2)) END, 6) AS sd", "round(CASE WHEN rn >= 20 THEN least(0.1 / nullif(sqrt(cov * sw * sw / (sw * sw - sw2)) * sqrt(252), 0), 3) ELSE 0 END, 6) AS weight").replace("min(ts), NULL FROM", "min(ts), 0 FROM"))

_WINS = f"SELECT ticker, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS win, avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS ratio, min(entry_price) AS entry, max(entry_price) AS stop FROM ({_BOOK}) GROUP BY ticker"


@query("kelly_fraction", f"SELECT ticker, round(least(greatest(win - (1 - win) / nullif(ratio, 0), 0), 0.25), 6) AS kelly, round(CASE WHEN abs(entry - stop) > 0 THEN 100000 * 0.02 / abs(entry - stop) ELSE 0 END, 6) AS units FROM ({_WINS})")
def kelly_fraction(spark, d):
    up, down = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), -F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    g = book(spark, d).groupBy("ticker").agg(F.avg((F.col("ret") > 0).cast("double")).alias("win"), F.try_divide(up, down).alias("ratio"), F.min("entry_price").alias("entry"), F.max("entry_price").alias("stop")).withColumn("capital", F.lit(100_000.0))
    return rounded(g.select("ticker", BT.kelly_fraction("win", "ratio", 0.25).alias("kelly"), BT.fixed_fractional("capital", 0.02, "entry", "stop").alias("units")), "kelly", "units")


_DD = f"WITH e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY exit_ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)) AS eq FROM ({_BOOK})), k AS (SELECT ticker, 1 - eq / max(eq) OVER (PARTITION BY ticker ORDER BY exit_ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS dd FROM e), g AS (SELECT ticker, max(dd) AS dd FROM k GROUP BY ticker)"


@query("margin_call", f"{_DD} SELECT ticker, 100000 * (1 - dd) < 0.9 * 100000 / 1.5 AS called, round(100000 * (1 - dd), 3) AS remaining, round(dd * 0.9, 6) AS expected_loss FROM g")
def margin_call(spark, d):
    e = M.equity(book(spark, d), order=("exit_ts", "l_orderkey", "l_linenumber")).groupBy("ticker").agg((-F.min("drawdown")).alias("dd"))
    called, left = PR.margin_call("dd", 100_000.0, 1.5, 0.9)
    return e.select("ticker", called.alias("called"), F.round(left, 3).alias("remaining"), F.round(PR.expected_loss("dd"), 6).alias("expected_loss"))


@query("funding_rates", f"SELECT b.ticker, b.ts, round(coalesce(f.close, 0), 6) AS rate FROM ({B1}) b ASOF LEFT JOIN ({B4}) f ON f.ticker = b.ticker AND f.ts <= b.ts")
def funding_rates(spark, d):
    rates = event_bars(spark, d, "4h").select("ticker", "ts", F.col("close").alias("rate"))
    return rounded(PR.merge_funding(event_bars(spark, d).select("ticker", "ts"), rates).select("ticker", "ts", "rate"), "rate")


# ---- folds, choices and sleeves
def _fold_rows(kind: str) -> str:
    start = {"wf_expanding": "CAST(NULL AS VARCHAR)", "wf_rolling": "(y - 10) || '-01-01'"}[kind]
    return f"SELECT '{kind}' AS kind, CAST(y AS VARCHAR) AS label, {start} AS train_start, (y - 2) || '-01-01' AS val_start, y || '-01-01' AS test_start, least((y + 2) || '-01-01', '2024-07-01') AS test_end FROM range(2012, 2025, 2) t(y)"


@query("fold_dates", f"{_fold_rows('wf_expanding')} UNION ALL {_fold_rows('wf_rolling')} UNION ALL SELECT 'holdout', '2012-end', NULL, '2010-01-01', '2012-01-01', '2024-07-01'")
def fold_dates(spark, d):
    rows = [(kind, f["label"], f["train_start"], f["val_start"], f["test_start"], f["test_end"]) for kind in ("wf_expanding", "wf_rolling", "holdout") for f in PF.folds(2012, 2024, every=2, kind=kind, until="2024-07-01")]
    return spark.createDataFrame(rows, "kind string, label string, train_start string, val_start string, test_start string, test_end string")


@query("month_folds", """SELECT a AS anchored, CAST(k AS INTEGER) AS fold, CAST(CASE WHEN a THEN DATE '1995-01-01' ELSE DATE '1995-01-01' + to_months(CAST(k * 6 AS INTEGER)) END AS DATE) AS train_start,
CAST(DATE '1995-01-01' + to_months(CAST(24 + k * 6 AS INTEGER)) AS DATE) AS train_end, CAST(DATE '1995-01-01' + to_months(CAST(30 + k * 6 AS INTEGER)) AS DATE) AS test_end FROM range(0, 6) t(k), (VALUES (true), (false)) v(a)""")
def month_folds(spark, d):
    rows = [(a, *f) for a in (True, False) for f in PF.month_folds("1995-01-01", 60, 24, 6, anchored=a)]
    return spark.createDataFrame(rows, "anchored boolean, fold int, train_start date, train_end date, test_end date")


@query("quarterly_walk_forward", f"""WITH f AS (SELECT CAST(k AS INTEGER) AS fold, DATE '1995-01-01' + to_months(CAST(k * 3 AS INTEGER)) AS a, DATE '1995-01-01' + to_months(CAST(12 + k * 3 AS INTEGER)) AS b, DATE '1995-01-01' + to_months(CAST(15 + k * 3 AS INTEGER)) AS c FROM range(0, 12) t(k))
SELECT fold, ticker, count(*) FILTER (exit_ts < b) AS n_train, count(*) FILTER (exit_ts >= b) AS n_test, round(avg(ret) FILTER (exit_ts < b), 9) AS train_mean, round(avg(ret) FILTER (exit_ts >= b), 9) AS test_mean FROM ({_BOOK}) JOIN f ON exit_ts >= a AND exit_ts < c GROUP BY ALL""")
def quarterly_walk_forward(spark, d):
    folds = spark.createDataFrame(PF.month_folds("1995-01-01", 48, 12, 3), "fold int, a date, b date, c date")
    own = book(spark, d).join(F.broadcast(folds), (F.col("exit_ts") >= F.col("a")) & (F.col("exit_ts") < F.col("c")))  # 12 rows
    before = F.col("exit_ts") < F.col("b")
    g = own.groupBy("fold", "ticker").agg(F.count_if(before).alias("n_train"), F.count_if(~before).alias("n_test"), F.avg(F.when(before, F.col("ret"))).alias("train_mean"), F.avg(F.when(~before, F.col("ret"))).alias("test_mean"))
    return rounded(g, "train_mean", "test_mean", digits=9)


@query("sector_rebalance", f"""WITH p AS (SELECT CAST(k AS INTEGER) AS period, CAST(DATE '1996-01-01' + to_months(CAST(12 * k AS INTEGER)) AS TIMESTAMP) AS start FROM range(0, 3) t(k)),
s AS (SELECT period, ticker, avg(ret) / nullif(stddev_pop(ret), 0) AS score, count(*) AS n FROM ({_BOOK}) JOIN p ON exit_ts < start GROUP BY ALL), m AS (SELECT period, quantile_cont(score, 0.5) AS mid FROM s GROUP BY period)
SELECT period, ticker, round(score, 6) AS score, n FROM s JOIN m USING (period) WHERE score >= mid""")
def sector_rebalance(spark, d):
    periods = spark.sql("SELECT cast(id AS int) AS period, add_months(DATE'1996-01-01', cast(12 * id AS int)) AS start FROM range(3)")
    return rounded(PF.rebalance(book(spark, d), periods.withColumn("start", F.col("start").cast("timestamp_ntz"))), "score")


_STATS = f"SELECT ticker, reason, count(*) AS n, avg(ret) AS mean FROM ({_BOOK}) GROUP BY ALL"


@query("top_models", f"SELECT ticker, reason AS model, n, round(mean, 6) AS score FROM ({_STATS}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY mean DESC NULLS LAST, reason) <= 2")
def top_models(spark, d):
    g = book(spark, d).groupBy("ticker", F.col("reason").alias("model")).agg(F.count("*").alias("n"), F.avg("ret").alias("score"))
    return rounded(ML.top_models(g, ("ticker",), 2).select("ticker", "model", "n", "score"), "score")


@query("finalists", f"SELECT ticker, reason AS param_id, round(mean, 6) AS mean FROM ({_STATS}) WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY mean DESC, reason) = 1")
def finalists(spark, d):
    g = book(spark, d).groupBy("ticker", F.col("reason").alias("param_id")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))
    return rounded(PF.finalists(g, ("ticker",)).select("ticker", "param_id", "mean"), "mean")


@query("resumed_grid", "SELECT p AS param_id, p >= 3 AS fresh FROM range(0, 6) t(p)")
def resumed_grid(spark, d):
    from tidemark.plans.campaign import resume

    place = store.scratch(spark)
    done = spark.range(3).select(F.col("id").alias("param_id"), F.lit(False).alias("fresh"))
    store.write(done, place)
    return resume(spark.range(6).select(F.col("id").alias("param_id")), place, lambda todo: todo.withColumn("fresh", F.lit(True)))


def sleeve_days(spark, trades):
    """Daily returns of sleeves, written once: their names, moments and combination each read them, and the trades behind are many more."""
    return _back(spark, PF.daily_returns(trades.withColumnRenamed("ticker", "sleeve")), store.scratch(spark))


for _mode in ("equal_weight", "inverse_vol"):
    _share = "1.0 / k" if _mode == "equal_weight" else "v / vs"

    @query(f"sleeves_{_mode}", f"""WITH d AS (SELECT ticker AS sleeve, CAST(exit_ts AS DATE) AS date, avg(ret) AS ret FROM ({_BOOK}) GROUP BY ALL), t AS (SELECT count(DISTINCT date) AS n FROM d),
    s AS (SELECT sleeve, 1 / sqrt((sum(ret * ret) - sum(ret) * sum(ret) / any_value(n)) / (any_value(n) - 1)) AS v FROM d, t GROUP BY sleeve), w AS (SELECT *, sum(v) OVER () AS vs, count(*) OVER () AS k FROM s)
    SELECT date, round(sum(ret * {_share}), 6) AS ret FROM d JOIN w USING (sleeve) GROUP BY date""")
    def sleeves(spark, d, mode=_mode):
        daily = sleeve_days(spark, book(spark, d))
        names = [r[0] for r in daily.select("sleeve").distinct().orderBy("sleeve").collect()]
        mean, cov, _ = PF.sleeve_moments(daily, names)
        return rounded(PF.combine(daily, dict(zip(names, PF.weights(mean, cov, mode).tolist(), strict=True))), "ret")


# ---- evaluation at several levels
_MK = "CASE WHEN ticker < 'error' THEN 'a' ELSE 'b' END"
_PERIODS = {"first": ("2024-01-01", "2024-01-08"), "second": ("2024-01-08", "2024-02-01")}


def _net(execution: str, bps: float) -> str:
    return f"SELECT ticker, ts, 0.01 * net / (1 + abs(net)) AS net FROM (SELECT ticker, ts, gross - turnover * {bps} / 1e4 AS net FROM ({q_positions._sim(execution)}))"


_CFG = f"SELECT 'base' AS config, {_MK} AS market, * FROM ({_net('next_open', 7.0)}) UNION ALL SELECT 'late', {_MK}, * FROM ({_net('next_close', 7.0)})"
_LEVELS = f"""WITH c AS ({_CFG}), l AS (SELECT *, 'portfolio' AS level, 'ALL' AS part FROM c UNION ALL SELECT *, 'market', market FROM c UNION ALL SELECT *, 'instrument', ticker FROM c
UNION ALL {' UNION ALL '.join(f"SELECT *, 'subperiod', '{n}' FROM c WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'" for n, (a, b) in _PERIODS.items())}),
p AS (SELECT config, level, part, ts, sum(net) / count(DISTINCT ticker) AS ret FROM l GROUP BY ALL), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY config, level, part ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq FROM p),
k AS (SELECT *, eq / max(eq) OVER (PARTITION BY config, level, part ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
g AS (SELECT config, level, part, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS vol, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe, exp(sum(ln(1 + ret))) - 1 AS total_return, min(dd) AS max_drawdown FROM k GROUP BY ALL)"""


def _configs(spark, d):
    small = 0.01 * F.col("net") / (1 + F.abs("net"))
    market = F.when(F.col("ticker") < "error", "a").otherwise("b")
    own = lambda how, name: P.simulate(crossing(spark, d), execution=how).select(F.lit(name).alias("config"), market.alias("market"), "ticker", "ts", small.alias("net"))
    return own("next_open", "base").unionByName(own("next_close", "late"))


@query("evaluate_levels", f"""{_LEVELS} SELECT g.config, g.level, g.part, g.n, round(g.mean, 8) AS mean, round(g.vol, 8) AS vol, round(g.sharpe, 5) AS sharpe, round(g.total_return, 6) AS total_return, round(g.max_drawdown, 6) AS max_drawdown,
round(g.sharpe - b.sharpe, 5) AS d_sharpe, round(g.total_return - b.total_return, 6) AS d_total_return, round(g.max_drawdown - b.max_drawdown, 6) AS d_max_drawdown FROM g LEFT JOIN g b ON b.config = 'base' AND b.level = g.level AND b.part = g.part""")
def evaluate_levels(spark, d):
    g = EV.evaluate(_configs(spark, d), _PERIODS)
    return rounded(rounded(rounded(g, "mean", "vol", digits=8), "sharpe", "d_sharpe", digits=5), "total_return", "max_drawdown", "d_total_return", "d_max_drawdown")


_MECHANISMS = (("next_open", 0.0), ("next_open", 7.0), ("next_open", 21.0), ("next_close", 7.0), ("same_close", 7.0))


@query("sensitivity", " UNION ALL ".join(f"SELECT '{how}|{bps:g}' AS config, ticker, count(*) AS n, round(sum(0.01 * net / (1 + abs(net))), 5) AS total FROM (SELECT ticker, gross - turnover * {bps} / 1e4 AS net FROM ({q_positions._sim(how)})) GROUP BY ticker" for how, bps in _MECHANISMS))
def sensitivity(spark, d):
    g = EV.sensitivity(crossing(spark, d), mechanisms=_MECHANISMS).groupBy("config", "ticker")
    return rounded(g.agg(F.count("*").alias("n"), F.sum(0.01 * F.col("net") / (1 + F.abs("net"))).alias("total")), "total", digits=5)


_TWO = f"WITH a AS (SELECT ticker, CAST(ts AS DATE) AS ts, last(close ORDER BY ts) AS x, first(close ORDER BY ts) AS y FROM ({B1}) GROUP BY ALL)"


@query("source_agreement", f"""{_TWO}, r AS (SELECT ticker, ts, x / {S.lag('x')} - 1 AS rx, y / {S.lag('y')} - 1 AS ry FROM a), w AS (SELECT ticker, date_trunc('week', ts) AS ts, last(x ORDER BY ts) AS x, last(y ORDER BY ts) AS y FROM a GROUP BY ALL),
v AS (SELECT ticker, x / {S.lag('x')} - 1 AS rx, y / {S.lag('y')} - 1 AS ry FROM w), g AS (SELECT ticker, count(*) AS n, corr(rx, ry) AS c, stddev_samp(rx - ry) * sqrt(252) AS t FROM r WHERE rx IS NOT NULL AND ry IS NOT NULL GROUP BY ticker), h AS (SELECT ticker, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS c FROM v WHERE rx IS NOT NULL AND ry IS NOT NULL GROUP BY ticker)
SELECT g.ticker, g.n, round(g.c, 5) AS corr, round(g.t, 4) AS tracking_error, round(h.c, 5) AS weekly_corr FROM g LEFT JOIN h USING (ticker)""")
def source_agreement(spark, d):
    own = event_bars(spark, d).withColumn("day", F.to_date("ts"))
    a, b = (own.groupBy("ticker", F.col("day").alias("ts")).agg(pick("close", "ts").alias("close")) for pick in (F.max_by, F.min_by))
    return rounded(rounded(EV.agreement(a, b), "corr", "weekly_corr", digits=5), "tracking_error", digits=4)


@query("entry_overlap", f"WITH e AS (SELECT DISTINCT ticker, entry_ts FROM ({_BOOK})) SELECT a.ticker AS a, b.ticker AS b, count(*) AS shared FROM e a JOIN e b ON a.entry_ts = b.entry_ts AND a.ticker < b.ticker GROUP BY ALL")
def entry_overlap(spark, d):
    return EV.overlap(book(spark, d))


@query("strategy_vs_benchmark", f"""WITH m AS (SELECT CAST(ts AS DATE) AS date, max_by(close, ts) AS c FROM ({B1}) WHERE ticker = 'view' GROUP BY ALL), b AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS k FROM m),
s AS (SELECT CAST(ts AS DATE) AS date, avg(close / open - 1) AS ret FROM ({B1}) WHERE ticker = 'click' GROUP BY ALL) SELECT date, round(ret, 6) AS ret, round(k, 6) AS benchmark, round(ret - k, 6) AS excess FROM s JOIN b USING (date)""")
def strategy_vs_benchmark(spark, d):
    own = event_bars(spark, d)
    daily = own.filter("ticker = 'click'").groupBy(F.to_date("ts").alias("date")).agg(F.avg(F.col("close") / F.col("open") - 1).alias("ret"))
    return rounded(EV.with_benchmark(daily, own.filter("ticker = 'view'")), "ret", "benchmark", "excess")


# ---- inference
def _phi(z: str) -> str:
    """The normal distribution function by its power series."""
    terms = f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * i + 3) - (i + 1) * ln(2) - lgamma(i + 2)))))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms})"


_MOM = f"SELECT ticker, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, avg(pow(ret - mu, 3)) / pow(any_value(s), 3) AS g1, avg(pow(ret - mu, 4)) / pow(any_value(s), 4) AS g2 FROM (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS mu, stddev_pop(ret) OVER (PARTITION BY ticker) AS s FROM ({_BOOK})) GROUP BY ticker"
_LUCK = ST.best_by_luck(1.0, 25)


@query("deflated_sharpe", f"WITH g AS ({_MOM}), e AS (SELECT *, m / sd AS sr, sqrt((1 - g1 * (m / sd) + (g2 - 1) / 4 * pow(m / sd, 2)) / (n - 1)) AS err FROM g), z AS (SELECT *, (sr - err * {_LUCK!r}) / err AS z FROM e) SELECT ticker, round({_phi('z')}, 5) AS probability FROM z")
def deflated_sharpe(spark, d):
    rows = ST.moments(book(spark, d), "ret", ("ticker",)).collect()  # one row a strategy
    return spark.createDataFrame([(r[0], round(ST.deflated_sharpe(*r[1:6], trials=25), 5)) for r in rows], "ticker string, probability double")


@query("deflated_sharpe_annual", f"WITH g AS ({_MOM}), s AS (SELECT *, m / sd * sqrt(252) AS sr FROM g), v AS (SELECT var_samp(sr) AS v FROM s), e AS (SELECT s.*, v, sqrt((1 - g1 * (sr / sqrt(252)) + (g2 - 1) / 4 * pow(sr / sqrt(252), 2)) / (n - 1)) AS err FROM s, v), z AS (SELECT *, (sr / sqrt(252) - sqrt(v / 252) * {_LUCK!r}) / err AS z FROM e) SELECT ticker, round({_phi('z')}, 5) AS probability FROM z")
def deflated_sharpe_annual(spark, d):
    rows = ST.moments(book(spark, d), "ret", ("ticker",)).collect()
    sr = [r[2] / r[3] * math.sqrt(252) for r in rows]
    v = float(np.var(sr, ddof=1))
    return spark.createDataFrame([(r[0], round(ST.deflated_sharpe_annual(s, r[1], 25, v, r[4], r[5]), 5)) for r, s in zip(rows, sr, strict=True)], "ticker string, probability double")


_PBO = f"""WITH r AS (SELECT ticker, ts, 0.01 * (close - {S.lag('close')}) / (close + {S.lag('close')}) AS ret FROM ({B1})), x AS (SELECT * FROM r WHERE ret IS NOT NULL),
t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM x)), u AS (SELECT ts, CAST(CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE (n % 8) + (i - (n % 8) * (n // 8 + 1)) // greatest(n // 8, 1) END AS INTEGER) AS block FROM t),
s AS (SELECT ticker, block, sum(ret) AS total, count(*) AS n FROM x JOIN u USING (ts) GROUP BY ALL), c AS (SELECT m FROM range(0, 256) q(m) WHERE bit_count(CAST(m AS INTEGER)) = 4),
p AS (SELECT m, ticker, sum(total) FILTER ((m >> block) & 1 = 1) / sum(n) FILTER ((m >> block) & 1 = 1) AS i, sum(total) FILTER ((m >> block) & 1 = 0) / sum(n) FILTER ((m >> block) & 1 = 0) AS o FROM s, c GROUP BY ALL),
w AS (SELECT m, o AS best FROM p QUALIFY row_number() OVER (PARTITION BY m ORDER BY i DESC, ticker) = 1), k AS (SELECT p.m, count(*) FILTER (p.o < w.best) + 1 AS rank, count(*) AS n FROM p JOIN w USING (m) GROUP BY p.m)"""


@query("pbo", f"{_PBO} SELECT round(avg(CASE WHEN 2 * rank <= n + 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS pbo FROM k")
def pbo(spark, d):
    rows = ST.block_means(q_positions.small_returns(spark, d).filter("ret IS NOT NULL"), "ticker", "ts", "ret", 8).collect()  # strategies x blocks
    names = sorted({r.ticker for r in rows})
    sums, counts = np.zeros((len(names), 8)), np.zeros((len(names), 8))
    for r in rows:
        sums[names.index(r.ticker), r.block], counts[names.index(r.ticker), r.block] = r.total, r.n
    return spark.createDataFrame([(round(float(ST.overfitting(sums, counts)), 6),)], "pbo double")


@query("by_adjust", "WITH t AS (SELECT p_partkey AS id, p_size / 60.0 AS p FROM part), h AS (SELECT sum(1.0::DOUBLE / i) AS c FROM range(1, (SELECT count(*) + 1 FROM part)) q(i)), s AS (SELECT id, p * count(*) OVER () * c / row_number() OVER (ORDER BY p, id) AS s, p FROM t, h) SELECT id, round(least(min(s) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_by FROM s")
def by_adjust(spark, d):
    own = load(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 60.0).alias("p"))
    return rounded(ST.benjamini_hochberg(own, out="p_by", dependent=True).select("id", "p_by"), "p_by")


_ADF = f"""WITH a AS (SELECT ticker, ts, close - {S.lag('close')} AS y, {S.lag('close')} AS x FROM ({B1})), b AS (SELECT ticker, y, x, {S.lag('y')} AS z FROM a), c AS (SELECT * FROM b WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
f AS (SELECT ticker, regr_slope(y, z) AS b1, regr_intercept(y, z) AS a1, regr_slope(x, z) AS b2, regr_intercept(x, z) AS a2, count(*) AS n FROM c GROUP BY ticker),
e AS (SELECT ticker, n, y - a1 - b1 * z AS ey, x - a2 - b2 * z AS ex FROM c JOIN f USING (ticker)), g AS (SELECT ticker, any_value(n) AS n, sum(ex * ey) / sum(ex * ex) AS beta, sum(ey * ey) AS yy, sum(ex * ey) AS xy, sum(ex * ex) AS xx FROM e GROUP BY ticker)
SELECT ticker, round(beta / sqrt((yy - beta * xy) / (n - 3) / xx), 4) AS t FROM g"""


@query("unit_root", _ADF)
def unit_root(spark, d):
    got = PR.unit_root(event_bars(spark, d), "close")  # one number a series
    return spark.createDataFrame([(k[0], round(v, 4)) for k, v in sorted(got.items())], "ticker string, t double")


@query("past_share", f"WITH b AS (SELECT ticker, ts, close FROM ({B1})), r AS (SELECT close AS v FROM b WHERE ticker = 'view') SELECT ticker, ts, round((SELECT count(*) FROM r WHERE v <= b.close)::DOUBLE / (SELECT count(*) FROM r), 6) AS share FROM b WHERE ticker <> 'view'")
def past_share(spark, d):
    own = event_bars(spark, d, "1h").select("ticker", "ts", F.col("close").alias("score"))
    return rounded(P.past_share(own.filter("ticker <> 'view'"), own.filter("ticker = 'view'")).select("ticker", "ts", "share"), "share")


# resampled or shuffled: held by tests
@query("placebo_scores")
def placebo_scores(spark, d):
    return EV.shuffled(event_bars(spark, d, "4h").select("ticker", "ts", "close"), "close")


@query("principal_curvature")
def principal_curvature(spark, d):
    names = ["click", "error", "purchase", "view"]
    wide = event_bars(spark, d, "4h").groupBy("ts").pivot("ticker", names).agg(F.first("close"))
    return SG.curvature(wide, names)


def _differences(spark, d):
    wide = q_positions.small_returns(spark, d).filter("ret IS NOT NULL").groupBy("ts").pivot("ticker", ["click", "error", "purchase", "view"]).agg(F.first("ret")).na.drop().orderBy("ts")
    return wide.drop("ts").toPandas().to_numpy()  # one row a time: what the tests resample


@query("superior_ability")
def superior_ability(spark, d):
    got = ST.superior_ability(spark, _differences(spark, d), draws=500)
    return spark.createDataFrame([(float(got["p_spa"]), float(got["p_rc"]), int(got["best"]))], "p_spa double, p_rc double, best int")


@query("step_down")
def step_down(spark, d):
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(ST.step_down(spark, _differences(spark, d), draws=500))], "strategy int, p double")


@query("romano_wolf")
def romano_wolf(spark, d):
    x = _differences(spark, d)
    return spark.createDataFrame([(i, bool(r)) for i, r in enumerate(ST.romano_wolf(spark, list(x.T), draws=300))], "strategy int, rejected boolean")


@query("sharpe_interval")
def sharpe_interval(spark, d):
    x = _differences(spark, d)
    got = ST.sharpe_difference_bootstrap(spark, x[:, 0], x[:, 1], draws=500)
    lo, hi = ST.paired_interval(spark, x[:, 0], x[:, 1], draws=500)
    return spark.createDataFrame([(*[float(got[k]) for k in ("d_sharpe", "p_two", "p_one", "ci_lo", "ci_hi")], lo, hi)], "d_sharpe double, p_two double, p_one double, ci_lo double, ci_hi double, mean_lo double, mean_hi double")


@query("trade_bootstrap")
def trade_bootstrap(spark, d):
    rets = [r.ret for r in book(spark, d).filter("ticker = 'Brand#1'").orderBy("exit_ts", "l_orderkey", "l_linenumber").select("ret").collect()]  # one instrument's trades
    return BT.bootstrap_paths(spark, rets or [0.0], paths=200, days=100)


_OVERLAY_FOLDS = [{"label": "1", "train_start": None, "val_start": "2024-01-11", "test_start": "2024-01-16", "test_end": "2024-02-01"}]


@query("overlay_stages")
def overlay_stages(spark, d):
    from tidemark.plans import overlay_run

    return overlay_run.run(event_bars(spark, d), "sma_50_200", _OVERLAY_FOLDS, overlay_run.Settings(least=50))[0]


@query("overlay_choices")
def overlay_choices(spark, d):
    from tidemark.plans import overlay_run

    return overlay_run.run(event_bars(spark, d), "ema_12_26", _OVERLAY_FOLDS, overlay_run.Settings(least=50, stages=("filter", "gate")))[1]


QUERIES["vol_target_weights"], ORACLE["vol_target_weights"] = q_folds.QUERIES.pop("vol_target_weights"), q_folds.ORACLE.pop("vol_target_weights")
