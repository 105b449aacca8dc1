"""Queries: metrics, joins, cross-section, positions and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel, correlation
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import overlay as ML
from tidemark.operators import portfolio as PF
from tidemark.operators import positions as P
from tidemark.operators import signals as SG
from tidemark.operators import stats as ST
from tidemark.plans import sql as S
from tidemark.plans.q_bars import event_bars, event_ticks, load, order_bars, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


#: The trade log: each order line is a trade of its part's brand, entered on its order's date.
_BOOK = """SELECT p_brand AS ticker, o_orderdate AS entry_ts, l_shipdate AS exit_ts, l_orderkey, l_linenumber, (CAST(l_quantity AS INTEGER) % 2) * 2 - 1 AS direction, l_extendedprice / nullif(l_quantity, 0) AS entry_price,
CASE WHEN l_returnflag = 'R' THEN 'stop' WHEN l_returnflag = 'A' THEN 'target' ELSE 'eod' END AS reason, l_discount - l_tax + 0.001 * l_linenumber - 0.012 AS ret
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def book(spark, d: str) -> DataFrame:
    lines, own, parts = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "part")
    reason = F.when(F.col("l_returnflag") == "R", "stop").when(F.col("l_returnflag") == "A", "target").otherwise("eod")
    df = lines.join(own, lines.l_orderkey == own.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return df.select(
        F.col("p_brand").alias("ticker"), F.col("o_orderdate").alias("entry_ts"), F.col("l_shipdate").alias("exit_ts"), "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 2 * 2 - 1).alias("direction"),
        F.try_divide("l_extendedprice", F.nullif("l_quantity", F.lit(0.0))).alias("entry_price"), reason.alias("reason"), (F.col("l_discount") - F.col("l_tax") + F.lit(0.001) * F.col("l_linenumber") - 0.012).alias("ret"),
    )


_EQ = "exp(sum(ln(1 + ret)) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING))"


@query("trade_stats", f"""WITH b AS ({_BOOK}), e AS (SELECT *, {_EQ.format(k='ticker', o='exit_ts, l_orderkey, l_linenumber')} AS eq FROM b), k AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY exit_ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
g AS (SELECT ticker, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win, exp(sum(ln(1 + ret))) - 1 AS total, avg(ret) AS m, stddev_pop(ret) AS s, stddev_pop(ret) FILTER (ret < 0) AS ds, min(dd) AS dd, sum(ret) FILTER (ret > 0) AS won, -sum(ret) FILTER (ret < 0) AS lost, date_diff('day', min(entry_ts), max(exit_ts)) / 365.25 AS y FROM k GROUP BY ticker),
q AS (SELECT *, CASE WHEN y > 0 AND n > 1 THEN n / y ELSE 252 END AS p FROM g)
SELECT ticker, n AS n_trades, round(win, 6) AS win_rate, round(total, 6) AS total_return, round(m, 6) AS avg_ret, round(sqrt(p) * (m - 0.06 / p) / s, 5) AS sharpe, round(sqrt(p) * m / ds, 5) AS sortino, round(dd, 6) AS max_drawdown, round(won / lost, 6) AS profit_factor FROM q""")
def trade_stats(spark, d):
    g = M.trade_stats(book(spark, d), entry="entry_ts", exit="exit_ts", order=("exit_ts", "l_orderkey", "l_linenumber"))
    return rounded(rounded(g, "win_rate", "total_return", "avg_ret", "max_drawdown", "profit_factor"), "sharpe", "sortino", digits=5)


_SMALL = f"SELECT ticker, ts, 0.01 * (close - {S.lag('close')}) / (close + {S.lag('close')}) AS ret FROM ({S.BARS_1H})"


def small_returns(spark, d: str) -> DataFrame:
    """Bounded returns of event bars, so that compounding stays finite."""
    p = Panel(event_bars(spark, d))
    before = p.lag("close")
    return p.select(ret=0.01 * (F.col("close") - before) / (F.col("close") + before))


@query("max_drawdown", f"WITH r AS (SELECT * FROM ({_SMALL}) WHERE ret IS NOT NULL), e AS (SELECT *, {_EQ.format(k='ticker', o='ts')} AS eq FROM r), k AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e) SELECT ticker, round(min(dd), 6) AS max_drawdown FROM k GROUP BY ticker")
def max_drawdown(spark, d):
    return M.equity(small_returns(spark, d).filter("ret IS NOT NULL")).groupBy("ticker").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))


@query("sharpe_sortino", f"WITH r AS (SELECT * FROM ({_SMALL}) WHERE ret IS NOT NULL) SELECT ticker, round(sqrt(252) * (avg(ret) - 0.06 / 252) / nullif(stddev_pop(ret), 0), 6) AS sharpe, round(sqrt(252) * avg(ret) / nullif(stddev_pop(ret) FILTER (ret < 0), 0), 6) AS sortino FROM r GROUP BY ticker")
def sharpe_sortino(spark, d):
    g = small_returns(spark, d).groupBy("ticker").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).alias("n"))
    return g.select("ticker", F.round(F.lit(252.0) ** 0.5 * (F.col("m") - M.RISK_FREE / 252) / F.nullif("s", F.lit(0.0)), 6).alias("sharpe"), F.round(F.lit(252.0) ** 0.5 * F.col("m") / F.nullif("n", F.lit(0.0)), 6).alias("sortino"))


@query("profit_factor", f"WITH r AS ({_SMALL}) SELECT ticker, round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 6) AS profit_factor FROM r GROUP BY ticker")
def profit_factor(spark, d):
    won, lost = F.sum(F.when(F.col("ret") > 0, F.col("ret"))), F.sum(F.when(F.col("ret") < 0, -F.col("ret")))
    g = small_returns(spark, d).groupBy("ticker").agg(won.alias("w"), lost.alias("l"))
    return g.select("ticker", F.round(M.profit_factor("w", "l"), 6).alias("profit_factor"))


_OSMALL = f"SELECT ticker, ts, 0.01 * (close - {S.lag('close')}) / (close + {S.lag('close')}) AS ret FROM (SELECT o_orderpriority AS ticker, o_orderdate AS ts, last(o_totalprice ORDER BY o_orderkey) AS close FROM orders GROUP BY ALL)"


def order_returns(spark, d: str) -> DataFrame:
    p = Panel(order_bars(spark, d))
    before = p.lag("close")
    return p.select(ret=0.01 * (F.col("close") - before) / (F.col("close") + before)).filter("ret IS NOT NULL")


@query("quarterly_hpr", f"WITH r AS (SELECT * FROM ({_OSMALL}) WHERE ret IS NOT NULL), e AS (SELECT *, {_EQ.format(k='ticker', o='ts')} AS eq FROM r) SELECT ticker, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS quarter, round(last(eq ORDER BY ts) / first(eq ORDER BY ts) - 1, 6) AS hpr FROM e GROUP BY ALL")
def quarterly_hpr(spark, d):
    return rounded(M.quarterly_hpr(order_returns(spark, d)), "hpr").withColumn("quarter", F.col("quarter").cast("timestamp_ntz"))


_SCORES = f"WITH r AS (SELECT * FROM ({_SMALL}) WHERE ret IS NOT NULL), e AS (SELECT *, {_EQ.format(k='ticker', o='ts')} AS eq FROM r), k AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e), t AS (SELECT ticker, avg(ret) / stddev_pop(ret) AS sharpe, exp(sum(ln(1 + ret))) - 1 AS total_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(dd) AS max_drawdown FROM k GROUP BY ticker)"


@query("rank_and_score", f"{_SCORES}, m AS (SELECT min(sharpe) a, max(sharpe) b, min(total_return) c, max(total_return) d, min(win_rate) e, max(win_rate) f, min(max_drawdown) g, max(max_drawdown) h FROM t) SELECT ticker, round(0.4 * (sharpe - a) / (b - a) + 0.3 * (total_return - c) / (d - c) + 0.2 * (win_rate - e) / (f - e) + 0.1 * (h - max_drawdown) / (h - g), 6) AS composite_score FROM t, m")
def rank_and_score(spark, d):
    e = M.equity(small_returns(spark, d).filter("ret IS NOT NULL"))
    t = e.groupBy("ticker").agg((F.avg("ret") / F.stddev_pop("ret")).alias("sharpe"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.min("drawdown").alias("max_drawdown"))
    return rounded(M.rank_and_score(t).select("ticker", "composite_score"), "composite_score")


@query("pnl_by_weekday", f"SELECT ticker, dayname(exit_ts) AS weekday, count(*) AS n, round(sum(ret), 6) AS pnl FROM ({_BOOK}) GROUP BY ALL")
def pnl_by_weekday(spark, d):
    return book(spark, d).groupBy("ticker", F.date_format("exit_ts", "EEEE").alias("weekday")).agg(F.count("*").alias("n"), F.round(F.sum("ret"), 6).alias("pnl"))


@query("pnl_by_reason_direction", f"SELECT reason, direction, count(*) AS n, round(avg(ret), 8) AS mean FROM ({_BOOK}) GROUP BY ALL")
def pnl_by_reason(spark, d):
    return book(spark, d).groupBy("reason", "direction").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 8).alias("mean"))


@query("pnl_by_hour", f"SELECT hour(ts) AS hour, count(*) AS n, round(sum(price), 4) AS total FROM ({S.ticks()}) GROUP BY ALL")
def pnl_by_hour(spark, d):
    return event_ticks(spark, d).groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("pnl_month_pivot", f"SELECT year(exit_ts) AS year, {', '.join(f'round(sum(ret) FILTER (month(exit_ts) = {m}), 6) AS m{m:02d}' for m in range(1, 13))} FROM ({_BOOK}) GROUP BY ALL")
def pnl_month_pivot(spark, d):
    return rounded(M.pivot_month(book(spark, d), "ret", "exit_ts"), *[f"m{m:02d}" for m in range(1, 13)]).withColumn("year", F.col("year").cast("bigint"))


@query("qcut_bins", """WITH e AS (SELECT quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM events), b AS (SELECT greatest(len(list_filter(q, lambda x: x < value)) - 1, 0) AS bin, value FROM events, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY bin""")
def qcut_bins(spark, d):
    return rounded(M.quantile_bins(load(spark, d, "events"), "value", "value"), "mean")


@query("equal_width_bins", "WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), x AS (SELECT least(floor((value - a) * 10 / (b - a)), 9) AS bin, value FROM events, e) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY bin")
def equal_width_bins(spark, d):
    ev = load(spark, d, "events").select("value")
    ends = ev.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    x = ev.join(F.broadcast(ends))  # one row
    return x.groupBy(F.least(F.floor((F.col("value") - F.col("a")) * 10 / (F.col("b") - F.col("a"))), F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("topk_per_group", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3")
def topk(spark, d):
    return M.top_k(load(spark, d, "events"), ("event_type",), (F.desc("value"), "event_id"), 3).select("event_type", "event_id", "value")


@query("distinct_names", "SELECT n.n_name, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS names FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n.n_name")
def distinct_names(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.countDistinct("c_mktsegment").alias("segments"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ", ").alias("names"))


@query("daily_pair_corr", f"""WITH b AS ({S.BARS_1D}), w AS (SELECT ts, max(close) FILTER (ticker = 'click') AS click, max(close) FILTER (ticker = 'error') AS error, max(close) FILTER (ticker = 'view') AS view FROM b GROUP BY ts)
SELECT 'click' AS a, 'error' AS b, round(corr(click, error), 6) AS corr FROM w UNION ALL SELECT 'click', 'view', round(corr(click, view), 6) FROM w UNION ALL SELECT 'error', 'view', round(corr(error, view), 6) FROM w""")
def daily_pair_corr(spark, d):
    names = ["click", "error", "view"]
    return rounded(M.pair_correlations(event_bars(spark, d, "daily").groupBy("ts").pivot("ticker", names).agg(F.first("close")), names), "corr")


@query("spearman_corr", "WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_custkey) + 0.0 AS b FROM customer) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    c = load(spark, d, "customer").select("c_acctbal", "c_custkey").withColumn("one", F.lit(1))
    c = P.percent_rank_average(P.percent_rank_average(c, "one", "c_acctbal", "a"), "one", "c_custkey", "b")
    return c.agg(F.round(correlation("a", "b"), 6).alias("rho"))


@query("histogram_entropy", "WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), x AS (SELECT least(floor((value - a) * 10 / (b - a)), 9) AS bin FROM events, e), n AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM x GROUP BY bin) SELECT round(sum(-p * ln(p)), 6) AS entropy FROM n")
def histogram_entropy(spark, d):
    return rounded(ML.entropy_of_histogram(load(spark, d, "events"), "value"), "entropy")


@query("cosine_to_first", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) f")
def cosine_to_first(spark, d):
    e = load(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(ML.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))  # one row


@query("json_props_mean", "SELECT event_type, count(CAST(json_extract(props, '$.k') AS INTEGER)) AS n, round(avg(CAST(json_extract(props, '$.k') AS INTEGER)), 6) AS mean FROM events GROUP BY event_type")
def json_props(spark, d):
    return load(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"]).groupBy("event_type").agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("mean"))


@query("melt_prices", f"SELECT ticker, ts, field, value FROM (UNPIVOT (SELECT ticker, ts, open, close FROM ({S.BARS_1D})) ON open, close INTO NAME field VALUE value)")
def melt_prices(spark, d):
    return event_bars(spark, d, "daily").unpivot(["ticker", "ts"], ["open", "close"], "field", "value")


@query("monthly_rolling_sharpe", f"WITH m AS (SELECT ticker, date_trunc('month', exit_ts) AS ts, sum(ret) AS pnl FROM ({_BOOK}) GROUP BY ALL) SELECT ticker, CAST(ts AS TIMESTAMP) AS ts, round({S.div(S.full('avg', 'pnl', 6), S.full('stddev_samp', 'pnl', 6))}, 5) AS sharpe FROM m")
def monthly_sharpe(spark, d):
    m = book(spark, d).groupBy("ticker", F.date_trunc("month", "exit_ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("ret").alias("pnl"))
    p = Panel(m)
    return rounded(p.select(sharpe=F.try_divide(p.mean("pnl", 6), F.nullif(p.std("pnl", 6), F.lit(0.0)))), "sharpe", digits=5)


@query("regime_stats", f"""WITH b AS ({S.BARS_1D}), r AS (SELECT *, close - {S.lag('close')} AS r FROM b), v AS (SELECT ticker, ts, {S.full('stddev_samp', 'r', 5)} AS v FROM r), m AS (SELECT ticker, quantile_cont(v, 0.5) AS mid FROM v GROUP BY ticker),
l AS (SELECT v.ticker, v.ts, CASE WHEN v > mid THEN 'high' WHEN v IS NOT NULL THEN 'low' END AS regime FROM v JOIN m USING (ticker)) SELECT t.ticker, coalesce(l.regime, 'none') AS regime, count(*) AS n, round(avg(price), 6) AS mean FROM ({S.ticks()}) t LEFT JOIN l ON t.ticker = l.ticker AND date_trunc('day', t.ts) = l.ts GROUP BY ALL""")
def regime_stats(spark, d):
    p = Panel(event_bars(spark, d, "daily"))
    v = p.select(v=p.std(p.diff("close"), 5))
    mid = v.groupBy("ticker").agg(F.percentile("v", 0.5).alias("mid"))
    label = v.join(mid, "ticker").select("ticker", F.col("ts").alias("day"), F.when(F.col("v") > F.col("mid"), "high").when(F.col("v").isNotNull(), "low").alias("regime"))
    t = event_ticks(spark, d).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return t.join(label, ["ticker", "day"], "left").groupBy("ticker", F.coalesce("regime", F.lit("none")).alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"))


# joins
_SIGNAL = f"SELECT ticker, ts, CASE WHEN close > {S.lag('close')} THEN 1 WHEN close < {S.lag('close')} THEN -1 ELSE 0 END AS signal FROM ({S.BARS_4H})"


def four_hour_signal(spark, d: str) -> DataFrame:
    p = Panel(event_bars(spark, d, "4h"))
    before = p.lag("close")
    return p.select(signal=F.when(F.col("close") > before, 1).when(F.col("close") < before, -1).otherwise(0))


@query("asof_signal", f"WITH s AS (SELECT * FROM ({_SIGNAL}) WHERE ticker = 'view'), f AS (SELECT ticker, ts, close FROM ({S.BARS_1H}) WHERE ticker = 'click') SELECT f.ts, f.close, coalesce(s.signal, 0) AS signal FROM f ASOF LEFT JOIN s ON f.ts >= s.ts")
def asof_signal(spark, d):
    s, f = four_hour_signal(spark, d).filter("ticker = 'view'"), event_bars(spark, d).filter("ticker = 'click'")
    return J.asof(f.select("ts", "close"), s.select("ts", "signal"), "ts", (), ("signal",)).withColumn("signal", F.coalesce("signal", F.lit(0)))


@query("asof_by_key", f"WITH s AS ({_SIGNAL}), f AS (SELECT ticker, ts, close FROM ({S.BARS_1H})) SELECT f.ticker, f.ts, f.close, s.signal FROM f ASOF LEFT JOIN s ON f.ticker = s.ticker AND f.ts >= s.ts")
def asof_by_key(spark, d):
    return J.asof(event_bars(spark, d).select("ticker", "ts", "close"), four_hour_signal(spark, d), "ts", ("ticker",), ("signal",))


@query("asof_lagged", f"WITH s AS (SELECT ticker, ts, lag(signal) OVER {S.WO} AS signal FROM ({_SIGNAL})), f AS (SELECT ticker, ts, close FROM ({S.BARS_1H})) SELECT f.ticker, f.ts, f.close, s.signal FROM f ASOF LEFT JOIN s ON f.ticker = s.ticker AND f.ts >= s.ts")
def asof_lagged(spark, d):
    return J.asof(event_bars(spark, d).select("ticker", "ts", "close"), four_hour_signal(spark, d), "ts", ("ticker",), ("signal",), lag_rows=1)


@query("live_count_range", "WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey), t AS (SELECT DISTINCT o_orderdate AS ts FROM orders) SELECT t.ts, count(s.o_custkey) AS live FROM t LEFT JOIN s ON t.ts BETWEEN s.a AND s.b GROUP BY t.ts")
def live_count(spark, d):
    o = load(spark, d, "orders")
    spans = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return J.live_count(o.select(F.col("o_orderdate").alias("ts")).distinct(), spans, "ts", "a", "b")


@query("broadcast_cost", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (s_acctbal / 100000), 4) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def broadcast_cost(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    x = J.lookup(lines, load(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return x.filter("s_acctbal IS NOT NULL").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (F.col("s_acctbal") / 100000), 4).alias("cost"))


@query("param_grid_cross", "SELECT fast, slow, concat('fast=', fast, ',slow=', slow) AS param_id, n_name FROM (VALUES (3), (5)) a(fast), (VALUES (10), (20), (40)) b(slow), nation")
def param_grid(spark, d):
    g = J.grid(spark, fast=[3, 5], slow=[10, 20, 40]).withColumns({"fast": F.col("fast").cast("int"), "slow": F.col("slow").cast("int")})
    return load(spark, d, "nation").select("n_name").crossJoin(F.broadcast(g)).select("fast", "slow", "param_id", "n_name")  # six rows


@query("semi_universe", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_universe(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_missing", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_missing(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing_work(load(spark, d, "customer"), o, "c_custkey").select("c_custkey", "c_mktsegment")


@query("inner_six_legs", f"WITH b AS ({S.BARS_4H}) SELECT a.ts, a.close AS click, b2.close AS error, c.close AS purchase, e.close AS signup, f.close AS view FROM b a JOIN b b2 USING (ts) JOIN b c USING (ts) JOIN b e USING (ts) JOIN b f USING (ts) WHERE a.ticker = 'click' AND b2.ticker = 'error' AND c.ticker = 'purchase' AND e.ticker = 'signup' AND f.ticker = 'view'")
def six_legs(spark, d):
    b = event_bars(spark, d, "4h")
    names = ["click", "error", "purchase", "signup", "view"]
    return b.groupBy("ts").pivot("ticker", names).agg(F.first("close")).na.drop(subset=names)


@query("outer_align_fill0", "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS s, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL) SELECT date, round(coalesce(max(v) FILTER (s = '1-URGENT'), 0), 4) AS urgent, round(coalesce(max(v) FILTER (s = '5-LOW'), 0), 4) AS low FROM x GROUP BY date")
def outer_align(spark, d):
    o = load(spark, d, "orders")
    own = lambda p: o.filter(F.col("o_orderpriority") == p).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(J.outer_align({"urgent": own("1-URGENT"), "low": own("5-LOW")}, "date", "v"), "urgent", "low", digits=4)


@query("merge_latest", "WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def merge_latest(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    even = F.col("o_orderkey") % 2 == 0
    return J.merge_latest(o.filter(even), o.filter(~even), ("o_custkey",), "o_orderkey")


@query("set_operations", "SELECT k, 'both' AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT k, 'idle' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    a, b = load(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.exceptAll(a).withColumn("side", F.lit("idle")))


# cross-section
_PAST = f"WITH b AS ({S.BARS_4H}), x AS (SELECT *, close / nullif({S.lag('close', 3)}, 0) - 1 AS past FROM b), k AS (SELECT *, CASE WHEN past IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY past NULLS LAST) + (count(*) OVER (PARTITION BY ts, past) - 1) / 2.0) / count(past) OVER (PARTITION BY ts) END AS rank FROM x)"
_WEIGHT = f"{_PAST}, n AS (SELECT *, count(*) FILTER (rank >= 0.8) OVER (PARTITION BY ts) AS nu, count(*) FILTER (rank <= 0.2) OVER (PARTITION BY ts) AS nd FROM k), g AS (SELECT *, CASE WHEN rank >= 0.8 THEN 1.0 / nu ELSE 0 END - CASE WHEN rank <= 0.2 THEN 1.0 / nd ELSE 0 END AS weight FROM n)"


@query("xs_rank", f"{_PAST} SELECT ticker, ts, round(rank, 6) AS rank FROM k")
def xs_rank(spark, d):
    return rounded(SG.trailing_rank(event_bars(spark, d, "4h"), 3), "rank").select("ticker", "ts", "rank")


@query("xs_long_short", f"{_WEIGHT} SELECT ticker, ts, round(weight, 6) AS weight FROM g")
def xs_long_short(spark, d):
    return rounded(P.long_short(SG.trailing_rank(event_bars(spark, d, "4h"), 3), "ts"), "weight").select("ticker", "ts", "weight")


@query("xs_returns_hold", f"{_WEIGHT}, i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM g)), j AS (SELECT g.*, CASE WHEN i % 6 = 0 THEN weight END AS w0 FROM g JOIN i USING (ts)), h AS (SELECT *, last_value(w0 IGNORE NULLS) OVER {S.CUM} AS kept FROM j), l AS (SELECT ts, (close / nullif({S.lag('close')}, 0) - 1) * {S.lag('kept')} AS r FROM h) SELECT ts, round(sum(r), 5) AS ret, count(r) AS n FROM l GROUP BY ts")
def xs_returns(spark, d):
    return rounded(SG.cross_sectional_returns(event_bars(spark, d, "4h"), 3, 6), "ret", digits=5)


@query("broad_market", f"WITH b AS ({S.BARS_4H}), f AS (SELECT *, first_value(close) OVER {S.CUM} AS k FROM b) SELECT ts, round(avg(close / k), 6) AS close, sum(volume) AS volume FROM f GROUP BY ts")
def broad_market(spark, d):
    return rounded(SG.broad_market(event_bars(spark, d, "4h")).select("ts", "close", "volume"), "close")


# positions
_CROSS = f"SELECT *, sign(coalesce(({S.full('avg', 'close', 5)}) - ({S.full('avg', 'close', 20)}), 0)) AS p FROM ({S.BARS_1H})"


def crossing(spark, d: str) -> DataFrame:
    p = Panel(event_bars(spark, d))
    p.let(F.coalesce(F.signum(p.mean("close", 5) - p.mean("close", 20)), F.lit(0.0)), "position")
    return p.drop_temporary()


def _sim(execution: str) -> str:
    c = f"coalesce(close / nullif({S.lag('close')}, 0) - 1, 0)"
    one, two = f"coalesce({S.lag('p')}, 0)", f"coalesce({S.lag('p', 2)}, 0)"
    held, gross, moved = {
        "next_open": (one, f"{two} * coalesce(open / nullif({S.lag('close')}, 0) - 1, 0) + {one} * coalesce(close / nullif(open, 0) - 1, 0)", f"abs({one} - {two})"),
        "next_close": (two, f"{two} * {c}", f"abs({one} - {two})"),
        "same_close": (one, f"{one} * {c}", f"abs(p - {one})"),
    }[execution]
    return f"SELECT ticker, ts, close, {held} AS held, CASE WHEN row_number() OVER {S.WO} = 1 THEN 0 ELSE {gross} END AS gross, {moved} AS turnover FROM ({_CROSS})"


for _e in ("next_open", "next_close", "same_close"):
    query(f"simulate_{_e}", f"SELECT ticker, ts, held, round(gross, 5) AS gross, round(turnover * 7 / 1e4, 6) AS cost, round(gross - turnover * 7 / 1e4, 5) AS net FROM ({_sim(_e)})")(
        lambda spark, d, e=_e: rounded(rounded(P.simulate(crossing(spark, d), execution=e), "cost"), "gross", "net", digits=5).select("ticker", "ts", "held", "gross", "cost", "net")
    )


@query("sma_cross_next_open", f"WITH n AS (SELECT *, gross - turnover * 7 / 1e4 AS net FROM ({_sim('next_open')})) SELECT ticker, count(*) AS n_bars, round(avg(net), 5) AS mean_net, round(stddev_samp(net), 5) AS sd_net, round(sum(turnover), 6) AS turnover, round(avg(CASE WHEN held <> 0 THEN 1.0 ELSE 0.0 END), 6) AS exposure FROM n GROUP BY ticker")
def sma_cross(spark, d):
    g = P.simulate(crossing(spark, d)).groupBy("ticker")
    return g.agg(F.count("*").alias("n_bars"), F.round(F.avg("net"), 5).alias("mean_net"), F.round(F.stddev_samp("net"), 5).alias("sd_net"), F.round(F.sum("turnover"), 6).alias("turnover"), F.round(F.avg((F.col("held") != 0).cast("double")), 6).alias("exposure"))


@query("tsmom", f"SELECT ticker, ts, coalesce(sign(close / nullif({S.lag('close', 24)}, 0) - 1), 0) AS position FROM ({S.BARS_1H})")
def tsmom(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(position=F.coalesce(F.signum(p.change("close", 24)), F.lit(0.0)))


_HOLD = f"SELECT *, coalesce(last_value(CASE WHEN coalesce(up, false) AND NOT coalesce(dn, false) THEN 1.0 WHEN coalesce(dn, false) AND NOT coalesce(up, false) THEN -1.0 END IGNORE NULLS) OVER {S.CUM}, 0) AS p FROM (SELECT ticker, ts, open, high, low, close, volume, close > uu AS up, close < ll AS dn FROM (SELECT *, {S.full('max', 'high', 10, ahead=-1)} AS uu, {S.full('min', 'low', 10, ahead=-1)} AS ll FROM ({S.BARS_1H})))"


def breakout(spark, d: str) -> DataFrame:
    p = Panel(event_bars(spark, d))
    up, down = p.high("high", 10, ahead=-1), p.low("low", 10, ahead=-1)
    p.let(p.hold(F.col("close") > up, F.col("close") < down), "position")
    return p.drop_temporary()


@query("hold_latch", f"SELECT ticker, ts, p AS position FROM ({_HOLD})")
def hold_latch(spark, d):
    return breakout(spark, d).select("ticker", "ts", "position")


@query("trade_islands", f"""WITH n AS (SELECT *, gross - turnover * 7 / 1e4 AS net0 FROM ({_sim('next_open')})), m AS (SELECT ticker, ts, sign(held) AS side, net0 / (1 + abs(net0)) AS net FROM n), c AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER {S.WO} AND row_number() OVER {S.WO} > 1 THEN 0 ELSE 1 END AS nw FROM m), t AS (SELECT *, sum(nw) OVER {S.CUM} AS trade FROM c)
SELECT ticker, CAST(trade AS BIGINT) AS trade, first(side) AS side, min(ts) AS entry, max(ts) AS exit, count(*) AS bars, round(exp(sum(ln(1 + net))) - 1, 5) AS ret FROM t WHERE side <> 0 GROUP BY ticker, trade""")
def trade_islands(spark, d):
    s = P.simulate(crossing(spark, d)).withColumn("net", F.col("net") / (1 + F.abs("net")))
    return rounded(P.trades(s), "ret", digits=5)


_SCORED = f"SELECT ticker, ts, p, CASE WHEN hour(ts) % 5 = 4 THEN NULL ELSE (hour(ts) * 7 + day(ts) * 3) % 10 / 10.0 END AS q FROM ({_HOLD})"
_ISLE = f"SELECT *, sum(nw) OVER {S.CUM} AS trade FROM (SELECT *, CASE WHEN sign(p) IS NOT DISTINCT FROM lag(sign(p)) OVER {S.WO} AND row_number() OVER {S.WO} > 1 THEN 0 ELSE 1 END AS nw FROM ({_SCORED}))"


def scored(spark, d: str) -> Panel:
    q = F.when(F.hour("ts") % 5 == 4, F.lit(None)).otherwise((F.hour("ts") * 7 + F.dayofmonth("ts") * 3) % 10 / 10.0)
    return Panel(breakout(spark, d).select("ticker", "ts", "position", q.alias("q")))


@query("filter_stage", f"SELECT ticker, ts, CASE WHEN coalesce(first_value(coalesce(q, 9)) OVER (PARTITION BY ticker, trade ORDER BY ts), 9) >= 0.5 THEN p ELSE 0 END AS position FROM ({_ISLE})")
def filter_stage(spark, d):
    p = scored(spark, d)
    return p.select(position=P.filter_stage(p, "position", "q", 0.5))


@query("gate_stage", f"SELECT ticker, ts, CASE WHEN q IS NULL OR q >= 0.5 THEN p ELSE 0 END AS position FROM ({_SCORED})")
def gate_stage(spark, d):
    p = scored(spark, d)
    return p.select(position=P.gate_stage("position", "q", 0.5))


@query("exit_stage", f"SELECT ticker, ts, CASE WHEN max(CASE WHEN q < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, trade ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 0 ELSE p END AS position FROM ({_ISLE})")
def exit_stage(spark, d):
    p = scored(spark, d)
    return p.select(position=P.exit_stage(p, "position", "q", 0.2))


@query("sizing_stage", f"WITH s AS ({_SCORED}), r AS (SELECT q FROM s WHERE day(ts) <= 10 AND q IS NOT NULL), x AS (SELECT s.*, (SELECT count(*) FROM r WHERE r.q <= s.q) / (SELECT count(*) FROM r)::DOUBLE AS f FROM s) SELECT ticker, ts, round(p * CASE WHEN q IS NULL THEN 1 ELSE 2 * f END, 6) AS position FROM x")
def sizing_stage(spark, d):
    s = scored(spark, d).df.withColumn("q", F.col("q").cast("double"))
    x = P.past_share(s, s.filter(F.dayofmonth("ts") <= 10), "q", "f")
    return x.select("ticker", "ts", F.round(P.sizing_stage("position", F.col("f")), 6).alias("position"))


@query("variant_stage", f"""WITH b AS ({S.BARS_1H}), v AS (SELECT *, row_number() OVER {S.WO} - 1 AS i, coalesce(sign(close - {S.lag('close', 5)}), 0) AS p0, coalesce(sign(close - {S.lag('close', 10)}), 0) AS p1, coalesce(sign(close - {S.lag('close', 20)}), 0) AS p2, (hour(ts) * 3) % 7 AS s0, (hour(ts) * 5) % 7 AS s1, (hour(ts) * 2 + 1) % 7 AS s2 FROM b),
c AS (SELECT *, last_value(CASE WHEN i % 21 = 0 THEN CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END END IGNORE NULLS) OVER {S.CUM} AS k FROM v) SELECT ticker, ts, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS position FROM c""")
def variant_stage(spark, d):
    p = Panel(event_bars(spark, d))
    for i, n in enumerate((5, 10, 20)):
        p.let(F.coalesce(F.signum(p.diff("close", n)), F.lit(0.0)), f"p{i}")
    h = F.hour("ts")
    for i, s in enumerate((h * 3 % 7, h * 5 % 7, (h * 2 + 1) % 7)):
        p.let(s, f"s{i}")
    return p.select(position=P.variant_stage(p, ["p0", "p1", "p2"], ["s0", "s1", "s2"]))


@query("portfolio_returns", f"WITH n AS ({_sim('next_open')}), i AS (SELECT ticker, min(ts) AS a, max(ts) AS b FROM n GROUP BY ticker), t AS (SELECT ts, sum(gross - turnover * 7 / 1e4) AS total FROM n GROUP BY ts), l AS (SELECT t.ts, t.total, count(i.ticker) AS live FROM t LEFT JOIN i ON t.ts BETWEEN i.a AND i.b GROUP BY ALL) SELECT ts, live, round(total / greatest(live, 1), 5) AS ret FROM l")
def portfolio_returns(spark, d):
    s = P.simulate(crossing(spark, d))
    ends = s.groupBy("ticker").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rounded(P.per_live(s, ends), "ret", digits=5)


@query("forward_return", f"WITH n AS (SELECT *, gross - turnover * 7 / 1e4 AS net FROM ({_sim('next_open')})) SELECT ticker, ts, round({S.full('sum', 'net', 5, ahead=5)}, 5) AS ahead FROM n")
def forward_return(spark, d):
    p = Panel(P.simulate(crossing(spark, d)))
    return rounded(p.select(ahead=P.forward_return(p, "net", 5)), "ahead", digits=5)


_ER = S.div(f"abs({S.lead('close', 20)} - close)", S.full("sum", "st", 20, ahead=20))


@query("regime_label", f"WITH b AS (SELECT *, abs(close - {S.lag('close')}) AS st FROM ({S.BARS_1H})) SELECT ticker, ts, round({_ER}, 6) AS er, {S.lead('ts', 22)} AS known FROM b")
def regime_label(spark, d):
    p = Panel(event_bars(spark, d))
    return rounded(p.select(er=ML.regime_label(p, 20), known=ML.label_date(p, 20, 2)), "er")


@query("cross_events", f"WITH b AS (SELECT *, ({S.full('avg', 'close', 5)}) AS f, ({S.full('avg', 'close', 20)}) AS s FROM ({S.BARS_1H})), c AS (SELECT *, {S.lag('f')} AS pf, {S.lag('s')} AS ps FROM b) SELECT ticker, ts, CASE WHEN f > s AND pf <= ps THEN 1 WHEN f < s AND pf >= ps THEN -1 ELSE 0 END AS signal FROM c")
def cross_events(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(signal=SG.cross_signal(p, p.mean("close", 5), p.mean("close", 20)))


@query("fair_value_gap", f"SELECT ticker, ts, coalesce({S.lag('close')} < {S.lead('close')} AND abs({S.lead('close')} - close) > 10, false) AS gap FROM ({S.BARS_1H})")
def fair_value_gap(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(gap=SG.fair_value_gap(p, 10.0))


@query("fibonacci_zone", f"WITH b AS (SELECT *, {S.full('max', 'close', 50)} AS hi, {S.full('min', 'close', 50)} AS lo FROM ({S.BARS_1H})), r AS (SELECT *, {S.div('close - lo', 'hi - lo')} AS r FROM b) SELECT ticker, ts, round(r, 6) AS retracement, coalesce(r BETWEEN 0.62 AND 0.79, false) AS zone FROM r")
def fibonacci_zone(spark, d):
    p = Panel(event_bars(spark, d))
    r, zone = SG.fibonacci(p, 50)
    return rounded(p.select(retracement=r, zone=zone), "retracement")


@query("liquidity_sweeps", f"WITH b AS (SELECT *, {S.lag('low')} AS bp, {S.lag('high')} AS sp FROM ({S.BARS_1H})), c AS (SELECT *, {S.full('min', 'bp', 5)} AS lo, {S.full('max', 'sp', 50)} AS hi FROM b) SELECT ticker, ts, coalesce(close < lo, false) OR coalesce(close > hi, false) AS sweep FROM c")
def liquidity_sweeps(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(sweep=SG.liquidity_sweeps(p, p.lag("low"), p.lag("high"), 5, 50))


@query("order_blocks", f"WITH b AS (SELECT *, {S.lag('low')} AS bp, {S.lag('high')} AS sp, {S.full('min', 'close', 50)} AS lo, {S.full('max', 'close', 50)} AS hi FROM ({S.BARS_1H})) SELECT ticker, ts, CASE WHEN close < bp AND close = lo THEN 'bearish' WHEN close > sp AND close = hi THEN 'bullish' END AS block FROM b")
def order_blocks(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(block=SG.order_blocks(p, p.lag("low"), p.lag("high"), 50))


@query("adaptive_momentum", f"WITH b AS (SELECT *, {S.full('avg', 'volume', 20)} AS v FROM ({S.BARS_1H})) SELECT ticker, ts, sign(CASE WHEN coalesce(volume > v, false) THEN close / nullif({S.lag('close', 5)}, 0) - 1 ELSE close / nullif({S.lag('close', 20)}, 0) - 1 END) AS signal FROM b")
def adaptive_momentum(spark, d):
    p = Panel(event_bars(spark, d))
    return p.select(signal=SG.adaptive_momentum(p))


# costs, folds, sleeves, statistics
_SPEC = "SELECT DISTINCT p_brand AS ticker, 0.0001 AS pip_size, 0.5 + length(p_brand) / 10.0 AS spread_pips, -3.0 AS swap_long, 1.0 AS swap_short FROM part"


@query("realistic_costs", f"""WITH b AS ({_BOOK}), n AS (SELECT *, greatest(date_diff('day', entry_ts, exit_ts), 0) AS nights, date_diff('day', DATE '1970-01-01', entry_ts) AS a, date_diff('day', DATE '1970-01-01', exit_ts) AS z FROM b), w AS (SELECT *, CASE WHEN nights > 0 THEN floor((z - 6) / 7.0) - floor((a - 6) / 7.0) ELSE 0 END AS wed FROM n)
SELECT l_orderkey, l_linenumber, round(spread_pips * pip_size / entry_price * 1e4, 6) AS spread_bps, round(CASE WHEN direction = 1 THEN swap_long ELSE swap_short END * (nights + 2 * wed) / (100000 * entry_price) * 1e4, 8) AS swap_bps FROM w JOIN ({_SPEC}) USING (ticker)""")
def realistic_costs(spark, d):
    from tidemark.operators.backtest import realistic_returns

    spec = load(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", F.lit(0.0001).alias("pip_size"), (F.lit(0.5) + F.length("ticker") / 10.0).alias("spread_pips"), F.lit(-3.0).alias("swap_long"), F.lit(1.0).alias("swap_short"))
    x = realistic_returns(book(spark, d), spec, "ret")
    return rounded(rounded(x, "spread_bps"), "swap_bps", digits=8).select("l_orderkey", "l_linenumber", "spread_bps", "swap_bps")


@query("chronological_split", f"WITH b AS ({S.BARS_1H}), i AS (SELECT *, row_number() OVER {S.WO} - 1 AS i, count(*) OVER (PARTITION BY ticker) // 5 AS n FROM b) SELECT ticker, ts, CAST(i // n AS INTEGER) AS split FROM i WHERE i // n < 5")
def chronological_split(spark, d):
    return PF.chronological_split(event_bars(spark, d), 5).select("ticker", "ts", "split")


_SCORE = f"SELECT ticker, split, param_id, avg(r) AS sharpe FROM (SELECT ticker, i // n AS split, param_id, (x * k) % 97 / 97.0 AS r FROM (SELECT *, row_number() OVER {S.WO} - 1 AS i, count(*) OVER (PARTITION BY ticker) // 5 AS n, hour(ts) * 13 + day(ts) * 5 AS x FROM ({S.BARS_1H})), (VALUES ('a', 3), ('b', 7), ('c', 11)) g(param_id, k) WHERE i // n < 5) GROUP BY ALL"


@query("walk_forward_choice", f"WITH s AS ({_SCORE}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ticker, split ORDER BY round(sharpe, 9) DESC, param_id) = 1) SELECT b.ticker, CAST(b.split AS INTEGER) AS fold, b.param_id, round(s.sharpe, 6) AS oos_sharpe FROM b JOIN s ON s.ticker = b.ticker AND s.param_id = b.param_id AND s.split = b.split + 1")
def walk_forward(spark, d):
    x = PF.chronological_split(event_bars(spark, d), 5).withColumn("x", F.hour("ts") * 13 + F.dayofmonth("ts") * 5)
    grid = spark.createDataFrame([("a", 3), ("b", 7), ("c", 11)], "param_id string, k int")
    s = x.crossJoin(F.broadcast(grid)).groupBy("ticker", "split", "param_id").agg(F.round(F.avg(F.col("x") * F.col("k") % 97 / 97.0), 9).alias("sharpe"))  # three rows
    return rounded(PF.walk_forward(s), "oos_sharpe").select("ticker", F.col("fold").cast("int").alias("fold"), "param_id", "oos_sharpe")


@query("daily_sleeve_returns", f"SELECT ticker AS sleeve, CAST(exit_ts AS DATE) AS date, round(avg(ret), 6) AS ret FROM ({_BOOK}) GROUP BY ALL")
def daily_sleeves(spark, d):
    return rounded(PF.daily_returns(book(spark, d).withColumnRenamed("ticker", "sleeve")), "ret")


@query("fit_eval_split", f"WITH r AS (SELECT DISTINCT CAST(exit_ts AS DATE) AS date FROM ({_BOOK})), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM r) SELECT date, CASE WHEN i < floor(n * 0.7) THEN 'fit' ELSE 'eval' END AS part FROM i")
def fit_eval(spark, d):
    daily = PF.daily_returns(book(spark, d).withColumnRenamed("ticker", "sleeve"))
    return PF.fit_eval(daily.select("date").distinct()).select("date", "part")


_P = "SELECT o_custkey AS id, (o_orderkey * 37 % 1000) / 1000.0 + 0.0005 AS p, CAST(o_custkey % 5 AS BIGINT) AS family FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"


def p_values(spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    first = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("n = 1")
    return first.select(F.col("o_custkey").alias("id"), ((F.col("o_orderkey") * 37 % 1000) / 1000.0 + 0.0005).alias("p"), (F.col("o_custkey") % 5).alias("family"))


@query("holm_adjust", f"WITH t AS ({_P}), s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p AS s FROM t) SELECT id, family, round(least(max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 1), 6) AS p_holm FROM s")
def holm(spark, d):
    return rounded(ST.holm(p_values(spark, d), by=("family",), tie="id"), "p_holm").select("id", "family", "p_holm")


@query("bh_adjust", f"WITH t AS ({_P}), s AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, id) AS s FROM t) SELECT id, family, round(least(min(s) OVER (PARTITION BY family ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_bh FROM s")
def bh(spark, d):
    return rounded(ST.benjamini_hochberg(p_values(spark, d), by=("family",)), "p_bh").select("id", "family", "p_bh")


@query("return_moments", f"SELECT ticker, count(ret) AS n, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS sd FROM ({_SMALL}) GROUP BY ticker")
def return_moments(spark, d):
    return rounded(ST.moments(small_returns(spark, d), "ret", ("ticker",)).select("ticker", "n", "mean", "sd"), "mean", "sd", digits=8)


_NW = """WITH b AS ({bars}), w AS (SELECT ts, 0.01 * max(close) FILTER (ticker = 'click') / 100 AS a, 0.01 * max(close) FILTER (ticker = 'view') / 100 AS b FROM b GROUP BY ts HAVING a IS NOT NULL AND b IS NOT NULL), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * a) AS ga, avg(b * b) AS gb, count(*) AS n FROM w)
SELECT round(ma / sqrt(ga - ma * ma) - mb / sqrt(gb - mb * mb), 6) AS d FROM m"""


@query("newey_west_sharpe_diff", _NW.format(bars=S.BARS_4H))
def newey_west(spark, d):
    w = event_bars(spark, d, "4h").groupBy("ts").pivot("ticker", ["click", "view"]).agg(F.first("close"))
    got = ST.sharpe_difference(w.select("ts", (F.col("click") * 0.0001).alias("a"), (F.col("view") * 0.0001).alias("b")), "a", "b")
    return spark.createDataFrame([(round(got[0], 6),)], "d double")


@query("clustered_ols", "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'const', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")
def clustered_ols(spark, d):
    got = ST.clustered_ols(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return spark.createDataFrame([("const", round(got["const"][0], 4)), ("slope", round(got["l_quantity"][0], 4))], "name string, coefficient double")


@query("cyclical_time", f"SELECT ticker, ts, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) AS weekday_cos FROM ({S.BARS_1H})")
def cyclical(spark, d):
    from tidemark.operators.features import cyclical_time

    return rounded(cyclical_time(event_bars(spark, d)).select("ticker", "ts", "hour_sin", "weekday_cos"), "hour_sin", "weekday_cos")


@query("lag_features", f"SELECT ticker, ts, {S.lag('close', 1)} AS close_lag_1, {S.lag('close', 2)} AS close_lag_2, {S.lag('close', 3)} AS close_lag_3 FROM ({S.BARS_1H})")
def lag_features(spark, d):
    from tidemark.operators.features import lags

    return lags(event_bars(spark, d)).select("ticker", "ts", "close_lag_1", "close_lag_2", "close_lag_3")


@query("content_keys", "SELECT n_nationkey, sha1(concat_ws('|', n_name, CAST(n_regionkey AS VARCHAR))) AS key, regexp_replace(regexp_replace(n_name, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM nation")
def content_keys(spark, d):
    from tidemark.sources.store import content_key, safe_id

    return load(spark, d, "nation").select("n_nationkey", content_key("n_name", "n_regionkey").alias("key"), safe_id("n_name").alias("safe"))

