"""Every query with SQL against DuckDB over generated tables, and the plans' shape."""

import datetime as dt
import math
import random

import duckdb
import pytest

from tidemark.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
#: These tables of the driver's are made here, small, with the same columns.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def rows():
    g = random.Random(17)
    day = lambda y, n: dt.datetime(y, 1, 1) + dt.timedelta(days=n)
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=g.uniform(0, 20 * 86400)), g.randrange(12), g.choice(["view", "error", "click", "signup", "purchase"]), round(g.expovariate(0.02) + 0.01, 2), '{"k": %d}' % g.randrange(100)) for i in range(4000)]
    orders = [(i, g.randrange(60), g.choice("FOP"), round(g.uniform(1000, 500000), 2), day(1995, g.randrange(1500)), g.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) for i in range(1200)]
    lines = [(g.randrange(1200), g.randrange(80), g.randrange(20), k % 7, float(g.randint(1, 50)), round(g.uniform(900, 90000), 2), g.randrange(11) / 100, g.randrange(9) / 100, g.choice("ANR"), g.choice("OF"), day(1995, g.randrange(1600))) for k in range(3000)]
    lines = list({(r[0], r[3]): r for r in lines}.values())
    return {
        "events": events, "orders": orders, "lineitem": lines, "customer": [(i, f"c{i}", g.randrange(5), round(g.uniform(-900, 9000), 2), g.choice(["AUTO", "HOME", "TOOLS"])) for i in range(80)], "supplier": [(i, f"s{i}", g.randrange(5), round(g.uniform(-900, 9000), 2)) for i in range(20)],
        "part": [(i, f"p {i}", f"Brand#{i % 9}", "T", i % 30, 900.0 + i) for i in range(80)], "nation": [(i, f"NATION {i}/x", i % 3) for i in range(5)], "embeddings": [(i, [g.gauss(0, 1) for _ in range(8)], 0) for i in range(30)],
    }


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for name, own in rows().items():
        spark.createDataFrame(own, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, tables, name):
    folder, con = tables
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    assert df.count() > 0 and df.columns


@pytest.mark.parametrize("name", ["sma", "linreg_stats", "hma", "rolling_skew_kurt", "adx_sma", "hold_latch", "simulate_next_open", "ema", "trade_scan_fixed", "rule_positions"])
def test_one_shuffle(spark, tables, name):
    """Ticks are dealt by instrument once; bars, windows and folds follow without another shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert plan.count("FlatMapGroupsInPandas") <= 1 + (name == "trade_scan_fixed")


def test_scan_reads_what_it_needs(spark, tables):
    plan = QUERIES["pnl_by_hour"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_pushed_filter(spark, tables):
    plan = QUERIES["semi_universe"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())
