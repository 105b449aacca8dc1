"""Reading and writing bars, trades and results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that exports give to the canonical columns.
ALIASES = {
    "ts": ("date", "datetime", "timestamp", "time", "date_time", "open_time"), "ticker": ("symbol", "instrument", "name", "code"), "open": ("o", "open_price"), "high": ("h", "high_price"),
    "low": ("l", "low_price"), "close": ("c", "ltp", "last", "close_price", "adj close"), "volume": ("v", "vol", "ltq", "qty"),
}
REQUIRED = ("ts", "open", "high", "low", "close")


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV, JSON or ORC by the path's suffix; CSV takes a schema, or reads everything as text."""
    kind = next((k for k in ("csv", "json", "orc") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True) if kind == "csv" else getattr(reader, kind)(path)


def read_by_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of one instrument each, with the file's stem as ticker."""
    return spark.read.parquet(path).withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def resolve(df: DataFrame, overrides: dict[str, str] | None = None, required=REQUIRED) -> DataFrame:
    """df with columns under their canonical names; raises if a required one can't be found."""
    have, found = {c.lower(): c for c in df.columns}, dict(overrides or {})
    for name, others in ALIASES.items():
        if name not in found:
            match = next((have[x] for x in (name, *others) if x in have), None)
            if match:
                found[name] = match
    missing = [n for n in required if n not in found]
    if missing:
        raise KeyError(f"no column for {missing} among {df.columns}")
    back = {v: k for k, v in found.items()}
    return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def parse_time(x: str | Column, pattern: str | None = None, offset_minutes: int = 0) -> Column:
    """A time without zone from text: a zone suffix is dropped, and an offset taken off."""
    c = F.col(x) if isinstance(x, str) else x
    plain = F.regexp_replace(c, r"\s*(Z|UTC|[+-]\d{2}:?\d{2})$", "")
    t = F.try_to_timestamp(plain, F.lit(pattern)) if pattern else F.try_to_timestamp(plain)
    return (t - F.expr(f"INTERVAL {int(offset_minutes)} MINUTES")).cast("timestamp_ntz")


def normalise(df: DataFrame, rename: dict[str, str] | None = None, drop=(), pattern: str | None = None, offset_minutes: int = 0, ticker: str | None = None) -> DataFrame:
    """Canonical bars of an export: junk dropped, columns renamed, times parsed, figures cast; what isn't a number is missing."""
    df = resolve(df.drop(*drop), rename)
    if dict(df.dtypes)["ts"] == "string":
        df = df.withColumn("ts", parse_time("ts", pattern, offset_minutes))
    if ticker is not None:
        df = df.withColumn("ticker", F.lit(ticker))
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers})


def ingest(spark: SparkSession, manifest: list[dict], out: str) -> DataFrame:
    """Run each source of a manifest (path, and the arguments of `normalise`) through cleaning, write by ticker, and report rows in and out."""
    from tidemark.operators.bars import keep_one, validate

    report = []
    for spec in manifest:
        args = {k: v for k, v in spec.items() if k not in {"path", "schema", "name"}}
        raw = read(spark, spec["path"], spec.get("schema"))
        clean = keep_one(validate(normalise(raw, **args)), ("ticker", "ts"), ("open", "high", "low", "close"))
        write_by(clean, f"{out}/{spec['name']}", "ticker")
        report.append((spec["name"], raw.count(), spark.read.parquet(f"{out}/{spec['name']}").count()))
    return spark.createDataFrame(report, "source string, rows_in bigint, rows_out bigint")


def write_by(df: DataFrame, path: str, *by: str, files: int | None = None) -> None:
    """Parquet in a folder per value. Rows are dealt by the partition columns first, so a value isn't spread over a file from every task."""
    dealt = df.repartition(files, *by) if files else df.repartition(*by)
    dealt.write.mode("overwrite").partitionBy(*by).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write: under the checkpoint folder, or the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Parquet, CSV (with a header), JSON or ORC by the path's suffix, as `read` reads it."""
    kind = next((k for k in ("csv", "json", "orc") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def pass_ticks(df: DataFrame, path: str, keys=("ticker", "ts"), tie=("event_id",)) -> None:
    """Ticks as they are, one for each instrument and time, in a folder per instrument."""
    from tidemark.operators.bars import keep_one

    write_by(keep_one(df, keys, tie), path, keys[0])


def cached(spark: SparkSession, source: str, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `make` gives of the Parquet table at `source`, kept in a folder under a key of its files' names, sizes and times: made anew only when one of those changes."""
    raw = spark.read.parquet(source)
    file = raw.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    n, state = file.agg(F.count("*"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first()
    place = f"{folder}/{config_key({'files': n, 'state': str(state)})}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        make(raw).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def with_lineage(df: DataFrame, **facts) -> DataFrame:
    """df with where it came from: a column for each fact given (market, timeframe, run_ts, ...); dictionaries are kept as sorted JSON."""
    plain = {k: json.dumps(v, sort_keys=True, default=str) if isinstance(v, dict) else v for k, v in facts.items()}
    return df.withColumns({k: F.lit(v) for k, v in plain.items()})


def replace_matching(df: DataFrame, path: str, by: str, *keys: str) -> None:
    """Rows of df in place of those in a store, partitioned by a column, that have the same keys; other rows stay. Only the partitions that df has are written."""
    spark = df.sparkSession
    old = spark.read.option("mergeSchema", "true").parquet(path)
    touched = [r[0] for r in df.select(by).distinct().collect()]
    rest = old.filter(F.col(by).isin(touched)).join(df.select(*keys).distinct(), list(keys), "left_anti")
    place = scratch(spark)  # what is read must not be what is written
    rest.unionByName(df, allowMissingColumns=True).write.parquet(place)
    replace_partitions(spark.read.parquet(place), path, by)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write only the partitions that df has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class ResultStore:
    """Trades and figures by campaign and strategy, pruned by folder on reading; columns may be added over time."""

    BY = ("campaign_id", "strategy_id")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, campaign_id: str, strategy_id: str) -> None:
        replace_partitions(df.withColumns({"campaign_id": F.lit(campaign_id), "strategy_id": F.lit(strategy_id)}), self.path, *self.BY)

    def read(self, campaign_id: str | None = None, strategy_id: str | None = None) -> DataFrame:
        df = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        for name, value in zip(self.BY, (campaign_id, strategy_id), strict=True):
            df = df.filter(F.col(name) == value) if value is not None else df
        return df

    def sql(self, query: str) -> DataFrame:
        """A query over {runs}."""
        return self.spark.sql(query, runs=self.read())


def content_key(*columns: str) -> Column:
    """A stable key of some columns' values."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def config_key(config: dict) -> str:
    """A stable key of a configuration."""
    import hashlib

    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def safe_id(x: str | Column) -> Column:
    """An identifier for file names: letters, digits, dots and dashes; others become one underscore."""
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9.\-]+", "_"), r"^_+|_+$", "")


def flatten_universe(nested: dict) -> list[dict]:
    """One row per instrument of {group: {defaults..., instruments: [...]}}; ids must be unique."""
    rows, seen = [], set()
    for group, spec in nested.items():
        base = {k: v for k, v in spec.items() if k != "instruments"}
        for item in spec.get("instruments", []):
            row = {"group": group, **base, **(item if isinstance(item, dict) else {"id": item, "ticker": item})}
            if row["id"] in seen:
                raise ValueError(f"instrument {row['id']} is there twice")
            seen.add(row["id"])
            rows.append(row)
    return rows


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    """The instrument dimension of a YAML file."""
    import yaml

    rows = flatten_universe(yaml.safe_load(Path(path).read_text()))
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def risk_free(spark: SparkSession, path: str) -> DataFrame:
    """(ts, rf) from a CSV of dates and percent figures; what isn't a number takes the last one."""
    from pyspark.sql import Window

    raw = read(spark, path)
    date, value = raw.columns[:2]
    rows = raw.select(F.to_timestamp_ntz(F.col(date)).alias("ts"), (F.expr(f"try_cast(`{value}` AS double)") / 100).alias("rf"))
    return rows.withColumn("rf", F.last("rf", ignorenulls=True).over(Window.orderBy("ts")))


def write_report(df: DataFrame, path: str) -> None:
    """A table of results as one CSV file and as Markdown, beside each other. For small tables."""
    table = df.toPandas()
    folder = Path(path)
    folder.parent.mkdir(parents=True, exist_ok=True)
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    shown = table.astype(object).where(table.notna(), None)
    folder.with_suffix(".md").write_text("\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, shown.itertuples(index=False))]) + "\n")
    table.to_csv(folder.with_suffix(".csv"), index=False)
