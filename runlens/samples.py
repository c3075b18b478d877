"""The sample frame: one row for each run, signal, (component) and index, with time in seconds and a finite value or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("run_id", "signal")
PART, UNKNOWN = 8 << 20, 1 << 60  # bytes of files for one task; more than this is what Spark takes for a size it doesn't know


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return (ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)").cast("double")


def by_run(df: DataFrame) -> DataFrame:
    """Rows dealt by run_id into tasks of at most PART bytes of the files read; small inputs as the session deals them.

    Windows and groups by run share this exchange, so the memory of one of their tasks doesn't grow with the number of runs.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if not PART < size < UNKNOWN:
        return df
    return df.repartition(max(-(-size // PART), df.sparkSession.sparkContext.defaultParallelism), "run_id")


def from_dataframe(df: DataFrame, run: str | Column, t: Column, values: dict[str, Column], order: list, labels: dict[str, Column] | None = None) -> DataFrame:
    """Samples of several signals that share a clock. `order` breaks ties of time; values that aren't finite become null.

    The columns are run_id, signal, idx, t, x, raw and label: raw is the value as it came, label the text of a text signal.
    """
    run = F.col(run) if isinstance(run, str) else run
    w = Window.partitionBy("run_id").orderBy("t", *order)
    base = by_run(df.withColumn("run_id", run).withColumn("t", t).where(finite(F.col("t")))).withColumn("idx", F.row_number().over(w).cast("long") - 1)
    entries = [F.struct(F.lit(name).alias("signal"), x.cast("double").alias("raw"), F.lit(None).cast("string").alias("label")) for name, x in values.items()]
    entries += [F.struct(F.lit(name).alias("signal"), F.lit(None).cast("double").alias("raw"), x.cast("string").alias("label")) for name, x in (labels or {}).items()]
    long = base.select("run_id", "idx", "t", F.explode(F.array(*entries)).alias("s")).select("run_id", "s.signal", "idx", "t", "s.raw", "s.label")
    return long.select("run_id", "signal", "idx", "t", F.when(finite(F.col("raw")), F.col("raw")).alias("x"), "raw", "label")


def components(df: DataFrame, vector: str = "v") -> DataFrame:
    """A vector signal by component; a sample is finite only where all its components are."""
    good = F.forall(vector, lambda x: finite(x))
    return df.select("*", good.alias("_ok"), F.posexplode(vector).alias("component", "raw")).withColumn("x", F.when(F.col("_ok"), F.col("raw"))).drop("_ok", vector)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str, gaps: bool = False, labels: bool = False) -> DataFrame:
    """A run for each user: `value` over time; with gaps, errors have no value; with labels, `event_type` as text."""
    value = F.when(F.col("event_type") != "error", F.col("value")) if gaps else F.col("value")
    text = {"event_type": F.col("event_type")} if labels else {}
    return from_dataframe(table(spark, sf_dir, "events"), "user_id", seconds(F.col("ts")), {"value": value}, ["event_id"], text)


def event_wide(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """The same runs as one row for each sample: run_id, idx, t, value, event_type."""
    w = Window.partitionBy("run_id").orderBy("t", "event_id")
    value = F.when(F.col("event_type") != "error", F.col("value")) if gaps else F.col("value")
    base = by_run(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), seconds(F.col("ts")).alias("t"), "event_id", value.alias("value"), "event_type"))
    return base.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "t", "value", "event_type")


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each supplier: quantity over ship dates, with repeated times."""
    return from_dataframe(table(spark, sf_dir, "lineitem"), "l_suppkey", seconds(F.col("l_shipdate")), {"quantity": F.col("l_quantity")}, ["l_orderkey", "l_linenumber"])
