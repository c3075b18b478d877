"""Signal files to sample frames. Headers are read from a few lines; the rows stay in Spark."""

from __future__ import annotations

import difflib
import fnmatch
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.units import Units
from runlens.samples import finite
from runlens.sources.tables import SourceError, sniff_delimiter

#: Extensions and aliases of formats, and names of time columns.
FORMATS = {"csv": ("csv", "tsv", "txt"), "hdf5": ("h5", "hdf5", "hdf", "he5"), "mat": ("mat", "mat73", "matlab"), "memory": ("memory",), "parquet": ("parquet",)}
TIME_NAMES = ("t", "time", "timestamp", "tout")
_HEADER = re.compile(r"^\s*(.*?)\s*(?:\[([^\]]*)\]|\(([^)]*)\))?\s*$")


def format_of(path: str, format: str | None = None) -> str:
    """An explicit format, else by the extension."""
    word = (format or path.rsplit(".", 1)[-1]).lower()
    for name, words in FORMATS.items():
        if word == name or word in words:
            return name
    raise SourceError(f"unknown format {word!r}; known are {', '.join(FORMATS)}")


_ADAPTERS: dict = {}


def register_adapter(name: str, reader) -> None:
    """Adds a format: reader(spark, paths, **options) gives a sample frame with run_id."""
    _ADAPTERS[name] = reader
    FORMATS.setdefault(name, (name,))


def discover(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.csv",), skip: tuple[str, ...] = ()) -> DataFrame:
    """Files of runs below a folder: path and a run_id from the name, told apart by a number where names repeat."""
    files = reduce(DataFrame.union, [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(folder).select("path", "length", "modificationTime") for p in patterns])
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files = files.where(~name.startswith("."))
    for s in skip:
        files = files.where(~F.contains("path", F.lit(s)))
    safe = F.regexp_replace(name, r"[^\w.-]+", "_")
    n = F.row_number().over(Window.partitionBy("safe").orderBy("path"))
    return files.withColumn("safe", safe).withColumn("n", n).select("path", "length", "modificationTime", F.when(F.col("n") > 1, F.concat("safe", F.lit("_"), F.col("n"))).otherwise(F.col("safe")).alias("run_id"))


def csv_catalog(lines: list[str], delimiter: str | None = None, units_row: bool = False, time: str | None = None) -> dict:
    """What the first lines of a CSV file say: delimiter, header line, names, units and the time column."""
    body = [(i, x) for i, x in enumerate(lines) if x.strip() and not x.lstrip().startswith("#")]
    if not body:
        raise SourceError("no header")
    d = delimiter or sniff_delimiter([x for _, x in body[:20]])
    cells = [c.strip().strip('"') for c in body[0][1].split(d)]
    parsed = [_HEADER.match(c) for c in cells]
    names, units = [m[1] for m in parsed], [m[2] or m[3] for m in parsed]
    if units_row and len(body) > 1:
        units = [u or (c.strip().strip("[]()") or None) for u, c in zip(units, body[1][1].split(d))]
    if len(set(names)) < len(names):
        raise SourceError("two columns have the same name")
    clock = time or next((n for n in names if n.lower() in TIME_NAMES), names[0])
    if clock not in names:
        raise SourceError(f"no time column {clock!r}")
    return {"delimiter": d, "header": body[0][1], "units_line": body[1][1] if units_row and len(body) > 1 else None, "names": names, "units": dict(zip(names, units)), "time": clock}


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, units_row: bool = False, decimal_comma: bool = False, time: str | None = None, names: list[str] | None = None, on_non_monotonic: str = "error") -> DataFrame:
    """Samples of CSV files that share a header, a run for each file. names: the signals wanted, by name or pattern.

    Rows whose time isn't finite are dropped; a cell that isn't a number is a label; a row with too many or too few cells is
    an error. Whole numbers are numbers as any other: a signal's kind is declared where it matters.
    """
    lines = [r.value for r in spark.read.text(path).limit(40).collect()]
    c = csv_catalog(lines, delimiter, units_row, time)
    clock = c["time"]
    wanted = [n for n in c["names"] if n != clock and n.lower() not in TIME_NAMES]
    if names is not None:
        wanted = select_names(wanted, names)
    text = spark.read.text(path).select("value", "_metadata.file_path")
    cut = F.split("value", re.escape(c["delimiter"]), -1)
    is_data = (F.trim("value") != "") & ~F.ltrim("value").startswith("#") & (F.col("value") != F.lit(c["header"]))
    if c["units_line"] is not None:
        is_data &= F.col("value") != F.lit(c["units_line"])
    width = len(c["names"])
    rows = text.where(is_data).withColumn("cells", cut)
    good = F.when(F.size("cells") == width, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), F.col("value"))))
    rows = rows.withColumn("cells", good).withColumn("order", F.monotonically_increasing_id())
    cell = lambda n: F.trim(F.regexp_replace(F.get("cells", c["names"].index(n)), '^"|"$', ""))
    number = lambda n: (F.regexp_replace(cell(n), ",", ".") if decimal_comma else cell(n)).try_cast("double")
    unit = c["units"].get(clock)
    scale = Units().factor(unit, "s")[0] if unit else 1.0
    run = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    entries = [F.struct(F.lit(n).alias("signal"), number(n).alias("raw"), F.when(number(n).isNull() & (cell(n) != "") & (F.lower(cell(n)) != "nan"), cell(n)).alias("label")) for n in wanted]
    base = rows.select(run.alias("run_id"), (number(clock) * F.lit(scale)).alias("t"), "order", F.array(*entries).alias("s")).where(finite(F.col("t")))
    by = ["t", "order"] if on_non_monotonic == "sort" else ["order"]
    w = Window.partitionBy("run_id").orderBy(*by)
    t = F.col("t") if on_non_monotonic == "sort" else F.when(F.col("t") < F.lag("t").over(w), F.raise_error(F.lit("times decrease"))).otherwise(F.col("t"))
    base = base.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).withColumn("t", t)
    return base.select("run_id", "idx", "t", F.explode("s").alias("s")).select("run_id", "s.signal", "idx", "t", F.when(finite(F.col("s.raw")), F.col("s.raw")).alias("x"), "s.raw", "s.label")


def select_names(known: list[str], wanted: list[str]) -> list[str]:
    """Names by exact match, pattern or unique last part; a near one is proposed for an unknown name."""
    out: list[str] = []
    for w in wanted:
        hit = [k for k in known if k == w] or [k for k in known if fnmatch.fnmatchcase(k, w)] or [k for k in known if k.rsplit("/", 1)[-1] == w]
        if not hit:
            near = difflib.get_close_matches(w, known, 1)
            raise SourceError(f"no signal {w!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        if len(hit) > 1 and not any(c in w for c in "*?["):
            raise SourceError(f"{w!r} may be {', '.join(hit)}")
        out += [h for h in hit if h not in out]
    return out


def open_source(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A sample frame of a file, folder or pattern."""
    kind = format_of(path, format)
    if kind in _ADAPTERS:
        return _ADAPTERS[kind](spark, path, **options)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise SourceError(f"{kind} files need a reader that isn't installed here: register_adapter({kind!r}, reader) adds one")


def from_arrays(spark: SparkSession, signals: dict, run_id: str = "run") -> DataFrame:
    """Samples of arrays in memory: {name: values} on the shared clock `t`, or {name: (times, values)}."""
    shared = signals.get("t")
    rows = []
    for name, value in signals.items():
        if name == "t":
            continue
        t, v = value if isinstance(value, tuple) else (shared, value)
        if t is None or len(t) != len(v):
            raise SourceError(f"{name}: times and values differ in number")
        rows += [(run_id, name, i, float(a), None if isinstance(b, str) else float(b), b if isinstance(b, str) else None) for i, (a, b) in enumerate(zip(t, v))]
    df = spark.createDataFrame(rows, "run_id string, signal string, idx long, t double, raw double, label string")
    return df.select("run_id", "signal", "idx", "t", F.when(finite(F.col("raw")), F.col("raw")).alias("x"), "raw", "label")


def catalog(samples: DataFrame) -> DataFrame:
    """One row for each run and signal: samples, extent, median step, kind."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("run_id", "signal").orderBy("idx"))
    g = samples.withColumn("dt", step).groupBy("run_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.percentile("dt", 0.5).alias("step"), F.count("x").alias("finite"), F.count("label").alias("labels"))
    return g.withColumn("kind", F.when(F.col("labels") > 0, "discrete").otherwise("continuous"))


def run_parameters(table: DataFrame, runs: DataFrame, key: str, candidates: list[str]) -> DataFrame:
    """Parameters of runs: a table row matches by the first of the candidate columns of `runs` that equals its key."""
    keyed = [runs.select("run_id", F.lit(i).alias("p_"), F.col(c).cast("string").alias("k_")) for i, c in enumerate(candidates)]
    met = reduce(DataFrame.unionByName, keyed).join(table.withColumn("k_", F.col(key).cast("string")), "k_")
    w = Window.partitionBy("run_id").orderBy("p_")
    return met.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "p_", "k_")


def pending_runs(found: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that no stored result has the same key for."""
    return found.join(done.select(*keys).distinct(), keys, "left_anti")
