"""What the verdicts of many runs add up to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts with their codes, the worst first.
CODES = {"fail": 0, "error": 1, "warn": 2, "pass": 3, "not_applicable": 4}


def code(verdict: Column) -> Column:
    out = F.lit(5)
    for name, n in CODES.items():
        out = F.when(verdict == name, n).otherwise(out)
    return out


def run_status(results: DataFrame) -> DataFrame:
    """Per run: counts by verdict and the worst of them."""
    names = F.array(*[F.lit(n) for n in CODES])
    g = results.groupBy("run_id").agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in CODES], F.min(code(F.col("verdict"))).alias("code"))
    return g.withColumn("status", F.get(names, F.col("code"))).drop("code")


def requirement_stats(results: DataFrame) -> DataFrame:
    """Per requirement: counts, how many were checked, pass rate, the worst run (failing ones first, then the least margin), the most frequent reason."""
    worst = F.min(F.when(F.col("margin").isNotNull(), F.struct((F.col("verdict") != "fail").cast("int").alias("rank"), "margin", "run_id")))
    g = results.groupBy("id").agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in CODES], worst.alias("worst"))
    bad = results.where("verdict in ('fail', 'error', 'warn') and reason is not null").groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first"))
    mode = bad.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "reason")).alias("m")).select("id", F.col("m.reason").alias("reason"))
    checked = F.col("pass") + F.col("warn") + F.col("fail")
    g = g.join(mode, "id", "left").withColumn("checked", checked)
    return g.select("id", *CODES, "checked", (F.col("pass") / F.nullif(F.col("checked"), F.lit(0))).alias("pass_rate"), F.col("worst.run_id").alias("worst_run"), F.col("worst.margin").alias("worst_margin"), "reason")


def sentences(stats: DataFrame) -> DataFrame:
    """One sentence for each requirement."""
    n = sum((F.col(c) for c in CODES), F.lit(0))
    text = F.when(F.col("fail") > 0, F.format_string("FAIL in %d/%d runs", "fail", n)).when(F.col("error") > 0, F.format_string("ERROR in %d/%d runs", "error", n)).when(F.col("warn") > 0, F.format_string("WARN in %d/%d runs", "warn", n))
    text = text.when(F.col("pass") == n, F.format_string("PASS in all %d runs", n)).when(F.col("pass") > 0, F.format_string("PASS in %d/%d runs", "pass", n)).otherwise(F.format_string("N/A in all %d runs", n))
    return stats.select("id", text.alias("sentence"))


def verdict_matrix(results: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each run with a verdict code for each requirement; 5 where it wasn't checked."""
    return results.groupBy("run_id").pivot("id", ids).agg(F.first(code(F.col("verdict")))).na.fill(5)


def margin_matrix(results: DataFrame, ids: list[str]) -> DataFrame:
    return results.groupBy("run_id").pivot("id", ids).agg(F.first("margin"))


def overlay(results: DataFrame, per_requirement: int = 16) -> DataFrame:
    """Runs to show for each requirement: failures, then warnings, then the least margins."""
    w = Window.partitionBy("id").orderBy(code(F.col("verdict")), F.col("margin").asc_nulls_last(), "run_id")
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_requirement)


def capped(violations: DataFrame, per_run: int = 20) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("start")
    return violations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_run)


def margin_scale(results: DataFrame) -> DataFrame:
    """Per requirement whether margins are told in percent: where the limit is the same sign and size for all runs they aren't."""
    return results.groupBy("id").agg(F.count_distinct("limit").alias("limits"), F.min("margin_pct").alias("least_pct"), F.max("margin_pct").alias("most_pct"), (F.count_distinct("limit") > 1).alias("in_percent"))


def filter_runs(summary: DataFrame, text: str) -> DataFrame:
    """Rows that meet all words: `name>number`, `name=value`, or a word that some text column contains."""
    out = summary
    for word in text.split():
        m = re.fullmatch(r"(\w+)(<=|>=|!=|=|<|>)(.+)", word)
        if m and m[1] in summary.columns:
            c, value = F.col(m[1]), m[3]
            try:
                side, c = F.lit(float(value)), c.try_cast("double")
            except ValueError:
                side, c = F.lit(value.lower()), F.lower(c.cast("string"))
            out = out.where({"<": c < side, "<=": c <= side, ">": c > side, ">=": c >= side, "=": c == side, "!=": c != side}[m[2]])
        else:
            texts = [F.contains(F.lower(F.col(n)), F.lit(word.lower())) for n, t in summary.dtypes if t == "string"]
            hit = F.lit(False)
            for x in texts:
                hit = hit | F.coalesce(x, F.lit(False))
            out = out.where(hit)
    return out
