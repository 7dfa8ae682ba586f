"""Queries over tables of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ticker_checks import FATAL, INFO, WARN


def of_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity)


def is_usable(issues: DataFrame) -> bool:
    """Whether nothing fatal was found."""
    return of_severity(issues, FATAL).isEmpty()


def counts(issues: DataFrame) -> DataFrame:
    """Observations affected by check and severity, the most frequent first, then by name."""
    wide = issues.groupBy("check").pivot("severity", [FATAL, WARN, INFO]).agg(F.sum("n_affected")).fillna(0)
    return wide.withColumn("total", F.col(FATAL) + F.col(WARN) + F.col(INFO)).orderBy(F.desc("total"), "check")


def lowest_coverage(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.select("symbol", "coverage", "tradeable_coverage").orderBy(F.coalesce("tradeable_coverage", "coverage"), "symbol").limit(n)


def capped(issues: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` issues of each severity and check, and how many more there are.

    The rank is the window's only use, so Spark keeps ``n`` rows of a group on each side of its shuffle.
    """
    order = Window.partitionBy("severity", "check").orderBy(F.col("symbol").asc_nulls_first(), F.col("date").asc_nulls_first(), "detail", "n_affected")
    first = issues.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    sizes = issues.groupBy("severity", "check").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first.join(F.broadcast(sizes), ["severity", "check"])  # a row a check and severity


def flag_totals(issues: DataFrame) -> DataFrame:
    warn = of_severity(issues, WARN)
    return warn.agg(F.coalesce(F.sum("n_affected"), F.lit(0)).alias("n_observations"), F.count("*").alias("n_groups"))
