"""Candidate symbols: a derivatives list joined to a sector map, and counts of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = ".NS"


def candidates(listed: DataFrame, sectors: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """Listed symbols with a known sector; a symbol without one is left out, never named unknown."""
    known = sectors.filter(F.coalesce(F.col("sector"), F.lit("")) != "")
    return listed.select("symbol").distinct().join(known.select("symbol", "sector"), "symbol").withColumn("ticker", F.concat("symbol", F.lit(suffix)))


def unmapped(listed: DataFrame, sectors: DataFrame) -> DataFrame:
    known = sectors.filter(F.coalesce(F.col("sector"), F.lit("")) != "")
    return listed.select("symbol").distinct().join(known, "symbol", "left_anti")


def sector_counts(members: DataFrame) -> DataFrame:
    """Members a sector, the largest first, then by name."""
    return members.groupBy("sector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector")


def same_sector_pairs(members: DataFrame) -> DataFrame:
    per = members.groupBy("sector").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("n_pairs"))


def pair_count(members: DataFrame) -> DataFrame:
    return members.agg(F.countDistinct("symbol").alias("n")).select(F.expr("n * (n - 1) div 2").cast("long").alias("n_pairs"))


def sector_coverage(listed: DataFrame, sectors: DataFrame) -> DataFrame:
    """How many listed symbols have a sector, and their percentage."""
    known = sectors.filter(F.coalesce(F.col("sector"), F.lit("")) != "").select("symbol").distinct().withColumn("known", F.lit(1))
    both = listed.select("symbol").distinct().join(known, "symbol", "left")
    return both.agg(F.count("known").alias("n_mapped"), F.count("*").alias("n_listed")).withColumn("coverage_pct", F.try_divide(100.0 * F.col("n_mapped"), F.col("n_listed")))
