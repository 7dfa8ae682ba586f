"""Download records as a table: (symbol, seq, status, rows, start, end, last_date), the last of a symbol counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that a series may end before the window asked for and still cover it.
SLACK_DAYS = 7


def latest(records: DataFrame) -> DataFrame:
    """One record a symbol, the one with the highest ``seq``."""
    rest = [c for c in records.columns if c != "symbol"]
    return records.groupBy("symbol").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("symbol", "r.*")


def success_records(bars: DataFrame) -> DataFrame:
    """Status, row count and date range of each symbol's bars."""
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("empty"))


def complete() -> Column:
    return (F.col("status") == "ok") & (F.col("rows") > 0)


def covers(start: Column, end: Column) -> Column:
    """Whether a record's series serves a window: the same window, or an earlier start and a late enough end."""
    same = (F.col("start") == start) & (F.col("end") == end)
    reaches = F.col("last_date") >= F.date_sub(end, SLACK_DAYS)
    usable = complete() & F.col("last_date").isNotNull()
    return F.coalesce(usable & (same | ((F.col("start") <= start) & reaches)), F.lit(False))


def by_outcome(records: DataFrame) -> DataFrame:
    """(symbol, outcome) with outcome completed, empty or failed."""
    outcome = F.when(complete(), "completed").when(F.col("status") == "failed", "failed").otherwise("empty")
    return records.select("symbol", outcome.alias("outcome"))


def pending(requested: DataFrame, records: DataFrame, start: str, end: str) -> DataFrame:
    """Requested symbols without a record that covers the window."""
    served = records.filter(covers(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return requested.join(served, "symbol", "left_anti")


def summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_symbols"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "empty").alias("n_empty"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
