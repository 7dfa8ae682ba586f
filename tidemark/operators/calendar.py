"""The session calendar, inferred from what was listed and what traded.

Windows without a partition run over one row a date: the calendar, not the bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, ratio

QUORUM, PADDING, STRESS_MOVE = 0.5, 0.90, 0.05


def listed_span(bars: DataFrame) -> DataFrame:
    """First and last observation of each symbol."""
    return bars.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def listed(dates: DataFrame, span: DataFrame) -> DataFrame:
    """(date, symbol) for every date within a symbol's listed life; ``span`` is a row a symbol."""
    return dates.join(span, (F.col("date") >= F.col("first")) & (F.col("date") <= F.col("last"))).select("date", "symbol")


def participation(bars: DataFrame, *, quorum: float = QUORUM, padding: float = PADDING) -> DataFrame:
    """A row a date: bars observed, traded (volume above zero), symbols listed, padded and session flags.

    The listed count is the starts up to a date less the ends before it, so no grid of dates and
    symbols is formed. A date is padded if almost no listed symbol traded. Bars without a volume column
    count as traded where they are observed.
    """
    traded = F.coalesce(F.col("volume"), F.lit(0.0)) > 0 if "volume" in bars.columns else F.col("close").isNotNull()
    per_date = bars.groupBy("date").agg(F.count("close").alias("n_observed"), F.count_if(traded).alias("n_traded"))
    span = listed_span(bars)
    starts = span.groupBy(F.col("first").alias("date")).agg(F.count("*").alias("n_started"))
    ends = span.groupBy(F.col("last").alias("date")).agg(F.count("*").alias("n_ended"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    known = per_date.join(starts, "date", "left").join(ends, "date", "left").fillna(0, ["n_started", "n_ended"])
    counted = known.withColumn("n_listed", F.sum("n_started").over(so_far) - F.coalesce(F.sum("n_ended").over(before), F.lit(0)))
    share = F.coalesce(ratio(F.col("n_traded"), F.col("n_listed")), F.lit(0.0))
    flagged = counted.select("date", "n_observed", "n_traded", "n_listed", share.alias("participation"))
    flagged = flagged.withColumn("padded", (F.col("n_listed") > 0) & (F.col("participation") <= F.lit(1.0 - padding)))
    return flagged.withColumn("is_session", (F.col("participation") >= F.lit(quorum)) & ~F.col("padded"))


def numbered(days: DataFrame) -> DataFrame:
    """``participation`` rows with session_no, the sessions up to and including each date."""
    return days.withColumn("session_no", F.sum(F.col("is_session").cast("long")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def sessions(days: DataFrame) -> DataFrame:
    """Sessions numbered from 1."""
    return numbered(days).filter("is_session").select("date", "session_no")


def grid_returns(bars: DataFrame) -> DataFrame:
    """(symbol, date, ret) over all panel dates: NULL where the date before has no bar of the symbol."""
    numbered = bars.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("no"))
    placed = bars.select("symbol", "date", "close").join(numbered, "date")
    before = F.when(F.lag("no").over(by_date()) == F.col("no") - 1, F.lag("close").over(by_date()))
    return placed.withColumn("before", before).select("symbol", "date", (ratio(F.col("close"), F.col("before")) - 1).alias("ret"))


def market_stress(bars: DataFrame, move: float = STRESS_MOVE) -> DataFrame:
    """Share of the observed symbols that moved more than ``move`` on each date."""
    moved = F.count_if(F.abs("ret") > F.lit(move))
    return grid_returns(bars).groupBy("date").agg(moved.alias("n_moved"), F.count("*").alias("n_observed")).withColumn("stress", F.coalesce(ratio(F.col("n_moved"), F.col("n_observed")), F.lit(0.0)))
