"""Raw bars to adjusted long panels.

Raw bars are (symbol, ingest_seq, date, open, high, low, close, adj_close, volume, dividends, splits);
``ingest_seq`` keeps the order of arrival, in which the last of several rows of a date wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import missing_to_null, number, ratio

REQUIRED = ["open", "high", "low", "close", "adj_close", "volume"]
OPTIONAL = ["dividends", "splits"]
FIELDS = ["open", "high", "low", "close", "volume", "turnover", "adj_factor"]
#: Adjustment factors outside this band mean a broken series.
FACTOR_BAND = (0.05, 1 + 1e-9)
MIN_ROWS = 500
ERROR_CHARS = 200


class CleanError(ValueError):
    """A raw table that cannot be a price series."""


def require(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise CleanError(f"missing columns: {', '.join(absent)}")
    return df


def session_date(ts: Column, tz: str) -> Column:
    """The date on the wall clock of ``tz``."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def keep_last(df: DataFrame, order: str | Column = "ingest_seq") -> DataFrame:
    """One row a symbol and date, the last to arrive; partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    return df.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("symbol", "date", "_row.*")


def usable(df: DataFrame) -> DataFrame:
    """Rows with a positive close and adjusted close; missing counts as not positive."""
    return df.filter((F.col("close") > 0) & (F.col("adj_close") > 0))


def factor(df: DataFrame) -> DataFrame:
    return df.withColumn("adj_factor", ratio(F.col("adj_close"), F.col("close")))


def factor_band(df: DataFrame, band: tuple[float, float] = FACTOR_BAND) -> DataFrame:
    """Extremes of each symbol's adjustment factor and whether the symbol is plausible."""
    f = F.col("adj_factor")
    stats = df.groupBy("symbol").agg(F.min(f).alias("min_factor"), F.max(f).alias("max_factor"), F.bool_or(F.isnan(f) | (F.abs(f) == float("inf"))).alias("not_finite"))
    return stats.withColumn("plausible", (F.col("min_factor") >= band[0]) & (F.col("max_factor") <= band[1]) & ~F.col("not_finite"))


def adjust(raw: DataFrame, band: tuple[float, float] = FACTOR_BAND) -> DataFrame:
    """Adjusted bars of plausible symbols: one factor on open, high and low; the adjusted close as close.

    Turnover is the unadjusted close times volume. No cell is filled from a neighbour.
    """
    raw = require(raw)
    for c in OPTIONAL:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(0.0))
    raw = missing_to_null(raw, REQUIRED).withColumns({c: F.coalesce(number(F.col(c)), F.lit(0.0)) for c in OPTIONAL})
    known = factor(usable(raw))
    accepted = known.join(factor_band(known, band).filter(~F.col("plausible")).select("symbol"), "symbol", "left_anti")
    f = F.col("adj_factor")
    return accepted.withColumns({"turnover": F.col("close") * F.col("volume"), "open": F.col("open") * f, "high": F.col("high") * f, "low": F.col("low") * f, "close": F.col("adj_close")}).drop("adj_close")


def incoherent(bars: DataFrame) -> DataFrame:
    """How many bars of each symbol have a high, low and close that contradict each other."""
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("close"))
    return bars.groupBy("symbol").agg(F.count_if(bad).alias("n_incoherent"))


def long_enough(bars: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    enough = bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from ``start`` to ``end``, both included."""
    if start:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars


def drop_ledger(requested: DataFrame, raw: DataFrame, min_rows: int = MIN_ROWS, band: tuple[float, float] = FACTOR_BAND) -> DataFrame:
    """(symbol, reason) of every requested symbol that gives no panel column; the first reason counts."""
    known = factor(usable(raw))
    arrived = raw.groupBy("symbol").agg(F.count("*").alias("n_raw"))
    kept = known.groupBy("symbol").agg(F.count("*").alias("n"))
    facts = requested.select("symbol").distinct().join(arrived, "symbol", "left").join(kept, "symbol", "left").join(factor_band(known, band), "symbol", "left")
    few = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" rows (< {min_rows})"))
    reason = F.when(F.col("n_raw").isNull(), "no raw file").when(F.col("n").isNull(), "no usable rows").when(~F.col("plausible"), "implausible adjustment factor").when(F.col("n") < min_rows, few)
    return facts.select("symbol", F.substring(reason, 1, ERROR_CHARS).alias("reason")).filter("reason is not null")


def build_panel(raw: DataFrame, *, min_rows: int = MIN_ROWS, start: str | None = None, end: str | None = None, band: tuple[float, float] = FACTOR_BAND) -> DataFrame:
    """The long panel: last row of a date, adjusted, symbols with enough rows, then the date slice."""
    return between(long_enough(adjust(keep_last(raw), band), min_rows), start, end)


def wide(bars: DataFrame, field: str, symbols: list[str]) -> DataFrame:
    """Dates by symbols for export; an absent bar stays NULL."""
    return bars.groupBy("date").pivot("symbol", symbols).agg(F.first(field)).orderBy("date")


def panel_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


def cell_coverage(bars: DataFrame) -> DataFrame:
    """Share of the grid of dates and symbols that holds a bar."""
    n = bars.agg(F.count("close").alias("n_cells"), F.countDistinct("symbol").alias("s"), F.countDistinct("date").alias("d"))
    return n.select("n_cells", (F.col("s") * F.col("d")).alias("n_grid"), ratio(F.col("n_cells"), F.col("s") * F.col("d")).alias("coverage"))


def median_turnover(bars: DataFrame) -> DataFrame:
    """Exact median over the whole sample. Descriptive only: membership decided by it would look ahead."""
    return bars.groupBy("symbol").agg(F.median("turnover").alias("median_turnover"))
