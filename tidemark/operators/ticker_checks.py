"""Checks of each symbol's raw bars. Nothing is changed or removed; every check adds issue rows.

``bars`` is raw: (symbol, ingest_seq, date, open, high, low, close, volume, dividends, splits).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, number, ratio
from tidemark.operators.runs import runs

FATAL, WARN, INFO = "FATAL", "WARN", "INFO"
ISSUE = ["check", "severity", "symbol", "date", "detail", "value", "n_affected"]
PRICES = ["open", "high", "low", "close", "adj_close"]


def issue(df: DataFrame, check: str | Column, severity: str | Column, *, detail: str | Column = "", date: Column | None = None, value: Column | None = None, n: Column | None = None, symbol: Column | None = None) -> DataFrame:
    """Rows of the common issue shape."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        text(check).alias("check"), text(severity).alias("severity"), (F.col("symbol") if symbol is None else symbol).alias("symbol"),
        (F.lit(None) if date is None else date).cast("date").alias("date"), text(detail).cast("string").alias("detail"),
        (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(1) if n is None else n).cast("long").alias("n_affected"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def no_rows(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """A requested symbol without any bar."""
    return issue(requested.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti"), "missing_values", FATAL, detail="no rows")


def duplicates(bars: DataFrame) -> DataFrame:
    """Dates that occur more than once; as affected count all their rows less their number."""
    per_date = bars.groupBy("symbol", "date").agg(F.count("*").alias("n")).filter("n > 1")
    per = per_date.groupBy("symbol").agg(F.min("date").alias("date"), F.sum(F.col("n") - 1).alias("n"))
    return issue(per, "duplicate_timestamps", FATAL, date=F.col("date"), n=F.col("n"))


def order(bars: DataFrame, arrival: str | Column = "ingest_seq") -> DataFrame:
    """Symbols whose rows do not arrive by date; equal dates are in order."""
    back = F.col("date") < F.lag("date").over(Window.partitionBy("symbol").orderBy(arrival))
    return issue(bars.withColumn("back", back).groupBy("symbol").agg(F.bool_or("back").alias("back")).filter("back"), "chronological_order", FATAL)


def row_checks(bars: DataFrame, share: float = 0.02, kinds: tuple[str, ...] = ("missing_values", "invalid_prices", "zero_volume")) -> DataFrame:
    """What a row alone shows, all in one pass: missing values, impossible prices, bars without volume.

    Prices at or below zero, high below low and negative volume are fatal, close and open outside low and
    high a warning; so are bars without volume above ``share`` of a symbol's bars.
    """
    prices = [c for c in PRICES if c in bars.columns]
    outside = lambda c: (F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))
    tests = [("missing_values", WARN, c, F.col(c).isNull()) for c in [*prices, *(["volume"] if "volume" in bars.columns else [])]]
    tests += [("invalid_prices", FATAL, c, F.col(c) <= 0) for c in prices]
    tests += [("invalid_prices", FATAL, "high below low", F.col("high") < F.col("low")), ("invalid_prices", FATAL, "negative volume", F.col("volume") < 0)]
    tests += [("invalid_prices", WARN, f"{c} outside range", outside(c)) for c in ("close", "open")]
    tests += [("zero_volume", INFO, "share", _no_volume())]
    found = [
        F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(detail).alias("detail"), F.count_if(met).alias("n"), F.min(F.when(met, F.col("date"))).alias("first"))
        for check, severity, detail, met in tests if check in kinds
    ]
    per = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.array(*found).alias("all")).select("symbol", "n_rows", F.inline("all")).filter("n > 0")
    part = F.when(F.col("check") == "zero_volume", ratio(F.col("n"), F.col("n_rows")))
    severity = F.when(part > F.lit(share), WARN).otherwise(F.col("severity"))
    return issue(per, F.col("check"), severity, detail=F.col("detail"), date=F.when(F.col("check") == "invalid_prices", F.col("first")), value=part, n=F.col("n"))


def missing(bars: DataFrame) -> DataFrame:
    return row_checks(bars, kinds=("missing_values",))


def invalid_prices(bars: DataFrame) -> DataFrame:
    """Prices at or below zero, high below low, negative volume; close and open outside low and high."""
    return row_checks(bars, kinds=("invalid_prices",))


def zero_volume(bars: DataFrame, share: float = 0.02) -> DataFrame:
    """Bars without volume; a warning above ``share`` of a symbol's bars."""
    return row_checks(bars, share, ("zero_volume",))


def _no_volume() -> Column:
    return F.coalesce(F.col("volume"), F.lit(0.0)) <= 0


def zero_runs(bars: DataFrame, longer_than: int = 3) -> DataFrame:
    """Runs of bars without volume that are longer than ``longer_than``."""
    found = runs(bars.withColumn("flag", _no_volume()), ["symbol"], "date", "flag").filter(F.col("length") > longer_than)
    return issue(found, "zero_volume", WARN, detail="run", date=F.col("start"), value=F.col("length"), n=F.col("length"))


def stale(bars: DataFrame, least: int = 5, price: str | Column = "close") -> DataFrame:
    """Runs of ``least`` or more unchanged prices; dated by the first unchanged bar, which counts with its anchor."""
    priced = bars.withColumn("price", F.col(price) if isinstance(price, str) else price)
    flagged = priced.withColumn("flag", F.col("price") - F.lag("price").over(by_date()) == 0)
    found = runs(flagged, ["symbol"], "date", "flag", "price").filter(F.col("length") >= least)
    return issue(found, "stale_price", WARN, date=F.col("start"), value=F.col("price"), n=F.col("length") + 1)


def returns(bars: DataFrame) -> DataFrame:
    """Change of close from the row before, unfilled."""
    return bars.withColumn("ret", ratio(F.col("close"), F.lag("close").over(by_date())) - 1)


def near_action(bars: DataFrame, window: int = 3) -> DataFrame:
    """Whether a dividend or split lies within ``window`` rows, and the nearest one; of two, the earlier."""
    is_action = (F.coalesce(F.col("dividends"), F.lit(0.0)) != 0) | (F.coalesce(F.col("splits"), F.lit(0.0)) != 0)
    numbered = bars.withColumns({"action": is_action, "no": F.row_number().over(by_date())})
    this = F.when(F.col("action"), F.struct("no", "date", "dividends", "splits"))
    back = F.last(this, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(this, ignorenulls=True).over(by_date().rowsBetween(0, Window.unboundedFollowing))
    both = numbered.withColumns({"back": back, "ahead": ahead})
    far = F.lit(1 << 30)
    to_back, to_ahead = F.coalesce(F.col("no") - F.col("back.no"), far), F.coalesce(F.col("ahead.no") - F.col("no"), far)
    nearest = F.when(to_back <= to_ahead, F.col("back")).otherwise(F.col("ahead"))
    picked = both.withColumns({"nearest": nearest, "distance": F.least(to_back, to_ahead)})
    near = F.col("distance") <= window
    made = {"near": near, "action_date": F.when(near, F.col("nearest.date")), "action_dividend": F.when(near, F.col("nearest.dividends")), "action_split": F.when(near, F.col("nearest.splits")), "action_distance": F.when(near, F.col("distance")).cast("long")}
    return picked.withColumns(made).drop("back", "ahead", "nearest", "no", "action", "distance")


def extreme_moves(bars: DataFrame, stress: DataFrame, *, move: float = 0.20, severe: float = 0.50, window: int = 3, wide: float = 0.10) -> DataFrame:
    """Moves beyond ``move``: a warning near a corporate action, if severe, or if the market was calm.

    Otherwise, on a day that moved the market, for information. ``stress`` is a row a date.
    """
    known = near_action(returns(bars), window).filter(F.abs("ret") > F.lit(move)).join(F.broadcast(stress.select("date", "stress")), "date", "left")
    market = F.coalesce(F.col("stress") >= F.lit(wide), F.lit(False))
    severity = F.when(F.col("near"), WARN).when((F.abs("ret") > F.lit(severe)) | ~market, WARN).otherwise(INFO)
    detail = F.when(F.col("near"), F.concat(F.lit("near action of "), F.col("action_date").cast("string"))).when(market, "market-wide").otherwise("unexplained")
    return issue(known, "extreme_move", severity, detail=detail, date=F.col("date"), value=F.col("ret"))


def coerced(bars: DataFrame) -> DataFrame:
    """Cells that are not numbers become NULL before the checks."""
    return bars.withColumns({c: number(F.col(c)) for c in [*PRICES, "volume", "dividends", "splits"] if c in bars.columns})


def check_tickers(bars: DataFrame, stress: DataFrame, requested: DataFrame | None = None, *, arrival: str | Column = "ingest_seq", zero_share: float = 0.02, zero_run: int = 3, stale_run: int = 5, move: float = 0.20, severe: float = 0.50, action_window: int = 3, wide: float = 0.10) -> DataFrame:
    """All checks of this module as one table of issues."""
    bars = coerced(bars)
    parts = [
        duplicates(bars), order(bars, arrival), row_checks(bars, zero_share), zero_runs(bars, zero_run),
        stale(bars, stale_run), extreme_moves(bars, stress, move=move, severe=severe, window=action_window, wide=wide),
    ]
    return union(parts + ([no_rows(requested, bars)] if requested is not None else []))
