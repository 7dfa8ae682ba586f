"""Checks across symbols: padded and phantom dates, coverage, gaps, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.calendar import grid_returns, listed_span, numbered, sessions
from tidemark.operators.runs import runs
from tidemark.operators.ticker_checks import FATAL, INFO, WARN, issue, union

METRICS = ["symbol", "first", "last", "n_sessions", "n_observed", "coverage", "n_traded", "n_zero_volume", "tradeable_coverage", "n_missing", "max_gap", "n_gaps"]


def padded(bars: DataFrame, days: DataFrame) -> DataFrame:
    """A warning for each padded date: bars there, how many moved, how many traded by the listed share."""
    moved = grid_returns(bars).groupBy("date").agg(F.count_if(F.abs("ret") > 1e-12).alias("n_moved"))
    found = days.filter("padded").join(moved, "date", "left")
    traded = F.rint(F.col("participation") * F.col("n_observed")).cast("long")
    detail = F.concat_ws(" ", F.when(traded == 0, "holiday").otherwise("partial"), F.concat(F.lit("moved="), F.coalesce("n_moved", F.lit(0))), F.concat(F.lit("traded="), traded))
    return issue(found, "padded_session", WARN, symbol=F.lit(None).cast("string"), detail=detail, date=F.col("date"), value=F.col("participation"), n=F.col("n_observed"))


def phantom(days: DataFrame, most: int = 5) -> DataFrame:
    """Dates on which hardly any symbol has a bar."""
    found = days.filter((F.col("n_observed") > 0) & (F.col("n_observed") <= most))
    return issue(found, "phantom_session", WARN, symbol=F.lit(None).cast("string"), date=F.col("date"), n=F.col("n_observed"))


def own_sessions(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, date, session_no, seen, traded): each symbol over the sessions of its listed life.

    First and last dates are panel dates, so equi-joins turn them to session numbers; the numbers
    between are expanded, which forms exactly the rows of the result.
    """
    known = F.broadcast(numbered(days).select("date", "is_session", "session_no"))
    lo = known.select(F.col("date").alias("first"), (F.col("session_no") - F.col("is_session").cast("long") + 1).alias("lo"))
    hi = known.select(F.col("date").alias("last"), F.col("session_no").alias("hi"))
    lives = listed_span(bars).join(F.broadcast(lo), "first").join(F.broadcast(hi), "last").filter("lo <= hi")
    grid = lives.select("symbol", F.explode(F.sequence("lo", "hi")).alias("session_no")).join(F.broadcast(sessions(days)), "session_no")
    seen = bars.filter(F.col("close").isNotNull()).select("symbol", "date", F.lit(True).alias("seen"), (F.coalesce(F.col("volume"), F.lit(0.0)) > 0).alias("traded"))
    return grid.join(seen, ["symbol", "date"], "left").fillna(False, ["seen", "traded"])


def per_ticker(bars: DataFrame, days: DataFrame, universe: DataFrame | None = None, longer_than: int = 5) -> DataFrame:
    """Coverage of each symbol over its own listed sessions; universe symbols without a bar get zeros."""
    grid = own_sessions(bars, days)
    counts = grid.groupBy("symbol").agg(F.count("*").alias("n_sessions"), F.count_if("seen").alias("n_observed"), F.count_if("traded").alias("n_traded"))
    missing = runs(grid.withColumn("gone", ~F.col("seen")), ["symbol"], "session_no", "gone")
    gaps = missing.groupBy("symbol").agg(F.max("length").alias("max_gap"), F.count_if(F.col("length") > longer_than).alias("n_gaps"))
    span = listed_span(bars)
    if universe is not None:
        span = universe.select("symbol").distinct().join(span, "symbol", "left")
    out = span.join(counts, "symbol", "left").join(gaps, "symbol", "left").fillna(0, ["n_sessions", "n_observed", "n_traded", "max_gap", "n_gaps"])
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("n_sessions")), F.lit(0.0))
    out = out.withColumns({"coverage": share("n_observed"), "tradeable_coverage": share("n_traded"), "n_zero_volume": F.col("n_observed") - F.col("n_traded"), "n_missing": F.col("n_sessions") - F.col("n_observed")})
    return out.select(METRICS)


def missing_sessions(metrics: DataFrame, least: float = 0.95) -> DataFrame:
    found = metrics.filter("n_missing > 0")
    return issue(found, "missing_sessions", F.when(F.col("coverage") >= F.lit(least), INFO).otherwise(WARN), value=F.col("coverage"), n=F.col("n_missing"))


def gaps(bars: DataFrame, days: DataFrame, longer_than: int = 5) -> DataFrame:
    """Runs of more than ``longer_than`` sessions without a bar."""
    grid = own_sessions(bars, days).withColumn("gone", ~F.col("seen"))
    found = runs(grid, ["symbol"], "session_no", "gone", "date").filter(F.col("length") > longer_than)
    return issue(found, "gaps", WARN, date=F.col("date"), value=F.col("length"), n=F.col("length"))


def low_coverage(metrics: DataFrame, least: float = 0.95) -> DataFrame:
    some = metrics.filter((F.col("n_observed") > 0) & (F.col("coverage") < F.lit(least)))
    none = metrics.filter("n_observed = 0")
    return issue(some, "coverage", WARN, value=F.col("coverage"), n=F.col("n_missing")).unionByName(issue(none, "coverage", FATAL, detail="no observations", value=F.lit(0.0)))


def _apart(a: DataFrame, b: DataFrame, severity: str, detail: str, shown: int = 10) -> DataFrame:
    """One issue for the symbols of ``a`` that ``b`` lacks, naming the first few."""
    only = a.select("symbol").distinct().join(b.select("symbol").distinct(), "symbol", "left_anti")
    named = only.orderBy("symbol").limit(shown).select(F.lit(0).alias("one"), F.col("symbol").alias("name"))
    both = only.select(F.lit(1).alias("one"), F.lit(None).cast("string").alias("name")).unionByName(named)
    per = both.agg(F.sum("one").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names")).filter("n > 0")
    return issue(per, "ticker_consistency", severity, symbol=F.lit(None).cast("string"), detail=F.concat(F.lit(detail + ": "), F.col("names")), n=F.col("n"))


def consistency(panel: DataFrame, universe: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame | None:
    """Universe symbols not in the panel, panel symbols not in the universe, panel symbols not in the manifest."""
    parts = []
    if universe is not None:
        parts += [_apart(universe, panel, FATAL, "not in panel"), _apart(panel, universe, INFO, "not in universe")]
    if manifest is not None:
        parts.append(_apart(panel, manifest, WARN, "not in manifest"))
    return union(parts) if parts else None


def check_panel(bars: DataFrame, days: DataFrame, universe: DataFrame | None = None, manifest: DataFrame | None = None, *, most_phantom: int = 5, gap: int = 5, coverage: float = 0.95) -> DataFrame:
    """All checks of this module as one table of issues."""
    metrics = per_ticker(bars, days, universe, gap)
    parts = [padded(bars, days), phantom(days, most_phantom), missing_sessions(metrics, coverage), gaps(bars, days, gap), low_coverage(metrics, coverage)]
    members = consistency(bars, universe, manifest)
    return union(parts + ([members] if members is not None else []))
