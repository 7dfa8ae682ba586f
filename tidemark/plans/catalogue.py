"""Every panel query over the star-schema tables: name -> callable, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import candidates as cand
from tidemark.operators import causality, clean, features, manifest, panel_checks, report, universe
from tidemark.operators import ticker_checks as tick
from tidemark.plans import oracle
from tidemark.sources import star
from tidemark.sources.stage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Thresholds that suit the derived bars; the operators' defaults suit market data.
QUORUM, PADDING, PHANTOM, STRESS_MOVE, WIDE = 0.3, 0.80, 7, 4.0, 0.20
MOVE, SEVERE, ACTION_WINDOW, COVERAGE, GAP = 4.0, 10.0, 3, 0.95, 5
FORMATION, TRADING, STEP = 36, 6, 6
CRITERIA = universe.Criteria(history_years=3.0, median_turnover=60_000.0, last_price=900.0, missing_frac=0.6, lookback=252)
CUTS = [date(1997, 1, 1), date(1999, 1, 1), date(2000, 6, 1)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, halves up: sums depend on their order in the last bits."""
    scale = F.lit(10.0**digits)
    return df.select(*((F.floor(F.col(c) * scale + 0.5) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return star.raw_bars(spark, d)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return clean.adjust(_raw(spark, d))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return cal.participation(_bars(spark, d), quorum=QUORUM, padding=PADDING)


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bars and their calendar, staged: plans that use them several times read them, and small ones broadcast."""
    b = materialize(_bars(spark, d), "bars")
    return b, materialize(cal.participation(b, quorum=QUORUM, padding=PADDING), "days")


def _defective(spark: SparkSession, d: str) -> DataFrame:
    """Raw bars with defects planted by the day's number."""
    day = F.date_diff("date", F.lit("1995-01-01").cast("date"))
    every = lambda n, column, value: F.when(day % n == 0, value).otherwise(F.col(column))
    none = F.lit(None).cast("double")
    return _raw(spark, d).withColumns({"open": every(97, "open", none), "close": every(211, "close", F.lit(0.0)), "high": every(89, "high", F.col("low") - 1), "volume": every(131, "volume", -F.col("volume") - 1)})


def _issues(df: DataFrame) -> DataFrame:
    return rounded(df.select(tick.ISSUE))


def _x(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("symbol", "date", F.col("close").alias("x"))


def _universe_members(spark: SparkSession, d: str) -> DataFrame:
    """Nations that have customers: the membership side of the consistency checks."""
    customer, nation = star.table(spark, d, "customer"), star.table(spark, d, "nation")
    return nation.join(customer, nation.n_nationkey == customer.c_nationkey, "left_semi").filter("n_nationkey % 7 <> 3").select(F.col("n_name").alias("symbol"))


# --- bars and cleaning ---------------------------------------------------------------------------


@query
def bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bars(spark, d))


@query
def clean_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    lines = star.lines(spark, d).select("symbol", "date", "arrival", "px", "l_discount")
    return rounded(clean.keep_last(lines, "arrival").select("symbol", "date", F.col("px").alias("close"), (F.col("px") * (1 - F.col("l_discount"))).alias("adj_close")))


@query
def clean_positive(spark: SparkSession, d: str) -> DataFrame:
    return clean.usable(_defective(spark, d)).groupBy("symbol").agg(F.count("*").alias("n_rows"))


@query
def adj_factor_band(spark: SparkSession, d: str) -> DataFrame:
    known = clean.factor(clean.usable(_raw(spark, d)))
    return rounded(clean.factor_band(known, (0.05, 1 + 1e-9)).drop("not_finite"))


@query
def drop_ledger(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_ledger(star.sectors(spark, d), _defective(spark, d).filter("symbol <> 'NATION_3'"), min_rows=1400)


@query
def incoherent_bars(spark: SparkSession, d: str) -> DataFrame:
    return clean.incoherent(_defective(spark, d))


@query
def panel_slice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.between(clean.long_enough(_bars(spark, d), 1400), "1997-01-01", "1997-06-30").select("symbol", "date", "close", "volume"))


@query
def panel_summary(spark: SparkSession, d: str) -> DataFrame:
    return clean.panel_summary(_bars(spark, d))


@query
def cell_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.cell_coverage(_bars(spark, d)))


@query
def median_turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.median_turnover(_bars(spark, d)))


@query
def panel_wide_close(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.wide(_bars(spark, d), "close", oracle.WIDE_SYMBOLS))


@query
def normalise_dates(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "events").groupBy(clean.session_date(F.col("ts"), "Asia/Kolkata").alias("date")).agg(F.count("*").alias("n_events"))


@query
def plausibility(spark: SparkSession, d: str) -> DataFrame:
    """Bars a year, factors within (0, 1], and actions of each symbol."""
    b = _bars(spark, d)
    years = F.date_diff(F.max("date"), F.min("date")) / F.lit(365.25)
    return rounded(b.groupBy("symbol").agg(F.try_divide(F.count("*"), years).alias("bars_a_year"), F.bool_and((F.col("adj_factor") > 0) & (F.col("adj_factor") <= 1)).alias("factor_ok"), F.count_if((F.col("dividends") != 0) | (F.col("splits") != 0)).alias("n_actions")))


# --- candidates ----------------------------------------------------------------------------------


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return star.sectors(spark, d).select("symbol")


def _sector_map(spark: SparkSession, d: str) -> DataFrame:
    """Sectors with some unknown: null for one region, empty for one nation."""
    hole = F.when(F.col("sector") == "ASIA", F.lit(None)).when(F.col("symbol") == "NATION_3", "").otherwise(F.col("sector"))
    return star.sectors(spark, d).withColumn("sector", hole)


@query
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return cand.candidates(_listed(spark, d), _sector_map(spark, d))


@query
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return cand.unmapped(_listed(spark, d), _sector_map(spark, d))


@query
def sector_counts(spark: SparkSession, d: str) -> DataFrame:
    return cand.sector_counts(candidates(spark, d))


@query
def same_sector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cand.same_sector_pairs(star.sectors(spark, d))


@query
def pair_count(spark: SparkSession, d: str) -> DataFrame:
    return cand.pair_count(star.sectors(spark, d))


@query
def sector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cand.sector_coverage(_listed(spark, d), _sector_map(spark, d)))


# --- calendar ------------------------------------------------------------------------------------


@query
def listed_span(spark: SparkSession, d: str) -> DataFrame:
    return cal.listed_span(_bars(spark, d))


@query
def listed_per_date(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return cal.listed(b.select("date").distinct(), F.broadcast(cal.listed_span(b))).groupBy("date").agg(F.count("*").alias("n_listed"))


@query
def participation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_days(spark, d))


@query
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return cal.sessions(_days(spark, d))


@query
def padded_dates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_days(spark, d).filter("padded").select("date", "participation"))


@query
def market_stress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.market_stress(_bars(spark, d), STRESS_MOVE))


# --- checks of tickers ---------------------------------------------------------------------------


@query
def tick_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.duplicates(star.lines(spark, d)))


@query
def tick_order(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.order(star.lines(spark, d), "arrival"))


@query
def tick_no_rows(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.no_rows(star.sectors(spark, d), _bars(spark, d).filter("symbol not like 'NATION_2%'")))


@query
def tick_missing(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.missing(_defective(spark, d)))


@query
def tick_invalid(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.invalid_prices(_defective(spark, d)))


@query
def tick_zero_volume(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.zero_volume(_defective(spark, d), 0.22))


@query
def tick_zero_runs(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.zero_runs(_raw(spark, d), 3))


@query
def tick_stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return _issues(tick.stale(_raw(spark, d), 3, F.floor(F.col("close") / 1000).cast("double")))


@query
def tick_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tick.returns(_raw(spark, d)).select("symbol", "date", "ret"))


@query
def tick_near_action(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tick.near_action(_raw(spark, d), ACTION_WINDOW).select("symbol", "date", "near", "action_date", "action_dividend", F.coalesce("action_distance", F.lit(-1)).alias("action_distance")))


def _extreme(spark: SparkSession, d: str) -> DataFrame:
    raw = materialize(_raw(spark, d), "raw")
    return tick.extreme_moves(raw, cal.market_stress(clean.adjust(raw), STRESS_MOVE), move=MOVE, severe=SEVERE, window=ACTION_WINDOW, wide=WIDE)


@query
def tick_extreme_moves(spark: SparkSession, d: str) -> DataFrame:
    return _issues(_extreme(spark, d))


# --- checks of the panel -------------------------------------------------------------------------


@query
def panel_padded(spark: SparkSession, d: str) -> DataFrame:
    return _issues(panel_checks.padded(*_panel(spark, d)))


@query
def panel_phantom(spark: SparkSession, d: str) -> DataFrame:
    return _issues(panel_checks.phantom(_days(spark, d), PHANTOM))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    b, days = _panel(spark, d)
    return panel_checks.per_ticker(b.filter("symbol <> 'NATION_11'"), days, star.sectors(spark, d), GAP)


@query
def per_ticker_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_metrics(spark, d))


@query
def panel_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _issues(panel_checks.gaps(*_panel(spark, d), GAP))


@query
def panel_missing(spark: SparkSession, d: str) -> DataFrame:
    return _issues(panel_checks.missing_sessions(_metrics(spark, d), 0.6))


@query
def panel_low_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _issues(panel_checks.low_coverage(_metrics(spark, d), 0.6))


@query
def consistency(spark: SparkSession, d: str) -> DataFrame:
    panel = _bars(spark, d).filter("symbol <> 'NATION_11'")
    return _issues(panel_checks.consistency(panel, _universe_members(spark, d), star.sectors(spark, d).filter("sector <> 'ASIA'")))


# --- issues --------------------------------------------------------------------------------------


def _all_issues(spark: SparkSession, d: str) -> DataFrame:
    defective = materialize(_defective(spark, d), "defective")
    b, days = _panel(spark, d)
    parts = [tick.row_checks(defective, 0.22), tick.zero_runs(_raw(spark, d), 3), panel_checks.phantom(days, PHANTOM), panel_checks.gaps(b, days, GAP)]
    return tick.union(parts)


@query
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts(_all_issues(spark, d))


@query
def issues_capped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.capped(_all_issues(spark, d), 25).select("check", "severity", "symbol", "date", "detail", "n_affected", "rank", "more"))


@query
def flag_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.flag_totals(_all_issues(spark, d))


@query
def worst_tradeable(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.lowest_coverage(_metrics(spark, d), 10))


# --- point-in-time universe ----------------------------------------------------------------------


def _dates(days: DataFrame) -> DataFrame:
    return universe.decision_dates(cal.sessions(days), FORMATION, TRADING, STEP)


def _schedule(spark: SparkSession, d: str, top: int | None = None) -> DataFrame:
    criteria = CRITERIA if top is None else universe.Criteria(**{**CRITERIA.__dict__, "top": top})
    b, days = _panel(spark, d)
    return universe.eligibility_schedule(star.sectors(spark, d), b, days, _dates(days), criteria)


@query
def decision_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dates(_panel(spark, d)[1])


@query
def liquidity_stats(spark: SparkSession, d: str) -> DataFrame:
    b, days = _panel(spark, d)
    return rounded(universe.liquidity_stats(star.sectors(spark, d), b, days, _dates(days)))


@query
def eligibility_schedule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_schedule(spark, d))


@query
def eligibility_capped(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d, 5).select("symbol", "as_of", "reasons", "eligible")


def _selected(spark: SparkSession, d: str, schedule: DataFrame | None = None, **more) -> DataFrame:
    sectors = star.sectors(spark, d).withColumn("sector", F.when(F.col("symbol") == "NATION_6", "").otherwise(F.col("sector")))
    complete = star.sectors(spark, d).filter("symbol <> 'NATION_12'").select("symbol")
    fatal = star.sectors(spark, d).filter("symbol in ('NATION_12', 'NATION_10')").select("symbol")
    schedule = materialize(_schedule(spark, d), "schedule") if schedule is None else schedule
    return universe.select(schedule, sectors, complete, fatal, **more)


@query
def selected_universe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_selected(spark, d).filter("member").select("symbol", "sector", "history_years", "median_turnover", "missing_frac", "last_price"))


@query
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_selected(spark, d).filter("not member").select("symbol", "sector", "excluded_for", "history_years", "median_turnover", "missing_frac", "last_price"))


@query
def size_capped(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, max_size=6).select("symbol", "excluded_for", "member")


@query
def ever_eligible(spark: SparkSession, d: str) -> DataFrame:
    return universe.ever_eligible(_schedule(spark, d))


@query
def eligible_over_time(spark: SparkSession, d: str) -> DataFrame:
    schedule = materialize(_schedule(spark, d), "schedule")
    return rounded(universe.eligible_over_time(schedule, _selected(spark, d, schedule).filter("member")))


@query
def sector_table(spark: SparkSession, d: str) -> DataFrame:
    return cand.sector_counts(_selected(spark, d).filter("member"))


@query
def reason_tally(spark: SparkSession, d: str) -> DataFrame:
    return universe.reason_tally(_schedule(spark, d))


@query
def turnover_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.turnover_quantiles(universe.latest(_schedule(spark, d))))


@query
def top_bottom_liquidity(spark: SparkSession, d: str) -> DataFrame:
    schedule = materialize(_schedule(spark, d), "schedule")
    return rounded(universe.most_and_least_liquid(universe.latest(schedule).select("symbol", "median_turnover"), 10))


@query
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.coverage_stats(universe.latest(_schedule(spark, d))))


@query
def expected_false_positives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.expected_false_positives(star.sectors(spark, d)))


# --- features ------------------------------------------------------------------------------------


def _feature(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: rounded(f(_x(spark, d)))


def _pair(df: DataFrame) -> DataFrame:
    return features.pair(df, "NATION_3", "NATION_8")


_feature("feat_trailing_mean", features.trailing_mean)
_feature("feat_trailing_mean_lag1", lambda df: features.trailing_mean(df, lag=1))
_feature("feat_zscore", features.trailing_zscore)
_feature("feat_expanding_mean", features.expanding_mean)
_feature("feat_lagged_return", features.lagged_return)
_feature("feat_multi", features.several)
_feature("feat_hedge_ratio", lambda df: features.rolling_beta(_pair(df)))
_feature("feat_fixed_beta", lambda df: features.fixed_beta(_pair(df)))
_feature("leak_full_zscore", features.leak_full_zscore)
_feature("leak_centered", features.leak_centred)
_feature("leak_next", features.leak_next)
_feature("leak_minmax", features.leak_minmax)
_feature("leak_full_beta", lambda df: features.leak_full_beta(_pair(df)))
_feature("leak_future_max", features.leak_future_max)
_feature("leak_bfill", lambda df: features.leak_backfill(df, F.dayofmonth("date") % 5 == 0))
# whole hundredths, so that a week's sum does not depend on its order
_feature("weekly_mean", lambda df: features.weekly(df.withColumn("x", F.floor(F.col("x") * 100 + 0.5).cast("double"))))


#: Features of a pair of symbols and the one that fills holes, beside those of a panel.
_OTHERS = {
    "hedge_ratio": lambda df: features.rolling_beta(_pair(df)), "fixed_beta": lambda df: features.fixed_beta(_pair(df)),
    "full_beta": lambda df: features.leak_full_beta(_pair(df)), "backfill": lambda df: features.leak_backfill(df, F.dayofmonth("date") % 5 == 0),
}


@query
def causality_report(spark: SparkSession, d: str) -> DataFrame:
    """Each causal and leaky feature, recomputed on histories cut at three dates (``check`` cuts at seven shares)."""
    x = materialize(_x(spark, d), "x")
    parts = [causality.summary(f, x, CUTS).withColumn("feature", F.lit(n)) for n, f in {**features.CAUSAL, **features.LEAKY, **_OTHERS}.items()]
    return reduce(DataFrame.unionByName, parts).select("feature", "checkpoint", "n_compared", "n_bad", "passed")


# --- manifest ------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A download record an order: a customer is the symbol, the order's status tells the outcome."""
    orders = star.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "empty").otherwise("failed")
    first = F.col("o_orderdate").cast("date")
    return orders.select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.when(status == "ok", F.col("o_orderkey") % 900).otherwise(0).cast("long").alias("rows"), first.alias("start"), F.date_add(first, 365).alias("end"), F.when(status == "ok", F.date_add(first, (355 + F.col("o_orderkey") % 11).cast("int"))).alias("last_date"))


START, END = "1997-01-01", "1997-12-01"


@query
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_records(spark, d))


@query
def manifest_completed(spark: SparkSession, d: str) -> DataFrame:
    return manifest.by_outcome(manifest.latest(_records(spark, d)))


@query
def manifest_pending(spark: SparkSession, d: str) -> DataFrame:
    requested = star.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"))
    return manifest.pending(requested, manifest.latest(_records(spark, d)), START, END)


@query
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.summary(manifest.latest(_records(spark, d)))


@query
def manifest_records(spark: SparkSession, d: str) -> DataFrame:
    """Success records of the bars of each symbol."""
    return manifest.success_records(_bars(spark, d))


ORACLE_SQL: dict[str, str] = oracle.statements()

