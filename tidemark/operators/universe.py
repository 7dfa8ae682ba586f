"""Point-in-time universe: who was eligible at each decision date, from data up to that date alone."""

from __future__ import annotations

import calendar as months
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import listed_span, numbered

STATS = ["symbol", "as_of", "first_obs", "last_obs", "history_years", "n_sessions_in_window", "n_traded_in_window", "missing_frac", "median_turnover", "last_price"]
RANKS = {"median_turnover": True, "history_years": True, "last_price": True, "missing_frac": False}


class SelectionError(ValueError):
    """No decision can be taken from these inputs."""


@dataclass(frozen=True)
class Criteria:
    """Floors and ceilings of eligibility; ``top`` keeps only the most liquid names of a date."""

    history_years: float = 3.0
    median_turnover: float = 2.5e8
    last_price: float = 20.0
    missing_frac: float = 0.02
    lookback: int = 252
    top: int | None = None


def add_months(day: date, n: int) -> date:
    """The same day ``n`` months on, or the month's last."""
    year, month = divmod(day.year * 12 + day.month - 1 + n, 12)
    return date(year, month + 1, min(day.day, months.monthrange(year, month + 1)[1]))


def boundaries(start: date, end: date, formation: int, trading: int, step: int) -> list[date]:
    """Ends of formation windows, stepped one from the other, that leave a whole trading window."""
    out, at = [], add_months(start, formation)
    while add_months(at, trading) <= end:
        out.append(at)
        at = add_months(at, step)
    return out


def decision_dates(sessions: DataFrame, formation: int, trading: int, step: int) -> DataFrame:
    """The last session up to each boundary, without repeats. Boundaries are a few dates on the driver."""
    ends = sessions.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if ends["lo"] is None:
        raise SelectionError("there are no sessions")
    limits = boundaries(ends["lo"], ends["hi"], formation, trading, step)
    if not limits:
        raise SelectionError("the sessions hold no formation and trading window")
    of = F.array(*(F.lit(d) for d in limits))
    up_to = sessions.select("date", F.explode(F.filter(of, lambda b: b >= F.col("date"))).alias("boundary"))
    return up_to.groupBy("boundary").agg(F.max("date").alias("as_of")).select("as_of").distinct()


def liquidity_stats(symbols: DataFrame, bars: DataFrame, days: DataFrame, dates: DataFrame, lookback: int = 252) -> DataFrame:
    """Statistics of every symbol at every decision date, in one query.

    ``dates`` (as_of) and ``days`` have a row a date. A bar is counted once towards the first decision
    date that sees it, and once in each trailing window it belongs to; nothing is truncated in a loop.
    """
    calendar = numbered(days).select("date", "is_session", "session_no")
    at = dates.join(calendar, F.col("as_of") == F.col("date")).select("as_of", F.col("session_no").alias("as_of_no"))
    everyone = symbols.select("symbol").distinct()
    order = F.array_sort(F.collect_list("as_of"))
    listed = F.broadcast(dates.agg(order.alias("all")))  # one row: the decision dates

    seen = bars.filter(F.col("close").isNotNull())
    first = listed_span(bars).select("symbol", F.col("first").alias("first_obs"))
    next_date = F.array_min(F.filter("all", lambda d: d >= F.col("date")))
    latest = seen.join(listed).select("symbol", "date", "close", next_date.alias("as_of")).filter("as_of is not null")
    latest = latest.groupBy("symbol", "as_of").agg(F.max("date").alias("d"), F.max_by("close", "date").alias("p"))

    grid = everyone.join(listed).select("symbol", F.explode("all").alias("as_of"))
    so_far = Window.partitionBy("symbol").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    carried = grid.join(latest, ["symbol", "as_of"], "left").withColumns({"last_obs": F.last("d", True).over(so_far), "last_price": F.last("p", True).over(so_far)})

    reach = at.select("as_of", F.explode(F.sequence(F.greatest(F.col("as_of_no") - lookback + 1, F.lit(1)), "as_of_no")).alias("session_no"))
    windows = F.broadcast(reach.join(calendar.filter("is_session"), "session_no").select("as_of", "date"))
    traded = F.coalesce(F.col("volume"), F.lit(0.0)) > 0
    inside = seen.join(windows, "date").groupBy("symbol", "as_of").agg(F.count_if(traded).alias("n_traded_in_window"), F.median(F.when(traded, F.col("turnover"))).alias("median_turnover"))

    first_no = calendar.select(F.col("date").alias("first_obs"), (F.col("session_no") - F.col("is_session").cast("long") + 1).alias("first_no"))
    known = carried.join(first, "symbol", "left").withColumn("first_obs", F.when(F.col("first_obs") <= F.col("as_of"), F.col("first_obs")))
    known = known.join(F.broadcast(first_no), "first_obs", "left").join(F.broadcast(at), "as_of").join(inside, ["symbol", "as_of"], "left")
    in_window = F.col("as_of_no") - F.greatest(F.col("as_of_no") - lookback + 1, F.lit(1), F.col("first_no")) + 1
    known = known.withColumns({
        "n_sessions_in_window": F.when(F.col("first_obs").isNotNull(), F.greatest(in_window, F.lit(0))).otherwise(0).cast("long"),
        "n_traded_in_window": F.when(F.col("first_obs").isNotNull(), F.coalesce("n_traded_in_window", F.lit(0))).otherwise(0).cast("long"),
        "median_turnover": F.coalesce("median_turnover", F.lit(0.0)),
        "history_years": F.round(F.date_diff("as_of", "first_obs") / F.lit(365.25), 3),
    })
    return known.withColumn("missing_frac", missing_share(F.col("n_traded_in_window"), F.col("n_sessions_in_window"))).select(STATS)


def missing_share(n: Column, window: Column) -> Column:
    """1 - n / window to four decimals, rounded half up in whole numbers; 1 without a window."""
    rounded = F.floor((20_000 * (window - n) + window) / (2 * window)) / F.lit(10_000.0)
    return F.when(window > 0, rounded).otherwise(1.0)


def reasons(c: Criteria) -> Column:
    """Codes of failed criteria in a fixed order, ``;`` between them."""
    failed = F.concat_ws(
        ";",
        F.when(F.col("history_years") < F.lit(c.history_years), "short_history"),
        F.when(F.col("median_turnover") < F.lit(c.median_turnover), "illiquid"),
        F.when(F.coalesce(F.col("last_price") < F.lit(c.last_price), F.lit(True)), "low_price"),
        F.when(F.col("missing_frac") > F.lit(c.missing_frac), "poor_coverage"),
    )
    return F.when(F.col("first_obs").isNull(), "no_data").otherwise(failed)


def eligibility_schedule(symbols: DataFrame, bars: DataFrame, days: DataFrame, dates: DataFrame, criteria: Criteria) -> DataFrame:
    """Statistics, reasons and eligibility of every symbol at every decision date."""
    judged = liquidity_stats(symbols, bars, days, dates, criteria.lookback).withColumn("reasons", reasons(criteria))
    judged = judged.withColumn("eligible", F.col("reasons") == "")
    if criteria.top is None:
        return judged
    rank = F.row_number().over(Window.partitionBy("as_of", "eligible").orderBy(F.desc("median_turnover"), "symbol"))
    below = F.col("eligible") & (F.col("rank") > criteria.top)
    return judged.withColumn("rank", rank).withColumns({"reasons": F.when(below, "below_daily_rank").otherwise(F.col("reasons")), "eligible": F.col("eligible") & ~below}).drop("rank")


def ever_eligible(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("symbol").agg(F.bool_or("eligible").alias("ever")).filter("ever").select("symbol")


def latest(schedule: DataFrame) -> DataFrame:
    """The rows of the last decision date."""
    last = schedule.agg(F.max("as_of").alias("as_of"))
    return schedule.join(F.broadcast(last), "as_of")


def select(schedule: DataFrame, sectors: DataFrame | None = None, complete: DataFrame | None = None, fatal: DataFrame | None = None, *, need_eligible: bool = True, max_size: int | None = None, rank_by: str = "median_turnover") -> DataFrame:
    """Every scheduled symbol with its last statistics, sector, reasons for exclusion and membership.

    Gates in order: no sector, incomplete download, fatal quality issue, never eligible; a gate is off
    where its table is None. ``max_size`` keeps the best by ``rank_by`` among those left.
    """
    if rank_by not in RANKS:
        raise SelectionError(f"cannot rank by {rank_by}; known: {', '.join(RANKS)}")
    mark = lambda df, name: df.select("symbol").distinct().withColumn(name, F.lit(True))
    out, gates = latest(schedule), []
    if sectors is not None:
        out = out.join(sectors.filter(F.coalesce("sector", F.lit("")) != "").select("symbol", "sector"), "symbol", "left")
        gates.append(F.when(F.col("sector").isNull(), "no_sector"))
    if complete is not None:
        out = out.join(mark(complete, "complete"), "symbol", "left")
        gates.append(F.when(F.col("complete").isNull(), "incomplete_download"))
    if fatal is not None:
        out = out.join(mark(fatal, "fatal"), "symbol", "left")
        gates.append(F.when(F.col("fatal").isNotNull(), "quality_fatal"))
    if need_eligible:
        out = out.join(mark(ever_eligible(schedule), "ever"), "symbol", "left")
        gates.append(F.when(F.col("ever").isNull(), "never_eligible"))
    out = out.withColumn("excluded_for", F.concat_ws(";", *gates) if gates else F.lit(""))
    if max_size is not None:
        by = F.desc_nulls_last(rank_by) if RANKS[rank_by] else F.asc_nulls_last(rank_by)
        rank = F.row_number().over(Window.partitionBy(F.col("excluded_for") == "").orderBy(by, "symbol"))
        out = out.withColumn("rank", rank)
        out = out.withColumn("excluded_for", F.when((F.col("excluded_for") == "") & (F.col("rank") > max_size), "size_cap").otherwise(F.col("excluded_for"))).drop("rank")
    return out.drop("complete", "fatal", "ever").withColumn("member", F.col("excluded_for") == "")


def eligible_over_time(schedule: DataFrame, members: DataFrame) -> DataFrame:
    """How many members were eligible at each decision date, and their share."""
    inside = schedule.join(members.select("symbol"), "symbol", "left_semi")
    return inside.groupBy("as_of").agg(F.count_if("eligible").alias("n_eligible"), F.count("*").alias("n_members")).withColumn("share", F.try_divide("n_eligible", "n_members"))


def reason_tally(schedule: DataFrame) -> DataFrame:
    codes = schedule.filter("reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("reason"))
    return codes.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def turnover_quantiles(rows: DataFrame) -> DataFrame:
    q = F.percentile("median_turnover", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return rows.agg(q.alias("q")).select(*(F.col("q")[i].alias(n) for i, n in enumerate(("min_turnover", "q25_turnover", "median_turnover", "q75_turnover", "max_turnover"))))


def most_and_least_liquid(rows: DataFrame, n: int = 10) -> DataFrame:
    top = rows.orderBy(F.desc("median_turnover"), "symbol").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy("median_turnover", "symbol").limit(n).withColumn("side", F.lit("bottom")))


def coverage_stats(rows: DataFrame, lookback: int = 252) -> DataFrame:
    return rows.agg(
        F.median("history_years").alias("median_history"), F.min("history_years").alias("min_history"), F.max("history_years").alias("max_history"),
        F.median("missing_frac").alias("median_missing"), F.max("missing_frac").alias("worst_missing"), F.count_if(F.col("n_sessions_in_window") >= lookback).alias("n_full_window"),
    )


def singleton_sectors(members: DataFrame) -> DataFrame:
    """Sectors with one member, which form no pair."""
    return members.groupBy("sector").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).filter("n = 1").select("sector", "symbol").orderBy("sector")


def most_missing(rows: DataFrame, n: int = 8) -> DataFrame:
    """The rows with the largest missing shares."""
    return rows.select("symbol", "missing_frac").orderBy(F.desc("missing_frac"), "symbol").limit(n)


def expected_false_positives(members: DataFrame, level: float = 0.05) -> DataFrame:
    """Pairs of a sector that a test at ``level`` passes by chance."""
    from tidemark.operators.candidates import same_sector_pairs

    return same_sector_pairs(members).select("n_pairs", (F.lit(level) * F.col("n_pairs")).alias("expected"))
