"""The flows end to end: a quality report, and a frozen universe, from raw bars and a configuration."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import identity
from tidemark.config import Config
from tidemark.operators import calendar as cal
from tidemark.operators import clean, panel_checks, report, universe
from tidemark.operators import ticker_checks as tick
from tidemark.sources import reports
from tidemark.sources.stage import materialize


@dataclass(frozen=True)
class Quality:
    """Everything a quality run found; the frames are staged tables or lazy over them."""

    issues: DataFrame
    metrics: DataFrame
    days: DataFrame

    @property
    def usable(self) -> bool:
        return report.is_usable(self.issues)


def panel_of(raw: DataFrame, config: Config, min_rows: int = clean.MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Adjusted bars and their calendar, staged."""
    q = config.quality
    bars = materialize(clean.build_panel(raw, min_rows=min_rows, start=str(config.universe.start_date), end=str(config.universe.end_date)), "bars")
    return bars, materialize(cal.participation(bars, quorum=q.session_quorum, padding=q.padding_frac), "days")


def check_quality(raw: DataFrame, bars: DataFrame, days: DataFrame, config: Config, *, requested: DataFrame | None = None, members: DataFrame | None = None, manifest: DataFrame | None = None) -> Quality:
    """Calendar, market stress, checks of each symbol's raw bars, checks of the panel: one table of issues."""
    q = config.quality
    stress = cal.market_stress(bars, q.market_stress_move)
    tickers = tick.check_tickers(
        raw, stress, requested, zero_share=q.zero_volume_frac_warn, zero_run=q.max_zero_volume_run, stale_run=q.max_stale_price_run, move=q.extreme_move_pct,
        severe=q.severe_move_pct, action_window=q.corporate_action_window_days, wide=q.market_stress_frac,
    )
    panel = panel_checks.check_panel(bars, days, members, manifest, most_phantom=q.phantom_date_max_tickers, gap=q.max_gap_sessions, coverage=q.min_coverage_over_life)
    metrics = panel_checks.per_ticker(bars, days, members, q.max_gap_sessions)
    return Quality(materialize(tickers.unionByName(panel), "issues"), materialize(metrics, "metrics"), days)


def quality_report(raw: DataFrame, config: Config, folder: str, **more: Any) -> dict[str, Any]:
    """Check and write the report files; the result says whether anything is fatal."""
    bars, days = panel_of(raw, config, more.pop("min_rows", clean.MIN_ROWS))
    found = check_quality(raw, bars, days, config, **more)
    return reports.quality(found.issues, found.metrics, folder, config.quality.max_issues_listed_per_check)


def criteria_of(config: Config) -> universe.Criteria:
    s = config.selection
    return universe.Criteria(s.min_history_years, s.min_median_turnover_inr, s.min_price_inr, s.max_missing_frac, config.lookback_sessions(config.backtest.metrics.trading_days_per_year), s.max_eligible_per_date)


def build_universe(raw: DataFrame, sectors: DataFrame, config: Config, folder: str, *, complete: DataFrame | None = None, min_rows: int = clean.MIN_ROWS, dry_run: bool = False) -> identity.FrozenUniverse:
    """Decide eligibility at the walk-forward dates, apply the gates, report, and freeze the members.

    The members that the driver holds are the universe: some hundreds of symbols.
    """
    s, b = config.selection, config.backtest
    bars, days = panel_of(raw, config, min_rows)
    dates = universe.decision_dates(cal.sessions(days), b.formation_months, b.trading_months, b.step_months)
    schedule = materialize(universe.eligibility_schedule(sectors, bars, days, dates, criteria_of(config)), "schedule")
    fatal = None
    if s.exclude_quality_fatal:
        fatal = report.of_severity(check_quality(raw, bars, days, config).issues, tick.FATAL).filter("symbol is not null").select("symbol")
    rank = "median_turnover" if s.rank_by == "median_turnover_inr" else s.rank_by
    selected = universe.select(schedule, sectors if s.require_sector else None, complete if s.require_complete_download else None, fatal, need_eligible=s.require_ever_eligible, max_size=s.max_size, rank_by=rank)
    if "sector" not in selected.columns:
        selected = selected.join(sectors.select("symbol", "sector"), "symbol", "left")
    selected = materialize(selected, "selected")
    members = {r["symbol"]: r["sector"] for r in selected.filter("member").select("symbol", F.coalesce("sector", F.lit("")).alias("sector")).collect()}
    path = Path(folder) / "universe.yaml"
    last = schedule.agg(F.max("as_of")).first()[0]
    frozen = identity.FrozenUniverse(config.universe.name, identity.next_version(list(members), members, path), str(last), tuple(sorted(members)), members, vars(criteria_of(config)))
    reports.universe_report(schedule, selected, folder, frozen.hash)
    if not dry_run:
        identity.write(frozen, path)
    return frozen
