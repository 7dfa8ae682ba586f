"""Report files from small collected aggregates: CSV, JSON and Markdown."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from tidemark.operators import report, universe
from tidemark.sources.store import write_json


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> str:
    """CSV files with headers in a folder; ``single`` only for tables with a row a symbol or less."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a table."""
    rows = df.limit(limit).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def quality(issues: DataFrame, metrics: DataFrame, folder: str, listed: int = 25) -> dict[str, Any]:
    """Write issues, per-symbol metrics, meta data and a summary; returns the meta data."""
    write_csv(issues, f"{folder}/issues")
    write_csv(metrics, f"{folder}/per_ticker", single=True)
    counts = {r["check"]: {k: r[k] for k in ("FATAL", "WARN", "INFO", "total")} for r in report.counts(issues).collect()}
    flags = report.flag_totals(issues).first().asDict()
    meta = {"usable": report.is_usable(issues), "counts": counts, **flags}
    write_json(meta, Path(folder) / "meta.json")
    shown = report.capped(issues, listed).orderBy("severity", "check", "rank").select("severity", "check", "symbol", "date", "detail", "n_affected", "more")
    parts = ["# Data quality", f"Verdict: {'usable' if meta['usable'] else 'NOT usable'}; {flags['n_observations']} observations flagged in {flags['n_groups']} groups.", "## By check", markdown(report.counts(issues)), "## Lowest coverage", markdown(report.lowest_coverage(metrics)), "## Issues", markdown(shown, 1000)]
    (Path(folder) / "summary.md").write_text("\n\n".join(parts), encoding="utf-8")
    return meta


def universe_report(schedule: DataFrame, selected: DataFrame, folder: str, universe_hash: str) -> dict[str, Any]:
    """Write members, exclusions and schedule, meta data and a summary; returns the meta data."""
    members = selected.filter("member")
    write_csv(members.orderBy("symbol"), f"{folder}/universe", single=True)
    write_csv(selected.filter("not member").orderBy("symbol"), f"{folder}/exclusions", single=True)
    write_csv(schedule, f"{folder}/eligibility")
    over_time = universe.eligible_over_time(schedule, members).orderBy("as_of")
    meta = {"universe_hash": universe_hash, "n_members": members.count(), "eligible": {str(r["as_of"]): r["n_eligible"] for r in over_time.collect()}}
    write_json(meta, Path(folder) / "meta.json")
    parts = ["# Universe", f"{meta['n_members']} members, hash {universe_hash}.", "## Eligible over time", markdown(over_time, 200), "## Turnover", markdown(universe.turnover_quantiles(members)), "## Most and least liquid", markdown(universe.most_and_least_liquid(members.select("symbol", "median_turnover"))), "## Coverage", markdown(universe.coverage_stats(members)), "## Most missing", markdown(universe.most_missing(members)), "## Reasons", markdown(universe.reason_tally(schedule))]
    if "sector" in members.columns:
        parts += ["## Sectors with one member", markdown(universe.singleton_sectors(members))]
    (Path(folder) / "summary.md").write_text("\n\n".join(parts), encoding="utf-8")
    return meta
