"""Configuration as a table of keys: each section is closed, each value has a rule, rules between keys follow.

``load`` reads one YAML file a section from a folder. Unknown and missing keys are errors; keys that
start with ``_`` are notes. Values that would let a decision see later data are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from datetime import date
from functools import lru_cache
from pathlib import Path
from types import SimpleNamespace
from typing import Any

import yaml

#: Set to 1 to demonstrate, on purpose, execution and z-scores that look ahead.
DEMO_ENV = "TIDEMARK_ALLOW_LOOKAHEAD"


class ConfigError(ValueError):
    """A configuration that is refused."""


class Section(SimpleNamespace):
    """Values of a section, as attributes."""

    def __setattr__(self, name: str, value: Any) -> None:
        raise ConfigError(f"{name}: configuration does not change after loading")


class Rule:
    """What a value must be: ``read`` brings it to its type, ``holds`` tells whether it is allowed."""

    def __init__(self, says: str, read: Callable[[Any], Any] = lambda x: x, holds: Callable[[Any], bool] = lambda x: True, *, none: bool = False) -> None:
        self.says, self.read, self.holds, self.none = says, read, holds, none

    def __call__(self, value: Any, where: str) -> Any:
        if value is None:
            if self.none:
                return None
            raise ConfigError(f"{where}: {self.says}, not null")
        try:
            out = self.read(value)
        except (TypeError, ValueError):
            out = None
        if out is None or not self.holds(out):
            raise ConfigError(f"{where}: {self.says}, got {value!r}")
        return out


def _exact(kind: type) -> Callable[[Any], Any]:
    def read(x: Any) -> Any:
        if isinstance(x, bool) != (kind is bool) or (kind is int and not isinstance(x, int)) or not isinstance(x, kind | int):
            raise TypeError
        return kind(x)

    return read


def number(lo: float | None = None, hi: float | None = None, *, above: bool = False, below: bool = False, whole: bool = False, none: bool = False) -> Rule:
    """A number from lo to hi; ``above`` and ``below`` leave the ends out."""

    def holds(x: float) -> bool:
        return (lo is None or (x > lo if above else x >= lo)) and (hi is None or (x < hi if below else x <= hi))

    range_ = f"{'above' if above else 'at least'} {lo}" * (lo is not None) + " and " * (lo is not None and hi is not None) + f"{'below' if below else 'at most'} {hi}" * (hi is not None)
    return Rule(f"must be a {'whole ' * whole}number {range_}".strip(), _exact(int) if whole else _exact(float), holds, none=none)


def one_of(*allowed: Any, none: bool = False, upper: bool = False) -> Rule:
    return Rule(f"must be one of {', '.join(map(str, allowed))}", lambda x: x, lambda x: (x.upper() if upper and isinstance(x, str) else x) in allowed, none=none)


def text(*, none: bool = False) -> Rule:
    return Rule("must be a text", lambda x: x if isinstance(x, str) else None, none=none)


def day(*, none: bool = False) -> Rule:
    return Rule("must be a date YYYY-MM-DD", lambda x: x if isinstance(x, date) else date.fromisoformat(str(x)), none=none)


def each(rule: Rule, *, empty: bool = False) -> Rule:
    return Rule(f"must be a list, each of which {rule.says}", lambda x: tuple(rule(v, "item") for v in (x or ())), lambda x: empty or bool(x), none=False)


def mapping(key: type = str, value: Rule | None = None) -> Rule:
    return Rule("must be a mapping", lambda x: {key(k): value(v, str(k)) if value else v for k, v in x.items()} if isinstance(x, Mapping) else None)


flag = Rule("must be true or false", lambda x: x if isinstance(x, bool) else None)
positive, unsigned = number(0, above=True), number(0)
share, inner = number(0, 1, below=True), number(0, 1, above=True, below=True)
count = number(1, whole=True)
bps, small_bps = number(0), number(0, 100, below=True)

# The sections, their keys and what each may be.
SCHEMA: dict[str, dict[str, Any]] = {
    "base": {"project_name": text(), "seed": number(0, whole=True), "log_level": one_of("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", upper=True), "log_to_file": flag, "figure_dpi": positive, "figure_format": one_of("png", "pdf", "svg")},
    "universe": {
        "name": text(), "version": number(0, whole=True), "frozen": flag, "as_of": day(none=True), "start_date": day(), "end_date": day(), "source": one_of("yfinance", "jugaad_data"), "ticker_suffix": text(),
        "price_field": one_of("adj_close", "close"), "benchmark": text(), "vix_symbol": text(), "target_size": number(0, above=True, whole=True, none=True), "min_history_years": positive,
        "min_median_turnover_inr": number(), "max_missing_frac": share, "tickers": each(text(), empty=True), "sectors": mapping(), "smoke_test_tickers": each(text(), empty=True), "survivorship_bias": mapping(),
    },
    "costs": {
        "rates_as_of": day(none=True), "verified": flag, "segment": one_of("equity_futures", "equity_cash"), "brokerage_flat_inr": unsigned, "brokerage_bps": small_bps, "exchange_txn_bps": small_bps, "stt_sell_bps": small_bps,
        "sebi_bps": bps, "stamp_duty_buy_bps": small_bps, "gst_rate": share, "slippage_bps_per_side": mapping(int, bps), "n_liquidity_buckets": count, "scenario_bps_round_trip": each(bps),
        "short_leg": {"method": one_of("single_stock_futures", "intraday_only", "cash_with_caveat", none=True), "decided": flag, "futures_roll_cost_bps": bps, "margin_fraction": number(0, 1, above=True)},
    },
    "backtest": {
        "formation_months": number(12, whole=True), "trading_months": count, "step_months": count,
        "execution": {"signal_price": one_of("close", "open"), "fill_price": one_of("open", "close", "vwap"), "lag_bars": number(0, whole=True), "allow_same_bar_fill": flag},
        "signal": {"z_entry": positive, "z_exit": unsigned, "z_stop": positive, "time_stop_halflives": positive, "max_holding_days": positive},
        "kill_switch": {"enabled": flag, "rolling_coint_window": number(30, above=True, whole=True), "pval_threshold": inner, "consecutive_days": count},
        "screening": {
            "fdr_alpha": inner, "fdr_method": one_of("fdr_bh", "fdr_by", "bonferroni", "holm"), "raw_pval_report_level": inner, "both_directions": flag, "pval_combine": one_of("max", "min"),
            "same_sector_only": flag, "report_unrestricted": flag, "min_half_life_days": positive, "max_half_life_days": positive, "min_overlapping_obs": number(100, above=True, whole=True),
        },
        "portfolio": {"initial_capital_inr": positive, "sizing": one_of("dollar_neutral", "equal_weight"), "max_weight_per_pair": number(0, 1, above=True), "max_concurrent_pairs": count, "vol_scale": flag},
        "metrics": {"trading_days_per_year": number(200, 300, above=True, below=True, whole=True), "risk_free_annual": number(-0.1, 0.5, above=True, below=True)},
    },
    "models": {
        "kalman": {"delta": inner, "delta_grid": each(inner), "observation_noise_R": positive, "warmup_obs": number(60, whole=True), "beta_init": number(), "P_init": positive, "tune_on": one_of("formation_only"), "report_sensitivity": flag},
        "ols": {"rolling_window_days": number(20, above=True, whole=True), "zscore_halflife_multiple": positive, "zscore_min_window": count, "zscore_max_window": count, "zscore_shift": number(whole=True)},
        "labels": {"horizon_halflife_multiple": positive, "horizon_min_days": count, "horizon_max_days": count},
        "xgboost": mapping(), "lstm": mapping(),
        "filter": {"split": one_of("temporal_only"), "validation_fraction": number(0, 0.5, above=True, below=True), "threshold_grid": each(number(0, 1)), "report_base_rate_first": flag},
        "validity": {
            "null_control": {"n_runs": number(100, whole=True), "preserve_sector_structure": flag}, "deflated_sharpe": {"trials_from_config_log": one_of(True)},
            "bootstrap": {"method": one_of("stationary", "circular", "moving"), "n_boot": number(500, whole=True), "block_length": number(1, whole=True, none=True), "ci_level": number(0.5, 1, above=True, below=True)},
        },
    },
    "quality": {
        "session_quorum": number(0, 1, above=True), "phantom_date_max_tickers": count, "extreme_move_pct": inner, "severe_move_pct": positive, "corporate_action_window_days": number(0, whole=True), "max_gap_sessions": count,
        "min_coverage_over_life": number(0, 1, above=True), "max_zero_volume_run": count, "zero_volume_frac_warn": share, "max_stale_price_run": number(2, whole=True), "cross_check_n_symbols": number(0, whole=True),
        "cross_check_tolerance_pct": inner, "max_issues_listed_per_check": count,
    },
    "selection": {
        "liquidity_lookback_months": count, "min_median_turnover_inr": positive, "min_history_years": positive, "max_missing_frac": share, "min_price_inr": unsigned, "max_eligible_per_date": number(1, above=True, whole=True, none=True),
        "max_size": number(1, above=True, whole=True, none=True), "rank_by": one_of("median_turnover_inr", "history_years"), "tie_break": one_of("symbol"), "require_sector": flag, "require_complete_download": flag,
        "exclude_quality_fatal": flag, "require_ever_eligible": flag, "decision_dates_from": one_of("backtest_schedule"),
    },
}

#: Keys that a section may leave out: thresholds that have a default here alone.
OPTIONAL: dict[str, dict[str, tuple[Rule, Any]]] = {
    "quality": {"padding_frac": (number(0, 1, above=True), 0.90), "market_stress_frac": (number(0, 1, above=True), 0.10), "market_stress_move": (inner, 0.05)},
}

#: (section, test, message): what must hold between keys.
BETWEEN: list[tuple[str, Callable[[Section], bool], str]] = [
    ("universe", lambda s: s.start_date < s.end_date, "start_date must come before end_date"),
    ("universe", lambda s: s.price_field != "close", "price_field close is not adjusted: a split would look like a crash; use adj_close"),
    ("universe", lambda s: not s.frozen or bool(s.tickers), "a frozen universe needs tickers"),
    ("universe", lambda s: not s.frozen or s.as_of is not None, "a frozen universe needs as_of"),
    ("universe", lambda s: not s.frozen or s.version > 0, "a frozen universe needs a version above 0"),
    ("universe", lambda s: not s.frozen or all(t in s.sectors for t in s.tickers), "every ticker of a frozen universe needs a sector"),
    ("universe", lambda s: not s.frozen or len(set(s.tickers)) == len(s.tickers), "a frozen universe names a ticker once"),
    ("costs", lambda s: set(s.slippage_bps_per_side) == set(range(1, s.n_liquidity_buckets + 1)), "slippage_bps_per_side needs the keys 1 to n_liquidity_buckets"),
    ("costs.short_leg", lambda s: not s.decided or s.method is not None, "a decided short leg needs a method"),
    ("backtest", lambda s: s.step_months >= s.trading_months, "step_months below trading_months makes trading windows overlap"),
    ("backtest.signal", lambda s: s.z_exit < s.z_entry, "z_exit must be below z_entry"),
    ("backtest.signal", lambda s: s.z_stop > s.z_entry, "z_stop must be above z_entry"),
    ("backtest.screening", lambda s: s.min_half_life_days < s.max_half_life_days, "min_half_life_days must be below max_half_life_days"),
    ("backtest.portfolio", lambda s: s.max_weight_per_pair * s.max_concurrent_pairs >= 1.0, "the pairs' weights cannot add up to the whole book"),
    ("models.ols", lambda s: s.zscore_min_window < s.zscore_max_window, "zscore_min_window must be below zscore_max_window"),
    ("models.labels", lambda s: s.horizon_min_days < s.horizon_max_days, "horizon_min_days must be below horizon_max_days"),
    ("models", lambda s: s.xgboost.get("max_depth") is not None and 1 <= int(s.xgboost["max_depth"]) <= 6, "xgboost.max_depth must be 1 to 6"),
    ("models", lambda s: not s.lstm.get("enabled") or s.lstm.get("normalisation") == "per_window", "lstm.normalisation must be per_window"),
    ("quality", lambda s: s.extreme_move_pct < s.severe_move_pct, "severe_move_pct must be above extreme_move_pct"),
]

#: Refusals of lookahead that DEMO_ENV lifts.
GUARDS: list[tuple[str, Callable[[Section], bool], str]] = [
    ("backtest.execution", lambda s: s.lag_bars >= 1 and not s.allow_same_bar_fill, "LOOKAHEAD: a signal on the close of a bar is filled on the next bar at the earliest"),
    ("models.ols", lambda s: s.zscore_shift >= 1, "LOOKAHEAD: zscore_shift must be 1 or more, the window ends before the bar that it scales"),
]


def _build(schema: Mapping[str, Any], optional: Mapping[str, tuple[Rule, Any]], data: Any, where: str) -> Section:
    if not isinstance(data, Mapping) or not data:
        raise ConfigError(f"{where}: must be a mapping that is not empty")
    given = {k: v for k, v in data.items() if not str(k).startswith("_")}
    if unknown := sorted(set(given) - set(schema) - set(optional)):
        raise ConfigError(f"{where}: unknown keys {unknown}; known: {sorted(schema)}")
    if absent := sorted(set(schema) - set(given)):
        raise ConfigError(f"{where}: missing keys {absent}")
    out = {k: _build(rule, {}, given[k], f"{where}.{k}") if isinstance(rule, dict) else rule(given[k], f"{where}.{k}") for k, rule in schema.items()}
    return Section(**out, **{k: rule(given.get(k, default), f"{where}.{k}") for k, (rule, default) in optional.items()})


def demo_allowed() -> bool:
    return os.environ.get(DEMO_ENV, "").strip().lower() in {"1", "true", "yes"}


def _plain(x: Any) -> Any:
    if isinstance(x, SimpleNamespace):
        return {k: _plain(v) for k, v in vars(x).items()}
    if isinstance(x, Mapping):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x.isoformat() if isinstance(x, date) else x


def digest(value: Any) -> str:
    """Twelve hex digits of the SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


class Config:
    """All sections, checked; ``hash`` names the parameters of a run."""

    def __init__(self, sections: Mapping[str, Any], source: Path | None = None) -> None:
        self.source = source
        for name, schema in SCHEMA.items():
            setattr(self, name, _build(schema, OPTIONAL.get(name, {}), sections.get(name), name))
        for where, test, message in BETWEEN + ([] if demo_allowed() else GUARDS):
            section: Any = self
            for part in where.split("."):
                section = getattr(section, part)
            if not test(section):
                raise ConfigError(f"{where}: {message}")

    def plain(self) -> dict[str, Any]:
        return {name: _plain(getattr(self, name)) for name in SCHEMA}

    @property
    def hash(self) -> str:
        return digest(self.plain())

    @property
    def ticker_list_hash(self) -> str:
        """Digest of the tickers alone; ``identity.universe_hash`` covers their sectors too."""
        return digest(sorted(self.universe.tickers))

    def n_windows(self, total_months: int) -> int:
        """Walk-forward windows that fit into a number of months."""
        b = self.backtest
        return max(0, (total_months - b.formation_months - b.trading_months) // b.step_months + 1)

    def lookback_sessions(self, days_per_year: int = 252) -> int:
        return round(self.selection.liquidity_lookback_months / 12 * days_per_year)

    @property
    def process_noise(self) -> float:
        """State noise of the Kalman filter."""
        return self.models.kalman.delta / (1 - self.models.kalman.delta)

    @property
    def n_pairs(self) -> int:
        n = len(self.universe.tickers)
        return n * (n - 1) // 2

    def __str__(self) -> str:
        u, b = self.universe, self.backtest
        return f"config {self.hash}: universe {u.name} v{u.version}, {len(u.tickers)} tickers, windows {b.formation_months}/{b.trading_months}/{b.step_months} months, seed {self.base.seed}"


def load(folder: str | Path) -> Config:
    """The configuration of a folder with one ``<section>.yaml`` a section."""
    folder = Path(folder)
    if not folder.is_dir():
        raise ConfigError(f"no such folder: {folder}")
    sections = {}
    for name in SCHEMA:
        path = folder / f"{name}.yaml"
        if not path.is_file():
            raise ConfigError(f"missing file: {path}")
        try:
            sections[name] = yaml.safe_load(path.read_text(encoding="utf-8"))
        except yaml.YAMLError as error:
            raise ConfigError(f"{path.name}: not YAML: {error}") from error
    return Config(sections, folder)


@lru_cache
def cached(folder: str) -> Config:
    return load(folder)
