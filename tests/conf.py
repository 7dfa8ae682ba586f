"""A valid configuration for tests, to be changed one key at a time."""

import copy

BASE = {
    "base": {"project_name": "test", "seed": 20260823, "log_level": "INFO", "log_to_file": True, "figure_dpi": 150, "figure_format": "png"},
    "universe": {
        "name": "u", "version": 1, "frozen": True, "as_of": "2026-08-26", "start_date": "2015-01-01", "end_date": "2026-07-31", "source": "yfinance", "ticker_suffix": ".NS", "price_field": "adj_close", "benchmark": "^X", "vix_symbol": "^V",
        "target_size": None, "min_history_years": 3.0, "min_median_turnover_inr": 2.5e8, "max_missing_frac": 0.02, "tickers": ["A.NS", "B.NS", "C.NS"], "sectors": {"A.NS": "x", "B.NS": "x", "C.NS": "y"}, "smoke_test_tickers": ["A.NS"], "survivorship_bias": {"present": True},
    },
    "costs": {
        "rates_as_of": None, "verified": False, "segment": "equity_futures", "brokerage_flat_inr": 20.0, "brokerage_bps": 3.0, "exchange_txn_bps": 0.19, "stt_sell_bps": 2.0, "sebi_bps": 0.01, "stamp_duty_buy_bps": 0.2, "gst_rate": 0.18,
        "slippage_bps_per_side": {1: 2.0, 2: 4.0, 3: 7.0, 4: 10.0}, "n_liquidity_buckets": 4, "scenario_bps_round_trip": [0, 10, 20, 40], "short_leg": {"method": None, "decided": False, "futures_roll_cost_bps": 5.0, "margin_fraction": 0.2},
    },
    "backtest": {
        "formation_months": 36, "trading_months": 6, "step_months": 6, "execution": {"signal_price": "close", "fill_price": "open", "lag_bars": 1, "allow_same_bar_fill": False},
        "signal": {"z_entry": 2.0, "z_exit": 0.5, "z_stop": 3.5, "time_stop_halflives": 3.0, "max_holding_days": 126}, "kill_switch": {"enabled": True, "rolling_coint_window": 252, "pval_threshold": 0.1, "consecutive_days": 20},
        "screening": {"fdr_alpha": 0.1, "fdr_method": "fdr_bh", "raw_pval_report_level": 0.05, "both_directions": True, "pval_combine": "max", "same_sector_only": True, "report_unrestricted": True, "min_half_life_days": 5, "max_half_life_days": 60, "min_overlapping_obs": 500},
        "portfolio": {"initial_capital_inr": 1e7, "sizing": "dollar_neutral", "max_weight_per_pair": 0.1, "max_concurrent_pairs": 20, "vol_scale": False}, "metrics": {"trading_days_per_year": 252, "risk_free_annual": 0.0},
    },
    "models": {
        "kalman": {"delta": 1e-4, "delta_grid": [1e-6, 1e-4], "observation_noise_R": 1e-3, "warmup_obs": 100, "beta_init": 0.0, "P_init": 1.0, "tune_on": "formation_only", "report_sensitivity": True},
        "ols": {"rolling_window_days": 252, "zscore_halflife_multiple": 1.5, "zscore_min_window": 20, "zscore_max_window": 120, "zscore_shift": 1}, "labels": {"horizon_halflife_multiple": 2.0, "horizon_min_days": 5, "horizon_max_days": 120},
        "xgboost": {"max_depth": 3}, "lstm": {"enabled": False}, "filter": {"split": "temporal_only", "validation_fraction": 0.25, "threshold_grid": [0.0, 0.5], "report_base_rate_first": True},
        "validity": {"null_control": {"n_runs": 500, "preserve_sector_structure": False}, "deflated_sharpe": {"trials_from_config_log": True}, "bootstrap": {"method": "stationary", "n_boot": 2000, "block_length": None, "ci_level": 0.95}},
    },
    "quality": {
        "session_quorum": 0.5, "phantom_date_max_tickers": 5, "extreme_move_pct": 0.2, "severe_move_pct": 0.5, "corporate_action_window_days": 3, "max_gap_sessions": 5, "min_coverage_over_life": 0.95, "max_zero_volume_run": 3,
        "zero_volume_frac_warn": 0.02, "max_stale_price_run": 5, "cross_check_n_symbols": 5, "cross_check_tolerance_pct": 0.02, "max_issues_listed_per_check": 25,
    },
    "selection": {
        "liquidity_lookback_months": 12, "min_median_turnover_inr": 2.5e8, "min_history_years": 3.0, "max_missing_frac": 0.02, "min_price_inr": 20.0, "max_eligible_per_date": None, "max_size": None, "rank_by": "median_turnover_inr",
        "tie_break": "symbol", "require_sector": True, "require_complete_download": True, "exclude_quality_fatal": True, "require_ever_eligible": True, "decision_dates_from": "backtest_schedule",
    },
}


def changed(path=None, value=None):
    out = copy.deepcopy(BASE)
    if path:
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at[p]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return out
