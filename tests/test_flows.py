import json
from datetime import date, timedelta

from conf import changed

from tidemark import flows, identity
from tidemark.config import Config


def test_quality_report_and_universe(spark, tmp_path):
    start = date(2018, 1, 1)
    rows = []
    for s in range(5):
        for i in range(0, 900):
            close = 100.0 + s + i * 0.05 * (-1 if s == 3 and i == 400 else 1)
            rows.append((f"S{s}", i, start + timedelta(days=i), close, close * 1.01, close * 0.99, close, close * 0.9, 0.0 if s == 4 else 5e6, 0.0, 0.0))
    rows[10] = (*rows[10][:6], -1.0, *rows[10][7:])  # a fatal price of S0
    raw = spark.createDataFrame(rows, "symbol string, ingest_seq long, date date, open double, high double, low double, close double, adj_close double, volume double, dividends double, splits double")
    plain = changed("backtest.formation_months", 12)
    plain["selection"] |= {"min_history_years": 0.5, "max_missing_frac": 0.1}
    config = Config(plain)
    sectors = spark.createDataFrame([(f"S{i}", "x" if i < 3 else "y") for i in range(5)], "symbol string, sector string")

    meta = flows.quality_report(raw, config, str(tmp_path / "quality"))
    assert not meta["usable"] and meta["counts"]["invalid_prices"]["FATAL"] >= 1 and meta["counts"]["zero_volume"]["WARN"] >= 900

    frozen = flows.build_universe(raw, sectors, config, str(tmp_path / "universe"))
    assert frozen.symbols == ("S1", "S2", "S3") and frozen.version == 1 and frozen.pairs(within_sectors=True) == 1
    assert "S3" in (summary := (tmp_path / "universe" / "summary.md").read_text()).split("one member")[1] and "Most missing" in summary
    assert identity.read(tmp_path / "universe" / "universe.yaml")["sectors"] == {"S1": "x", "S2": "x", "S3": "y"}
    assert json.loads((tmp_path / "universe" / "meta.json").read_text())["universe_hash"] == frozen.hash
    again = flows.build_universe(raw, sectors, config, str(tmp_path / "universe"), dry_run=True)
    assert (again.hash, again.version) == (frozen.hash, 1)
