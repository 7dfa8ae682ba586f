import io
import json
import logging
import random
import urllib.error

import numpy as np
import pytest
import yaml
from conf import changed
from pyspark.sql import functions as F

from tidemark import config, identity, provenance, seeds
from tidemark.sources import store


# --- configuration -------------------------------------------------------------------------------


def test_loads_from_files_and_hashes(tmp_path):
    for name, section in changed().items():
        (tmp_path / f"{name}.yaml").write_text(yaml.safe_dump(section))
    c = config.load(tmp_path)
    assert c.hash == config.Config(changed()).hash and len(c.hash) == 12
    assert c.hash != config.Config(changed("base.seed", 1)).hash
    assert (c.n_windows(139), c.n_windows(42), c.n_windows(41), c.lookback_sessions(), c.n_pairs) == (17, 1, 0, 252, 3)
    assert c.process_noise == pytest.approx(1e-4 / (1 - 1e-4))
    assert c.ticker_list_hash != identity.universe_hash(c.universe.tickers, c.universe.sectors)
    assert c.quality.padding_frac == 0.90 and "config" in str(c)
    assert config.cached(str(tmp_path)) is config.cached(str(tmp_path))
    (tmp_path / "costs.yaml").unlink()
    with pytest.raises(config.ConfigError, match="missing file"):
        config.load(tmp_path)


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("base.seed", -1), ("base.seed", 1.5), ("base.log_level", "LOUD"), ("base.figure_dpi", 0), ("base.figure_format", "gif"), ("base.typo", 1), ("base.seed", ...), ("universe.start_date", "2030-01-01"), ("universe.start_date", "soon"),
        ("universe.price_field", "close"), ("universe.source", "web"), ("universe.tickers", []), ("universe.as_of", None), ("universe.version", 0), ("universe.tickers", ["A.NS", "Z.NS"]), ("universe.tickers", ["A.NS", "A.NS"]),
        ("universe.max_missing_frac", 1.0), ("universe.target_size", 0), ("costs.stt_sell_bps", 100), ("costs.gst_rate", 1.0), ("costs.slippage_bps_per_side", {1: 1.0}), ("costs.slippage_bps_per_side", {1: 1, 2: 1, 3: 1, 4: -1}),
        ("costs.scenario_bps_round_trip", []), ("costs.short_leg.decided", True), ("costs.short_leg.method", "hope"), ("costs.short_leg.margin_fraction", 0), ("backtest.formation_months", 11), ("backtest.step_months", 5),
        ("backtest.execution.lag_bars", 0), ("backtest.execution.allow_same_bar_fill", True), ("backtest.execution.fill_price", "high"), ("backtest.signal.z_exit", 2.0), ("backtest.signal.z_stop", 2.0), ("backtest.kill_switch.rolling_coint_window", 30),
        ("backtest.screening.fdr_method", "none"), ("backtest.screening.min_half_life_days", 60), ("backtest.screening.min_overlapping_obs", 100), ("backtest.portfolio.max_weight_per_pair", 0.01), ("backtest.metrics.trading_days_per_year", 365),
        ("models.kalman.delta", 1.0), ("models.kalman.warmup_obs", 59), ("models.kalman.tune_on", "everything"), ("models.kalman.delta_grid", []), ("models.ols.zscore_shift", 0), ("models.ols.zscore_max_window", 20), ("models.labels.horizon_min_days", 120),
        ("models.filter.split", "random"), ("models.filter.validation_fraction", 0.5), ("models.filter.threshold_grid", [1.5]), ("models.xgboost", {"max_depth": 7}), ("models.xgboost", {}), ("models.lstm", {"enabled": True}),
        ("models.validity.null_control.n_runs", 99), ("models.validity.deflated_sharpe.trials_from_config_log", False), ("models.validity.bootstrap.n_boot", 499), ("models.validity.bootstrap.method", "iid"), ("models.validity.bootstrap.ci_level", 0.5),
        ("quality.session_quorum", 0), ("quality.severe_move_pct", 0.2), ("quality.max_stale_price_run", 1), ("quality.max_gap_sessions", 0), ("selection.rank_by", "luck"), ("selection.tie_break", "random"), ("selection.max_size", 1),
        ("selection.decision_dates_from", "hand"), ("selection.liquidity_lookback_months", 0),
    ],
)
def test_refusals(path, value):
    with pytest.raises(config.ConfigError, match=path.split(".")[0]):
        config.Config(changed(path, value))


def test_notes_demo_and_immutability(monkeypatch):
    assert config.Config(changed("base._note", "free text")).base.seed == 20260823
    monkeypatch.setenv(config.DEMO_ENV, "1")
    c = config.Config(changed("backtest.execution.lag_bars", 0))
    with pytest.raises(config.ConfigError):
        config.Config(changed("models.filter.split", "random"))
    with pytest.raises(config.ConfigError):
        c.base.seed = 3
    with pytest.raises(config.ConfigError):
        config.Config({})


# --- identity ------------------------------------------------------------------------------------


def test_universe_identity(tmp_path):
    sectors = {"B": "x", "A": "y", "C": "x"}
    assert identity.universe_hash(["B", "A", "C"], sectors) == identity.universe_hash(["C", "A", "B"], dict(sorted(sectors.items())))
    assert identity.universe_hash(["A"], {"A": "x"}) != identity.universe_hash(["A"], {"A": "y"}) != identity.universe_hash(["A"])
    path = tmp_path / "universe.yaml"
    assert identity.next_version(["A"], sectors, path) == 1
    u = identity.FrozenUniverse("u", 1, "2020-01-01", ("B", "A", "C"), sectors)
    identity.write(u, path)
    assert (u.pairs(), u.pairs(within_sectors=True), u.by_sector) == (3, 1, {"x": ["B", "C"], "y": ["A"]})
    assert identity.next_version(["C", "B", "A"], sectors, path) == 1
    assert identity.next_version(["A", "B"], {k: sectors[k] for k in "AB"}, path) == 2
    assert u.hash in path.read_text()
    for bad in (("A", "Z"), ("A", "A")):
        with pytest.raises(identity.FreezeError):
            identity.render(identity.FrozenUniverse("u", 1, "", bad, sectors))


# --- seeds and provenance ------------------------------------------------------------------------


def test_streams():
    a = seeds.stream(7, "boot", pair="x", window=3).random(4)
    assert (a == seeds.stream(7, "boot", window=3, pair="x").random(4)).all()
    assert not (a == seeds.stream(7, "boot", pair="x", window=4).random(4)).any()
    assert not (a == seeds.stream(8, "boot", pair="x", window=3).random(4)).any()
    for bad in (-1, 1.5, "x", True):
        with pytest.raises(ValueError):
            seeds.stream(bad, "x")
    assert seeds.fingerprints(7, ["a", "b"]) == seeds.fingerprints(7, ["b", "a"]) and len(set(seeds.fingerprints(7, "abc").values())) == 3
    assert "numpy.random" in seeds.seed_globally(1)
    before = np.random.get_state()[1].copy()
    with seeds.seeded(99):
        first = np.random.rand(), random.random()
    assert (np.random.get_state()[1] == before).all()
    with pytest.raises(KeyError), seeds.seeded(99):
        assert (np.random.rand(), random.random()) == first
        raise KeyError
    assert (np.random.get_state()[1] == before).all()


def test_uniform_column_does_not_depend_on_partitions(spark):
    draw = lambda n, label="a": {r.id: r.u for r in spark.range(0, 500, 1, n).select("id", seeds.uniform(7, label, F.col("id")).alias("u")).collect()}
    assert draw(1) == draw(7) != draw(1, "b")
    assert all(0 <= u < 1 for u in draw(2).values()) and 0.4 < np.mean(list(draw(2).values())) < 0.6


def test_provenance(spark, tmp_path, monkeypatch):
    document = provenance.describe(spark, config.Config(changed()))
    data = json.loads(provenance.keep(document, tmp_path / "run.json").read_text())
    assert data["run"].endswith(data["configuration"]["hash"]) and data["packages"]["pyspark"]
    assert data["session"]["settings"]["spark.sql.session.timeZone"] == "UTC" and data["session"]["master"] == "local[4]"
    monkeypatch.setenv(provenance.FOLDERS["root"], str(tmp_path))  # no repository there
    assert "error" in provenance.describe()["code"]
    assert provenance.folder("data") == tmp_path / "data"
    monkeypatch.setenv(provenance.FOLDERS["data"], str(tmp_path))
    assert provenance.folder("data") == tmp_path
    log = provenance.log_to("t", file=tmp_path / "t.log")
    assert provenance.log_to("t", file=tmp_path / "t.log") is log and len(log.handlers) == 2
    log.warning("here")
    assert "here" in (tmp_path / "t.log").read_text()
    logging.getLogger("t").handlers.clear()
    assert all(ok for _, ok, _ in provenance.health())
    assert [r for r in provenance.health(changed()) if not r[1]] == [("costs.short_leg", False, "not decided")]


# --- manifest and acquisition --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("record", "expected"),
    [
        ({}, True), ({"status": "failed"}, False), ({"rows": 0}, False), ({"last_date": None}, False), ({"last_date": "2020-12-20"}, False), ({"last_date": "2020-12-25"}, True), ({"requested_start": "2020-02-01"}, False),
        ({"requested_end": "2020-12-31", "last_date": "2020-03-01", "requested_start": "2020-01-15"}, True),
    ],
)
def test_covers(spark, tmp_path, record, expected):
    base = {"symbol": "A", "status": "ok", "rows": 10, "last_date": "2020-12-30", "requested_start": "2020-01-01", "requested_end": "2020-06-30"}
    m = store.Manifest(tmp_path / "m.json", records={"A": store.Record(**base | record)})
    assert m.pending(spark, ["A"], "2020-01-15", "2020-12-31") == ([] if expected else ["A"])


def test_manifest_round_trip(spark, tmp_path):
    m = store.Manifest.load(tmp_path / "m.json", "test")
    m.success("B", 10, "2020-01-01", "2020-12-31", "2020-01-01", "2020-12-31")
    m.success("A", 0, None, None, "2020-01-01", "2020-12-31")
    m.failure("C", "x" * 900, "2020-01-01", "2020-12-31", 4)
    m.save()
    back = store.Manifest.load(tmp_path / "m.json")
    assert list(back.records) == ["A", "B", "C"] and len(back.records["C"].error) == 500
    assert [back.with_status(s) for s in ("completed", "empty", "failed")] == [["B"], ["A"], ["C"]]
    assert back.pending(spark, ["C", "B", "A", "D"], "2020-01-01", "2020-12-31") == ["C", "A", "D"]
    assert back.summary() == {"total": 3, "rows": 10, "ok": 1, "empty": 1, "failed": 1}


def test_json_is_replaced_whole(tmp_path):
    store.write_json({"a": 1}, tmp_path / "x.json")
    with pytest.raises(TypeError):
        store.write_json({(1, 2): object()}, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1


def test_retry_and_rate():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise store.RetryableError("later")
        return "done"

    assert store.persist(flaky, [1.0, 2.0, 3.0], sleep=waits.append) == ("done", 3) and waits == [1.0, 2.0]
    drawn = list(store.pauses(4, base=1, growth=10, longest=5))
    assert len(drawn) == 4 and all(0 <= w <= limit for w, limit in zip(drawn, (1, 5, 5, 5), strict=True))
    with pytest.raises(store.SourceError, match="after 2"):
        store.persist(lambda: 1 / 0, [0.0], sleep=waits.append)
    with pytest.raises(PermissionError):
        store.persist(lambda: store.answer(403, b""), final=(PermissionError,), sleep=waits.append)
    for status, body, error in ((429, b"x", store.RetryableError), (404, b"x", store.SourceError), (200, b"", store.SourceError)):
        with pytest.raises(error):
            store.answer(status, body)
    now = [0.0]
    pace = store.Pace(0.3, 0.0, lambda: now[0])
    assert [pace.reserve() for _ in range(3)] == pytest.approx([0.0, 0.3, 0.6])
    now[0] = 5.0
    assert pace.reserve() == 0.0


def test_get_maps_what_the_server_says():
    def opener(reply):
        def open_(request, timeout):
            assert request.get_header("X-a") == "b"
            if isinstance(reply, Exception):
                raise reply
            return reply

        return open_

    class Reply(io.BytesIO):
        status = 200

    said = lambda code: urllib.error.HTTPError("http://x", code, "", {}, None)
    get = lambda reply: store.get("http://x/", headers={"X-a": "b"}, opener=opener(reply))
    assert get(Reply(b"body")) == b"body"
    for reply, error in ((Reply(b""), store.SourceError), (said(503), store.RetryableError), (said(401), PermissionError), (said(404), store.SourceError), (urllib.error.URLError("down"), store.RetryableError)):
        with pytest.raises(error):
            get(reply)


def test_acquire_resumes_and_isolates_failures(spark, tmp_path):
    asked = []

    def fetch(symbol, start, end):
        asked.append(symbol)
        if symbol == "BAD":
            raise store.RetryableError("down")
        if symbol == "ODD":
            return spark.range(1)
        rows = [] if symbol == "NONE" else [(symbol, "2020-01-01"), (symbol, "2020-12-30")]
        return spark.createDataFrame(rows, "symbol string, date string").selectExpr("symbol", "cast(date as date) as date")

    m = store.Manifest.load(tmp_path / "m.json")
    run = lambda **more: store.acquire(spark, ["A", "BAD", "A", "NONE", "ODD", "B"], fetch, str(tmp_path / "raw"), m, "2020-01-01", "2020-12-31", waits=lambda: [0.0], sleep=lambda s: None, **more)
    out = run()
    assert out["ok"] == ["A", "B"] and out["failed"] == ["BAD", "NONE", "ODD"] and out["short"] == ["A", "B"]
    assert asked == ["A", "BAD", "BAD", "NONE", "ODD", "B"] and [m.records[s].attempts for s in ("NONE", "BAD", "ODD")] == [1, 2, 1]
    assert len(m.records["A"].digest) == 16 and m.records["A"].digest != m.records["B"].digest and not (tmp_path / "raw" / "NONE").exists()
    asked.clear()
    assert run()["skipped"] == ["A", "B"] and asked == ["BAD", "BAD", "NONE", "ODD"]
    assert [s for s, _ in store.iter_raw(spark, str(tmp_path / "raw"), m)] == ["A", "B"]
    assert run(refresh=True)["skipped"] == []
