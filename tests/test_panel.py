from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import candidates, causality, clean, features, manifest, panel_checks, report, universe
from tidemark.operators import ticker_checks as tick
from tidemark.operators.runs import runs

RAW = "symbol string, ingest_seq long, date date, open double, high double, low double, close double, adj_close double, volume double, dividends double, splits double"
START = date(2018, 1, 1)


def day(i):
    return START + timedelta(days=i)


def clean_rows(symbol="A", n=60, start=0, close=lambda i: 100.0 + i * 0.1):
    return [[symbol, i, day(start + i), close(i) * 0.99, close(i) * 1.02, close(i) * 0.97, close(i), close(i) * 0.9, 1e6, 0.0, 0.0] for i in range(n)]


def raw(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def issues(df):
    return sorted((r.check, r.severity, r.detail, r.n_affected) for r in df.collect())


CALM = "date date, stress double"


# --- cleaning ------------------------------------------------------------------------------------


def test_adjustment_uses_one_factor_and_unadjusted_turnover(spark):
    row = clean.adjust(raw(spark, clean_rows(n=1))).first()
    assert (row.adj_factor, row.close, row.turnover) == (pytest.approx(0.9), 90.0, 100.0 * 1e6)
    assert (row.open, row.high, row.low) == (pytest.approx(99 * 0.9), pytest.approx(102 * 0.9), pytest.approx(97 * 0.9))


def test_last_arrival_wins(spark):
    rows = clean_rows(n=3)
    again = list(rows[1])
    again[1], again[6], again[7] = 99, 500.0, 500.0
    got = {r.date: r.close for r in clean.keep_last(raw(spark, [again, *rows])).collect()}
    assert got[day(1)] == 500.0 and len(got) == 3


def test_unusable_and_implausible(spark):
    rows = clean_rows("A", 3) + clean_rows("B", 3) + clean_rows("C", 3) + clean_rows("D", 2)
    rows[0][6] = 0.0
    rows[1][6] = float("nan")
    rows[4][7] = rows[4][6] * 0.01
    rows[7][7] = rows[7][6] * 1.5
    df = raw(spark, rows)
    assert sorted(r.symbol for r in clean.adjust(df).select("symbol").distinct().collect()) == ["A", "D"]
    asked = spark.createDataFrame([(s,) for s in "ABCDZ"], "symbol string")
    got = {r.symbol: r.reason for r in clean.drop_ledger(asked, clean.missing_to_null(df, ["close"]), min_rows=3).collect()}
    assert got == {"A": "only 1 rows (< 3)", "B": "implausible adjustment factor", "C": "implausible adjustment factor", "D": "only 2 rows (< 3)", "Z": "no raw file"}
    with pytest.raises(clean.CleanError, match="volume"):
        clean.adjust(df.drop("volume"))


def test_panel_keeps_holes_and_slices_inclusively(spark):
    rows = clean_rows("A", 10) + [r for i, r in enumerate(clean_rows("B", 10)) if i != 4]
    panel = clean.build_panel(raw(spark, rows), min_rows=9, start=str(day(2)), end=str(day(6)))
    wide = {r.date: (r.A, r.B) for r in clean.wide(panel, "close", ["A", "B"]).collect()}
    assert sorted(wide) == [day(i) for i in range(2, 7)] and wide[day(4)][1] is None
    assert clean.build_panel(raw(spark, rows), min_rows=10).select("symbol").distinct().count() == 1
    summary = clean.panel_summary(panel).first()
    assert (summary.n_symbols, summary.n_dates, summary.n_bars) == (2, 5, 9)
    assert clean.cell_coverage(panel).first().coverage == 0.9
    assert clean.incoherent(panel).agg(F.sum("n_incoherent")).first()[0] == 0


def test_wall_clock_dates(spark):
    df = spark.sql("select timestamp'2020-01-01 18:30:00' as ts")
    assert df.select(clean.session_date(F.col("ts"), "Asia/Kolkata").alias("d")).first().d == date(2020, 1, 2)


# --- candidates ----------------------------------------------------------------------------------


def test_candidates(spark):
    listed = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string")
    sectors = spark.createDataFrame([("A", "x"), ("B", ""), ("C", None), ("E", "x"), ("D", "x")], "symbol string, sector string")
    got = candidates.candidates(listed, sectors)
    assert sorted(r.ticker for r in got.collect()) == ["A.NS", "D.NS"]
    assert sorted(r.symbol for r in candidates.unmapped(listed, sectors).collect()) == ["B", "C"]
    assert candidates.same_sector_pairs(got).first().n_pairs == 1 and candidates.pair_count(listed).first().n_pairs == 6
    assert candidates.sector_coverage(listed, sectors).first().coverage_pct == 50.0


# --- runs and calendar ---------------------------------------------------------------------------


def test_runs(spark):
    flags = [0, 1, 1, 0, 1, None, 1, 1, 1]
    df = spark.createDataFrame([("A", i, None if f is None else bool(f)) for i, f in enumerate(flags)] + [("B", 0, True)], "symbol string, no int, f boolean")
    got = sorted((r.symbol, r.start, r.end, r.length) for r in runs(df, ["symbol"], "no", "f").collect())
    assert got == [("A", 1, 2, 2), ("A", 4, 4, 1), ("A", 6, 8, 3), ("B", 0, 0, 1)]


def panel(spark, n=10, days=40, volume=lambda s, d: 1e6, absent=lambda s, d: False, close=lambda s, d: 100.0 + s + d * 0.1):
    rows = [(f"S{s}", day(d), close(s, d), volume(s, d), 5e8) for s in range(n) for d in range(days) if not absent(s, d)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume double, turnover double")


def test_calendar_pads_and_quorum(spark):
    # day 5: nobody trades; day 6: one of ten trades, which is not at most 1 - 0.90 in doubles; day 7: four trade
    trading = {5: 0, 6: 1, 7: 4}
    bars = panel(spark, volume=lambda s, d: 1e6 if s < trading.get(d, 10) else 0.0)
    days = {r.date: r for r in cal.participation(bars).collect()}
    assert days[day(5)].padded and not days[day(6)].padded and not days[day(7)].padded
    numbers = {r.date: r.session_no for r in cal.sessions(cal.participation(bars)).collect()}
    assert not {day(5), day(6), day(7)} & set(numbers) and numbers[day(8)] == 6


def test_listed_count_equals_the_range_join(spark):
    bars = panel(spark, absent=lambda s, d: d < 3 * s or d > 30 + s or (s + d) % 5 == 0)
    direct = {r.date: r.n for r in cal.listed(bars.select("date").distinct(), F.broadcast(cal.listed_span(bars))).groupBy("date").agg(F.count("*").alias("n")).collect()}
    assert {r.date: r.n_listed for r in cal.participation(bars).collect()} == direct


def test_grid_returns_do_not_bridge_holes(spark):
    bars = panel(spark, n=2, days=4, absent=lambda s, d: s == 0 and d == 1)
    got = {(r.symbol, r.date): r.ret for r in cal.grid_returns(bars).collect()}
    assert got["S0", day(2)] is None and got["S0", day(3)] is not None and got["S1", day(1)] is not None


# --- checks of tickers ---------------------------------------------------------------------------


def test_clean_bars_have_no_finding(spark):
    got = tick.check_tickers(raw(spark, clean_rows(n=300)), spark.createDataFrame([], CALM))
    assert [i for i in issues(got) if i[1] != "INFO"] == []


def test_planted_defects(spark):
    rows = clean_rows(n=60)
    rows[3][6] = -1.0
    rows[5][4], rows[5][5] = 1.0, 2.0
    rows[7][3] = None
    rows[9][8] = -5.0
    rows[11][6] = 500.0
    found = issues(tick.invalid_prices(raw(spark, rows)))
    assert ("invalid_prices", "FATAL", "close", 1) in found and ("invalid_prices", "FATAL", "high below low", 1) in found and ("invalid_prices", "FATAL", "negative volume", 1) in found
    assert ("invalid_prices", "WARN", "close outside range", 3) in found
    assert issues(tick.missing(raw(spark, rows))) == [("missing_values", "WARN", "open", 1)]


def test_duplicates_and_order(spark):
    rows = clean_rows(n=10)
    extra = [list(rows[2]), list(rows[2]), list(rows[5])]
    for i, r in enumerate(extra):
        r[1] = 100 + i
    df = raw(spark, rows + extra)
    row = tick.duplicates(df).first()
    assert (row.n_affected, row.date) == (3, day(2))
    assert issues(tick.order(df)) == [("chronological_order", "FATAL", "", 1)]
    assert tick.order(raw(spark, rows)).count() == 0
    asked = spark.createDataFrame([("A",), ("Q",)], "symbol string")
    assert [r.symbol for r in tick.no_rows(asked, df).collect()] == ["Q"]
    # an extreme move on a repeated date does not fail
    rows[5][6] = 1000.0
    assert tick.extreme_moves(raw(spark, rows + extra), spark.createDataFrame([], CALM)).count() >= 1


def test_volume_and_stale_runs(spark):
    rows = clean_rows(n=100)
    for i in (10, 11, 12, 40, 41, 42, 43):
        rows[i][8] = 0.0
    for i in range(70, 76):
        rows[i][6] = rows[69][6]
    df = raw(spark, rows)
    assert issues(tick.zero_volume(df)) == [("zero_volume", "WARN", "share", 7)]
    assert [(r.date, r.n_affected) for r in tick.zero_runs(df).collect()] == [(day(40), 4)]
    stale = tick.stale(df).first()
    assert (stale.date, stale.n_affected, stale.value) == (day(70), 7, rows[69][6])
    for i in (73,):
        rows[i][6] += 0.5
    assert tick.stale(raw(spark, rows)).count() == 0


@pytest.mark.parametrize(("jump", "stress", "action", "severity", "detail"), [(1.35, 0.0, None, "WARN", "unexplained"), (1.35, 0.5, None, "INFO", "market-wide"), (0.3, 0.5, None, "WARN", "market-wide"), (1.35, 0.5, 52, "WARN", "near action of 2018-02-22"), (1.1, 0.0, None, None, None)])
def test_extreme_moves(spark, jump, stress, action, severity, detail):
    rows = clean_rows(n=60, close=lambda i: 100.0 * (jump if i >= 50 else 1))
    if action:
        rows[action][9] = 3.0
    got = tick.extreme_moves(raw(spark, rows), spark.createDataFrame([(day(i), stress) for i in range(60)], CALM)).collect()
    assert [(r.severity, r.detail, r.date) for r in got] == ([(severity, detail, day(50))] if severity else [])


def test_nearest_action_prefers_the_earlier(spark):
    rows = clean_rows(n=20)
    rows[8][9], rows[12][10] = 1.0, 2.0
    got = {r.date: r for r in tick.near_action(raw(spark, rows), 3).collect()}
    assert got[day(10)].action_date == day(8) and got[day(11)].action_split == 2.0 and got[day(11)].action_distance == 1
    assert not got[day(4)].near and got[day(4)].action_date is None and got[day(5)].near


# --- checks of the panel -------------------------------------------------------------------------


def test_coverage_gaps_and_membership(spark):
    bars = panel(spark, n=6, days=60, absent=lambda s, d: (s == 1 and d < 30) or (s == 2 and 20 <= d < 30) or (s == 3 and d % 3 == 0 and 0 < d < 59))
    days = cal.participation(bars)
    asked = spark.createDataFrame([(f"S{i}",) for i in range(6)] + [("GHOST",)], "symbol string")
    got = {r.symbol: r for r in panel_checks.per_ticker(bars, days, asked).collect()}
    assert got["S1"].coverage == 1.0 and got["S1"].n_sessions == 30  # judged over its own life
    assert (got["S2"].max_gap, got["S2"].n_gaps, got["S2"].n_missing) == (10, 1, 10)
    assert got["S3"].max_gap == 1 and got["S3"].n_gaps == 0
    assert got["GHOST"].n_sessions == 0 and got["GHOST"].coverage == 0.0
    metrics = panel_checks.per_ticker(bars, days, asked)
    assert issues(panel_checks.low_coverage(metrics)) == [("coverage", "FATAL", "no observations", 1)] + [("coverage", "WARN", "", n) for n in sorted((10, 19))]
    assert [(r.symbol, r.date, r.n_affected) for r in panel_checks.gaps(bars, days).collect()] == [("S2", day(20), 10)]
    listed = issues(panel_checks.consistency(bars, asked, asked.filter("symbol <> 'S0'")))
    assert listed == [("ticker_consistency", "FATAL", "not in panel: GHOST", 1), ("ticker_consistency", "WARN", "not in manifest: S0", 1)]
    everything = panel_checks.check_panel(bars, days, asked)
    assert everything.columns == tick.ISSUE
    counted = report.counts(everything).collect()
    assert counted[0].total >= counted[-1].total and not report.is_usable(everything)
    assert report.flag_totals(everything).first().n_groups == report.of_severity(everything, "WARN").count()


def test_padded_and_phantom_dates(spark):
    bars = panel(spark, n=10, days=30, volume=lambda s, d: 0.0 if d == 12 else 1e6, absent=lambda s, d: d == 20 and s > 1, close=lambda s, d: 100.0 + s + (d - (d >= 12)) * 0.1)
    days = cal.participation(bars)
    row = panel_checks.padded(bars, days).first()
    assert (row.date, row.detail, row.n_affected) == (day(12), "holiday moved=0 traded=0", 10)
    assert [(r.date, r.n_affected) for r in panel_checks.phantom(days).collect()] == [(day(20), 2)]


def test_checks_leave_their_input(spark):
    df = raw(spark, clean_rows(n=30))
    before = sorted(map(tuple, df.collect()))
    tick.check_tickers(df, spark.createDataFrame([], CALM)).collect()
    assert sorted(map(tuple, df.collect())) == before


# --- universe ------------------------------------------------------------------------------------

CRITERIA = universe.Criteria(history_years=0.5, median_turnover=2e8, last_price=20.0, missing_frac=0.1, lookback=60)


def schedule(spark, bars, dates, symbols=None, criteria=CRITERIA):
    symbols = bars.select("symbol").distinct() if symbols is None else symbols
    return universe.eligibility_schedule(symbols, bars, cal.participation(bars), dates, criteria)


def test_month_steps_are_iterated():
    assert universe.add_months(date(2020, 8, 31), 6) == date(2021, 2, 28)
    assert universe.boundaries(date(2018, 8, 31), date(2021, 3, 1), 6, 6, 6) == [date(2019, 2, 28), date(2019, 8, 28), date(2020, 2, 28), date(2020, 8, 28)]
    assert len(universe.boundaries(date(2015, 1, 1), date(2026, 7, 31), 36, 6, 6)) == 17


def test_decision_dates_snap_back(spark):
    sessions = spark.createDataFrame([(day(i), n) for n, i in enumerate(range(0, 900, 7))], "date date, session_no long")
    got = [r.as_of for r in universe.decision_dates(sessions, 12, 6, 6).orderBy("as_of").collect()]
    assert got[0] == max(day(i) for i in range(0, 900, 7) if day(i) <= date(2019, 1, 1)) and len(got) == 2
    with pytest.raises(universe.SelectionError):
        universe.decision_dates(sessions.limit(0), 12, 6, 6)
    with pytest.raises(universe.SelectionError):
        universe.decision_dates(sessions, 60, 6, 6)


def test_future_rows_do_not_matter(spark):
    dates = spark.createDataFrame([(day(199),), (day(260),)], "as_of date")
    base = panel(spark, n=6, days=300, absent=lambda s, d: (s == 2 and d % 4 == 0) or (s == 4 and d < 150), volume=lambda s, d: 0.0 if s == 5 and d > 230 else 1e6)
    early = base.filter(F.col("date") <= F.lit(day(260)))
    corrupt = base.withColumns({c: F.when(F.col("date") > F.lit(day(260)), F.col(c) * 1000 + 7).otherwise(F.col(c)) for c in ("close", "turnover")})
    rows = [sorted(map(tuple, schedule(spark, b, dates).collect())) for b in (base, early, corrupt, base.repartition(7))]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == 12


def test_reasons_in_order(spark):
    dates = spark.createDataFrame([(day(250),)], "as_of date")
    bars = panel(spark, n=5, days=300, absent=lambda s, d: (s == 1 and d < 200) or (s == 2 and d % 3 == 0), close=lambda s, d: 5.0 if s == 3 else 100.0)
    bars = bars.withColumn("turnover", F.when(F.col("symbol") == "S4", 1e6).otherwise(F.col("turnover")))
    asked = spark.createDataFrame([(f"S{i}",) for i in range(5)] + [("NONE",)], "symbol string")
    got = {r.symbol: r for r in schedule(spark, bars, dates, asked).collect()}
    assert {s: r.reasons for s, r in got.items()} == {"S0": "", "S1": "short_history", "S2": "poor_coverage", "S3": "low_price", "S4": "illiquid", "NONE": "no_data"}
    assert got["S0"].eligible and (got["S0"].n_sessions_in_window, got["S1"].n_sessions_in_window) == (60, 51)
    assert got["S2"].missing_frac == pytest.approx(1 / 3, abs=1e-4) and got["NONE"].missing_frac == 1.0


def test_rank_gates_and_cap(spark):
    dates = spark.createDataFrame([(day(250),)], "as_of date")
    bars = panel(spark, n=6, days=260).withColumn("turnover", F.lit(3e8) + F.when(F.col("symbol").isin("S4", "S5"), 1e6).otherwise(0.0))
    capped = {r.symbol: r.reasons for r in schedule(spark, bars, dates, criteria=universe.Criteria(0.5, 2e8, 20.0, 0.1, 60, top=3)).collect()}
    assert capped == {"S4": "", "S5": "", "S0": "", "S1": "below_daily_rank", "S2": "below_daily_rank", "S3": "below_daily_rank"}
    table = lambda names: spark.createDataFrame([(n,) for n in names], "symbol string")
    sectors = spark.createDataFrame([(f"S{i}", None if i == 0 else "x") for i in range(6)], "symbol string, sector string")
    chosen = universe.select(schedule(spark, bars, dates), sectors, table(["S0", "S2", "S3", "S4", "S5"]), table(["S2", "S0"]), max_size=2)
    got = {r.symbol: r.excluded_for for r in chosen.collect()}
    assert got == {"S0": "no_sector;quality_fatal", "S1": "incomplete_download", "S2": "quality_fatal", "S3": "size_cap", "S4": "", "S5": ""}
    with pytest.raises(universe.SelectionError):
        universe.select(schedule(spark, bars, dates), rank_by="luck")
    over = universe.eligible_over_time(schedule(spark, bars, dates), chosen.filter("member")).first()
    assert (over.n_eligible, over.n_members, over.share) == (2, 2, 1.0)


# --- causality -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def series(spark):
    import random

    rng = random.Random(3)
    rows = []
    for s in ("A", "B"):
        x = 100.0
        for i in range(150):
            x += rng.gauss(0, 1)
            rows.append((s, day(i), x))
    return spark.createDataFrame(rows, "symbol string, date date, x double").persist()


@pytest.mark.parametrize("name", features.CAUSAL)
def test_causal_features_pass(series, name):
    assert causality.require_causal(features.CAUSAL[name], series, name, cuts=[day(90), day(140)]).n_compared > 0


@pytest.mark.parametrize("name", features.LEAKY)
def test_leaky_features_fail(series, name):
    with pytest.raises(causality.LeakageError, match="looks ahead"):
        causality.require_causal(features.LEAKY[name], series, name, cuts=[day(90)])


def test_detector_edges(series):
    hole = lambda df: features.leak_backfill(df, F.dayofmonth("date") % 7 == 0)
    assert not causality.check(hole, series, cuts=[day(96)]).passed and causality.check(hole, series, cuts=[day(90)]).passed  # a sparse leak
    dropped = lambda df: features.leak_next(df).filter("value is not null")
    assert not causality.check(dropped, series, cuts=[day(90)]).passed  # labels that truncation loses
    assert not causality.check(features.weekly, series, cuts=[day(92)]).passed  # a label after the cut
    assert not causality.check(lambda df: df.limit(0), series, cuts=[day(90)]).passed  # nothing compared
    with pytest.raises(causality.LeakageError, match="not a DataFrame"):
        causality.check(lambda df: 3, series, cuts=[day(90)])
    with pytest.raises(causality.LeakageError, match="columns change"):
        causality.check(lambda df: df.withColumn(f"c{df.count()}", F.lit(1)), series, cuts=[day(90)])
    pair = lambda data: features.rolling_beta(features.pair(data["y"].unionByName(data["x"]), "A", "B"))
    both = {"y": series.filter("symbol = 'A'"), "x": series.filter("symbol = 'B'")}
    assert causality.check(pair, both, cuts=[day(120)]).passed
    with pytest.raises(ValueError, match="different numbers"):
        causality.check(pair, both | {"x": series.limit(10)})


def test_checkpoints():
    assert causality.checkpoints(1000) == [350, 450, 550, 650, 750, 850, 920]
    assert causality.checkpoints(31) and all(30 <= c < 31 for c in causality.checkpoints(31))
    with pytest.raises(ValueError):
        causality.checkpoints(30)


# --- manifest as a table -------------------------------------------------------------------------


def test_calendar_without_volume_counts_observed_bars(spark):
    rows = [("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 2), None), ("A", date(2020, 1, 3), 1.0), ("B", date(2020, 1, 1), 1.0), ("B", date(2020, 1, 3), 2.0)]
    days = cal.participation(spark.createDataFrame(rows, "symbol string, date date, close double")).orderBy("date").collect()
    assert [(d.n_observed, d.n_traded, d.n_listed, d.is_session) for d in days] == [(2, 2, 2, True), (0, 0, 2, False), (2, 2, 2, True)]


def test_manifest_table(spark):
    rows = [("A", 1, "failed", 0, None), ("A", 2, "ok", 9, "2020-12-28"), ("B", 1, "ok", 9, "2020-12-01"), ("C", 1, "ok", 0, "2020-12-30")]
    df = spark.createDataFrame(rows, "symbol string, seq int, status string, rows long, last string").selectExpr("*", "date'2019-12-01' as start", "date'2020-11-30' as end", "cast(last as date) as last_date")
    last = manifest.latest(df)
    asked = spark.createDataFrame([(s,) for s in "ABCD"], "symbol string")
    assert sorted(r.symbol for r in manifest.pending(asked, last, "2020-01-01", "2020-12-31").collect()) == ["B", "C", "D"]
    assert {r.symbol: r.outcome for r in manifest.by_outcome(last).collect()} == {"A": "completed", "B": "completed", "C": "empty"}
    assert manifest.summary(last).first().n_rows == 18
