"""The catalogue's queries as SQL for DuckDB, written from the definitions and sharing no code with them."""

from __future__ import annotations

import re

WIDE_SYMBOLS = [f"NATION_{i}" for i in range(25)]

_ARRIVAL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"

#: Named parts; a statement gets those that it names, in this order.
PARTS = {
    "sec": "SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey",
    "lin": f"""SELECT symbol, sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity, l_discount, l_tax, l_returnflag,
        row_number() OVER (ORDER BY {_ARRIVAL}) AS seq
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN sec ON symbol = n_name""",
    "raw": """SELECT symbol, sector, date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close,
        arg_max(px * (1 - l_discount), seq) AS adj_close, sum(CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE l_quantity END) AS volume,
        arg_max(CASE WHEN l_tax = 0.08e0 THEN 0.08e0 * px ELSE 0e0 END, seq) AS dividends, 0e0 AS splits
      FROM lin GROUP BY symbol, sector, date""",
    "defect": """SELECT symbol, sector, date, CASE WHEN day % 97 = 0 THEN NULL ELSE open END AS open, CASE WHEN day % 89 = 0 THEN low - 1 ELSE high END AS high, low,
        CASE WHEN day % 211 = 0 THEN 0e0 ELSE close END AS close, adj_close, CASE WHEN day % 131 = 0 THEN -volume - 1 ELSE volume END AS volume, dividends, splits
      FROM (SELECT *, date - DATE '1995-01-01' AS day FROM raw)""",
    "bar": """SELECT symbol, sector, date, open * f AS open, high * f AS high, low * f AS low, adj_close AS close, volume, dividends, splits, f AS adj_factor, close * volume AS turnover
      FROM (SELECT *, adj_close / close AS f FROM raw WHERE close > 0 AND adj_close > 0)""",
    "span": "SELECT symbol, min(date) AS first, max(date) AS last FROM bar GROUP BY symbol",
    "perdate": "SELECT date, count(*) AS n_observed, count(*) FILTER (WHERE volume > 0) AS n_traded FROM bar GROUP BY date",
    "part": "SELECT date, n_observed, n_traded, (SELECT count(*) FROM span WHERE date BETWEEN first AND last) AS n_listed FROM perdate",
    "day": """SELECT *, p <= 1e0 - 0.8e0 AND n_listed > 0 AS padded, p >= 0.3e0 AND NOT (p <= 1e0 - 0.8e0 AND n_listed > 0) AS is_session
      FROM (SELECT *, coalesce(CAST(n_traded AS DOUBLE) / nullif(n_listed, 0), 0e0) AS p FROM part)""",
    "ses": "SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM day WHERE is_session",
    "gridret": """SELECT symbol, date, CASE WHEN lag(no) OVER w = no - 1 THEN close / lag(close) OVER w - 1 END AS ret
      FROM bar JOIN (SELECT date, row_number() OVER (ORDER BY date) AS no FROM perdate) USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "stress": "SELECT date, count(*) FILTER (WHERE abs(ret) > 4e0) AS n_moved, count(*) AS n_observed, count(*) FILTER (WHERE abs(ret) > 4e0) / CAST(count(*) AS DOUBLE) AS stress FROM gridret GROUP BY date",
    "own": """SELECT s.symbol, ses.date, ses.session_no, b.date IS NOT NULL AS seen, coalesce(b.volume > 0, false) AS traded
      FROM span s JOIN ses ON ses.date BETWEEN s.first AND s.last LEFT JOIN bar b ON b.symbol = s.symbol AND b.date = ses.date""",
    "gaprun": """SELECT symbol, min(session_no) AS start, min(date) AS date, count(*) AS length
      FROM (SELECT *, session_no - row_number() OVER (PARTITION BY symbol ORDER BY session_no) AS island FROM own WHERE NOT seen) GROUP BY symbol, island""",
    "metric": """SELECT x.symbol, s.first, s.last, coalesce(n, 0) AS n_sessions, coalesce(o, 0) AS n_observed, coalesce(CAST(o AS DOUBLE) / nullif(n, 0), 0e0) AS coverage,
        coalesce(t, 0) AS n_traded, coalesce(o - t, 0) AS n_zero_volume, coalesce(CAST(t AS DOUBLE) / nullif(n, 0), 0e0) AS tradeable_coverage, coalesce(n - o, 0) AS n_missing,
        coalesce(g, 0) AS max_gap, coalesce(k, 0) AS n_gaps
      FROM sec x LEFT JOIN (SELECT * FROM span WHERE symbol <> 'NATION_11') s ON s.symbol = x.symbol
      LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE seen) AS o, count(*) FILTER (WHERE traded) AS t FROM own GROUP BY symbol) c ON c.symbol = s.symbol
      LEFT JOIN (SELECT symbol, max(length) AS g, count(*) FILTER (WHERE length > 5) AS k FROM gaprun GROUP BY symbol) r ON r.symbol = s.symbol""",
    "bound": """SELECT CAST(min(date) + INTERVAL 36 MONTH AS DATE) AS b, max(date) AS hi FROM ses
      UNION ALL SELECT CAST(b + INTERVAL 6 MONTH AS DATE), hi FROM bound WHERE CAST(CAST(b + INTERVAL 6 MONTH AS DATE) + INTERVAL 6 MONTH AS DATE) <= hi""",
    "dec": "SELECT DISTINCT as_of FROM (SELECT max(date) AS as_of FROM ses JOIN bound ON date <= b WHERE b + INTERVAL 6 MONTH <= hi GROUP BY b)",
    "stat0": """SELECT x.symbol, dec.as_of, min(b.date) AS first_obs, max(b.date) AS last_obs, arg_max(b.close, b.date) AS last_price
      FROM sec x CROSS JOIN dec LEFT JOIN bar b ON b.symbol = x.symbol AND b.date <= dec.as_of GROUP BY x.symbol, dec.as_of""",
    "win": """SELECT dec.as_of, w.date FROM dec JOIN ses a ON a.date = dec.as_of JOIN ses w ON w.session_no BETWEEN a.session_no - 251 AND a.session_no""",
    "stat1": """SELECT s.symbol, s.as_of, s.first_obs, s.last_obs, s.last_price, count(win.date) AS w, count(b.date) FILTER (WHERE b.volume > 0) AS n, coalesce(median(b.turnover) FILTER (WHERE b.volume > 0), 0e0) AS med
      FROM stat0 s LEFT JOIN win ON win.as_of = s.as_of AND win.date >= s.first_obs LEFT JOIN bar b ON b.symbol = s.symbol AND b.date = win.date GROUP BY ALL""",
    "stats": """SELECT symbol, as_of, first_obs, last_obs, round((as_of - first_obs) / 365.25e0, 3) AS history_years, w AS n_sessions_in_window, n AS n_traded_in_window,
        CASE WHEN w > 0 THEN ((20000 * (w - n) + w) // (2 * w)) / 10000e0 ELSE 1e0 END AS missing_frac, med AS median_turnover, last_price FROM stat1""",
    "elig": """SELECT *, reasons = '' AS eligible FROM (SELECT *, CASE WHEN first_obs IS NULL THEN 'no_data' ELSE concat_ws(';', CASE WHEN history_years < 3e0 THEN 'short_history' END,
        CASE WHEN median_turnover < 60000e0 THEN 'illiquid' END, CASE WHEN coalesce(last_price < 900e0, true) THEN 'low_price' END, CASE WHEN missing_frac > 0.6e0 THEN 'poor_coverage' END) END AS reasons FROM stats)""",
    "last": "SELECT * FROM elig WHERE as_of = (SELECT max(as_of) FROM elig)",
    "ever": "SELECT symbol FROM elig GROUP BY symbol HAVING bool_or(eligible)",
    "sel": """SELECT *, excluded_for = '' AS member FROM (SELECT l.*, CASE WHEN l.symbol = 'NATION_6' THEN NULL ELSE sector END AS sector,
        concat_ws(';', CASE WHEN l.symbol = 'NATION_6' THEN 'no_sector' END, CASE WHEN l.symbol = 'NATION_12' THEN 'incomplete_download' END,
          CASE WHEN l.symbol IN ('NATION_12', 'NATION_10') THEN 'quality_fatal' END, CASE WHEN l.symbol NOT IN (SELECT symbol FROM ever) THEN 'never_eligible' END) AS excluded_for
      FROM last l JOIN sec USING (symbol))""",
    "i_missing": """SELECT 'missing_values' AS "check", 'WARN' AS severity, symbol, CAST(NULL AS DATE) AS date, 'open' AS detail, CAST(NULL AS DOUBLE) AS value, count(*) AS n_affected FROM defect WHERE open IS NULL GROUP BY symbol""",
    "i_invalid": """SELECT 'invalid_prices' AS "check", severity, symbol, min(date) AS date, detail, CAST(NULL AS DOUBLE) AS value, count(*) AS n_affected FROM (
        SELECT symbol, date, 'FATAL' AS severity, 'open' AS detail FROM defect WHERE open <= 0
        UNION ALL SELECT symbol, date, 'FATAL', 'high' FROM defect WHERE high <= 0 UNION ALL SELECT symbol, date, 'FATAL', 'low' FROM defect WHERE low <= 0
        UNION ALL SELECT symbol, date, 'FATAL', 'close' FROM defect WHERE close <= 0 UNION ALL SELECT symbol, date, 'FATAL', 'adj_close' FROM defect WHERE adj_close <= 0
        UNION ALL SELECT symbol, date, 'FATAL', 'high below low' FROM defect WHERE high < low UNION ALL SELECT symbol, date, 'FATAL', 'negative volume' FROM defect WHERE volume < 0
        UNION ALL SELECT symbol, date, 'WARN', 'close outside range' FROM defect WHERE close < low OR close > high
        UNION ALL SELECT symbol, date, 'WARN', 'open outside range' FROM defect WHERE open < low OR open > high) GROUP BY severity, symbol, detail""",
    "i_zero": """SELECT 'zero_volume' AS "check", CASE WHEN n / CAST(r AS DOUBLE) > 0.22e0 THEN 'WARN' ELSE 'INFO' END AS severity, symbol, CAST(NULL AS DATE) AS date, 'share' AS detail, round(n / CAST(r AS DOUBLE), 6) AS value, n AS n_affected
      FROM (SELECT symbol, count(*) FILTER (WHERE coalesce(volume, 0) <= 0) AS n, count(*) AS r FROM defect GROUP BY symbol) WHERE n > 0""",
    "i_run": """SELECT 'zero_volume' AS "check", 'WARN' AS severity, symbol, min(date) AS date, 'run' AS detail, CAST(count(*) AS DOUBLE) AS value, count(*) AS n_affected FROM (
        SELECT *, no - row_number() OVER (PARTITION BY symbol ORDER BY date) AS island FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS no FROM raw) WHERE volume <= 0) GROUP BY symbol, island HAVING count(*) > 3""",
    "i_phantom": """SELECT 'phantom_session' AS "check", 'WARN' AS severity, CAST(NULL AS VARCHAR) AS symbol, date, '' AS detail, CAST(NULL AS DOUBLE) AS value, n_observed AS n_affected FROM day WHERE n_observed BETWEEN 1 AND 7""",
    "i_gap": """SELECT 'gaps' AS "check", 'WARN' AS severity, symbol, date, '' AS detail, CAST(length AS DOUBLE) AS value, length AS n_affected FROM gaprun WHERE length > 5""",
    "issue": "SELECT * FROM i_missing UNION ALL SELECT * FROM i_invalid UNION ALL SELECT * FROM i_zero UNION ALL SELECT * FROM i_run UNION ALL SELECT * FROM i_phantom UNION ALL SELECT * FROM i_gap",
    "x": "SELECT symbol, date, close AS x FROM bar",
    "pair": "SELECT 'NATION_3/NATION_8' AS symbol, a.date, a.x AS y, b.x FROM x a JOIN x b ON a.date = b.date WHERE a.symbol = 'NATION_3' AND b.symbol = 'NATION_8'",
    "smap": "SELECT symbol, CASE WHEN sector = 'ASIA' THEN NULL WHEN symbol = 'NATION_3' THEN '' ELSE sector END AS sector FROM sec",
    "rec": """SELECT o_custkey AS symbol, o_orderkey AS seq, status, CASE WHEN status = 'ok' THEN o_orderkey % 900 ELSE 0 END AS rows, start, start + 365 AS "end", CASE WHEN status = 'ok' THEN start + CAST(355 + o_orderkey % 11 AS INTEGER) END AS last_date
      FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'empty' ELSE 'failed' END AS status, CAST(o_orderdate AS DATE) AS start FROM orders)""",
    "lrec": "SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1",
}

_W = "PARTITION BY symbol ORDER BY date ROWS BETWEEN"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.rpartition('.')[2]}" for c in columns)


#: Statements over the parts.
STATEMENTS = {
    "bars": f"SELECT symbol, sector, date, {_r('open', 'high', 'low', 'close', 'volume', 'dividends', 'splits', 'adj_factor', 'turnover')} FROM bar",
    "clean_dedup_last": "SELECT symbol, date, round(close, 6) AS close, round(adj_close, 6) AS adj_close FROM raw",
    "clean_positive": "SELECT symbol, count(*) AS n_rows FROM defect WHERE close > 0 AND adj_close > 0 GROUP BY symbol",
    "adj_factor_band": "SELECT symbol, round(min(adj_factor), 6) AS min_factor, round(max(adj_factor), 6) AS max_factor, min(adj_factor) >= 0.05e0 AND max(adj_factor) <= 1.000000001e0 AS plausible FROM bar GROUP BY symbol",
    "drop_ledger": """SELECT symbol, CASE WHEN r IS NULL THEN 'no raw file' WHEN n = 0 THEN 'no usable rows' ELSE 'only ' || n || ' rows (< 1400)' END AS reason
      FROM sec LEFT JOIN (SELECT symbol, count(*) AS r, count(*) FILTER (WHERE close > 0 AND adj_close > 0) AS n FROM defect WHERE symbol <> 'NATION_3' GROUP BY symbol) USING (symbol) WHERE r IS NULL OR n < 1400""",
    "incoherent_bars": "SELECT symbol, count(*) FILTER (WHERE high < low OR high < close OR low > close) AS n_incoherent FROM defect GROUP BY symbol",
    "panel_slice": "SELECT symbol, date, round(close, 6) AS close, volume FROM bar WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND symbol IN (SELECT symbol FROM bar GROUP BY symbol HAVING count(*) >= 1400)",
    "panel_summary": "SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars FROM bar",
    "cell_coverage": "SELECT n AS n_cells, g AS n_grid, round(n / CAST(g AS DOUBLE), 6) AS coverage FROM (SELECT count(*) AS n, count(DISTINCT symbol) * count(DISTINCT date) AS g FROM bar)",
    "median_turnover": "SELECT symbol, round(median(turnover), 6) AS median_turnover FROM bar GROUP BY symbol",
    "panel_wide_close": "SELECT date, " + ", ".join(f"round(max(close) FILTER (WHERE symbol = '{s}'), 6) AS {s}" for s in WIDE_SYMBOLS) + " FROM bar GROUP BY date",
    "normalise_dates": "SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, count(*) AS n_events FROM events GROUP BY 1",
    "plausibility": """SELECT symbol, round(count(*) / ((max(date) - min(date)) / 365.25e0), 6) AS bars_a_year, bool_and(adj_factor > 0 AND adj_factor <= 1) AS factor_ok, count(*) FILTER (WHERE dividends <> 0) AS n_actions FROM bar GROUP BY symbol""",
    "candidates": "SELECT symbol, sector, symbol || '.NS' AS ticker FROM smap WHERE coalesce(sector, '') <> ''",
    "unmapped": "SELECT symbol FROM smap WHERE coalesce(sector, '') = ''",
    "sector_counts": "SELECT sector, count(*) AS n FROM smap WHERE coalesce(sector, '') <> '' GROUP BY sector",
    "same_sector_pairs": "SELECT count(*) AS n_pairs FROM sec a JOIN sec b ON a.sector = b.sector AND a.symbol < b.symbol",
    "pair_count": "SELECT count(*) AS n_pairs FROM sec a JOIN sec b ON a.symbol < b.symbol",
    "sector_coverage": "SELECT m AS n_mapped, n AS n_listed, round(100e0 * m / n, 6) AS coverage_pct FROM (SELECT count(*) FILTER (WHERE coalesce(sector, '') <> '') AS m, count(*) AS n FROM smap)",
    "listed_span": "SELECT * FROM span",
    "listed_per_date": "SELECT date, n_listed FROM part",
    "participation": "SELECT date, n_observed, n_traded, n_listed, round(p, 6) AS participation, padded, is_session FROM day",
    "sessions": "SELECT * FROM ses",
    "padded_dates": "SELECT date, round(p, 6) AS participation FROM day WHERE padded",
    "market_stress": "SELECT date, n_moved, n_observed, round(stress, 6) AS stress FROM stress",
    "tick_duplicates": """SELECT 'duplicate_timestamps' AS "check", 'FATAL' AS severity, symbol, min(date) AS date, '' AS detail, CAST(NULL AS DOUBLE) AS value, CAST(sum(n - 1) AS BIGINT) AS n_affected FROM (SELECT symbol, date, count(*) AS n FROM lin GROUP BY symbol, date HAVING count(*) > 1) GROUP BY symbol""",
    "tick_order": """SELECT 'chronological_order' AS "check", 'FATAL' AS severity, symbol, CAST(NULL AS DATE) AS date, '' AS detail, CAST(NULL AS DOUBLE) AS value, CAST(1 AS BIGINT) AS n_affected
      FROM (SELECT symbol, date < lag(date) OVER (PARTITION BY symbol ORDER BY seq) AS back FROM lin) GROUP BY symbol HAVING bool_or(back)""",
    "tick_no_rows": """SELECT 'missing_values' AS "check", 'FATAL' AS severity, symbol, CAST(NULL AS DATE) AS date, 'no rows' AS detail, CAST(NULL AS DOUBLE) AS value, CAST(1 AS BIGINT) AS n_affected FROM sec WHERE symbol NOT IN (SELECT symbol FROM bar WHERE symbol NOT LIKE 'NATION_2%')""",
    "tick_missing": "SELECT * FROM i_missing",
    "tick_invalid": "SELECT * FROM i_invalid",
    "tick_zero_volume": "SELECT * FROM i_zero",
    "tick_zero_runs": "SELECT * FROM i_run",
    "tick_stale_runs": """SELECT 'stale_price' AS "check", 'WARN' AS severity, symbol, min(date) AS date, '' AS detail, min(b) AS value, count(*) + 1 AS n_affected FROM (
        SELECT *, no - row_number() OVER (PARTITION BY symbol ORDER BY date) AS island FROM (
          SELECT symbol, date, floor(close / 1000) AS b, floor(close / 1000) - lag(floor(close / 1000)) OVER w AS d, row_number() OVER w AS no FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE d = 0) GROUP BY symbol, island HAVING count(*) >= 3""",
    "tick_returns": "SELECT symbol, date, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS ret FROM raw",
    "tick_near_action": "SELECT symbol, date, near, CASE WHEN near THEN adate END AS action_date, round(CASE WHEN near THEN adiv END, 6) AS action_dividend, CASE WHEN near THEN dist ELSE -1 END AS action_distance FROM act",
    "tick_extreme_moves": """SELECT 'extreme_move' AS "check", CASE WHEN near OR abs(ret) > 10e0 OR NOT coalesce(stress >= 0.2e0, false) THEN 'WARN' ELSE 'INFO' END AS severity, symbol, date,
        CASE WHEN near THEN 'near action of ' || CAST(adate AS VARCHAR) WHEN coalesce(stress >= 0.2e0, false) THEN 'market-wide' ELSE 'unexplained' END AS detail, round(ret, 6) AS value, CAST(1 AS BIGINT) AS n_affected
      FROM act LEFT JOIN stress USING (date) WHERE abs(ret) > 4e0""",
    "panel_padded": """SELECT 'padded_session' AS "check", 'WARN' AS severity, CAST(NULL AS VARCHAR) AS symbol, date, CASE WHEN t = 0 THEN 'holiday' ELSE 'partial' END || ' moved=' || coalesce(m, 0) || ' traded=' || t AS detail, round(p, 6) AS value, n_observed AS n_affected
      FROM (SELECT *, CAST(round_even(p * n_observed, 0) AS BIGINT) AS t FROM day WHERE padded) LEFT JOIN (SELECT date, count(*) FILTER (WHERE abs(ret) > 1e-12) AS m FROM gridret GROUP BY date) USING (date)""",
    "panel_phantom": "SELECT * FROM i_phantom",
    "per_ticker_coverage": f"SELECT symbol, first, last, n_sessions, n_observed, {_r('coverage')}, n_traded, n_zero_volume, {_r('tradeable_coverage')}, n_missing, max_gap, n_gaps FROM metric",
    "panel_gaps": "SELECT * FROM i_gap",
    "panel_missing": """SELECT 'missing_sessions' AS "check", CASE WHEN coverage >= 0.6e0 THEN 'INFO' ELSE 'WARN' END AS severity, symbol, CAST(NULL AS DATE) AS date, '' AS detail, round(coverage, 6) AS value, n_missing AS n_affected FROM metric WHERE n_missing > 0""",
    "panel_low_coverage": """SELECT 'coverage' AS "check", 'WARN' AS severity, symbol, CAST(NULL AS DATE) AS date, '' AS detail, round(coverage, 6) AS value, n_missing AS n_affected FROM metric WHERE n_observed > 0 AND coverage < 0.6e0
      UNION ALL SELECT 'coverage', 'FATAL', symbol, NULL, 'no observations', 0e0, 1 FROM metric WHERE n_observed = 0""",
    "consistency": """SELECT 'ticker_consistency' AS "check", severity, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS DATE) AS date, title || ': ' || array_to_string(list_sort(list(symbol))[1:10], ' ') AS detail, CAST(NULL AS DOUBLE) AS value, count(*) AS n_affected FROM (
        SELECT 'FATAL' AS severity, 'not in panel' AS title, symbol FROM (SELECT symbol FROM uni EXCEPT SELECT symbol FROM pan)
        UNION ALL SELECT 'INFO', 'not in universe', symbol FROM (SELECT symbol FROM pan EXCEPT SELECT symbol FROM uni)
        UNION ALL SELECT 'WARN', 'not in manifest', symbol FROM (SELECT symbol FROM pan EXCEPT SELECT symbol FROM sec WHERE sector <> 'ASIA')) GROUP BY severity, title""",
    "issue_counts": """SELECT "check", f AS "FATAL", w AS "WARN", i AS "INFO", f + w + i AS total FROM (SELECT "check", CAST(coalesce(sum(n_affected) FILTER (WHERE severity = 'FATAL'), 0) AS BIGINT) AS f,
        CAST(coalesce(sum(n_affected) FILTER (WHERE severity = 'WARN'), 0) AS BIGINT) AS w, CAST(coalesce(sum(n_affected) FILTER (WHERE severity = 'INFO'), 0) AS BIGINT) AS i FROM issue GROUP BY "check")""",
    "issues_capped": """SELECT "check", severity, symbol, date, detail, n_affected, CAST(rank AS INTEGER) AS rank, greatest(n - 25, 0) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY severity, "check" ORDER BY symbol NULLS FIRST, date NULLS FIRST, detail, n_affected) AS rank, count(*) OVER (PARTITION BY severity, "check") AS n FROM issue) WHERE rank <= 25""",
    "flag_totals": "SELECT CAST(coalesce(sum(n_affected), 0) AS BIGINT) AS n_observations, count(*) AS n_groups FROM issue WHERE severity = 'WARN'",
    "worst_tradeable": f"SELECT symbol, {_r('coverage', 'tradeable_coverage')} FROM (SELECT * FROM metric ORDER BY metric.tradeable_coverage, symbol LIMIT 10) AS worst",
    "decision_dates": "SELECT as_of FROM dec",
    "liquidity_stats": f"SELECT symbol, as_of, first_obs, last_obs, history_years, n_sessions_in_window, n_traded_in_window, missing_frac, {_r('median_turnover', 'last_price')} FROM stats",
    "eligibility_schedule": f"SELECT symbol, as_of, first_obs, last_obs, history_years, n_sessions_in_window, n_traded_in_window, missing_frac, {_r('median_turnover', 'last_price')}, reasons, eligible FROM elig",
    "eligibility_capped": """SELECT symbol, as_of, CASE WHEN eligible AND rank > 5 THEN 'below_daily_rank' ELSE reasons END AS reasons, eligible AND rank <= 5 AS eligible
      FROM (SELECT *, row_number() OVER (PARTITION BY as_of, eligible ORDER BY median_turnover DESC, symbol) AS rank FROM elig)""",
    "selected_universe": f"SELECT symbol, sector, history_years, {_r('median_turnover')}, missing_frac, {_r('last_price')} FROM sel WHERE member",
    "exclusions": f"SELECT symbol, sector, excluded_for, history_years, {_r('median_turnover')}, missing_frac, {_r('last_price')} FROM sel WHERE NOT member",
    "size_capped": """SELECT symbol, CASE WHEN member AND rank > 6 THEN 'size_cap' ELSE excluded_for END AS excluded_for, member AND rank <= 6 AS member
      FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY median_turnover DESC, symbol) AS rank FROM sel)""",
    "ever_eligible": "SELECT symbol FROM ever",
    "eligible_over_time": "SELECT as_of, count(*) FILTER (WHERE eligible) AS n_eligible, count(*) AS n_members, round(count(*) FILTER (WHERE eligible) / CAST(count(*) AS DOUBLE), 6) AS share FROM elig WHERE symbol IN (SELECT symbol FROM sel WHERE member) GROUP BY as_of",
    "sector_table": "SELECT sector, count(*) AS n FROM sel WHERE member GROUP BY sector",
    "reason_tally": "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM elig WHERE reasons <> '') GROUP BY reason",
    "turnover_quantiles": "SELECT round(min(median_turnover), 6) AS min_turnover, round(quantile_cont(median_turnover, 0.25), 6) AS q25_turnover, round(median(last.median_turnover), 6) AS median_turnover, round(quantile_cont(last.median_turnover, 0.75), 6) AS q75_turnover, round(max(last.median_turnover), 6) AS max_turnover FROM last",
    "top_bottom_liquidity": f"""SELECT symbol, {_r('median_turnover')}, side FROM (SELECT * FROM (SELECT symbol, median_turnover, 'top' AS side FROM last ORDER BY median_turnover DESC, symbol LIMIT 10)
      UNION ALL SELECT * FROM (SELECT symbol, median_turnover, 'bottom' AS side FROM last ORDER BY median_turnover, symbol LIMIT 10))""",
    "coverage_stats": """SELECT round(median(history_years), 6) AS median_history, round(min(history_years), 6) AS min_history, round(max(history_years), 6) AS max_history, round(median(missing_frac), 6) AS median_missing, max(missing_frac) AS worst_missing, count(*) FILTER (WHERE n_sessions_in_window >= 252) AS n_full_window FROM last""",
    "expected_false_positives": "SELECT n AS n_pairs, round(0.05e0 * n, 6) AS expected FROM (SELECT count(*) AS n FROM sec a JOIN sec b ON a.sector = b.sector AND a.symbol < b.symbol)",
    "feat_trailing_mean": f"SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 20 THEN avg(x) OVER w END, 6) AS value FROM x WINDOW w AS ({_W} 19 PRECEDING AND CURRENT ROW)",
    "feat_trailing_mean_lag1": f"SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 20 THEN avg(x) OVER w END, 6) AS value FROM x WINDOW w AS ({_W} 20 PRECEDING AND 1 PRECEDING)",
    "feat_zscore": f"SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 60 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) AS value FROM x WINDOW w AS ({_W} 60 PRECEDING AND 1 PRECEDING)",
    "feat_expanding_mean": f"SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 30 THEN avg(x) OVER w END, 6) AS value FROM x WINDOW w AS ({_W} UNBOUNDED PRECEDING AND CURRENT ROW)",
    "feat_lagged_return": "SELECT symbol, date, round(x / lag(x, 5) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS value FROM x",
    "feat_multi": f"""SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 60 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) AS z, round(CASE WHEN count(r) OVER v >= 20 THEN stddev_samp(r) OVER v END, 6) AS vol, CAST(sign(r) AS DOUBLE) AS sign
      FROM (SELECT *, x / lag(x) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM x) WINDOW w AS ({_W} 60 PRECEDING AND 1 PRECEDING), v AS ({_W} 19 PRECEDING AND CURRENT ROW)""",
    "feat_hedge_ratio": f"SELECT symbol, date, round(b, 6) AS beta, round(y - b * x, 6) AS spread FROM (SELECT *, CASE WHEN count(x) OVER w >= 60 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END AS b FROM pair WINDOW w AS ({_W} 60 PRECEDING AND 1 PRECEDING))",
    "feat_fixed_beta": "SELECT symbol, date, round(y - 1.5e0 * x, 6) AS spread FROM pair",
    "leak_full_zscore": "SELECT symbol, date, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) AS value FROM x WINDOW w AS (PARTITION BY symbol)",
    "leak_centered": f"SELECT symbol, date, round(CASE WHEN count(x) OVER w >= 21 THEN avg(x) OVER w END, 6) AS value FROM x WINDOW w AS ({_W} 10 PRECEDING AND 10 FOLLOWING)",
    "leak_next": "SELECT symbol, date, round(lead(x) OVER (PARTITION BY symbol ORDER BY date), 6) AS value FROM x",
    "leak_minmax": "SELECT symbol, date, round((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 6) AS value FROM x WINDOW w AS (PARTITION BY symbol)",
    "leak_full_beta": "SELECT symbol, date, round(y - covar_samp(y, x) OVER w / var_pop(x) OVER w * x, 6) AS spread FROM pair WINDOW w AS (PARTITION BY symbol)",
    "leak_future_max": f"SELECT symbol, date, round(x / max(x) OVER w, 6) AS value FROM x WINDOW w AS ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "leak_bfill": f"SELECT symbol, date, round(first_value(k IGNORE NULLS) OVER w, 6) AS value FROM (SELECT symbol, date, CASE WHEN day(date) % 5 <> 0 THEN x END AS k FROM x) WINDOW w AS ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "weekly_mean": "SELECT symbol, CAST(date_trunc('week', date) AS DATE) + 6 AS date, round(avg(floor(x * 100e0 + 0.5e0)), 6) AS value FROM x GROUP BY 1, 2",
    "manifest_latest": "SELECT * FROM lrec",
    "manifest_completed": "SELECT symbol, CASE WHEN status = 'ok' AND rows > 0 THEN 'completed' WHEN status = 'failed' THEN 'failed' ELSE 'empty' END AS outcome FROM lrec",
    "manifest_pending": """SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT symbol FROM lrec WHERE status = 'ok' AND rows > 0 AND last_date IS NOT NULL
        AND ((start = DATE '1997-01-01' AND "end" = DATE '1997-12-01') OR (start <= DATE '1997-01-01' AND last_date >= DATE '1997-11-24')))""",
    "manifest_summary": "SELECT count(*) AS n_symbols, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'empty') AS n_empty, count(*) FILTER (WHERE status = 'failed') AS n_failed, CAST(coalesce(sum(rows), 0) AS BIGINT) AS n_rows FROM lrec",
    "manifest_records": "SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, 'ok' AS status FROM bar GROUP BY symbol",
}

PARTS |= {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS no, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM raw",
    "near2": """SELECT a.symbol, a.date, a.ret, b.date AS adate, b.dividends AS adiv, abs(b.no - a.no) AS dist, row_number() OVER (PARTITION BY a.symbol, a.date ORDER BY abs(b.no - a.no), b.no) AS pick
      FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.no BETWEEN a.no - 3 AND a.no + 3 AND (b.dividends <> 0 OR b.splits <> 0)""",
    "act": "SELECT n.symbol, n.date, n.ret, t.adate IS NOT NULL AS near, t.adate, t.adiv, t.dist FROM numbered n LEFT JOIN (SELECT * FROM near2 WHERE pick = 1) t ON t.symbol = n.symbol AND t.date = n.date",
    "pan": "SELECT DISTINCT symbol FROM bar WHERE symbol <> 'NATION_11'",
    "uni": "SELECT n_name AS symbol FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey % 7 <> 3",
}


#: Features of the detector's report, the statements of their values, and the dates of its cuts.
DETECTED = {
    "trailing_mean": "feat_trailing_mean", "trailing_mean_lag1": "feat_trailing_mean_lag1", "zscore": "feat_zscore", "expanding_mean": "feat_expanding_mean",
    "lagged_return": "feat_lagged_return", "several": "feat_multi", "hedge_ratio": "feat_hedge_ratio", "fixed_beta": "feat_fixed_beta", "full_zscore": "leak_full_zscore",
    "centred": "leak_centered", "next": "leak_next", "minmax": "leak_minmax", "full_beta": "leak_full_beta", "future_max": "leak_future_max", "backfill": "leak_bfill",
}
CUTS = ("1997-01-01", "1999-01-01", "2000-06-01")


def _detection() -> str:
    """Every feature over all rows and over those up to each cut, compared cell by cell."""
    parts = []
    for feature, name in DETECTED.items():
        whole = re.sub(r"round\((.*?), 6\) AS", r"(\1) AS", STATEMENTS[name], flags=re.DOTALL)
        columns = re.findall(r"(?:\) AS|CAST\(sign\(r\) AS DOUBLE\) AS) (\w+)(?=,| FROM|\s+FROM)", whole.partition(" FROM ")[0] + " FROM")
        for cut in CUTS:
            until = re.sub(r"\bFROM (x|pair)\b", rf"FROM (SELECT * FROM \1 WHERE date <= DATE '{cut}') \1", whole)
            for c in columns:
                alike = f"f.{c} IS NOT DISTINCT FROM c.{c} OR coalesce(abs(f.{c} - c.{c}) <= 1e-12 + 1e-9 * abs(c.{c}), false)"
                parts.append(
                    f"SELECT '{feature}' AS feature, DATE '{cut}' AS checkpoint, count(*) FILTER (WHERE f.symbol IS NOT NULL AND c.symbol IS NOT NULL) AS compared, count(*) FILTER (WHERE f.symbol IS NULL OR c.symbol IS NULL OR NOT ({alike})) AS bad"
                    f" FROM (SELECT * FROM ({whole}) WHERE date <= DATE '{cut}') f FULL JOIN ({until}) c ON f.symbol = c.symbol AND f.date = c.date"
                )
    summed = "SELECT feature, checkpoint, CAST(sum(compared) AS BIGINT) AS n_compared, CAST(sum(bad) AS BIGINT) AS n_bad, sum(bad) = 0 AND sum(compared) > 0 AS passed"
    return f"{summed} FROM ({' UNION ALL '.join(parts)}) GROUP BY feature, checkpoint"


STATEMENTS["causality_report"] = _detection()


def _rounding(sql: str) -> str:
    """round(x, 6) spelled as floor(x * 1e6 + 0.5) / 1e6, which treats halves alike in every engine."""
    at = sql.find("round(")
    while at >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inside = sql[at + 6 : end]
        if inside.endswith(", 6"):
            sql = f"{sql[:at]}floor(({inside[:-3]}) * 1e6 + 0.5e0) / 1e6{sql[end + 1:]}"
        at = sql.find("round(", at + 1)
    return sql


def _needed(sql: str, found: list[str]) -> None:
    for name, part in PARTS.items():
        if name not in found and re.search(rf"\b(FROM|JOIN|EXCEPT SELECT symbol FROM) {name}\b", sql):
            found.append(name)
            _needed(part, found)


def statements() -> dict[str, str]:
    """Each statement with the parts that it needs."""
    out = {}
    for name, sql in STATEMENTS.items():
        found: list[str] = []
        _needed(sql, found)
        # a part follows those that it names
        ordered: list[str] = []
        while len(ordered) < len(found):
            for n in found:
                own: list[str] = []
                _needed(PARTS[n], own)
                if n not in ordered and all(o in ordered or o == n for o in own):
                    ordered.append(n)
        out[name] = _rounding(("WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered) + "\n" if ordered else "") + sql)
    return out
