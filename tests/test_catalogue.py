import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: A query of each kind; the driver compares all of them.
SAMPLE = ["bars", "drop_ledger", "panel_slice", "candidates", "participation", "market_stress", "tick_invalid", "tick_near_action", "per_ticker_coverage", "panel_padded", "consistency", "issue_counts", "issues_capped", "causality_report", "eligibility_schedule", "exclusions", "feat_zscore", "feat_hedge_ratio", "manifest_pending"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)[:10] if hasattr(v, "year") else v
    return sorted(str([plain(v) for v in r]) for r in frame)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(columns).collect()) == rows(duck.execute(f"select {quoted} from ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert "eligible" in df.columns and df.count() > 0


def test_causality_report_tells_causal_from_leaky(spark):
    got = {}
    for r in catalogue.causality_report(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.feature, []).append((r.passed, r.n_bad))
    assert all(ok for n in ("trailing_mean", "zscore", "several") for ok, _ in got[n])
    assert not any(ok for n in ("full_zscore", "minmax", "centred", "next") for ok, _ in got[n])
