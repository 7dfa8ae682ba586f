import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.operators import ticker_checks as tick
from tidemark.sources import reports, store
from tidemark.streaming import arrivals


def test_raw_zone_is_written_once(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "raw")
    store.write_table(df, path, raw=True)
    with pytest.raises(store.StoreError):
        store.write_table(df, path, raw=True)
    store.write_table(spark.range(3), path, raw=True, refresh=True)
    assert store.read_table(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "absent"))
    rows = store.digests(spark, f"{path}/*.parquet").collect()
    assert rows and all(len(r.digest) == 16 for r in rows)


def test_nanosecond_index(spark, tmp_path):
    frame = pa.table({"Date": pa.array(pd.to_datetime(["2020-01-01", "2020-01-02"]).values, pa.timestamp("ns")), "x": [1.0, 2.0]})
    pq.write_table(frame, tmp_path / "x.parquet", version="2.6")
    got = store.read_nanoseconds(spark, str(tmp_path / "x.parquet"), "Date").orderBy("Date").collect()
    assert [r.Date.date().isoformat() for r in got] == ["2020-01-01", "2020-01-02"]


def test_listings(spark, tmp_path):
    lots = tmp_path / "lots.csv"
    lots.write_text("UNDERLYING , Symbol \nx, NIFTY \nfirst, AAA\nsecond,AAA \nx, \n" + "".join(f"x,S{i}\n" for i in range(120)))
    got = {r.symbol: r.underlying for r in store.underlyings(spark, str(lots)).collect()}
    assert len(got) == 121 and got["AAA"] == "first" and "NIFTY" not in got
    with pytest.raises(store.SourceError, match="fewer"):
        store.underlyings(spark, str(lots), least=200)
    index = tmp_path / "index.csv"
    index.write_text("Company Name,Industry,Symbol\nA Ltd,Banks,AAA\nB Ltd,,BBB\nC Ltd,Oil,BBB\nD,Steel,AAA\n")
    assert [tuple(r) for r in store.constituents(spark, str(index)).collect()] == [("AAA", "A Ltd", "Banks")]
    index.write_text("a,b\n1,2\n")
    with pytest.raises(store.SourceError, match="no columns"):
        store.constituents(spark, str(index))


def test_report_files(spark, tmp_path):
    issues = spark.createDataFrame([("gaps", "WARN", "A", None, "", 6.0, 6), ("coverage", "FATAL", "B", None, "", None, 1)], "check string, severity string, symbol string, date date, detail string, value double, n_affected long")
    metrics = spark.createDataFrame([("A", 0.5, 0.4), ("B", 1.0, 1.0)], "symbol string, coverage double, tradeable_coverage double")
    meta = reports.quality(issues, metrics, str(tmp_path))
    assert meta["usable"] is False and meta["counts"]["gaps"]["WARN"] == 6
    assert "NOT usable" in (tmp_path / "summary.md").read_text() and list((tmp_path / "issues").glob("*.csv"))


def test_streaming_checks(spark, tmp_path):
    schema = "symbol string, date date, ts timestamp, open double, high double, low double, close double, adj_close double, volume double"
    rows = [("A", "2020-01-01", 1.0, 2.0, 0.5, 1.0, 1.0, 5.0), ("A", "2020-01-01", 1.0, 0.1, 0.5, 1.0, 1.0, -5.0), ("B", "2020-01-02", 1.0, 2.0, 0.5, None, 1.0, 0.0)]
    bars = spark.createDataFrame([(s, d, d, *x) for s, d, *x in rows], "symbol string, d string, t string, open double, high double, low double, close double, adj_close double, volume double")
    bars = bars.selectExpr("symbol", "cast(d as date) as date", "cast(t as timestamp) as ts", "open", "high", "low", "close", "adj_close", "volume")
    bars.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = arrivals.row_issues(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.detail for r in spark.table("found").collect()) == ["close missing", "high below low", "negative volume"]
    arrivals.batch_issues(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("check = 'duplicate_timestamps'").count() == 1
    assert set(got.drop("batch").columns) == set(tick.ISSUE)
    counts = arrivals.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {(str(r.date), r.n_bars, r.n_traded) for r in spark.table("days").collect()} == {("2020-01-01", 2, 1), ("2020-01-02", 1, 0)}
