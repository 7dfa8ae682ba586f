"""Structured Streaming over arriving raw bars: the checks that need no later row, by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import ticker_checks as tick


def row_issues(bars: DataFrame) -> DataFrame:
    """(symbol, date, check, detail) for each arriving bar with a defect of its own; stateless."""
    price = {f"{c} not positive": F.col(c) <= 0 for c in ("open", "high", "low", "close")}
    tests = price | {"high below low": F.col("high") < F.col("low"), "negative volume": F.col("volume") < 0, "close missing": F.col("close").isNull()}
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))
    return bars.select("symbol", "date", F.explode(found).alias("detail")).withColumn("check", F.lit("invalid_prices"))


def daily_counts(bars: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Bars and traded bars a day, final once the watermark has passed."""
    day = F.window(F.col(ts), "1 day")
    return bars.withWatermark(ts, late).groupBy(day).agg(F.count("*").alias("n_bars"), F.count_if(F.col("volume") > 0).alias("n_traded")).select(F.col("window.start").cast("date").alias("date"), "n_bars", "n_traded")


def batch_issues(bars: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the issues of each micro-batch to a Parquet table, a folder a batch, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        parts = tick.union([tick.duplicates(batch), tick.missing(batch), tick.invalid_prices(batch)])
        parts.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.unpersist()

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
