"""Daily bars derived from a star schema of order lines: a nation is a symbol, its region the sector.

A line's price is its extended price by quantity; a bar's open and close are the first and last line of
the day in a fixed order, volume counts lines that were not returned, the closing line's discount is the
adjustment and its tax tells a dividend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order in which lines arrive; order and line number alone repeat.
ARRIVAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector) of every nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, date, px, arrival, ...) of every line; nations and regions are a few rows."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = F.broadcast(nation.join(F.broadcast(sectors(spark, sf_dir)), F.col("n_name") == F.col("symbol")).select("n_nationkey", "symbol", "sector"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "symbol", "sector")
    item = table(spark, sf_dir, "lineitem").select(*ARRIVAL, "l_returnflag", "l_shipdate")
    joined = item.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("symbol", "sector", F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.struct(*ARRIVAL).alias("arrival"), "l_quantity", "l_discount", "l_tax", "l_returnflag")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unadjusted bars with adjusted close, dividends and splits, by one partial aggregation."""
    day = lines(spark, sf_dir).groupBy("symbol", "sector", "date").agg(
        F.min_by("px", "arrival").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by(F.struct("px", "l_discount", "l_tax"), "arrival").alias("last"),
        F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))).alias("volume"),
    )
    close = F.col("last.px")
    return day.select("symbol", "sector", "date", "open", "high", "low", close.alias("close"), (close * (1 - F.col("last.l_discount"))).alias("adj_close"), "volume", F.when(F.col("last.l_tax") == 0.08, 0.08 * close).otherwise(0.0).alias("dividends"), F.lit(0.0).alias("splits"))
