"""Maximal runs of consecutive flagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, flag: str, *carried: str) -> DataFrame:
    """(keys, start, end, length) of runs of rows with ``flag``, by row position within ``keys``.

    The position among all rows less the position among the flagged ones is constant in a run. The
    ``carried`` columns come from a run's first row.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    among = F.row_number().over(Window.partitionBy(*keys, F.coalesce(F.col(flag), F.lit(False))).orderBy(order))
    marked = df.withColumn("island", position - among).filter(F.col(flag))
    firsts = [F.min_by(c, order).alias(c) for c in carried]
    return marked.groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"), *firsts).drop("island")
