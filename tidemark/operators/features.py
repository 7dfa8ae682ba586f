"""Feature queries over a long panel (symbol, date, x): causal ones, and known leaks for the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, enough, history, ratio

KEYS = ["symbol", "date"]


def _of(df: DataFrame, **columns) -> DataFrame:
    return df.select(*KEYS, *(c.alias(n) for n, c in columns.items()))


def trailing_mean(df: DataFrame, n: int = 20, lag: int = 0) -> DataFrame:
    w = history(n - 1 + lag, lag)
    return _of(df, value=enough(F.avg("x").over(w), "x", w, n))


def trailing_zscore(df: DataFrame, n: int = 60) -> DataFrame:
    """Distance from the mean of the ``n`` rows before, in their standard deviations."""
    w = history(n, 1)
    z = ratio(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w))
    return _of(df, value=enough(z, "x", w, n))


def expanding_mean(df: DataFrame, least: int = 30) -> DataFrame:
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return _of(df, value=enough(F.avg("x").over(w), "x", w, least))


def lagged_return(df: DataFrame, n: int = 5) -> DataFrame:
    return _of(df, value=ratio(F.col("x"), F.lag("x", n).over(by_date())) - 1)


def several(df: DataFrame, n: int = 60, short: int = 20) -> DataFrame:
    """z-score, trailing volatility of returns and the sign of the last move, as three columns."""
    w, v = history(n, 1), history(short - 1)
    known = df.withColumn("r", ratio(F.col("x"), F.lag("x").over(by_date())) - 1)
    z = enough(ratio(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w)), "x", w, n)
    return _of(known, z=z, vol=enough(F.stddev_samp("r").over(v), "r", v, short), sign=F.signum("r"))


def pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """(symbol, date, y, x) of two symbols on common dates, under the name a/b."""
    side = lambda s, n: df.filter(F.col("symbol") == s).select("date", F.col("x").alias(n))
    return side(a, "y").join(side(b, "x"), "date").withColumn("symbol", F.lit(f"{a}/{b}"))


def rolling_beta(pairs: DataFrame, n: int = 60) -> DataFrame:
    """Hedge ratio of the ``n`` rows before and the spread that it leaves."""
    w = history(n, 1)
    beta = enough(ratio(F.covar_samp("y", "x").over(w), F.var_samp("x").over(w)), "x", w, n)
    return _of(pairs.withColumn("b", beta), beta=F.col("b"), spread=F.col("y") - F.col("b") * F.col("x"))


def fixed_beta(pairs: DataFrame, beta: float = 1.5) -> DataFrame:
    return _of(pairs, spread=F.col("y") - F.lit(beta) * F.col("x"))


def _whole():
    return Window.partitionBy("symbol")


def leak_full_zscore(df: DataFrame) -> DataFrame:
    w = _whole()
    return _of(df, value=ratio(F.col("x") - F.avg("x").over(w), F.stddev_samp("x").over(w)))


def leak_centred(df: DataFrame, side: int = 10) -> DataFrame:
    w = by_date().rowsBetween(-side, side)
    return _of(df, value=enough(F.avg("x").over(w), "x", w, 2 * side + 1))


def leak_next(df: DataFrame) -> DataFrame:
    return _of(df, value=F.lead("x").over(by_date()))


def leak_minmax(df: DataFrame) -> DataFrame:
    w = _whole()
    return _of(df, value=ratio(F.col("x") - F.min("x").over(w), F.max("x").over(w) - F.min("x").over(w)))


def leak_full_beta(pairs: DataFrame) -> DataFrame:
    """Hedge ratio of the whole sample: sample covariance over population variance."""
    w = _whole()
    return _of(pairs.withColumn("b", ratio(F.covar_samp("y", "x").over(w), F.var_pop("x").over(w))), spread=F.col("y") - F.col("b") * F.col("x"))


def leak_future_max(df: DataFrame) -> DataFrame:
    ahead = by_date().rowsBetween(0, Window.unboundedFollowing)
    return _of(df, value=ratio(F.col("x"), F.max("x").over(ahead)))


def leak_backfill(df: DataFrame, hole) -> DataFrame:
    """Holes (rows for which ``hole`` holds) filled from the next known row."""
    ahead = by_date().rowsBetween(0, Window.unboundedFollowing)
    known = df.withColumn("x", F.when(~hole, F.col("x")))
    return _of(known, value=F.first("x", ignorenulls=True).over(ahead))


def weekly(df: DataFrame) -> DataFrame:
    """Weekly means, labelled by the week's Sunday: labels that the input does not have."""
    week = F.date_add(F.date_trunc("week", "date").cast("date"), 6)
    return df.groupBy("symbol", week.alias("date")).agg(F.avg("x").alias("value"))


CAUSAL = {"trailing_mean": trailing_mean, "trailing_mean_lag1": lambda df: trailing_mean(df, lag=1), "zscore": trailing_zscore, "expanding_mean": expanding_mean, "lagged_return": lagged_return, "several": several}
LEAKY = {"full_zscore": leak_full_zscore, "centred": leak_centred, "next": leak_next, "minmax": leak_minmax, "future_max": leak_future_max}
