"""A text model's score as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cuts, give_back, quoted


def scorer(start: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """A function from a text column to the scores; ``start()`` runs once per task, its result on each slice."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in batches:
            yield pa.array([float(x) for at, n in cuts([texts], len(texts)) for x in work(texts.slice(at, n).to_pylist())], pa.float64())
        give_back()

    return of


def with_scores(docs: DataFrame, score: Callable[[Column], Column], threshold: float, *keep: str) -> DataFrame:
    """``keep`` columns (if none is named all, but for older ones with the two names below), score double and predicted int."""
    kept = keep or [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*(F.col(quoted(k)) for k in kept), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
