"""A corpus pipeline: toxicity, quality, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents, whatever their names. Stage results are Parquet, reread as the next stage's documents. Null
and empty texts pass or fail by their scores; they have no near duplicates. Rows that share a doc_id
are documents of their own: of equal or similar texts one row leaves the third stage, unlike texts all
stay. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, quality_model, toxicity
from tidemark.llm.common import materialize, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; documents predicted toxic go."""
    score = toxicity.scorer(spark, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score(docs["text"]) < toxicity.THRESHOLD)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; documents not predicted to be of quality go."""
    score = quality_model.scorer(spark, quality_model.fit(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score(docs["text"]) >= quality_model.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; of each component the document with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The stages learn models and merge tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
