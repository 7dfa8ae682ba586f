"""Helpers shared by the training-data operators.

Texts travel to Python through Arrow batches; intermediate tables are staged in the shared folder.
"""

from __future__ import annotations

import ctypes
import pickle
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stage import discard, materialize, new_folder, release

__all__ = [
    "BROADCAST_ROWS", "CACHE_WORDS", "WordHash", "discard", "give_back", "kept", "labelled_sample", "learn", "map_rows", "materialize", "new_folder", "quoted", "read", "release",
    "remainder", "slices", "small",
]

#: Entries of a worker's word cache; it is emptied when full, so memory stays bounded.
CACHE_WORDS = 100_000
#: Rows, and bytes of text, that become Python objects at once; a longer text comes alone.
STEP, STEP_BYTES = 1000, 1 << 20
#: Seconds without a task after which a worker lets go of what it keeps between tasks.
KEPT_S = 3.0
#: Rows of a broadcast side at most, where each row is a number or two.
BROADCAST_ROWS = 200_000


class WordHash(dict):
    """word -> 8 bytes of a 64-bit hash, remembered for up to ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes | str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word if isinstance(word, bytes) else word.encode("utf-8", "replace"))
        return value


def give_back() -> None:
    """Return freed memory to the system: an idle worker process would else keep a task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


_kept: dict[Any, Any] = {}
_last: list[threading.Timer] = []


def _let_go() -> None:
    _kept.clear()
    give_back()


@contextmanager
def kept(key: Any, make: Callable[[], Any]) -> Iterator[Any]:
    """What ``make()`` gives, for one task; the worker's next task finds it again, if that begins within ``KEPT_S``.

    A worker keeps one such thing, and none ``KEPT_S`` after the last task that used it: workers outlive
    an operator, and share their executor's memory with those that follow.
    """
    while _last:
        _last.pop().cancel()
    value = _kept.get(key)
    if value is None:
        _kept.clear()
        value = _kept[key] = make()
    try:
        yield value
    finally:
        _last.append(threading.Timer(KEPT_S, _let_go))
        _last[-1].daemon = True
        _last[-1].start()


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., list[tuple]]], *columns: str) -> DataFrame:
    """Apply ``start()`` once per task, then its result to the Python lists of ``columns`` of each slice.

    The function returns rows as tuples in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    frame = df.select(*columns)
    target = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch):
                rows = work(*(c.to_pylist() for c in part.columns))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
        give_back()

    return frame.mapInArrow(run, schema)


def cuts(columns: list[pa.Array], rows: int) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of at most STEP rows and, unless one row has more, STEP_BYTES of texts and lists."""
    held = np.zeros(rows + 1, dtype=np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            held[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        elif pa.types.is_list(column.type):
            held[1:] += 8 * np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < rows:
        end = min(at + STEP, max(at + 1, int(np.searchsorted(held, held[at] + STEP_BYTES, side="right")) - 1))
        yield at, end - at
        at = end


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in cuts(batch.columns, batch.num_rows):
        yield batch.slice(*part)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def small(side: DataFrame) -> DataFrame:
    """A staged table of one or two numbers a row, broadcast if it has few rows; else the join shuffles."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % by


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, learn_from_fold: bool, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` documents with labels outside the held-out fold, chosen by a hash of the id.

    ``rows`` bounds what is broadcast (ids) and what one training task reads: of rows that repeat an id,
    one is learned from. Labels other than 0 and 1 and null ids are left out; ids labelled in
    contradiction count with their larger label.
    """
    spark = docs.sparkSession
    inside = remainder("doc_id", folds) == fold
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).filter(inside if learn_from_fold else ~inside)
    picked = usable.groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = spark.createDataFrame(picked.collect(), picked.schema)  # at most `rows` pairs of numbers
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(found), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def learn(sample: DataFrame, start: Callable[[], tuple[Callable, Callable]]) -> object | None:
    """Run a trainer in one task over a bounded sample (text, y) and return its model, None without rows.

    ``start()`` gives ``add(texts, ys)``, called for each slice, and ``finish()``, which returns the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = start()
        seen = 0
        for batch in batches:
            for part in slices(batch):
                add(*(c.to_pylist() for c in part.columns))
                seen += part.num_rows
        if seen:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(finish())], pa.binary())})
        del add, finish
        give_back()

    ordered = sample.select("text", "y").repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "y")
    rows = ordered.mapInArrow(run, "model binary").collect()  # one model of a fixed size
    return pickle.loads(rows[0][0]) if rows else None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
