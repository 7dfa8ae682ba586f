"""Approximate nearest neighbours by inner product: score-aware quantisation, then exact reranking.

Codebooks of 16 centres a subspace are fitted to a bounded sample under the anisotropic loss, which
weighs the part of a residual that is parallel to its vector ``PARALLEL`` times the rest: errors along
a vector are what changes its inner products with the queries that it matters for. Every row gets
one 4-bit code a subspace. A block of queries scans a block of rows through lookup tables, two codes
a byte; the best rows of each block are scored again exactly, in double precision. So is every other
row that may reach the k-th of these scores, judged by its approximate score and the length of what its
codes leave of it: the result is that of brute force, and codes only say how many rows need scoring.

Rows of a block with equal vectors are one entry of the scan, which stands for their smallest ids. The
rows of a block are bounded, the queries of a block too; blocks of queries meet blocks of rows
through an equi-join on a grid, and a query's partial results are reduced before and after a shuffle.

Edge cases: vectors that are null, zero, of another length than most (the smallest of equally frequent
lengths), or hold null or non-finite numbers take no part; ties go to the smaller id; rows that repeat an id are candidates
each, but never for a query of the same id; query rows of equal id and vector give one list, those of
equal id and different vectors a list each; further columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Rows that codebooks are fitted to, at most; numbers of a subspace; weight of the parallel part.
TRAIN_ROWS, WIDTH, PARALLEL, ROUNDS = 4096, 2, 4.0, 6
#: Rows and queries of a block at most, and entries of a block that are scored exactly for each query at least.
ROWS, QUERIES, RERANK = 32_768, 8192, 200
#: Lists of a query that are merged at once; queries that a scan of a block serves at once, and entries of a slice of it.
MERGED, GROUP, SLICE = 64, 32, 2048


def usable(vector: Column) -> Column:
    numbers = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(numbers, bad), F.lit(True)) & F.coalesce(F.exists(numbers, lambda x: x != 0), F.lit(False))


class Quantiser:
    """Product codebooks (subspaces, 16, WIDTH) under the anisotropic loss."""

    def __init__(self, sample: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        self.dim = sample.shape[1]
        x = self.split(sample)
        self.books = x[rng.integers(0, len(sample), (16, x.shape[1])), np.arange(x.shape[1])].transpose(1, 0, 2).copy()
        self.books += rng.normal(0, 1e-3 * (np.abs(sample).mean() + 1e-9), self.books.shape)
        for _ in range(ROUNDS):
            codes = self.codes(sample)
            self._refit(x, self._unit(sample), codes)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, WIDTH); an even number of subspaces, zeros at the end."""
        parts = -(-x.shape[1] // WIDTH)
        padded = np.zeros((len(x), (parts + parts % 2) * WIDTH))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), -1, WIDTH)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return self.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))

    def codes(self, rows: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the loss, from the nearest centres."""
        x, u = self.split(rows), self._unit(rows)
        near = lambda m: ((x[:, m, None] - self.books[m]) ** 2).sum(2)
        codes = np.stack([near(m).argmin(1) for m in range(x.shape[1])], 1)
        along = lambda m: ((x[:, m, None] - self.books[m]) * u[:, m, None]).sum(2)
        at = np.arange(len(x))
        parallel = sum(along(m)[at, codes[:, m]] for m in range(x.shape[1]))
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                a = along(m)
                others = parallel - a[at, codes[:, m]]
                codes[:, m] = (near(m) + (PARALLEL - 1) * (others[:, None] + a) ** 2 - (PARALLEL - 1) * others[:, None] ** 2).argmin(1)
                parallel = others + a[at, codes[:, m]]
        return codes.astype(np.uint8)

    def _refit(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """Centres that minimise the loss for given codes, one subspace after the other."""
        residual = lambda m: ((x[:, m] - self.books[m][codes[:, m]]) * u[:, m]).sum(1)
        parallel = sum(residual(m) for m in range(x.shape[1]))
        for m in range(x.shape[1]):
            others = parallel - residual(m)
            for c in range(16):
                mine = codes[:, m] == c
                if mine.any():
                    v, d = u[mine, m], x[mine, m]
                    left = np.eye(WIDTH) * len(d) + (PARALLEL - 1) * v.T @ v
                    right = d.sum(0) + (PARALLEL - 1) * (v * (others[mine] + (d * v).sum(1))[:, None]).sum(0)
                    self.books[m, c] = np.linalg.solve(left, right)
            parallel = others + residual(m)

    def packed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subspaces / 2, rows): two codes a byte; and how far each row's score may be from the approximate one, for a query of length 1."""
        c, x = self.codes(rows), self.split(rows)
        left = np.sqrt(((x - self.books[np.arange(c.shape[1]), c]) ** 2).sum((1, 2)))
        rounding = (c.shape[1] + 4) * 2.0**-23 * (np.linalg.norm(rows, axis=1) + left)  # tables and their sums are single precision
        return np.ascontiguousarray((c[:, ::2] | (c[:, 1::2] << 4)).T), left + rounding

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(subspaces / 2, queries, 256): the inner products that each byte stands for."""
        one = np.einsum("qmw,mcw->mqc", self.split(queries), self.books)
        return (one[::2, :, None, :] + one[1::2, :, :, None]).reshape(len(one) // 2, len(queries), 256).astype(np.float32)


def fit(vectors: DataFrame, rows: int = TRAIN_ROWS) -> Quantiser:
    """Codebooks from a bounded sample of (id, v), chosen by a hash."""
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(rows).select("v")
    return Quantiser(np.array([r[0] for r in sample.collect()]))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _entries(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and their number for each distinct vector, and these vectors; ``ids`` ascend.

    The 2 k smallest ids, each at most k times, hold the k smallest other than any one id.
    """
    held: dict[bytes, list[int]] = {}
    first = []
    for i, (number, row) in enumerate(zip(ids.tolist(), x, strict=True)):
        mine = held.setdefault(row.tobytes(), [])
        if not mine:
            first.append(i)
        if len(mine) < 2 * k and (len(mine) < k or mine[-k] != number):
            mine.append(number)
    return np.array([i for mine in held.values() for i in mine], dtype=np.int64), np.array([len(mine) for mine in held.values()], dtype=np.int64), x[first]


def _exact(entries: np.ndarray, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids that these entries stand for and their scores."""
    # sums from the first component to the last, whatever else is scored beside
    scores, many = np.cumsum(x[entries] * query, axis=1)[:, -1], counts[entries]
    mine = ids[np.repeat(starts[entries] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    scores = np.repeat(scores, many)[mine != query_id]
    mine = mine[mine != query_id]
    kept = _top(scores, mine, k)
    return mine[kept], scores[kept]


def _scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, entries): the sums of what the bytes of each entry stand for; a slice of entries at a time stays in a core's cache."""
    by_byte = np.ascontiguousarray(tables.transpose(0, 2, 1))
    near = np.empty((tables.shape[1], codes.shape[1]), dtype=np.float32)
    for at in range(0, codes.shape[1], SLICE):
        part = codes[:, at : at + SLICE]
        total = np.zeros((part.shape[1], tables.shape[1]), dtype=np.float32)
        for table, code in zip(by_byte, part, strict=True):
            total += table.take(code, axis=0)
        near[:, at : at + SLICE] = total.T
    return near


def _best(
    queries: np.ndarray, query_ids: np.ndarray, near: np.ndarray, own: np.ndarray, reach: np.ndarray, norms: np.ndarray, x: np.ndarray,
    starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int, rerank: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best ids among the entries of a block and their scores; ``own`` marks entries that stand for the query's own id only."""
    lengths = np.linalg.norm(queries, axis=1)
    if len(counts) <= rerank:
        every = np.arange(len(counts))
        return [_exact(every, x, starts, counts, ids, q, i, k) for q, i in zip(queries, query_ids, strict=True)]
    least = np.full(len(queries), -np.inf)
    for j, (q, i) in enumerate(zip(queries, query_ids, strict=True)):
        _, scores = _exact(np.argpartition(np.where(own[j], np.inf, -near[j]), rerank)[:rerank], x, starts, counts, ids, q, i, k)
        if len(scores) == k:
            least[j] = scores[-1]
    # all that may reach the k-th score by the bound of their codes, then but for rounding; one product scores those of all queries
    may = ~(near + (lengths[:, None] * reach).astype(np.float32) < np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]) & ~own
    some = np.flatnonzero(may.any(axis=0))
    scores = queries @ x[some].T
    may = may[:, some] & ~(scores < least[:, None] - 1e-9 * lengths[:, None] * norms[some])
    return [_exact(some[m], x, starts, counts, ids, q, i, k) for m, q, i in zip(may, queries, query_ids, strict=True)]


def search(vectors: DataFrame, *, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", rerank: int = RERANK, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row that ``queries`` marks."""
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    all_rows = all_rows.filter(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = all_rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.count_if("q").alias("q"))
    common = lengths.orderBy(F.desc("n"), "length").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_rows = all_rows.filter(F.size("v") == common[0]["length"])
    sent = spark.sparkContext.broadcast(fit(all_rows))
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"  # of vectors between tasks
    # few copies of the blocks between tasks, but work for all cores
    row_blocks = max(1, -(-common[0]["n"] // rows))
    query_blocks = max(1, -(-common[0]["q"] // block), min(-(-common[0]["q"] // 256), -(-2 * spark.sparkContext.defaultParallelism // row_blocks)))

    def blob(frame: DataFrame, parts: int, name: str, encode: bool) -> DataFrame:
        """One row a part as bytes: ids and vectors; on request the entries of distinct vectors, with their codes, numbers of ids and reach."""
        fields = [(name, pa.int64()), *((c, pa.binary()) for c in ("ids", "vectors", "codes", "counts", "reach"))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(part: int, ids: list, held: list) -> pa.RecordBatch:
                ids, x = np.concatenate(ids), np.concatenate(held) + 0.0  # no -0.0, equal vectors have equal bytes
                counts, codes, reach = np.array([], np.int64), np.array([], np.uint8), np.array([])
                if encode:
                    ids, counts, x = _entries(ids, x, k)
                    codes, reach = sent.value.packed(x)
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((part, *(a.tobytes() for a in (ids, x.astype(kind), codes, counts, reach))), fields, strict=True)], schema=pa.schema(fields))

            now, ids, held = None, [], []
            for batch in batches:
                part = batch.column(0).to_numpy()
                x = batch.column(2).flatten().to_numpy().reshape(-1, sent.value.dim)
                for p in dict.fromkeys(part.tolist()):
                    if now is not None and p != now:
                        yield out(now, ids, held)
                        ids, held = [], []
                    now = p
                    ids.append(batch.column(1).to_numpy()[part == p])
                    held.append(x[part == p])
            if now is not None:
                yield out(now, ids, held)

        dealt = frame.select(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias(name), "id", "v").repartition(parts, name).sortWithinPartitions(name, "id", "v")
        return dealt.mapInArrow(run, f"{name} long, ids binary, vectors binary, codes binary, counts binary, reach binary")

    of_rows = materialize(blob(all_rows, row_blocks, "row_block", True), "rows").withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    of_queries = blob(all_rows.filter("q").select("id", "v").distinct(), query_blocks, "query_block", False).select("query_block", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    result = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, codes, counts, reach, query_ids, q = (np.frombuffer(c[i].as_buffer(), dtype=t) for c, t in zip(batch.columns[:-2], ("<i8", kind, "u1", "<i8", "<f8", "<i8", kind), strict=True))
                block_number, row_block = batch.column(7)[i].as_py() << 32, batch.column(8)[i].as_py()
                x, q = (v.astype(np.float64).reshape(-1, sent.value.dim) for v in (x, q))
                codes = codes.reshape(-1, len(counts))
                starts = np.cumsum(counts) - counts
                low, high = ids[starts], ids[starts + counts - 1]
                norms = np.linalg.norm(x, axis=1)
                for at in range(0, len(query_ids), GROUP):
                    some, some_ids = q[at : at + GROUP], query_ids[at : at + GROUP]
                    near = _scan(sent.value.tables(some), codes)
                    own = (low == some_ids[:, None]) & (high == some_ids[:, None])
                    out: tuple[list, ...] = [], [], [], [], []
                    best = _best(some, some_ids, near, own, reach, norms, x, starts, counts, ids, k, rerank)
                    for j, (query_id, (found, scores)) in enumerate(zip(some_ids, best, strict=True)):
                        for column, values in zip(out, (np.full(len(found), block_number + at + j), np.full(len(found), query_id), np.full(len(found), row_block), found, scores), strict=True):
                            column.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=result)

    names = ["ids", "vectors", "codes", "counts", "reach", "query_ids", "query_vectors", "query_block", "row_block"]
    grid = of_rows.join(of_queries, "query_block").select(names).repartition(row_blocks * query_blocks, "row_block", "query_block")
    found = grid.mapInArrow(scan, "query long, query_id long, part long, vec_id long, score double")
    # a query's block and place number it, as ids may repeat; its lists are merged a bounded number at once
    while True:
        lists = found.groupBy("query", "query_id", F.floor(F.col("part") / MERGED).alias("part")).agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")).alias("all"))
        best = lists.select("query", "query_id", "part", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("pos", "x"))
        row_blocks = -(-row_blocks // MERGED)
        if row_blocks == 1:
            return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
        found = best.select("query", "query_id", "part", "x.vec_id", "x.score")


def sql(table: str = "embeddings", *, queries: str = "vec_id % 20 = 0", k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> str:
    """The same by brute force for DuckDB, where vectors have one length."""
    return f"""
WITH usable AS (
  SELECT {id_column} AS id, {queries} AS q, CAST({vector} AS DOUBLE[]) AS v FROM {table} WHERE {id_column} IS NOT NULL AND {vector} IS NOT NULL
), kept AS (
  SELECT * FROM usable WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), scored AS (
  SELECT a.id AS query_id, b.id AS vec_id, list_inner_product(a.v, b.v) AS score FROM (SELECT DISTINCT id, v FROM kept WHERE q) a JOIN kept b ON a.id <> b.id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
