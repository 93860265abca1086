"""Exact top-k inner products over vectors in descending length.

All vectors are turned by the right singular vectors of the data (from the
d x d matrix of its products), so a few leading coordinates carry most of a
product.  Base vectors are sorted by descending length and cut in blocks.
Every group of query blocks reads the base blocks from the shared folder in
that order and keeps each query's k best: a base vector is computed in full
only if the product over the leading coordinates plus the Cauchy-Schwarz bound
of the rest can still reach the k-th best, and a group stops reading at the
first base block whose longest vector times each query's length cannot.
Vectors are shuffled twice (one row an id, then ranges of length) however many
blocks there are; nothing is shuffled for the products.

Products are summed in double precision and rounded to ``DIGITS`` places;
equal ones are ordered by neighbour id, and the bounds leave room for the
rounding, so results are exact, ties included.

Defined results: null vectors, rows with a null id, and vectors with a null,
infinite or undefined entry are neither queries nor neighbours; the zero
vector is like any other; repeated rows count once (the first by entries);
vectors of different dimensions are an error; with at
most k others all are returned; an empty table gives an empty result; other
columns are ignored.  A vector is not its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import written

K, BLOCK, LEAD, DIGITS = 10, 4096, 16, 6
#: Bytes of a group of queries, in double precision.
GROUP_BYTES = 64 << 20
_SLACK = 2 * 10.0**-DIGITS


def _single(vectors: DataFrame) -> bool:
    return isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)


def clean(vectors: DataFrame) -> DataFrame:
    """(id, v): one row per id, finite numbers only, in single precision if they came so."""
    v = F.col("embedding") if _single(vectors) else F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(ok).select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        m = matrix(batch.column(0))
        if len(m):
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n or n and len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of several dimensions")
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first (d x d, bounded by the dimension)."""
    rows = vectors.select("v").mapInArrow(_gram, "g array<double>").agg(F.collect_list("g")).first()[0] if not vectors.isEmpty() else []
    if not rows:
        return np.zeros((0, 0))
    total = np.sum([np.array(r) for r in rows], axis=0)
    d = int(round(len(total) ** 0.5))
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(d, d))[1][:, ::-1])


def _block(kind: str):
    """A partition's vectors as one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            table = pa.Table.from_batches(own)
            v, ids = matrix(table.column("v").combine_chunks()), table.column("id").to_numpy()
            length = np.linalg.norm(v, axis=1)
            order = np.lexsort([ids, -length])
            yield pa.RecordBatch.from_arrays([pa.array([float(length.max())]), pa.array([len(v)], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([v[order].astype(kind).tobytes()], pa.binary())], names=["longest", "n", "ids", "plain"])

    return run


def blocks(vectors: DataFrame, block: int, kind: str = "<f8") -> DataFrame:
    """Blocks of vectors in descending length, as binary matrices of the vectors' own precision, written one a file."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    parts = max(1, -(-vectors.count() // block))
    # Range partitions of the length are the blocks; no global sort in one task.
    ranged = vectors.withColumn("length", length).repartitionByRange(parts, F.desc("length"), "id").select("id", "v")
    return written(ranged.mapInArrow(_block(kind), "longest double, n int, ids binary, plain binary"), "vector-blocks")


def read_block(path: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the block in a file of the shared folder, on whatever file system that is."""
    where, name = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    row = pq.read_table(name, filesystem=where, columns=["n", "ids", "plain"]).to_pylist()[0]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["plain"], kind).reshape(row["n"], -1).astype(np.float64)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then lower id."""
    order = np.lexsort([ids, -scores], axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Best:
    """The k best so far of a group of queries, which base blocks of descending length are offered to."""

    def __init__(self, ids: np.ndarray, plain: np.ndarray, turn: np.ndarray, k: int, lead: int):
        self.ids, self.plain, self.turn, self.k, self.lead = ids, plain, turn, k, lead
        self.length = np.linalg.norm(plain, axis=1)
        self.partial = self.leading(plain)
        self.score, self.best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def leading(self, plain: np.ndarray) -> np.ndarray:
        """The leading turned coordinates and the length of the rest: two such rows' product bounds the vectors' product."""
        turned = plain @ self.turn
        return np.hstack([turned[:, : self.lead], np.sqrt(np.maximum(0, (turned[:, self.lead :] ** 2).sum(axis=1)))[:, None]])

    def reach(self, longest: float) -> np.ndarray:
        """The queries that a vector of that length could still serve."""
        return np.flatnonzero(self.length * longest + _SLACK >= self.score[:, -1])

    def offer(self, live: np.ndarray, ids: np.ndarray, plain: np.ndarray) -> None:
        partial, k = self.leading(plain), self.k
        for a in range(0, len(live), 512):
            own = live[a : a + 512]
            floor = self.score[own, -1] - _SLACK
            hope = self.partial[own] @ partial.T >= floor[:, None]
            many = np.count_nonzero(hope)
            if not many:
                continue
            if many > hope.size // 8:
                product = self.plain[own] @ plain.T
                fresh = np.flatnonzero(~np.isfinite(floor))
                if len(fresh) and len(ids) > k:
                    # No k best yet: this block's own will do (one more, for a vector isn't its own neighbour).
                    floor[fresh] = np.partition(product[fresh], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] - _SLACK
                row, col = np.nonzero(product >= floor[:, None])
                value = product[row, col]
            else:
                row, col = np.nonzero(hope)
                value = np.einsum("ij,ij->i", self.plain[own[row]], plain[col])
            other = ids[col] != self.ids[own[row]]
            row, col, value = row[other], col[other], np.round(value[other], DIGITS)
            if not len(row):
                continue
            hit, at = np.unique(row, return_inverse=True)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            score, cand = np.full((len(hit), place.max() + 1), -np.inf), np.full((len(hit), place.max() + 1), np.iinfo(np.int64).max)
            score[at, place], cand[at, place] = value, ids[col]
            to = own[hit]
            self.score[to], self.best[to] = top(np.hstack([self.score[to], score]), np.hstack([self.best[to], cand]), k)


def _search(files: list[tuple[float, str]], size: int, turn: np.ndarray, k: int, lead: int, kind: str):
    """Groups of ``size`` blocks against all ``files``, which are in descending order of their longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (g for batch in batches for g in batch.column(0).to_pylist()):
            own = [read_block(path, kind) for _, path in files[group * size : (group + 1) * size]]
            q = Best(np.concatenate([x for x, _ in own]), np.vstack([v for _, v in own]), turn, k, lead)
            for longest, path in files:
                live = q.reach(longest)
                if not len(live):
                    break  # later blocks are shorter still
                q.offer(live, *read_block(path, kind))
            row, rank = np.nonzero(np.isfinite(q.score))
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[row]), pa.array((rank + 1).astype(np.int32)), pa.array(q.best[row, rank]), pa.array(q.score[row, rank])], names=["vec_id", "rank", "neighbor", "score"])

    return run


def nearest(vectors: DataFrame, k: int = K, block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """(vec_id, rank, neighbor, score): each vector's k highest inner products with others."""
    spark = vectors.sparkSession
    table = written(clean(vectors), "vectors")
    kind = "<f4" if _single(vectors) else "<f8"
    turn = rotation(table)
    found = blocks(table, block, kind).select("longest", "_metadata.file_path").collect()  # a name a block
    files = sorted(((r.longest, r.file_path) for r in found), key=lambda x: (-x[0], x[1]))
    # Larger groups read the base less often: as many blocks as a worker holds, while there are groups for all cores.
    size = max(1, min(GROUP_BYTES // max(1, block * 8 * len(turn)), len(files) // (2 * spark.sparkContext.defaultParallelism)))
    groups = -(-len(files) // size)
    tasks = spark.range(0, groups, 1, max(1, groups))
    return tasks.mapInArrow(_search(files, size, turn, k, lead, kind), "vec_id bigint, rank int, neighbor bigint, score double")


def oracle_sql() -> str:
    return f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS neighbor, round(list_dot_product(a.e, b.e), {DIGITS}) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor) AS rank FROM p) WHERE rank <= {K}"""
