"""Exact dedup: fuse filters of immutable snapshots screen incoming digests.

The table is taken as batches in order of ids.  Each batch but the last is,
once taken in, an immutable snapshot with a static binary fuse filter over its
distinct digests, sharded by digest and kept as a table in the shared folder.
An incoming digest is routed to its shard and looked up in the filters of the
snapshots before its batch; digests that no filter holds are new for sure.
Positives (true copies, and 1 in 256 others) are joined with the exact bucket
of their digest, where texts are compared byte by byte.  Copies inside a batch
are grouped separately, by digest, and go through the same byte check.

Only digests (8 bytes a document) are shuffled for the screening.  Texts of
suspects alone move, each distinct one once a task: documents that the
screening clears are dropped at the scan while the suspects' digests are at
most ``BROADCAST_DIGESTS`` (their number is counted first); beyond, a shuffled
join on the digest brings them together.

Defined results: a null text, and a row with a null id, is never a copy and is
always kept; empty texts are copies of each other; of equal texts the lowest
id is kept; of repeated rows (same id and text) one is kept; rows of one id
with different texts are decided each by its own text; an empty table
gives an empty result; other columns, whatever their names, are carried along
by :func:`deduplicate` and ignored by :func:`groups`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import written
from .fuse import FuseFilter

#: Batches the table is taken in as, and documents of a filter's shard.
BATCHES, SHARD_DOCS = 4, 500_000
#: Digests of suspects up to which they are sent to every scan (16 to 32 bytes each in its hash table).
BROADCAST_DIGESTS = 4_000_000


def digest(text: str = "text"):
    """64 bits of a text, null for a null text."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, digest, batch) of the rows that can be copies, as a written table."""
    base = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    low, high, n = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not n:
        low, high = 0, 0
    batch = F.floor((F.col("doc_id").cast("double") - low) * batches / (float(high) - low + 1)).cast("int")
    shard = F.pmod(F.shiftrightunsigned("digest", 32), F.lit(max(1, -(-n // SHARD_DOCS)))).cast("int")
    return written(base.select("doc_id", digest().alias("digest"), batch.alias("batch")).withColumn("shard", shard), "digests")


def _build(key: tuple, table: pa.Table) -> pa.Table:
    keys = np.unique(table.column("digest").to_numpy().astype(np.uint64))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "snapshot": pa.array([key[1].as_py()], pa.int32()), "filter": pa.array([FuseFilter.build(keys).dumps()], pa.binary())})


def _screen(key: tuple, incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = incoming.column("digest").to_numpy().astype(np.uint64)
    batch = incoming.column("batch").to_numpy()
    hit = np.zeros(len(keys), bool)
    for snapshot, data in zip(filters.column("snapshot").to_pylist(), filters.column("filter").to_pylist()):
        later = np.flatnonzero(batch > snapshot)
        hit[later] |= FuseFilter.loads(data).contains(keys[later])
    return pa.table({"digest": incoming.column("digest").filter(pa.array(hit))})


def snapshot_filters(table: DataFrame) -> DataFrame:
    """(shard, snapshot, filter) of every batch but the last."""
    last = table.agg(F.max("batch")).first()[0]
    keys = table.where(F.col("batch") < (last or 0)).select("shard", "batch", "digest")
    return written(keys.groupBy("shard", "batch").applyInArrow(_build, "shard int, snapshot int, filter binary"), "fuse-filters")


def candidates(table: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of more than one document: screened positives, and copies inside a batch."""
    # Within a batch one row per digest is enough to ask the filters.
    per_batch = table.groupBy("shard", "batch", "digest").agg(F.count("*").alias("n"))
    per_batch = written(per_batch, "batch-digests")
    positives = per_batch.where("batch > 0").select("shard", "batch", "digest").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "digest bigint")
    inside = per_batch.where("n > 1").select("digest")
    return positives.union(inside).distinct()


def suspects_of(base: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows whose digest is suspect: dropped at the scan if the digests are few enough, by a shuffled join if not."""
    few = suspects.count() <= BROADCAST_DIGESTS
    return base.join(F.broadcast(suspects) if few else suspects.hint("merge"), "digest", "left_semi")


def copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, digest, keep_id, rows): the documents that share their bytes with another row."""
    table = digests(docs, batches)
    suspects = written(candidates(table, snapshot_filters(table)), "suspects")
    base = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", digest().alias("digest"))
    # Equal digest and equal bytes, combined before the shuffle, so that a text of many copies moves once a task.
    texts = suspects_of(base, suspects).groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    texts = written(texts.drop("text"), "exact-buckets")
    several = written(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "collisions")
    # Nearly every digest has one text: its rows are told by the digest alone.
    found = table.select("doc_id", "digest").join(texts.where("n > 1"), "digest")
    if not several.isEmpty():
        bucket = suspects_of(base, several)
        first = bucket.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
        found = found.join(several, "digest", "left_anti").unionByName(bucket.join(first, ["digest", "text"]).select(*found.columns))
    return found.groupBy("doc_id", "digest", "keep_id").agg(F.count("*").alias("rows"))


def groups(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """A row per row: ``doc_id``, the ``keep_id`` of its group and whether it is a ``duplicate``."""
    found = copies(docs, batches).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keep_id")
    ids = docs.select("doc_id", digest().alias("digest"))
    return ids.join(found, (ids.doc_id == found._id) & (ids.digest == found._digest), "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce(F.col("keep_id") != F.col("doc_id"), F.lit(False)).alias("duplicate"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that ``found`` (doc_id, digest, gone, rows) leaves: none that is gone, one of repeated rows.

    One anti-join takes out both; of the repeated rows alone, one each comes back.
    """
    own = digest()
    pick = lambda rows: rows.select(F.col("doc_id").alias("_id_"), F.col("digest").alias("_digest_"))
    match = lambda rows: (docs.doc_id == rows._id_) & (own == rows._digest_)
    out, again = pick(found.where("gone OR rows > 1")), pick(found.where("NOT gone AND rows > 1"))
    kept = docs.join(out, match(out), "left_anti")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, match(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without copies, with the columns they came with."""
    return without(docs, written(copies(docs, batches).withColumn("gone", F.col("doc_id") != F.col("keep_id")), "copies"))


def oracle_sql() -> str:
    return """SELECT doc_id, coalesce(k, doc_id) AS keep_id, coalesce(k <> doc_id, false) AS duplicate
    FROM (SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL THEN min(doc_id) OVER (PARTITION BY text) END AS k FROM documents)"""
