"""Line dedup: documents probe a sharded minimal perfect hash of all lines.

Distinct line hashes are counted once; each shard of them becomes a minimal
perfect hash that indexes three compact arrays: a 16-bit fingerprint, the
number of occurrences (in the narrowest integer type that holds the shard's
highest) and the first document (lowest id, then digest of its text).  The
shards are a table in the shared folder.  Then the documents' line hashes (no
texts) are routed to the shard that they probe, a stream behind the shard's
arrays, so a line that occurs in every document costs no memory.  A shard has
a stream for every ``STREAM_LINES`` lines that probe it, so such a line is
spread over as many tasks as it needs.  A line stays where its first document
has it first and goes everywhere else.

Defined results: blank lines always stay and are never counted; a line inside
a document stays at its first position; null texts stay null with 0 lines; a
row with a null id stays as it is and its lines count for no one; repeated
rows (same id and text) count as one document and come out alike (the SQL is
for unique ids); rows of one id with different texts are documents of their
own; the empty text has one blank line; an empty table gives an empty result; other columns are ignored.  Two
different lines are taken for one only if all 64 bits of their hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._store import written
from ._words import slices, text_column
from .exact_dedup import digest
from .fuse import PerfectHash

#: Occurrences from which a line is repeated, distinct lines of a shard, lines of a stream that probes it.
MIN_COUNT, SHARD_LINES, STREAM_LINES = 2, 200_000, 400_000


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            split = pc.split_pattern(text_column(batch, "text"), "\n")
            offsets = split.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            flat = split.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            position = np.arange(len(flat)) - offsets[:-1][row]
            encoded = flat.dictionary_encode()
            code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words = encoded.dictionary.to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words], np.uint64)
            blank = np.array([not x.strip() for x in words], bool)
            first = np.zeros(len(code), bool)
            first[np.unique(row * max(1, len(words)) + code, return_index=True)[1]] = True
            keep = np.flatnonzero(~blank[code]) if len(code) else np.zeros(0, np.int64)
            ids, digests = (batch.column(batch.schema.get_field_index(c)).take(pa.array(row[keep])) for c in ("doc_id", "digest"))
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array(position[keep], pa.int32()), pa.array(hashes[code[keep]].astype(np.int64)), pa.array(first[keep])], names=["doc_id", "digest", "position", "hash", "first"])


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, position, hash, first) of every line that isn't blank, written."""
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest"), "text")
    return written(rows.mapInArrow(_lines, "doc_id bigint, digest bigint, position int, hash bigint, first boolean"), "lines")


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _index(key: tuple, table: pa.Table) -> pa.Table:
    keys = table.column("hash").to_numpy().astype(np.uint64)
    perfect = PerfectHash.build(keys)
    slot = perfect.slot(keys)
    prints, counts, owners = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint64), np.zeros((len(keys), 2), np.int64)
    prints[slot] = keys.astype(np.uint16)
    counts[slot] = table.column("n").to_numpy()
    owners[slot, 0], owners[slot, 1] = table.column("owner").to_numpy(), table.column("own_digest").to_numpy()
    salts = max(1, -(-int(counts.sum()) // key[1].as_py()))
    counts = _narrow(counts)
    own = {"shard": [key[0].as_py()], "salts": [salts], "hashing": [perfect.dumps()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "width": [counts.itemsize], "owners": [owners.tobytes()]}
    return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "width", "salts") else pa.binary()) for k, v in own.items()})


INDEX = "shard int, salts int, hashing binary, prints binary, counts binary, width int, owners binary"


def line_index(lines: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The shards' perfect hashes and arrays as a written table, and their number."""
    counts = lines.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest")).alias("o"))
    distinct = written(counts.select("hash", "n", F.col("o.doc_id").alias("owner"), F.col("o.digest").alias("own_digest")), "line-counts")
    shards = max(1, -(-distinct.count() // shard_lines))
    keyed = distinct.select(shard_of(shards).alias("shard"), F.lit(STREAM_LINES).alias("stream"), "hash", "n", "owner", "own_digest")
    return written(keyed.groupBy("shard", "stream").applyInArrow(_index, INDEX), "line-index"), shards


def shard_of(shards: int):
    return F.pmod(F.shiftrightunsigned("hash", 20), F.lit(shards)).cast("int")


def _probe(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, arrays = None, None
        for batch in batches:
            kind = batch.column(batch.schema.get_field_index("hashing"))
            heads = np.flatnonzero(pc.is_valid(kind).to_numpy(zero_copy_only=False))
            edges = [0, *heads.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if b > a and kind[a].is_valid:
                    row = {k: part.column(part.schema.get_field_index(k))[0].as_py() for k in ("hashing", "prints", "counts", "width", "owners")}
                    perfect = PerfectHash.loads(row["hashing"])
                    arrays = np.frombuffer(row["prints"], np.uint16), np.frombuffer(row["counts"], f"<u{row['width']}"), np.frombuffer(row["owners"], np.int64).reshape(-1, 2)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                get = lambda c: part.column(part.schema.get_field_index(c))
                keys = get("hash").to_numpy(zero_copy_only=False).astype(np.uint64)
                slot = perfect.slot(keys)
                known = slot >= 0
                slot = np.where(known, slot, 0)
                known &= arrays[0][slot] == keys.astype(np.uint16)
                first = get("first").to_numpy(zero_copy_only=False)
                own = np.stack([get(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "digest")], axis=1)
                gone = known & (arrays[1][slot] >= min_count) & ~(first & (arrays[2][slot] == own).all(axis=1))
                gone = pa.array(gone)
                yield pa.RecordBatch.from_arrays([get(c).filter(gone) for c in ("doc_id", "digest", "position")], names=["doc_id", "digest", "position"])

    return run


LINE = "doc_id bigint, digest bigint, position int, hash bigint, first boolean"


def probes(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The lines with the shard that they probe and the stream of it that they are in."""
    # A row a shard, as a table of its own, so that the optimizer sees its size and sends it around while it is small.
    salts = written(index.select(F.col("shard").alias("_h"), "salts"), "line-streams")
    asked = lines.select(shard_of(shards).alias("shard"), "doc_id", "digest", "position", "hash", "first")
    return asked.join(salts, asked.shard == salts._h).withColumn("salt", F.pmod(F.xxhash64("doc_id", "position"), F.col("salts")).cast("int")).drop("_h", "salts")


def repeated_lines(lines: DataFrame, index: DataFrame, shards: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, digest, position) of the lines that go."""
    none = lambda schema: [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))]
    arrays = "hashing binary, prints binary, counts binary, owners binary, width int"
    asked = probes(lines, index, shards).select("shard", "salt", F.lit(1).alias("kind"), *(x.split()[0] for x in LINE.split(", ")), *none(arrays))
    heads = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *none(LINE), *(x.split()[0] for x in arrays.split(", ")))
    # The arrays of a shard come first in its stream, the lines that probe them after.
    stream = heads.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return stream.mapInArrow(_probe(min_count), "doc_id bigint, digest bigint, position int")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            gone = batch.column(batch.schema.get_field_index("gone"))
            total = pc.add(pc.count_substring(texts, "\n"), 1)
            total = pc.fill_null(total.cast(pa.int32()), 0)
            dropped = pc.fill_null(pc.list_value_length(gone), 0)
            out = texts
            if pc.any(pc.greater(dropped, 0)).as_py():
                rows = texts.to_pylist()
                for i in np.flatnonzero(dropped.to_numpy(zero_copy_only=False)):
                    own = rows[i].split("\n")
                    for k in gone[int(i)].as_py():
                        own[k] = None
                    rows[i] = "\n".join(x for x in own if x is not None)
                out = pa.array(rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), out, total, dropped.cast(pa.int32())], names=["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_count: int = MIN_COUNT, shard_lines: int = SHARD_LINES) -> DataFrame:
    """doc_id, the ``text`` without repeated lines, ``n_lines`` before and ``n_dropped``."""
    lines = line_table(docs)
    index, shards = line_index(lines, shard_lines)
    gone = repeated_lines(lines, index, shards, min_count).groupBy("doc_id", "digest").agg(F.collect_set("position").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "gone")
    base = docs.select("doc_id", "text", digest().alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.join(gone, (base.doc_id == gone._id) & (base.digest == gone._digest), "left").select("doc_id", "text", "gone").mapInArrow(_rewrite, f"doc_id {kind}, text string, n_lines int, n_dropped int")


def oracle_sql() -> str:
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents WHERE text IS NOT NULL),
    m AS (SELECT *, count(*) OVER (PARTITION BY line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, position) AS k FROM l),
    f AS (SELECT *, trim(line) = '' OR n < {MIN_COUNT} OR k = 1 AS stays FROM m)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE stays), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS n_dropped
    FROM f GROUP BY doc_id"""
