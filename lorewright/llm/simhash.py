"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint is a 256-bit SimHash of its words, each weighted by
the cube root of its count (in eighths, so that sums are exact and equal texts
have equal fingerprints).  Two documents are near copies if their fingerprints
differ in at most ``TAU`` bits.

Candidates share a 32-bit block, up to the bits that are least certain: of
each block a document gives the value itself and those with any of its three
bits of smallest margin turned, for near copies differ just there.  The bits
are cut into eight blocks in four ways, and blocks of different cuts have at
most a byte in common, so that pairs at ``TAU`` are found too, not only near
ones.  A candidate must then pass the pigeonring test: the ring of 32
segments of 8 bits must have a chain of ``CHAIN`` consecutive segments each of
whose prefixes of l segments differs in at most l * TAU / 32 bits.  Every pair
within ``TAU`` has such a chain, so the test loses nothing; what passes gets
the full Hamming check.  Only the search by blocks is approximate (recall
against brute force is measured in the tests, by distance up to ``TAU``).

Equal fingerprints are collapsed first, so copies cost nothing.  A bucket's
pairs are explored as a spanning forest: a document that is already reached is
not compared with its own group again, whatever the bucket's size.  What a
large bucket of unlike documents has left after ``EFFORT`` comparisons a member
is cut into pieces of ``PIECE``, and every two pieces are compared on their
own, by other workers: no pair is left out.  Connected
components are found by alternating large and small stars, with a written
table per round.  A component is then divided by leaders: the lowest id leads,
takes what lies within ``RADIUS`` bits, the lowest id left leads next, and so
on; so a chain of documents that share a passage, each with the next, does not
make one group of unlike ends.

Defined results: null texts and rows with a null id are groups of their own
and always kept; texts without a word are hashed whole, so empty texts form
one group; repeated rows are in one group (of rows with the id kept, one
stays); rows of one id with different texts are decided each by its own text
(of those in one group, one stays); the
lowest id of a group is kept; an empty table gives an empty
result; other columns are carried along by :func:`deduplicate` and ignored by
:func:`groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._store import written
from ._words import mix64, slices, text_column, word_codes
from .exact_dedup import digest, without

BITS, TAU, RADIUS = 256, 40, 50
WORDS = ("f0", "f1", "f2", "f3")
SEGMENTS, CHAIN = 32, 4
BLOCKS, WEAK = 8, 3
#: Bytes of every block: of the cut into neighbours, then of cuts that take one byte of each word.
CUTS = np.array([[4 * q + w for w in range(4)] for q in range(BLOCKS)] + [[8 * w + (q + s * w) % 8 for w in range(4)] for s in (0, 1, 3) for q in range(BLOCKS)])
#: Places of the weakest bits, 12 in each.
WEAKEST = tuple(f"weak{i}" for i in range(len(CUTS) * WEAK // 12))
#: Comparisons a member that one worker spends on a bucket, and members of a piece of what is left.
EFFORT, PIECE = 256, 2048
#: Fingerprints whose keys are made at once.
_KEYED = 2048
#: Words of a text that the kernel gathers at once.
_GATHER = 8192


def word_bits(words: list[str]) -> np.ndarray:
    """Rows of 0 and 1: the words' 256-bit hashes."""
    raw = b"".join(xxhash.xxh3_128_digest(w, seed) for w in (x.encode("utf-8", "surrogatepass") for x in words) for seed in (0, 1))
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(words), BITS // 8), axis=1).astype(np.float32)


def margins(texts: pa.Array) -> np.ndarray:
    """Per text the signed sum of every bit."""
    offsets, codes, words = word_codes(texts)
    rows, base = len(texts), max(1, len(words))
    pair, count = np.unique(np.repeat(np.arange(rows), np.diff(offsets)) * base + codes, return_counts=True)
    row, code = pair // base, pair % base
    bits = word_bits(words)
    weight = np.rint(8 * np.cbrt(count)).astype(np.float32)
    offsets = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros((rows, BITS))
    for i in range(rows):
        for a in range(offsets[i], offsets[i + 1], _GATHER):
            b = min(a + _GATHER, offsets[i + 1])
            out[i] += weight[a:b] @ bits[code[a:b]]
    totals = np.concatenate([[0], np.cumsum(weight, dtype=np.float64)])
    out = 2 * out - (totals[offsets[1:]] - totals[offsets[:-1]])[:, None]
    for i in np.flatnonzero(np.diff(offsets) == 0):
        out[i] = 2 * word_bits([texts[int(i)].as_py()])[0] - 1
    return out


def pack(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) fingerprints as int64, and (n, 8) places of each block's weakest bits, 5 bits each."""
    words = np.packbits(z >= 0, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    blocks = np.abs(z).reshape(len(z), BITS // 8, 8)[:, CUTS].reshape(len(z), len(CUTS), BITS // BLOCKS)
    weakest = np.argsort(blocks, axis=2, kind="stable")[:, :, :WEAK].reshape(len(z), len(WEAKEST), -1)
    return words, ((31 - weakest).astype(np.int64) << (5 * np.arange(12))).sum(axis=2)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            words, weak = pack(margins(text_column(batch, "text")))
            own = [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest")), *map(pa.array, words.T.copy()), *map(pa.array, weak.T.copy())]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "digest", *WORDS, *WEAKEST])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, f0 .. f3, weak0 .. weak7) of the rows that have an id and a text."""
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest"), "text")
    return rows.mapInArrow(_fingerprint, "doc_id bigint, digest bigint, " + ", ".join(f"{c} bigint" for c in (*WORDS, *WEAKEST)))


def keys(words: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """(n, 32 * 8) bucket keys of fingerprints: block number, then the block with weak bits turned."""
    n = len(words)
    values = np.ascontiguousarray(words.astype(">i8").view(np.uint8).reshape(n, BITS // 8)[:, CUTS]).view(">u4").reshape(n, len(CUTS)).astype(np.int64)
    places = (weak[:, :, None] >> (5 * np.arange(12)) & 31).reshape(n, len(CUTS), WEAK)
    flips = np.left_shift(np.int64(1), places)
    turned = [values | np.arange(len(CUTS), dtype=np.int64) << 32]
    for w in range(WEAK):
        turned += [x ^ flips[:, :, w] for x in turned]
    return np.stack(turned, axis=2).reshape(n, -1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _KEYED):
            batch = whole.slice(at, _KEYED)
            words, weak = (np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names], axis=1) for names in (WORDS, WEAKEST))
            own = keys(words, weak)
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(ids, own.shape[1]))], names=["key", "id"])


def pigeonring(x: np.ndarray, y: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Which pairs of fingerprints, (n, 4) int64 each, have a viable chain."""
    d = np.bitwise_count(np.bitwise_xor(x, y).view(np.uint8)).astype(np.int32).reshape(-1, SEGMENTS)
    viable, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int32)
    for length in range(1, CHAIN + 1):
        total += np.roll(d, 1 - length, axis=1)
        viable &= total * SEGMENTS <= length * tau
    return viable.any(axis=1)


def within(x: np.ndarray, y: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Pairs at Hamming distance ``tau`` at most: the pigeonring test, then the full check."""
    out = pigeonring(x, y, tau)
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(np.bitwise_xor(x[at], y[at]).view(np.uint64)).sum(axis=1) <= tau
    return out


def forest(ids: np.ndarray, prints: np.ndarray, tau: int = TAU, effort: float = np.inf) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Edges of a spanning forest of one bucket's pairs within ``tau``, and the members that are still to be compared with each other.

    None is where ``effort`` comparisons a member are enough, or the bucket is no larger than a piece.
    """
    edges, spent, most = [], 0, np.inf if len(ids) <= PIECE else effort * len(ids)
    left, stack = np.arange(len(ids)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            if spent > most:
                return edges, np.r_[np.array(stack, np.int64), left]
            spent += len(left)
            at = stack.pop()
            near = within(np.broadcast_to(prints[at], (len(left), len(WORDS))), prints[left], tau)
            if near.any():
                found = left[near]
                edges.append((np.full(len(found), ids[at]), ids[found]))
                stack.extend(found.tolist())
                left = left[~near]
    return edges, left


def _runs(columns: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by the first of them, cut so that no run of its equal values is divided."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        own = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(own[0]):
            continue
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if not cut and held and held[-1][0][-1] != own[0][0]:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if cut:
            held.append([x[:cut] for x in own])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([x[cut:] for x in own])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the keys that several documents give, under a signature of the member set."""
    for key, ids in _runs(("key", "id"), batches):
        starts, sizes = _starts(key)
        if len(starts):
            signature = mix64(np.add.reduceat(mix64(ids.astype(np.uint64)), starts) ^ sizes.astype(np.uint64))
            full = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(signature, sizes)[full].astype(np.int64)), pa.array(ids[full])], names=["bucket", "id"])


def _pairs(effort: float):
    """Edges (a, b) inside the buckets of a sorted stream; and as (bucket, a, no b) the members of large ones still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, *words in _runs(("bucket", "id", *WORDS), batches):
            prints = np.stack(words, axis=1)
            starts, sizes = _starts(key)
            two = starts[sizes == 2]
            near = two[within(prints[two], prints[two + 1])]
            found = [(ids[near], ids[near + 1])]
            for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                edges, rest = forest(ids[a : a + n], prints[a : a + n], effort=effort)
                found += edges
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), key[a])), pa.array(ids[a + rest]), pa.nulls(len(rest), pa.int64())], names=["bucket", "a", "b"])
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[0]), pa.array(pair[1])], names=["bucket", "a", "b"])

    return run


def _compared(members: DataFrame, nodes: DataFrame, effort: float) -> DataFrame:
    """Pairs inside the buckets of (bucket, id), as written rows of :func:`_pairs`."""
    filled = members.join(nodes.select("id", *WORDS), "id").repartition("bucket").sortWithinPartitions("bucket")
    return written(filled.select("bucket", "id", *WORDS).mapInArrow(_pairs(effort), "bucket bigint, a bigint, b bigint"), "simhash-pairs")


def near_pairs(nodes: DataFrame, effort: float = EFFORT) -> DataFrame:
    """Edges (a, b), a < b, that connect near copies among distinct fingerprints.

    Only (key, id) of every key is shuffled.  Keys of one document end there;
    the others' member sets, each once however many keys have it, are then
    joined with the fingerprints.
    """
    keyed = nodes.select("id", *WORDS, *WEAKEST).mapInArrow(_keyed, "key bigint, id bigint").repartition("key").sortWithinPartitions("key")
    return compared_in_full(keyed.mapInArrow(_buckets, "bucket bigint, id bigint").distinct(), nodes, effort)


def compared_in_full(buckets: DataFrame, nodes: DataFrame, effort: float = EFFORT) -> DataFrame:
    """Edges (a, b) of the near copies in (bucket, id): first bucket by bucket, then large ones' rests by two pieces each."""
    found = _compared(buckets, nodes, effort)
    edges, rest = found.where("b IS NOT NULL"), found.where("b IS NULL").select("bucket", F.col("a").alias("id"))
    sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("n"))
    if not sizes.isEmpty():
        piece = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
        twos = rest.join(sizes, "bucket").withColumn("p", piece).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        twos = twos.select(F.xxhash64("bucket", F.least("p", "q"), F.greatest("p", "q")).alias("bucket"), "id")
        edges = edges.unionByName(_compared(twos, nodes, float("inf")))
    return edges.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every node of an edge with the lowest id of its component."""
    edges = written(edges.where("a != b"), "edges")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", low).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("b"), F.col("e.m").alias("a")).where("a != b").distinct()
        edges = written(small.select("a", "b"), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = state


def _leaders(key: tuple, table: pa.Table) -> pa.Table:
    """Divide a component: the lowest id left leads those within the radius."""
    ids, lead = table.column("id").to_numpy(), table.column("lead").to_numpy()
    order = np.lexsort([ids, lead])
    ids, lead = ids[order], lead[order]
    prints = np.stack([table.column(c).to_numpy() for c in WORDS], axis=1)[order]
    leader, left = lead.copy(), np.arange(len(ids))
    while len(left):
        near = np.bitwise_count((prints[left] ^ prints[left[0]]).view(np.uint64)).sum(axis=1) <= RADIUS
        leader[left[near]] = lead[left[0]]
        left = left[~near]
    return pa.table({"id": ids, "leader": leader})


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, rows, gone) of every row that is in a group, also of one.

    Rows are gone that are not their group's first, which is of the lowest id, and of its texts in the group of lowest digest.
    """
    prints = written(fingerprints(docs), "simhash")
    nodes = prints.groupBy(*WORDS).agg(F.min(F.struct("doc_id", *WEAKEST)).alias("m"))
    nodes = nodes.select(F.col("m.doc_id").alias("id"), *WORDS, *(F.col(f"m.{c}").alias(c) for c in WEAKEST))
    # Where rows of one id lead several fingerprints, all but the first get a number of their own.
    again = F.row_number().over(Window.partitionBy("id").orderBy(*WORDS)) > 1
    nodes = written(nodes.withColumn("lead", F.col("id")).withColumn("id", F.when(again, F.xxhash64("id", *WORDS)).otherwise(F.col("id"))), "simhash-nodes")
    roots = components(near_pairs(nodes))
    roots = roots.union(roots.select(F.col("root").alias("id"), "root")).distinct()
    led = nodes.join(roots, "id").select("root", "id", "lead", *WORDS).groupBy("root").applyInArrow(_leaders, "id bigint, leader bigint")
    whole = nodes.join(led, "id", "left").select(*WORDS, F.coalesce("leader", "lead").alias("keep_id"))
    rows = prints.join(whole, list(WORDS)).select("doc_id", "digest", "keep_id").repartition("doc_id").groupBy("doc_id", "digest", "keep_id").agg(F.count("*").alias("rows"))
    first = F.min("digest").over(Window.partitionBy("doc_id", "keep_id"))
    return rows.withColumn("gone", (F.col("doc_id") != F.col("keep_id")) | (F.col("digest") != first))


def groups(docs: DataFrame) -> DataFrame:
    """A row per row: ``doc_id``, the ``keep_id`` of its group, and whether it is a ``duplicate``."""
    found = members(docs).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keep_id")
    ids = docs.select("doc_id", digest().alias("digest"))
    return ids.join(found, (ids.doc_id == found._id) & (ids.digest == found._digest), "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce(F.col("keep_id") != F.col("doc_id"), F.lit(False)).alias("duplicate"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns they came with."""
    return without(docs, written(members(docs), "near-copies"))
