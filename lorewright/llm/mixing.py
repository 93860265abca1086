"""Mixing sources to target weights by Sainte-Laguë apportionment.

The corpus is cut into shards of about ``SHARD_DOCS`` documents by a hash of
the id, so no window ever holds more than a shard.  In each shard the
documents of a source are put in a seeded random order and laid end to end;
every ``block_tokens`` tokens of that line are a block, and a document belongs
to the block that holds its first token.  Of a shard's blocks the share
``KEEP`` is allotted to its sources by highest quotients weight / (2k + 1),
k = 0, 1, ..., which gives integer quotas; a source's first ``quota`` blocks in
seeded order are taken.  A source whose blocks are used up drops out of the
contest and the others go on, so the target weights hold among the sources
that can fill them, no document is repeated, and a tiny source doesn't bound
what all others keep.

All of it is window functions over (id, source, token count); the text is read
once, to count tokens, and never shuffled.

Defined results: null text counts 0 tokens; a document of 0 tokens belongs to
the block where it falls; rows of a null source are a source of their own, as
are rows of a null id (one shard takes them); repeated rows are
counted and kept each for itself (their order is by all of id, source and
tokens, so any tie is between equal rows); equal quotients go to the source
first in order of name (null before all); sources without a weight, or with
one of 0, get no blocks; if that holds for all, nothing is taken; an empty
table gives an empty result.  A document longer than a block covers several
blocks and goes by its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import written

#: Production parameters: tokens of a block, documents of a shard, seed, exponent of the weights, share of a shard's blocks that is allotted.
BLOCK_TOKENS, SHARD_DOCS, SEED, EXPONENT, KEEP = 2_000, 50_000, 17, 0.7, 0.8


def token_count(text: Column) -> Column:
    """White-space separated tokens of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def seeded(seed: int, *columns: Column) -> Column:
    """A seeded order that any SQL engine with MD5 can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns)).cast("binary"))


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, shard, and the number ``block`` of the document's block."""
    shards = shards or max(1, -(-docs.count() // SHARD_DOCS))
    base = docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    base = base.withColumn("_o", seeded(seed, F.col("doc_id")))
    base = base.withColumn("shard", (F.conv(F.substring("_o", 1, 8), 16, 10).cast("bigint") % shards).cast("int"))
    line = Window.partitionBy("shard", "source").orderBy("_o", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    return base.withColumn("block", F.floor(F.coalesce(F.sum("tokens").over(line), F.lit(0)) / block_tokens).cast("bigint")).drop("_o")


def tempered(docs_blocks: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    """Default target weights: a source's share of tokens to the power ``exponent``."""
    return docs_blocks.groupBy("source").agg(F.sum("tokens").alias("n")).select("source", F.round(F.pow(F.col("n").cast("double"), F.lit(exponent)), 3).alias("weight"))


def quotas(docs_blocks: DataFrame, weights: DataFrame, keep: float = KEEP) -> DataFrame:
    """(shard, source, available, quota): Sainte-Laguë quotas of each shard.

    Every block that a source has is one quotient, weight / (2k + 1); the
    highest win, as many as the share ``keep`` of the shard's blocks, rounded
    up.  No shard has more quotients than blocks, so a shard bounds the sort.
    """
    have = docs_blocks.groupBy("shard", "source").agg((F.max("block") + 1).alias("available"))
    have = have.withColumn("_total", F.ceil(F.sum("available").over(Window.partitionBy("shard")) * F.lit(keep)))
    w = weights.where("weight > 0").select(F.col("source").alias("_s"), "weight")
    have = have.join(w, have.source.eqNullSafe(w._s), "left").drop("_s")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("_q"), F.asc_nulls_first("source"), "_k"))
    contest = have.where("weight IS NOT NULL").select("shard", "source", "_total", "weight", F.explode(F.sequence(F.lit(0), F.col("available") - 1)).alias("_k"))
    won = contest.withColumn("_q", F.col("weight") / (2 * F.col("_k") + 1)).withColumn("_r", rank).where("_r <= _total")
    won = won.groupBy(F.col("shard").alias("_h"), F.col("source").alias("_s")).agg(F.count("*").alias("quota"))
    joined = have.join(won, (have.shard == won._h) & have.source.eqNullSafe(won._s), "left")
    return joined.select("shard", "source", "available", F.coalesce("quota", F.lit(0)).cast("bigint").alias("quota"))


def select(docs: DataFrame, weights: DataFrame | None = None, block_tokens: int = BLOCK_TOKENS, shards: int | None = None, seed: int = SEED, keep: float = KEEP) -> DataFrame:
    """Every document with its shard, block, the source's quota there, and ``taken``."""
    # Quotas need all blocks before a document can be taken: the table of numbers is written, the texts are read once.
    cut = written(blocks(docs, block_tokens, shards, seed), "blocks")
    allot = quotas(cut, tempered(cut) if weights is None else weights, keep)
    allot = allot.select(F.col("shard").alias("_h"), F.col("source").alias("_s"), "quota")
    # A row per (shard, source): fixed by the list of sources, not by the corpus; AQE broadcasts it only if it is small.
    joined = cut.join(allot, (cut.shard == allot._h) & cut.source.eqNullSafe(allot._s), "left").drop("_h", "_s")
    return joined.withColumn("taken", F.coalesce(F.col("block") < F.col("quota"), F.lit(False)))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the blocks taken, with the columns they came with.

    Rows that share an id stay together: all of them if one is taken.
    """
    chosen = select(docs, **parameters).where("taken").groupBy("doc_id").agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("_id"))
    return docs.join(chosen, docs.doc_id.eqNullSafe(chosen._id), "left_semi")


def oracle_sql() -> str:
    """The same allotment in SQL."""
    return f"""
    WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS tokens,
                         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS o FROM documents),
    sh AS (SELECT *, CAST(CAST('0x' || substr(o, 1, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + {SHARD_DOCS - 1}) // {SHARD_DOCS}) FROM documents) AS INTEGER) AS shard FROM base),
    cut AS (SELECT doc_id, source, tokens, shard, CAST(coalesce(sum(tokens) OVER (PARTITION BY shard, source ORDER BY o, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_TOKENS} AS BIGINT) AS block FROM sh),
    w AS (SELECT source, round(pow(CAST(sum(tokens) AS DOUBLE), {EXPONENT}), 3) AS weight FROM cut GROUP BY source),
    have AS (SELECT shard, source, available, ceil(sum(available) OVER (PARTITION BY shard) * CAST({KEEP} AS DOUBLE)) AS total FROM (SELECT shard, source, max(block) + 1 AS available FROM cut GROUP BY shard, source)),
    quotient AS (SELECT shard, h.source AS source, total, k, weight / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, available)) AS k FROM have) h JOIN w ON h.source IS NOT DISTINCT FROM w.source WHERE weight > 0),
    quota AS (SELECT shard, source, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY q DESC, source NULLS FIRST, k) AS r FROM quotient) WHERE r <= total GROUP BY shard, source)
    SELECT doc_id, c.source AS source, tokens, c.shard AS shard, block, coalesce(quota, 0) AS quota, coalesce(block < quota, false) AS taken
    FROM cut c LEFT JOIN quota q ON c.shard = q.shard AND c.source IS NOT DISTINCT FROM q.source"""
