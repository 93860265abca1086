"""Context for a synthesis of one unit, its digest, and the cache of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

SOURCE, NEIGHBORS, HITS, SUMMARY, LINES = 800, 15, 12, 160, 24


def context(unit: DataFrame, neighbors: DataFrame, hits: DataFrame) -> DataFrame:
    """(ku_id, context, digest) of a unit, from neighbours (id, name, summary, rank) and hits of the same form.

    Neighbours come first, then hits that are new, 24 lines in all.
    """
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.substring(F.trim(F.coalesce("summary", F.lit(""))), 1, SUMMARY)).alias("line")
    rows = neighbors.where(F.col("rank") <= NEIGHBORS).select("id", F.lit(0).alias("arm"), "rank", line).unionByName(hits.where(F.col("rank") <= HITS).select("id", F.lit(1).alias("arm"), "rank", line))
    first = rows.groupBy("id").agg(F.min(F.struct("arm", "rank", "line")).alias("m")).join(unit.select(F.col("ku_id").alias("id")), "id", "left_anti")
    related = first.agg(F.slice(F.sort_array(F.collect_list("m")), 1, LINES).alias("r"))  # at most 27 lines
    text = F.coalesce("extra.statement", F.lit(""))
    head = F.concat("name", F.lit(" ("), "ku_type", F.lit(")"), F.when(F.col("domain") != "", F.concat(F.lit(" domain: "), "domain")).otherwise(""))
    parts = F.array_compact(F.array(head, F.when(text != "", F.concat(F.lit("statement: "), text)), F.when((F.col("summary") != "") & (F.col("summary") != text), F.concat(F.lit("summary: "), "summary")), F.when(F.trim(F.coalesce("extra.source_text", F.lit(""))) != "", F.concat(F.lit("source: "), F.substring(F.trim("extra.source_text"), 1, SOURCE)))))
    out = unit.crossJoin(related).select("ku_id", F.array_join(F.concat(parts, F.transform("r", lambda x: x["line"])), "\n").alias("context"))
    return out.withColumn("digest", F.sha1(F.col("context").cast("binary")))


def stale(contexts: DataFrame, cache: DataFrame) -> DataFrame:
    """(ku_id, context, digest, content, is_stale): what the cache (ku_id, content, digest) still answers."""
    c = cache.select("ku_id", "content", F.col("digest").alias("_d"))
    return contexts.join(c, "ku_id", "left").withColumn("is_stale", F.coalesce(F.col("_d") != F.col("digest"), F.lit(True))).drop("_d")


def generate(contexts: DataFrame, cache: DataFrame, complete: Callable[[str], str], force: bool = False) -> DataFrame:
    """The new cache: stale entries (all, if forced) are completed by the injected function, others kept."""
    rows = stale(contexts, cache)
    todo = rows if force else rows.where("is_stale")

    def run(batches):
        for b in batches:
            yield b.assign(content=[complete(x) for x in b["context"]])[["ku_id", "content", "digest"]]

    new = todo.select("ku_id", "context", "digest").mapInPandas(run, "ku_id string, content string, digest string")
    return cache.join(todo.select("ku_id"), "ku_id", "left_anti").select("ku_id", "content", "digest").unionByName(new)
