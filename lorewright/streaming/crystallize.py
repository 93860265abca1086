"""Events to knowledge: translation, event-level dedup, filtering and outcomes, batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import light_fingerprint

def ingest_text(title: Column, content: Column) -> Column:
    """Title and content as one text; blank parts leave no gap."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    return F.concat_ws("\n\n", F.when(t != "", t), F.when(c != "", c))


def dedup_key(refs: Column, content: Column) -> Column:
    """Event references joined by a bar, else the content's fingerprint."""
    return F.when(F.size(refs) > 0, F.array_join(refs, "|")).otherwise(light_fingerprint(content))


def source_string(evidence: Column) -> Column:
    """Where a candidate came from, by its first evidence."""
    e = F.try_element_at(evidence, F.lit(1))
    agent = F.when(F.coalesce(e["agent"], F.lit("")) != "", F.concat(F.lit("agent:"), e["agent"]))
    kind = F.when(F.coalesce(e["evidence_type"], F.lit("")) != "", e["evidence_type"]).otherwise("candidate")
    own = F.concat_ws(":", kind, agent, F.when(F.coalesce(e["source_id"], F.lit("")) != "", e["source_id"]))
    return F.when(e.isNull(), F.lit("knowledge_candidate")).otherwise(own)


Translator = Callable[[DataFrame], DataFrame]
MEMORY = "memory_id string, agent_id string, title string, content string, confidence double, domain_hint string"


def matured_memory(events: DataFrame) -> DataFrame:
    """Candidates of ``memory.matured`` events, whose payload is a JSON object; those without content and title are dropped."""
    p = F.from_json("payload", MEMORY)
    own = lambda name: F.trim(F.coalesce(p[name], F.lit("")))
    ref = F.coalesce(p["memory_id"], F.lit(""))
    evidence = F.struct(F.lit("memory").alias("evidence_type"), ref.alias("source_id"), p["agent_id"].alias("agent"), F.coalesce(p["confidence"], F.lit(1.0)).alias("confidence"))
    rows = events.select("ord", "event", own("title").alias("title"), F.when(own("content") != "", own("content")).otherwise(own("title")).alias("content"), F.array(evidence).alias("evidence"), F.when(ref != "", F.array(ref)).otherwise(F.array().cast("array<string>")).alias("event_refs"), F.coalesce(p["domain_hint"], F.lit("")).alias("domain_hint"))
    return rows.where("content != ''")


#: Translators by event; others are registered beside them.
TRANSLATORS: dict[str, Translator] = {"memory.matured": matured_memory}


def translate(events: DataFrame, translators: dict[str, Translator] | None = None) -> DataFrame:
    """Candidates of events (ord, event, payload), each type by its translator.

    Events that no translator takes, or that theirs drops, come out as
    candidates that are not ``translated``, so that every event has an outcome.
    """
    every = TRANSLATORS if translators is None else translators
    rows = None
    for name, f in every.items():
        own = f(events.where(F.col("event") == name)).withColumn("translated", F.lit(True))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    rest = events.select("ord", "event").withColumn("translated", F.lit(False)).withColumn("event_refs", F.array().cast("array<string>"))
    if rows is None:
        return rest.withColumn("title", F.lit("")).withColumn("content", F.lit(""))
    return rows.unionByName(rest.join(rows.select("ord"), "ord", "left_anti"), allowMissingColumns=True)


def outcomes(candidates: DataFrame, keep: Column | None = None) -> DataFrame:
    """Each candidate (ord, event, translated, title, content, event_refs) with its ``outcome``.

    Only what was taken in is remembered: a candidate repeats an earlier one
    if that one was crystallized, and one that is blank or filtered blocks nothing.
    """
    rows = candidates.withColumn("key", dedup_key(F.col("event_refs"), F.col("content")))
    good = F.col("translated") & (keep if keep is not None else F.lit(True)) & (ingest_text(F.col("title"), F.col("content")) != "")
    rows = rows.withColumn("_good", good)
    before = F.max(F.col("_good").cast("int")).over(Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_dup", F.coalesce(before, F.lit(0)) == 1)
    filtered = ~keep if keep is not None else F.lit(False)
    outcome = F.when(~F.col("translated"), "skipped_filter").when(F.col("_dup"), "skipped_dup").when(filtered, "skipped_filter").when(~F.col("_good"), "skipped_empty").otherwise("crystallized")
    return rows.withColumn("outcome", outcome).drop("_good", "_dup")


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: Column, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """The first event of each key.  Without a watermark the state is unbounded; with one, bounded (an extension)."""
    rows = events.withColumn("dedup_key", key)
    if watermark:
        return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["dedup_key"])
    return rows.dropDuplicates(["dedup_key"])


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feed every micro-batch to ``sink``; progress is in ``checkpoint``, so a batch that failed is fed again."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
