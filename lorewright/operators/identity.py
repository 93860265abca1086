"""Identity: fingerprints, groups of equal units, merging and redirection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import fingerprint

STEP, CAP = 0.02, 0.98


def identities(ku: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(ku_id, fp, canonical_id): the earliest live unit of each fingerprint is canonical."""
    rows = ku.where("status != 'deleted'").select("ku_id", "ord", fingerprint(F.col("ku_type"), F.col("name"), F.col("domain"), ascii_only).alias("fp"))
    first = F.first("ku_id").over(Window.partitionBy("fp").orderBy("ord", "ku_id"))
    return rows.withColumn("canonical_id", first).drop("ord")


def merged(ku: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(canonical_id, fp, n, sources, supports, confidence) of each group.

    Sources and supports are united in order of arrival; every one beyond the
    first unit's own raises confidence by 0.02, to 0.98 at most, and by that
    rule may lower a default of 1.0; facts stay at 1.0.
    """
    own = fingerprint(F.col("ku_type"), F.col("name"), F.col("domain"), ascii_only)
    part = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = ku.where("status != 'deleted'").select(own.alias("fp"), F.struct("ord", "ku_id", "ku_type", "confidence", part(F.col("sources")).alias("sources"), part(F.col("extra.supports")).alias("supports")).alias("r"))
    g = rows.groupBy("fp").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("r")).alias("r"))
    g = g.withColumn("sources", F.array_distinct(F.flatten(F.transform("r", lambda x: x["sources"]))))
    g = g.withColumn("supports", F.array_distinct(F.flatten(F.transform("r", lambda x: x["supports"]))))
    head = F.col("r")[0]
    added = F.size("sources") - F.size(F.array_distinct(head["sources"])) + F.size("supports") - F.size(F.array_distinct(head["supports"]))
    confidence = F.when((added == 0) | (head["ku_type"] == "Fact"), head["confidence"]).otherwise(F.least(F.lit(CAP), head["confidence"] + STEP * added))
    return g.select(head["ku_id"].alias("canonical_id"), "fp", "n", "sources", "supports", confidence.alias("confidence"))


def redirect(rel: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with merged ends moved to the canonical unit.

    Only moved edges are dropped: when they become loops, or when an edge of
    the same ends and type exists or was moved before.
    """
    m = ids.where("ku_id != canonical_id").select("ku_id", "canonical_id")
    a, b = m.select(F.col("ku_id").alias("from_ku"), F.col("canonical_id").alias("_f")), m.select(F.col("ku_id").alias("to_ku"), F.col("canonical_id").alias("_t"))
    r = rel.join(a, "from_ku", "left").join(b, "to_ku", "left")
    moved = F.col("_f").isNotNull() | F.col("_t").isNotNull()
    r = r.select("rel_id", F.coalesce("_f", "from_ku").alias("from_ku"), F.coalesce("_t", "to_ku").alias("to_ku"), "rel_type", "weight", "ord", moved.alias("moved"))
    rank = F.row_number().over(Window.partitionBy("from_ku", "to_ku", "rel_type").orderBy("moved", "ord", "rel_id"))
    return r.withColumn("_r", rank).where("NOT moved OR (from_ku != to_ku AND _r = 1)").drop("_r")


def duplicates(docs: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, n, first_id) of every fingerprint that occurs more than once."""
    return docs.groupBy(fp).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def collapse(ku: DataFrame, rel: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, relations, identities) after merging equal units: duplicates are soft-deleted."""
    ids = identities(ku, ascii_only)
    new = merged(ku, ascii_only).select(F.col("canonical_id").alias("ku_id"), F.col("sources").alias("_so"), F.col("supports").alias("_su"), F.col("confidence").alias("_c"))
    dup = ids.where("ku_id != canonical_id").select("ku_id", F.lit(True).alias("_dup"))
    out = ku.join(new, "ku_id", "left").join(dup, "ku_id", "left")
    out = out.withColumn("sources", F.coalesce("_so", "sources")).withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("status", F.when(F.col("_dup"), "deleted").otherwise(F.col("status")))
    out = out.withColumn("extra", F.when(F.col("_su").isNotNull() & F.col("extra").isNotNull(), F.col("extra").withField("supports", F.col("_su"))).otherwise(F.col("extra")))
    return out.drop("_so", "_su", "_c", "_dup"), redirect(rel, ids), ids
