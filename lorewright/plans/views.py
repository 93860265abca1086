"""Unit, relation and card views over the driver's tables, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import read_table

_E = "array<string>"


#: Tables whose rows cost enough to be spread over all cores; the others are read as they lie.
HEAVY = ("documents", "pages")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name) if name in HEAVY else spark.read.parquet(f"{sf}/{name}.parquet")


#: Labels up to which they are sent to every scan of the documents (60 to 150 bytes each in memory); beyond, the join moves every text once.
BROADCAST_LABELS = 500_000


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have labels, with them."""
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels, "doc_id")


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(number.cast("string"), 8, "0"))


def _unit(rows: DataFrame, prefix: str, kind: str, number: Column, name: Column, summary: Column, domain: Column, tags: Column | None = None, confidence: Column | None = None, claim_status: Column | None = None, supports: Column | None = None) -> DataFrame:
    none = F.array().cast(_E)
    n = number
    # Every 29th unit is soft-deleted, so that filters have something to do.
    return rows.select(
        _id(prefix, n).alias("ku_id"), F.lit(kind).alias("ku_type"), name.alias("name"), summary.alias("summary"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
        F.when(n % 29 == 28, "deleted").otherwise("active").alias("status"), domain.alias("domain"), (none if tags is None else tags).alias("tags"), none.alias("sources"),
        F.struct((F.lit(None).cast("string") if claim_status is None else claim_status).alias("claim_status"), (none if supports is None else supports).alias("supports"), F.lit(None).cast("string").alias("definition"), summary.alias("statement"), F.lit("").alias("source_text")).alias("extra"), n.cast("bigint").alias("ord"),
    )


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _unit(table(spark, sf, "part"), "CON", "Concept", c("p_partkey"), c("p_name"), c("p_type"), c("p_brand"), F.array("p_type"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return _unit(table(spark, sf, "supplier"), "ENT", "Entity", F.col("s_suppkey"), F.col("s_name"), F.lit(""), F.lit(""))


def source_number() -> Column:
    return F.substring("source", 4, 10).try_cast("bigint")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    confidence = 0.20 + 0.50 * F.col("quality") + (F.col("doc_id") % 25) / 100.0
    # Claims that were settled before are among those that are new.
    status = F.when(F.col("doc_id") % 7 == 5, "active").when(F.col("doc_id") % 7 == 6, "disputed").otherwise("pending")
    return _unit(rows, "CLM", "Claim", F.col("doc_id"), F.substring("text", 1, 80), F.col("text"), F.col("lang"), confidence=confidence, claim_status=status, supports=F.array(_id("EVD", source_number())))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return _unit(rows, "FCT", "Fact", F.col("doc_id"), F.substring("text", 1, 80), F.col("text"), F.lit(""))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source").distinct()
    return _unit(rows, "EVD", "Evidence", source_number(), F.col("source"), F.lit(""), F.lit(""))


def units(spark: SparkSession, sf: str) -> DataFrame:
    out = concepts(spark, sf)
    for f in (entities, claims, facts, evidence):
        out = out.unionByName(f(spark, sf))
    return out


def _rel(rows: DataFrame, kind: str, a: Column, b: Column, weight: float, order: Column) -> DataFrame:
    return rows.select(F.concat_ws(":", F.lit(kind), a, b).alias("rel_id"), a.alias("from_ku"), b.alias("to_ku"), F.lit(kind).alias("rel_type"), F.lit(weight).alias("weight"), order.cast("bigint").alias("ord"))


def supports(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return _rel(rows, "SUPPORTS", _id("EVD", source_number()), _id("CLM", F.col("doc_id")), 0.6, F.col("doc_id"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return _rel(rows, "MENTIONS", _id("CON", F.col("l_partkey")), _id("ENT", F.col("l_suppkey")), 1.0, F.col("l_partkey") * 100000 + F.col("l_suppkey"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation (0.9) -> customer and supplier (0.8)."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    parts = [_rel(n, "HAS", node("R", "n_regionkey"), node("N", "n_nationkey"), 0.9, F.col("n_nationkey")), _rel(c, "HAS", node("N", "c_nationkey"), node("C", "c_custkey"), 0.8, F.col("c_custkey") + 1000), _rel(s, "OWNS", node("N", "s_nationkey"), node("S", "s_suppkey"), 0.8, F.col("s_suppkey") + 10_000_000)]
    return parts[0].union(parts[1]).union(parts[2])


def web(spark: SparkSession, sf: str) -> DataFrame:
    """The tree with rings of nations, and edges of several types between the same nodes."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    node = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    k = F.col("n_nationkey")
    ring = lambda kind, to, weight, base: _rel(n, kind, node("N", k), node("N", to % 25), weight, k + base)
    also = _rel(c, "ALSO", node("N", F.col("c_nationkey")), node("C", F.col("c_custkey")), 0.4, 500 - F.col("c_custkey"))
    return tree(spark, sf).union(ring("NEAR", k + 1, 0.6, 50_000_000)).union(ring("NEAR", k * 7 + 2, 0.5, 60_000_000)).union(also).union(ring("HAS", k + 1, 0.3, 70_000_000))


_DEAD = "CASE WHEN CAST({n} AS BIGINT) % 29 = 28 THEN 'deleted' ELSE 'active' END AS status"


def _sql_unit(name: str, prefix: str, kind: str, number: str, columns: str, source: str) -> str:
    return f"{name} AS (SELECT '{prefix}_' || lpad(CAST({number} AS VARCHAR), 8, '0') AS ku_id, '{kind}' AS ku_type, {columns}, {_DEAD.format(n=number)}, CAST({number} AS BIGINT) AS ord FROM {source})"


_EVD = "'EVD_' || lpad(substr(source, 4), 8, '0')"
#: Common table expressions: concepts, entities, claims, facts, evidence, ku, supports, mentions, tree.
CTE = "WITH RECURSIVE " + ",\n".join([
    _sql_unit("concepts", "CON", "Concept", "p_partkey", "p_name AS name, p_type AS summary, p_brand AS domain, 1.0::DOUBLE AS confidence, [p_type] AS tags, CAST(NULL AS VARCHAR) AS claim_status, CAST([] AS VARCHAR[]) AS supports", "part"),
    _sql_unit("entities", "ENT", "Entity", "s_suppkey", "s_name AS name, '' AS summary, '' AS domain, 1.0::DOUBLE AS confidence, CAST([] AS VARCHAR[]) AS tags, CAST(NULL AS VARCHAR) AS claim_status, CAST([] AS VARCHAR[]) AS supports", "supplier"),
    _sql_unit("claims", "CLM", "Claim", "doc_id", f"substr(text, 1, 80) AS name, text AS summary, lang AS domain, 0.20::DOUBLE + 0.50::DOUBLE * quality + (doc_id % 25) / 100.0::DOUBLE AS confidence, CAST([] AS VARCHAR[]) AS tags, CASE doc_id % 7 WHEN 5 THEN 'active' WHEN 6 THEN 'disputed' ELSE 'pending' END AS claim_status, [{_EVD}] AS supports", "documents JOIN labels USING (doc_id)"),
    _sql_unit("facts", "FCT", "Fact", "doc_id", "substr(text, 1, 80) AS name, text AS summary, '' AS domain, 1.0::DOUBLE AS confidence, CAST([] AS VARCHAR[]) AS tags, CAST(NULL AS VARCHAR) AS claim_status, CAST([] AS VARCHAR[]) AS supports", "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    _sql_unit("evidence", "EVD", "Evidence", "substr(source, 4)", "source AS name, '' AS summary, '' AS domain, 1.0::DOUBLE AS confidence, CAST([] AS VARCHAR[]) AS tags, CAST(NULL AS VARCHAR) AS claim_status, CAST([] AS VARCHAR[]) AS supports", "(SELECT DISTINCT source FROM documents)"),
    "ku AS (SELECT * FROM concepts UNION ALL SELECT * FROM entities UNION ALL SELECT * FROM claims UNION ALL SELECT * FROM facts UNION ALL SELECT * FROM evidence)",
    f"supports AS (SELECT {_EVD} AS from_ku, 'CLM_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS to_ku, 'SUPPORTS' AS rel_type, 0.6::DOUBLE AS weight, doc_id AS ord FROM documents JOIN labels USING (doc_id))",
    "mentions AS (SELECT DISTINCT 'CON_' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS from_ku, 'ENT_' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS to_ku, 'MENTIONS' AS rel_type, 1.0::DOUBLE AS weight, l_partkey * 100000 + l_suppkey AS ord FROM lineitem)",
    "tree AS (SELECT 'R' || n_regionkey AS from_ku, 'N' || n_nationkey AS to_ku, 'HAS' AS rel_type, 0.9::DOUBLE AS weight, CAST(n_nationkey AS BIGINT) AS ord FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'HAS', 0.8, c_custkey + 1000 FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'OWNS', 0.8, s_suppkey + 10000000 FROM supplier)",
])
