"""Scans and snapshot writes over the unit, relation, card and event tables.

A store is a folder of Parquet snapshots; every write makes a new snapshot and
never changes one that a plan may still read.  Scans push their predicates to
the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schema import KU_TYPES
from ..sources.tables import written

# --- scans ---


def point_lookup(ku: DataFrame, ku_id: str) -> DataFrame:
    """The unit of an id, deleted or not."""
    return ku.where(F.col("ku_id") == ku_id)


def by_type(ku: DataFrame, ku_type: str, *, status: str = "active", domain: str = "", limit: int = 100) -> DataFrame:
    rows = ku.where((F.col("ku_type") == ku_type) & (F.col("status") == status))
    return (rows.where(F.col("domain") == domain) if domain else rows).orderBy("ord").limit(limit)


def by_domain(ku: DataFrame, domain: str, limit: int = 200) -> DataFrame:
    return ku.where((F.col("domain") == domain) & (F.col("status") != "deleted")).orderBy("ord", "ku_id").limit(limit)


def capped_per_type(ku: DataFrame, limit: int = 2000) -> DataFrame:
    """Active units, the first ``limit`` of each type."""
    rank = F.row_number().over(Window.partitionBy("ku_type").orderBy("ord"))
    return ku.where((F.col("status") == "active") & F.col("ku_type").isin(*KU_TYPES)).withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def relations_of(rel: DataFrame, ku_id: str, *, direction: str = "both", rel_type: str = "") -> DataFrame:
    """Edges at a node; the type holds for both directions."""
    out, into = F.col("from_ku") == ku_id, F.col("to_ku") == ku_id
    rows = rel.where({"out": out, "in": into, "both": out | into}[direction])
    return rows.where(F.col("rel_type") == rel_type) if rel_type else rows


def all_relations(rel: DataFrame, limit: int = 5000) -> DataFrame:
    return rel.orderBy("ord", "rel_id").limit(limit)


def claims_by_domain(ku: DataFrame, domain: str, claim_status: str | None = None) -> DataFrame:
    """Claims of a domain, deleted ones too."""
    rows = ku.where((F.col("ku_type") == "Claim") & (F.col("domain") == domain))
    return rows.where(F.col("extra.claim_status") == claim_status) if claim_status else rows


def conflicts(cards: DataFrame, *, domain: str = "", status: str = "open") -> DataFrame:
    rows = cards.where(F.col("status") == status)
    return rows.where(F.col("domain") == domain) if domain else rows


def recent_events(log: DataFrame, limit: int = 50, event: str = "") -> DataFrame:
    """Latest events, of a type if one is given; a top-k and not a sort."""
    rows = log.where(F.col("event") == event) if event else log
    return rows.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)


def stats(ku: DataFrame, rel: DataFrame, cards: DataFrame) -> DataFrame:
    """(metric, value): units by type, totals, open conflicts and graph size."""
    live = ku.where("status != 'deleted'")
    row = lambda name: F.lit(name).alias("metric")
    count = F.count("*").alias("value")
    by = live.groupBy("ku_type").agg(count).select(F.concat(F.lit("type:"), "ku_type").alias("metric"), "value")
    edges = rel.groupBy("from_ku", "to_ku").agg(F.lit(1).alias("one"))
    parts = [live.agg(count).select(row("total_kus"), "value"), rel.agg(count).select(row("total_relations"), "value"), cards.where("status = 'open'").agg(count).select(row("open_conflicts"), "value"), edges.agg(count).select(row("graph_edges"), "value"), live.select("ku_id").union(rel.select("from_ku")).union(rel.select("to_ku")).distinct().agg(count).select(row("graph_nodes"), "value")]
    for p in parts:
        by = by.unionByName(p)
    return by


def ingest_counts(ku: DataFrame) -> DataFrame:
    """Number of units by type, as the response to an ingest tells them."""
    return ku.groupBy("ku_type").agg(F.count("*").alias("n"), F.min("ku_id").alias("first_id"))


def event_counts(ku: DataFrame) -> DataFrame:
    """One row with the counts that ``knowledge.created`` carries."""
    return ku.agg(*[F.count_if(F.col("ku_type") == t).alias(t.lower()) for t in KU_TYPES[:5]])


def induced(ku: DataFrame, rel: DataFrame, limit: int = 2000, edges: int = 20_000) -> DataFrame:
    """Edges with both ends among the capped units."""
    nodes = capped_per_type(ku, max(1, min(5000, limit))).select("ku_id")
    kept = rel.join(nodes.withColumnRenamed("ku_id", "from_ku"), "from_ku", "left_semi").join(nodes.withColumnRenamed("ku_id", "to_ku"), "to_ku", "left_semi")
    return kept.orderBy("ord", "rel_id").limit(min(edges, 20_000))


def response(ku: DataFrame, include_source_text: bool = True) -> DataFrame:
    return ku if include_source_text else ku.withColumn("extra", F.col("extra").dropFields("source_text"))


# --- writes ---


def upsert(old: DataFrame, new: DataFrame, key: str = "ku_id") -> DataFrame:
    """``new`` rows replace those of the same key but keep their type and time of creation."""
    kept = old.join(new.select(key), key, "left_anti")
    if "created_at" not in old.columns:
        return kept.unionByName(new)
    fixed = [c for c in ("ku_type", "created_at") if c in old.columns and key == "ku_id"]
    prior = old.select(key, *[F.col(c).alias(f"_{c}") for c in fixed])
    merged = new.join(prior, key, "left")
    for c in fixed:
        merged = merged.withColumn(c, F.coalesce(f"_{c}", c))
    return kept.unionByName(merged.select(*old.columns))


def soft_delete(ku: DataFrame, gone: DataFrame) -> DataFrame:
    """Units of ``gone`` (ku_id) marked deleted."""
    mark = gone.select("ku_id").distinct().withColumn("_gone", F.lit(True))
    return ku.join(mark, "ku_id", "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is neither stored nor met before (first by ``ord`` wins)."""
    order = "ord" if "ord" in new.columns else key
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def delete_relation(rel: DataFrame, rel_id: str) -> DataFrame:
    return rel.where(F.col("rel_id") != rel_id)


def numbered(rows: DataFrame, *order: Column | str, base: int = 0) -> DataFrame:
    """Adds ``number``: base + 1, base + 2, ... in a fixed order.

    Partitions are ranged by the order, numbered inside, and offset by the
    sizes of those before, so no single task sorts all rows.  The ranged rows
    are written first: drawn again, the ranges could differ.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")  # a row per partition
    return ranged.withColumn("_k", local).join(before, "_p").withColumn("number", (F.col("_k") + F.col("_b") + base).cast("bigint")).drop("_p", "_k", "_b")


def allocate_ids(rows: DataFrame, prefix: str, base: int = 0, order: Column | str = "ord") -> DataFrame:
    """Adds ``new_id``: the prefix and the next numbers in a fixed order."""
    return numbered(rows, order, base=base).withColumn("new_id", F.concat(F.lit(prefix + "_"), F.lpad(F.col("number").cast("string"), 8, "0"))).drop("number")


class Store:
    """Named tables as numbered snapshots in a folder; the newest finished one is current."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, path = self._fs(f"{self.folder}/{table}")
        if not fs.exists(path):
            return []
        jp = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(jp(f"{self.folder}/{table}/{n}/_SUCCESS")))

    def read(self, table: str, schema) -> DataFrame:
        have = self.versions(table)
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/v{have[-1]}")

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        have = self.versions(table)
        path = f"{self.folder}/{table}/v{(have[-1] if have else 0) + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to the current snapshot as parts of their own."""
        rows.write.mode("append").parquet(f"{self.folder}/{table}/v{(self.versions(table) or [1])[-1]}")

    def clear(self, tables: dict) -> int:
        """Write empty snapshots; the number of units there were."""
        n = self.read("ku", tables["ku"]).count() if "ku" in tables else 0
        for name, schema in tables.items():
            self.write(name, self.spark.createDataFrame([], schema))
        return n
