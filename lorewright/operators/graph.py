"""Breadth-first search, neighbours and paths by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import written

DECAY = 0.7


def undirected(rel: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """(u, v, weight, rel_type, ord) in both directions."""
    rows = rel.where(F.col("rel_type").isin(*rel_types)) if rel_types else rel
    cols = ("weight", "rel_type", "ord")
    return rows.select(F.col("from_ku").alias("u"), F.col("to_ku").alias("v"), *cols).union(rows.select("to_ku", "from_ku", *cols))


def bfs(rel: DataFrame, start: DataFrame, max_depth: int = 2, rel_types: list[str] | None = None) -> DataFrame:
    """(seed, node, depth, score, rel_type) of what ``start`` (seed) reaches, each by its first-found path.

    Nodes are expanded in the order they were found, edges by ``ord``; a
    node's score is its parent's times weight times 0.7.  All seeds advance
    together, one join a level; of several edges to a node only the first is
    followed.  A level is written before the next, so plans don't grow with
    the depth.
    """
    edges = written(undirected(rel, rel_types), "edges")
    seen = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit("").alias("rel_type"), F.array().cast("array<bigint>").alias("path"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select("seed", F.col("node").alias("u"), "score", "path").join(edges, "u").select("seed", F.col("v").alias("node"), F.lit(depth).alias("depth"), (F.col("score") * F.col("weight") * DECAY).alias("score"), "rel_type", F.concat("path", F.array("ord")).alias("path"))
        new = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        first = F.row_number().over(Window.partitionBy("seed", "node").orderBy("path"))
        frontier = new.withColumn("_r", first).where("_r = 1").drop("_r")
        if depth < max_depth:
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").drop("path")


def neighbors(rel: DataFrame, ku_id: str, depth: int = 1, rel_type: str = "") -> DataFrame:
    """(node, depth) of other nodes within ``depth`` hops; an unknown node has none."""
    seed = rel.sparkSession.range(1).select(F.lit(ku_id).alias("seed"))
    return bfs(rel, seed, depth, [rel_type] if rel_type else None).select("node", "depth")


def ranked(reached: DataFrame, ku: DataFrame, top_k: int = 20) -> DataFrame:
    """The best reached units that exist, by score."""
    rows = reached.join(ku.select(F.col("ku_id").alias("node"), "name", F.substring("summary", 1, 100).alias("summary")), "node")
    return rows.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node").limit(top_k)


def graph_mode(rel: DataFrame, ku: DataFrame, seeds: DataFrame, top_k: int = 20) -> DataFrame:
    """Two hops around each of ``seeds`` (id, rank): units first seen by the best seed, best scores first."""
    reached = bfs(rel, seeds.select(F.col("id").alias("seed")), 2).join(seeds.select(F.col("id").alias("seed"), F.col("rank").alias("seed_rank")), "seed")
    best = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node"))
    known = reached.join(ku.select(F.col("ku_id").alias("node")), "node", "left_semi").withColumn("_k", best).where(F.col("_k") <= top_k)
    first = F.row_number().over(Window.partitionBy("node").orderBy("seed_rank"))
    rows = known.withColumn("_r", first).where("_r = 1").withColumn("score", F.round("score", 6))
    return rows.orderBy(F.desc("score"), "node").limit(top_k).select("node", "score", "depth")


def shortest_path(rel: DataFrame, start: str, goal: str, max_hops: int = 100) -> DataFrame:
    """One row: ``path`` (empty if there is none), ``reachable`` and ``hops``; directed and unweighted.

    Ties go to the path of smaller ids.  Each level keeps one path a node, so
    the frontier never outgrows the graph.
    """
    spark = rel.sparkSession
    edges = rel.select(F.col("from_ku").alias("u"), F.col("to_ku").alias("v")).distinct()
    nodes = edges.select("u").union(edges.select("v"))
    path: list[str] = []
    if not nodes.where(F.col("u") == start).isEmpty() and not nodes.where(F.col("u") == goal).isEmpty():
        seen = frontier = spark.createDataFrame([(start, [start])], "node string, path array<string>")
        for _ in range(max_hops + 1):
            hit = frontier.where(F.col("node") == goal).first()
            if hit:
                path = hit.path
                break
            step = frontier.withColumnRenamed("node", "u").join(edges, "u").select(F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
            frontier = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
            frontier = written(frontier, "frontier")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return spark.createDataFrame([(path, bool(path), max(0, len(path) - 1))], "path array<string>, reachable boolean, hops int")
