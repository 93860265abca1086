"""Observation of near-duplicate units: cosine of character trigram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_name
from ..sources.tables import written

THRESHOLD = 0.62


def trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def near_pairs(items: DataFrame, threshold: float = THRESHOLD, ascii_only: bool = False) -> DataFrame:
    """(a, b, cosine) of items (id, text) whose trigram cosine reaches ``threshold``.

    Trigrams are ranked by the number of texts that have them.  A text's
    commonest ones, as long as their part of its length stays below the
    threshold, can't make a pair alone, so texts meet only through the rest
    (the rarest trigram that a pair shares is in the rest of both); nothing
    that reaches the threshold is lost.  What meets is compared in full.
    """
    t = items.select("id", normalize_name(F.col("text"), ascii_only).alias("t"))
    g = written(t.select("id", F.explode(trigrams(F.col("t"))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n")), "trigrams")
    norm = g.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    freq = g.groupBy("g").agg(F.count("*").alias("df"))
    common = Window.partitionBy("id").orderBy(F.desc("df"), "g")
    own = g.join(freq, "g").join(norm, "id").withColumn("part", F.sqrt(F.sum(F.col("n") * F.col("n")).over(common.rowsBetween(Window.unboundedPreceding, 0)).cast("double")) / F.col("norm"))
    rest = own.where(F.col("part") >= threshold - 2e-6).select("id", "g")  # the cosine is rounded to six places
    met = rest.select(F.col("id").alias("a"), "g").join(rest.select(F.col("id").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    mine, other = g.withColumnRenamed("id", "a"), g.select(F.col("id").alias("b"), "g", F.col("n").alias("nb"))
    dots = met.join(mine, "a").join(other, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("nb")).alias("dot"))
    na, nb = norm.select(F.col("id").alias("a"), F.col("norm").alias("x")), norm.select(F.col("id").alias("b"), F.col("norm").alias("y"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("dot") / (F.col("x") * F.col("y")), 6).alias("cosine")).where(F.col("cosine") >= threshold)


def summary(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs, nodes involved, and their share of all items."""
    nodes = pairs.select("a").union(pairs.select("b")).agg(F.countDistinct("a").alias("involved"))
    return pairs.agg(F.count("*").alias("pairs")).crossJoin(nodes).crossJoin(items.agg(F.count("*").alias("items"))).select("pairs", "involved", "items", F.when(F.col("items") > 0, F.round(F.col("involved") / F.col("items"), 6)).otherwise(0.0).alias("rate"))
