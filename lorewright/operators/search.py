"""Keyword, vector and fused search.

An index is three tables: postings sorted by term, document lengths, and term
statistics.  New units add rows to the first two and a merge of the third,
which is as large as the vocabulary; nothing is tokenised or counted again.  A
query reads the postings of its words alone, by a filter that Parquet prunes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokens
from ..schema import INACTIVE
from ..sources.tables import written

K1, B, EPSILON, RRF_K, ARM = 1.5, 0.75, 0.25, 60, 100
MIN_COSINE = 0.1


def document_text(name: Column, summary: Column, tags: Column) -> Column:
    return F.concat_ws(" ", name, summary, F.array_join(tags, " "))


@dataclass
class Index:
    """postings(id, term, tf), lengths(id, ord, dl), terms(term, df)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    def saved(self) -> Index:
        """The index as written tables, postings sorted by term, so that texts are tokenised once."""
        postings = written(by_term(self.postings), "postings")
        return Index(postings, written(self.lengths, "lengths"), written(document_frequencies(postings), "terms"))

    def union(self, other: Index) -> Index:
        """Append units without touching those indexed."""
        terms = self.terms.unionByName(other.terms).groupBy("term").agg(F.sum("df").alias("df"))
        return Index(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths), terms)


TABLES = ("postings", "lengths", "terms")


def by_term(postings: DataFrame) -> DataFrame:
    """Postings laid so that every term is in one place and files are sorted by it."""
    return postings.repartition("term").sortWithinPartitions("term", "id")


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def save(ix: Index, folder: str) -> None:
    """Write an index for other sessions."""
    by_term(ix.postings).write.mode("overwrite").parquet(f"{folder}/postings")
    ix.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    ix.terms.write.mode("overwrite").parquet(f"{folder}/terms")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{t}") for t in TABLES))


def save_vectors(vectors: DataFrame, folder: str) -> None:
    """Write vectors with their ids; :func:`load_vectors` gives None where there are none."""
    vectors.write.mode("overwrite").parquet(folder)


def load_vectors(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def _frequencies(t: Column) -> Column:
    """Distinct tokens of a text with their numbers, and one entry of the length with no term; equal tokens are neighbours once sorted."""
    last = lambda s, i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1))
    ends = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: last(s, i))
    entry = lambda s, e: F.transform(e, lambda i, k: F.struct(F.get(s, i).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("bigint").alias("n")))
    # Elements of their own, so that the tokens are sorted and their ends found once a text.
    bound = lambda x, f: F.flatten(F.transform(F.array(x), f))
    counts = bound(F.sort_array(t), lambda s: F.when(F.size(s) > 0, bound(ends(s), lambda e: entry(s, e))).otherwise(F.array().cast("array<struct<term:string,n:bigint>>")))
    return F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(t).cast("bigint").alias("n"))), counts)


def index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", order: str | None = None) -> Index:
    """The index of a table of texts: every text is tokenised and counted where it lies, in one pass that is written; no Python worker is needed."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(order or id_column).alias("ord"), F.explode(F.flatten(F.transform(F.array(tokens(F.col(text))), _frequencies))).alias("f"))
    counted = written(rows.select("id", "ord", "f.term", "f.n"), "tokens")
    postings = counted.where("term IS NOT NULL").select("id", "term", F.col("n").alias("tf"))
    return Index(postings, counted.where("term IS NULL").select("id", "ord", F.col("n").alias("dl")), document_frequencies(postings))


def corpus_stats(ix: Index) -> DataFrame:
    """One row: n documents, average length, terms and the mean of raw idf; from lengths and term statistics alone."""
    n = ix.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return ix.terms.crossJoin(n).groupBy("n", "avgdl").agg(F.count("*").alias("terms"), F.avg(raw).alias("mean_idf"))


def scores(ix: Index, query: str) -> DataFrame:
    """(id, ord, score) of the documents that hold a query term; a repeated term counts again.

    A negative idf becomes EPSILON times the mean idf of the vocabulary.
    """
    spark = ix.postings.sparkSession
    asked = Counter(spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t)  # the query's own words
    own = F.col("term").isin(*asked) if asked else F.lit(False)
    count = F.coalesce(F.try_element_at(F.create_map(*[x for w, n in asked.items() for x in (F.lit(w), F.lit(n))]), F.col("term")), F.lit(0)) if asked else F.lit(0)
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = ix.terms.where(own).crossJoin(corpus_stats(ix)).select("term", "avgdl", (count * F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)).alias("weight"))
    # The words of a query, a row each.
    parts = ix.postings.where(own).join(F.broadcast(idf), "term").join(ix.lengths, "id")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return parts.groupBy("id", "ord").agg(F.sum(part).alias("score"))


def bm25(ix: Index, query: str, top_k: int = 10) -> DataFrame:
    """(id, score, rank) of the best documents; rounded scores, ties in order of arrival."""
    s = scores(ix, query).withColumn("score", F.round("score", 6))
    top = s.where("score != 0").orderBy(F.desc("score"), "ord").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).select("id", "score", "rank")  # a window over top_k rows


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    # The length is an element of its own, so that it is computed once a vector.
    return F.flatten(F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), lambda n: F.transform(v, lambda x: (x / n).cast("float"))))


def vector(vectors: DataFrame, query: DataFrame, top_k: int = 10, threshold: float | None = MIN_COSINE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score, rank) by inner product with the one vector of ``query`` (column ``q``); exact."""
    s = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(F.col(id_column).alias("id"), F.round(dot(F.col(column), F.col("q")), 6).alias("score"))
    if threshold is not None:
        top = s.orderBy(F.desc("score"), "id").limit(top_k).where(F.col("score") >= threshold)
    else:
        top = s.orderBy(F.desc("score"), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a window over top_k rows


def fuse(*arms: DataFrame, top_k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: (id, score, rank)."""
    rows = arms[0].select("id", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("id", "rank"))
    s = rows.groupBy("id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    top = s.orderBy(F.desc("score"), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def post_filter(hits: DataFrame, ku: DataFrame, *, exclude_inactive: bool = True, ku_types: list[str] | None = None, domain: str = "") -> DataFrame:
    """Hits that stand: known, not inactive, of the domain and types. Applied after the cut, never below it."""
    if not domain and not ku_types and not exclude_inactive:
        return hits
    rows = F.broadcast(hits).join(ku.select(F.col("ku_id").alias("id"), "ku_type", "status", "domain", F.coalesce("extra.claim_status", F.lit("active")).alias("claim_status")), "id")  # at most twice top_k hits
    if exclude_inactive:
        rows = rows.where(~F.col("status").isin(*INACTIVE) & ~((F.col("ku_type") == "Claim") & F.col("claim_status").isin(*INACTIVE)))
    if domain:
        rows = rows.where(F.col("domain") == domain)
    if ku_types:
        rows = rows.where(F.col("ku_type").isin(*ku_types))
    return rows.select(*hits.columns, "ku_type", "domain")


def by_name(ku: DataFrame, name: str, exact: bool = False, limit: int = 20) -> DataFrame:
    """Units whose name, summary or domain hold every word of ``name``, or whose name equals it."""
    live = ku.where("status != 'deleted'")
    if exact:
        return live.where(F.col("name") == name).orderBy("ord", "ku_id").limit(limit)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    bag = F.split(F.concat_ws(" ", low(F.col("name")), low(F.col("summary")), low(F.col("domain"))), r"[^\p{L}\p{N}]+")
    need = F.filter(F.split(F.lower(F.lit(name)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return live.where(F.size(F.array_except(need, bag)) == 0).orderBy("ord", "ku_id").limit(limit)


def domain_listing(ku: DataFrame, domain: str, top_k: int = 20, ku_types: list[str] | None = None) -> DataFrame:
    """The first units of a domain, cut before they are sorted by confidence."""
    rows = ku.where((F.col("domain") == domain) & (F.col("status") != "deleted")).orderBy("ord", "ku_id").limit(2 * top_k)
    if ku_types:
        rows = rows.where(F.col("ku_type").isin(*ku_types))
    return rows.orderBy("ord", "ku_id").limit(top_k).orderBy(F.desc("confidence"), "ord", "ku_id")
