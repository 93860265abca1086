"""URL filters by a temporal list join.

A block list is a log of dated entries: a domain (with its subdomains) or a
domain and path prefix is added to a category or removed from it.  Entries
become validity intervals (from an addition to the next removal), and every
capture is joined as of its fetch time with the intervals of its host and the
host's parent domains that are open at that time.

Only page id, URL and fetch time are read.  The distinct hosts, not the
captures, meet the list, by those of their suffixes alone that have as many
labels as some listed domain; every listed host gets the array of its
intervals.  The captures join that, once, by host, and the intervals open at
the fetch time are told row by row.  A host in every capture costs no more
than others where the array side is small enough to be sent around, and its
partition is split at run time where not.

Defined results: a null or unparsable URL has no host and is not blocked; a
null fetch time matches nothing; hosts are compared without case, port, user
and a final dot; an addition repeated while active changes nothing, a removal
without addition too; of entries at the same instant the removal comes first,
so a list replaced at once stays active; an interval holds its start and not
its end; repeated captures come out as often; empty tables give empty results
(an empty list blocks nothing); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The production list: names, the top-level parts they are listed under, and what it says over time.
NAMES = {"casino-win": "gambling", "free-bets": "gambling", "spam-farm": "spam", "cheap-pills": "pharma", "adult-x": "adult", "ads-track": "tracking"}
PARENTS = ("example.com", "example.net", "example.org")
#: Entries of every domain: (day added or removed, action), by the name's place in the list.
EPOCH = "2024-01-01 00:00:00"
HISTORY = ((0, 0, "add"), (9, 1, "remove"), (14, 1, "add"), (24, 2, "remove"))


def production_entries() -> list[tuple[str, str, str, int, str]]:
    """(domain, path, category, day, action) of the production list."""
    rows = []
    for k, (name, category) in enumerate(NAMES.items()):
        for j, parent in enumerate(PARENTS):
            rows += [(f"{name}.{parent}", "", category, base + step * k + j, action) for base, step, action in HISTORY]
            rows.append((f"{name}.{parent}", "/en/", "english-" + category, 3 + k, "add"))
    return rows


def entries(spark: SparkSession) -> DataFrame:
    """The production list as a table: domain, path, category, at, action."""
    rows = spark.createDataFrame(production_entries(), "domain string, path string, category string, day int, action string")
    return rows.select("domain", "path", "category", F.expr(f"timestamp'{EPOCH}' + make_interval(0, 0, 0, day)").alias("at"), "action")


def fetch_time() -> Column:
    """Captures carry no time: a page's is a fixed minute of January 2024 by its id."""
    return F.expr(f"timestamp'{EPOCH}' + make_interval(0, 0, 0, 0, 0, CAST(pmod(page_id * 7919, 43200) AS INT))")


def intervals(log: DataFrame) -> DataFrame:
    """(domain, path, category, valid_from, valid_to): when each entry was active; open ends are null."""
    w = Window.partitionBy("domain", "path", "category").orderBy("at", F.desc("action"))
    order = log.where("domain IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select(F.lower("domain").alias("domain"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("category", F.lit("")).alias("category"), "at", "action")
    # Runs of the same action count by their first entry.
    turns = order.withColumn("_before", F.lag("action").over(w)).where("_before IS NULL OR _before != action")
    return turns.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'").select("domain", "path", "category", F.col("at").alias("valid_from"), "valid_to").where("valid_to IS NULL OR valid_to > valid_from")


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_rules(hosts: DataFrame, active: DataFrame) -> DataFrame:
    """(_host, rules): the listed ones of ``hosts`` (_host) with the intervals of their own and their parents' domains."""
    labels = lambda c: F.size(F.split(c, r"\."))
    # As many rows as listed domains differ in number of labels.
    sizes = sorted(r[0] for r in active.select(labels("domain").alias("n")).distinct().collect())
    suffixes = F.filter(F.array(*[F.when(labels("_host") >= n, F.substring_index("_host", ".", -n)) for n in sizes]).cast("array<string>"), lambda x: x.isNotNull())
    keys = hosts.select("_host", F.explode(suffixes).alias("_domain"))
    joined = keys.join(active, F.col("_domain") == F.col("domain"))
    return joined.groupBy("_host").agg(F.collect_list(F.struct("domain", "path", "category", "valid_from", "valid_to")).alias("_rules"))


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """page_id, url, fetch_time, ``blocked``, sorted ``categories`` and the listed ``rules`` in force.

    ``captures`` has page_id, url and fetch_time.
    """
    rows = captures.select("page_id", "url", "fetch_time").withColumn("host", host_of(F.col("url")))
    rules = host_rules(rows.where("host IS NOT NULL").select(F.col("host").alias("_host")).distinct(), intervals(log))
    joined = rows.join(rules, rows.host == rules._host, "left").withColumn("_path", path_of(F.col("url")))
    open_ = lambda r: (F.col("fetch_time") >= r.valid_from) & (r.valid_to.isNull() | (F.col("fetch_time") < r.valid_to)) & F.col("_path").startswith(r.path)
    hits = joined.withColumn("_hits", F.coalesce(F.filter("_rules", open_), F.array().cast(joined.schema["_rules"].dataType)))
    told = lambda f: F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", f))), ",")
    return hits.select("page_id", "url", "fetch_time", (F.size("_hits") > 0).alias("blocked"), told(lambda r: r.category).alias("categories"), told(lambda r: F.concat(r.domain, r.path)).alias("rules"))


def oracle_sql() -> str:
    values = ", ".join(f"('{d}', '{p}', '{c}', {day}, '{a}')" for d, p, c, day, a in production_entries())
    return f"""
    WITH log AS (SELECT domain, path, category, TIMESTAMP '{EPOCH}' + to_days(CAST(day AS INTEGER)) AS since, action FROM (VALUES {values}) t(domain, path, category, day, action)),
    turns AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY domain, path, category ORDER BY since, action DESC) AS before FROM log) WHERE before IS NULL OR before <> action),
    iv AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY domain, path, category ORDER BY since, action DESC) AS valid_to FROM turns) WHERE action = 'add' AND (valid_to IS NULL OR valid_to > since)),
    c AS (SELECT page_id, url, TIMESTAMP '{EPOCH}' + to_minutes(CAST((page_id * 7919) % 43200 AS INTEGER)) AS fetch_time,
                 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    hits AS (SELECT c.page_id, iv.category, iv.domain || iv.path AS rule FROM c JOIN iv ON (c.host = iv.domain OR c.host LIKE '%.' || iv.domain) AND c.fetch_time >= iv.since AND (iv.valid_to IS NULL OR c.fetch_time < iv.valid_to) AND starts_with(c.path, iv.path)),
    g AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM hits GROUP BY page_id)
    SELECT c.page_id AS page_id, url, fetch_time, g.page_id IS NOT NULL AS blocked, coalesce(categories, '') AS categories, coalesce(rules, '') AS rules FROM c LEFT JOIN g USING (page_id)"""
