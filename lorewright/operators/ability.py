"""Ability coverage: a taxonomy of skills with concept checklists against units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DOMAIN_CAP, REFS = 500, 20
PACKAGE = "ability_key string, display_name string, domain string, skills array<struct<skill_key string, display_name string, coverage double, concept_hits array<string>, ku_refs array<string>>>, workflows array<struct<name string, steps array<string>>>, coverage map<string,double>, version string"
#: Other spellings by which a concept counts as covered.
ALIASES = {k: v.split() for k, v in (("moat", "护城河"), ("drawdown", "回撤 最大回撤"), ("momentum", "动量 趋势"), ("sharpe ratio", "夏普 sharpe"), ("transformer", "变换器"), ("attention", "注意力"), ("value factor", "价值因子 价值 低估"), ("diversification", "分散 多元 分散化"), ("intrinsic value", "内在价值 内生价值"), ("loss aversion", "损失厌恶 亏损"), ("confirmation bias", "确认偏差 确认偏见"))}


def pool(ku: DataFrame, taxonomy: DataFrame, limit: int = DOMAIN_CAP) -> DataFrame:
    """(ability_key, ku_id, ord, text): units of an ability's domains, the first ``limit`` of each domain, once each."""
    domains = taxonomy.select("ability_key", F.explode("domains").alias("domain")).distinct()
    live = ku.where("status != 'deleted' AND ku_type != 'Ability'").join(domains.select("domain").distinct(), "domain", "left_semi")
    first = F.row_number().over(Window.partitionBy("domain").orderBy("ord", "ku_id"))
    text = F.lower(F.concat_ws(" ", "name", "summary", F.array_join("tags", " ")))
    # Ids alone are ranked; texts are fetched for the first ``limit`` of each domain, which are few enough to be sent to every task.
    chosen = live.select("domain", "ku_id", "ord").withColumn("_r", first).where(F.col("_r") <= limit).select(F.col("domain").alias("_d"), F.col("ku_id").alias("_k"), F.col("ord").alias("_o"))
    same = F.col("domain").eqNullSafe(F.col("_d")) & F.col("ku_id").eqNullSafe(F.col("_k")) & F.col("ord").eqNullSafe(F.col("_o"))
    rows = live.join(F.broadcast(chosen), same, "left_semi").select("domain", "ku_id", "ord", text.alias("text"))
    return rows.join(domains, "domain").select("ability_key", "ku_id", "ord", "text").distinct()


def checklist(taxonomy: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(ability_key, skill, required, concept, needle) with a row per spelling; a skill without concepts has a null one."""
    sk = taxonomy.select("ability_key", F.explode(F.concat(F.transform("required_skills", lambda s: F.struct(s.alias("skill"), F.lit(True).alias("required"))), F.transform(F.coalesce("optional_skills", F.array().cast("array<string>")), lambda s: F.struct(s.alias("skill"), F.lit(False).alias("required"))))).alias("s"), "concept_checklist")
    rows = sk.select("ability_key", "s.skill", "s.required", F.explode_outer(F.try_element_at("concept_checklist", F.col("s.skill"))).alias("concept"))
    table = ALIASES if aliases is None else aliases
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if table else F.create_map().cast("map<string,array<string>>")
    low = F.lower("concept")
    return rows.withColumn("needle", F.explode_outer(F.concat(F.array(low), F.coalesce(F.try_element_at(pairs, low), F.array().cast("array<string>")))))


def hits(items: DataFrame, units: DataFrame) -> DataFrame:
    """(ability_key, skill, required, concept, hit) of every item of the checklist."""
    match = items.where("needle IS NOT NULL").join(units, "ability_key").where(F.contains("text", "needle")).select("ability_key", "skill", "concept").distinct().withColumn("hit", F.lit(True))
    return items.select("ability_key", "skill", "required", "concept").distinct().join(match, ["ability_key", "skill", "concept"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def coverage(h: DataFrame) -> DataFrame:
    """(ability_key, skill, required, coverage): share of concepts hit, half-even to two places.

    A required skill without concepts has 0; an optional one isn't listed.
    """
    share = F.bround(F.count_if("hit") / F.count("concept"), 2)
    g = h.groupBy("ability_key", "skill", "required").agg(F.count("concept").alias("n"), F.when(F.count("concept") > 0, share).otherwise(0.0).alias("coverage"))
    return g.where("required OR n > 0").drop("n")


def report(taxonomy: DataFrame, cov: DataFrame, units: DataFrame) -> DataFrame:
    """(ability_key, can_compile, missing_skills, ku_count) of every ability."""
    g = cov.where("required").groupBy("ability_key").agg(F.avg((F.col("coverage") >= 0.5).cast("int")).alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("coverage") < 0.5, F.col("skill")))), ",").alias("missing_skills"))
    n = units.groupBy("ability_key").agg(F.count("*").alias("ku_count"))
    t = taxonomy.select("ability_key", "min_coverage")
    return t.join(g, "ability_key").join(n, "ability_key", "left").select("ability_key", (F.col("passed") >= F.col("min_coverage")).alias("can_compile"), "missing_skills", F.coalesce("ku_count", F.lit(0)).cast("bigint").alias("ku_count"))


def skills(items: DataFrame, units: DataFrame, cov: DataFrame, h: DataFrame) -> DataFrame:
    """Skills with coverage: concepts hit and the first twenty units that name the skill or a concept of it."""
    title = items.select("ability_key", "skill", F.replace("skill", F.lit("_"), F.lit(" ")).alias("needle"))
    needles = items.where("needle IS NOT NULL").select("ability_key", "skill", "needle").union(title).distinct()
    found = needles.join(units, "ability_key").where(F.contains("text", "needle")).select("ability_key", "skill", "ord", "ku_id").distinct()
    rank = F.row_number().over(Window.partitionBy("ability_key", "skill").orderBy("ord", "ku_id"))
    refs = found.withColumn("_r", rank).where(F.col("_r") <= REFS).groupBy("ability_key", "skill").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ku_id"))), lambda x: x["ku_id"]), ",").alias("ku_refs"))
    hit = h.where("hit").groupBy("ability_key", "skill").agg(F.array_join(F.sort_array(F.collect_list("concept")), ",").alias("concept_hits"))
    rows = cov.where("coverage > 0").join(refs, ["ability_key", "skill"], "left").join(hit, ["ability_key", "skill"], "left")
    return rows.select("ability_key", "skill", F.initcap(F.replace("skill", F.lit("_"), F.lit(" "))).alias("display_name"), "coverage", F.coalesce("concept_hits", F.lit("")).alias("concept_hits"), F.coalesce("ku_refs", F.lit("")).alias("ku_refs"))


def packages(taxonomy: DataFrame, skill_rows: DataFrame, rep: DataFrame, version: str = "1.0.0") -> DataFrame:
    """(ability_key, package) as JSON of the abilities that pass their gate."""
    s = skill_rows.groupBy("ability_key").agg(F.sort_array(F.collect_list(F.struct(F.col("skill").alias("skill_key"), "display_name", "coverage", F.split("concept_hits", ",").alias("concept_hits"), F.split("ku_refs", ",").alias("ku_refs")))).alias("skills"))
    rows = taxonomy.join(rep.where("can_compile").select("ability_key"), "ability_key").join(s, "ability_key", "left")
    cov = F.map_from_entries(F.transform("skills", lambda x: F.struct(x["skill_key"], x["coverage"])))
    return rows.select("ability_key", F.to_json(F.struct("ability_key", "display_name", "domain", "skills", "workflows", cov.alias("coverage"), F.lit(version).alias("version"))).alias("package"))


def write_packages(rows: DataFrame, folder: str) -> None:
    """One JSON line per ability, in a folder by key."""
    rows.write.mode("overwrite").partitionBy("ability_key").text(folder)


def load_package(spark, folder: str, key: str) -> DataFrame:
    """The compiled package of a key (no row if there is none); stored packages carry no unit list of their own."""
    text = spark.read.text(folder)
    return text.where(F.col("ability_key") == key).select(F.from_json("value", PACKAGE).alias("p")).select("p.*")


def workflows(taxonomy: DataFrame) -> DataFrame:
    """(ability_key, workflow, step_no, step)."""
    w = taxonomy.select("ability_key", F.explode("workflows").alias("w"))
    return w.select("ability_key", F.col("w.name").alias("workflow"), F.posexplode("w.steps").alias("step_no", "step"))

