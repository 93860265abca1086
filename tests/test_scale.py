"""What moves or is held at size: token counts without Python workers, pools without texts, chapters of blank texts."""

from collections import Counter

from compare import duck
from pyspark.sql import functions as F

from lorewright.operators import ability, search
from lorewright.plans import core


def test_tokens_are_counted_by_expressions(spark):
    rows = [["b", "a", "b", "ab", "a", "b"], [], ["z"], ["y", "y"]]
    got = spark.createDataFrame([(t,) for t in rows], "t array<string>").select("t", search._frequencies(F.col("t")).alias("f"))
    for r in got.collect():
        assert r.f[0].term is None and r.f[0].n == len(r.t)
        assert {x.term: x.n for x in r.f[1:]} == Counter(r.t) and len(r.f) == len(set(r.t)) + 1


def test_no_text_is_ranked(spark):
    tax = spark.createDataFrame([("k", ["d"])], "ability_key string, domains array<string>")
    ku = spark.range(30).select(F.col("id").cast("string").alias("ku_id"), F.lit("Fact").alias("ku_type"), F.lit("n").alias("name"), F.concat(F.lit("s"), "id").alias("summary"), F.lit("d").alias("domain"), F.array(F.lit("t")).alias("tags"), (-F.col("id")).alias("ord"), F.lit("active").alias("status"))
    pool = ability.pool(ku, tax, 7)
    assert sorted(r.text for r in pool.collect()) == sorted(f"n s{i} t" for i in range(23, 30))
    plan = pool._jdf.queryExecution().optimizedPlan()
    ranked = [line for line in plan.toString().splitlines() if "row_number" in line]
    assert ranked and not any("summary" in line or "text" in line for line in plan.toString()[plan.toString().index(ranked[-1]) :].splitlines()[:3])


def test_blank_texts_have_no_chapter_in_the_query(spark, tmp_path):
    rows = [(1, "a\nb"), (2, ""), (3, " \n\t\n"), (4, None), (5, "c  ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in core.txt_chapters(spark, str(tmp_path)).collect()}
    c = duck("/root/testdata/sf0.001")
    c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(c.execute(core.SQL["txt_chapters"]).fetchall()) and {r[0] for r in got} == {1, 5}
