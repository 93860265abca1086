"""Search, graph, identity, evolution, abilities and store on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lorewright import schema
from lorewright.operators import ability, evolve, extract, graph, identity, relate, search, store, synthesis
from lorewright.streaming import crystallize
from lorewright.streaming.bus import Bus


def test_bm25(spark):
    rows = [(1, "risk management in portfolios"), (2, "momentum factor and risk"), (3, "graph neural network"), (4, "风险管理是投资的核心")]
    ix = search.index(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert search.bm25(ix, "风险管理").first().id == 4
    assert search.bm25(ix, "zzz").count() == 0
    assert {r.id for r in search.bm25(ix, "momentum portfolios").collect()} == {1, 2}
    assert search.bm25(ix, "risk").count() == 0  # in half of the documents: idf is 0
    more = search.index(spark.createDataFrame([(5, "momentum momentum")], "doc_id bigint, text string"))
    assert search.bm25(ix.union(more), "momentum").first().id == 5


def test_saved_indexes(spark, tmp_path):
    ix = search.index(spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "eps zeta")], "doc_id bigint, text string"))
    search.save(ix, str(tmp_path / "ix"))
    assert search.bm25(search.load(spark, str(tmp_path / "ix")), "gamma").first().id == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id bigint, embedding array<float>")
    search.save_vectors(v, str(tmp_path / "v"))
    loaded = search.load_vectors(spark, str(tmp_path / "v"))
    assert [r.id for r in search.vector(loaded, v.where("vec_id = 2").select(F.col("embedding").alias("q"))).collect()] == [2, 1]
    assert search.load_vectors(spark, str(tmp_path / "none")) is None


def test_rrf_and_filter(spark):
    arm = lambda *ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank int")
    got = search.fuse(arm("a", "b"), arm("b", "c")).collect()
    assert got[0].id == "b" and got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    ku = spark.createDataFrame([("a", "Claim", "active", "d", ("superseded",)), ("b", "Concept", "active", "d", (None,)), ("c", "Claim", "deleted", "d", ("active",))], "ku_id string, ku_type string, status string, domain string, extra struct<claim_status:string>")
    hits = search.fuse(arm("a", "b"), arm("b", "c"))
    assert [r.id for r in search.post_filter(hits, ku).collect()] == ["b"]
    assert {r.id for r in search.post_filter(hits, ku, exclude_inactive=False, domain="d").collect()} == {"a", "b", "c"}


EDGES = [("A", "B", "X", 0.9, 1), ("B", "C", "X", 0.8, 2), ("C", "D", "Y", 0.7, 3)]


def rel(spark, edges=EDGES):
    rows = [(f"r{i}", *e) for i, e in enumerate(edges)]
    return spark.createDataFrame(rows, "rel_id string, from_ku string, to_ku string, rel_type string, weight double, ord bigint")


def test_graph(spark):
    seed = spark.createDataFrame([("A",)], "seed string")
    got = {r.node: (r.depth, round(r.score, 6)) for r in graph.bfs(rel(spark), seed, 2).collect()}
    assert got == {"B": (1, 0.63), "C": (2, round(0.63 * 0.8 * 0.7, 6))}
    assert {r.node for r in graph.bfs(rel(spark), seed, 3, ["X"]).collect()} == {"B", "C"}
    path = lambda a, b: graph.shortest_path(rel(spark), a, b).first()
    assert path("A", "D").path == list("ABCD") and path("A", "D").hops == 3
    assert path("D", "A").path == [] and not path("A", "nowhere").reachable
    loop = rel(spark, [("A", "A", "X", 1.0, 1), ("A", "B", "X", 1.0, 2), ("A", "B", "Y", 0.5, 3)])
    assert [r.node for r in graph.neighbors(loop, "A").collect()] == ["B"]


def test_redirect(spark):
    r = rel(spark, [("C", "B", "X", 1.0, 1), ("A", "C", "X", 1.0, 2), ("A", "B", "X", 1.0, 3), ("Z", "Z", "X", 1.0, 4)])
    ids = spark.createDataFrame([("C", "f", "A"), ("A", "f", "A")], "ku_id string, fp string, canonical_id string")
    got = {(x.from_ku, x.to_ku) for x in identity.redirect(r, ids).collect()}
    assert got == {("A", "B"), ("Z", "Z")} and identity.redirect(r, ids).count() == 2


def claims(spark, *rows):
    return spark.createDataFrame([(i, "d", c, list(s), "pending", k, t) for k, (i, t, c, s) in enumerate(rows)], "ku_id string, domain string, confidence double, supports array<string>, claim_status string, ord bigint, statement string")


def test_conflicts(spark):
    c = claims(spark, ("a", "index funds are good", 0.80, ["e1"]), ("b", "index funds are not good", 0.68, ["e2"]))
    assert [x.status for x in evolve.cards(evolve.pairs(c)).collect()] == ["open"]
    c = claims(spark, ("a", "index funds are good", 0.90, ["e1"]), ("b", "index funds are not good", 0.55, ["e2"]))
    card = evolve.cards(evolve.pairs(c)).first()
    assert (card.status, card.winner, card.loser) == ("resolved", "a", "b")
    c = claims(spark, ("a", "index funds are good value", 0.6, ["e1"]), ("b", "index funds are good value", 0.6, ["e2", "e3"]))
    assert evolve.evidence_boost(c, evolve.pairs(c)).first().confidence == pytest.approx(0.64)
    assert evolve.fold(c).count() == 2


def test_manual_resolution(spark):
    cards = spark.createDataFrame([("c1", "a", "b", "d", "open", "s", None, None)], "conflict_id string, claim_a_id string, claim_b_id string, domain string, status string, resolution_strategy string, resolution_note string, resolved_by string")
    ku = spark.createDataFrame([("a", ("disputed",)), ("b", ("disputed",))], "ku_id string, extra struct<claim_status:string>")
    after, units = evolve.manual_resolve(cards, ku, "c1", "b")
    assert after.first().status == "resolved"
    assert {r.ku_id: r.extra.claim_status for r in units.collect()} == {"a": "superseded", "b": "active"}
    again, _ = evolve.manual_resolve(after, ku, "c1", "a")
    assert again.first().resolved_by == "human"


def test_transition(spark):
    from lorewright.functions.text import transition

    rows = spark.createDataFrame([("pending", 0.8, False, 1.0), ("pending", 0.8, True, 0.1), ("pending", 0.2, False, 1.0), ("active", 0.2, False, 1.0), ("disputed", 0.5, True, 0.3), ("rejected", 0.9, False, 1.0)], "s string, c double, x boolean, g double")
    got = [r[0] for r in rows.select(transition(F.col("s"), F.col("c"), F.col("x"), F.col("g"))).collect()]
    assert got == ["active", "disputed", "rejected", "superseded", "active", "rejected"]
    assert got == [evolve.next_status(*r) for r in rows.collect()]


def test_extraction(spark):
    bad = "not json"
    many = '```json\n{"facts": [' + ", ".join('{"statement": "s%d"}' % i for i in range(10)) + '], "claims": [{"statement": "c", "confidence": 1.5}, {"statement": " "}], "entities": [{"name": "n", "type": "Robot"}]}\n```'
    rows = spark.createDataFrame([(0, bad), (1, many), (2, "{}")], "i int, r string")
    got = [r.x for r in rows.orderBy("i").select(extract.validated(extract.parse(F.col("r"))).alias("x")).collect()]
    assert got[0] is None and got[2] is None
    assert len(got[1].facts) == 5 and got[1].claims[0].confidence == 1.0 and len(got[1].claims) == 1 and got[1].entities[0].type == "Person"


def test_ingest(spark):
    chunks = spark.createDataFrame([("d1", 0, "Alpha Beta said 5 things. Gamma grows")], "doc_id string, chunk_idx int, content string")
    docs = spark.createDataFrame([("d1", "book.pdf", "Book")], "doc_id string, source string, title string")
    ku, rels = extract.package(extract.extract(chunks), docs, "general")
    kinds = {r.ku_type for r in ku.collect()}
    assert kinds == set(schema.KU_TYPES) - {"Ability"}
    assert {r.rel_type for r in rels.collect()} == {"SUPPORTS", "MENTIONS"}
    assert ku.where("ku_type = 'Claim'").first().domain == "general"
    assert extract.extract(chunks, lambda t: 1 / 0).count() == 0


def test_relations(spark):
    new = spark.createDataFrame([("e", "Entity", "Fama", "", None), ("c1", "Concept", "factor model", "by fama and french", None), ("c2", "Concept", "factor", "", None), ("c3", "Concept", "x", "", None)], "ku_id string, ku_type string, name string, summary string, doc_id string").withColumn("extra", F.struct(F.lit("").alias("definition")))
    got = {(r.from_ku, r.to_ku, r.rel_type) for r in relate.discover(new, new.limit(0)).collect()}
    assert got == {("e", "c1", "CREATED_BY"), ("c1", "c2", "DERIVED_FROM")}


def test_ability(spark):
    schema_ = "ability_key string, display_name string, domain string, domains array<string>, required_skills array<string>, optional_skills array<string>, min_coverage double, concept_checklist map<string,array<string>>, workflows array<struct<name:string,steps:array<string>>>"
    tax = spark.createDataFrame([("k", "K", "d", ["d", "e"], ["s_one", "s_two"], ["s_three"], 0.5, {"s_one": ["alpha", "beta"], "s_two": ["gamma"]}, [("w", ["s_one"])])], schema_)
    ku = spark.createDataFrame([("1", "Concept", "Alpha", "", "d", [], 1, "active"), ("2", "Concept", "x", "the beta", "e", [], 2, "active"), ("3", "Concept", "gamma", "", "d", [], 3, "deleted")], "ku_id string, ku_type string, name string, summary string, domain string, tags array<string>, ord bigint, status string")
    units, items = ability.pool(ku, tax), ability.checklist(tax)
    h = ability.hits(items, units)
    cov = ability.coverage(h)
    assert {r.skill: r.coverage for r in cov.collect()} == {"s_one": 1.0, "s_two": 0.0}
    rep = ability.report(tax, cov, units).first()
    assert rep.can_compile and rep.missing_skills == "s_two" and rep.ku_count == 2
    sk = ability.skills(items, units, cov, h).first()
    assert sk.display_name == "S One" and sk.ku_refs == "1,2"


def test_ability_files(spark, tmp_path):
    rows = spark.createDataFrame([("k", '{"ability_key": "k", "version": "1"}')], "ability_key string, package string")
    ability.write_packages(rows, str(tmp_path / "p"))
    assert ability.load_package(spark, str(tmp_path / "p"), "k").first().version == "1"
    assert ability.load_package(spark, str(tmp_path / "p"), "none").count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    kind = "ku_id string, name string, status string"
    assert s.read("ku", kind).count() == 0
    s.write("ku", spark.createDataFrame([("a", "x", "active"), ("b", "y", "active")], kind))
    new = store.upsert(s.read("ku", kind), spark.createDataFrame([("b", "z", "active"), ("c", "w", "active")], kind))
    s.write("ku", new)
    gone = store.soft_delete(s.read("ku", kind), spark.createDataFrame([("a",)], "ku_id string"))
    assert {r.ku_id: (r.name, r.status) for r in gone.collect()} == {"a": ("x", "deleted"), "b": ("z", "active"), "c": ("w", "active")}
    assert s.clear({"ku": kind}) == 3 and s.read("ku", kind).count() == 0
    r = rel(spark)
    assert store.relations_of(r, "B").count() == 2 and store.relations_of(r, "B", direction="out").count() == 1
    assert store.delete_relation(r, "r0").count() == 2 and store.insert_ignore(r, r, "rel_id").count() == 3


def test_synthesis_cache(spark):
    ctx = spark.createDataFrame([("a", "ctx", "d2"), ("b", "ctx", "d1")], "ku_id string, context string, digest string")
    cache = spark.createDataFrame([("a", "old", "d1"), ("b", "kept", "d1")], "ku_id string, content string, digest string")
    got = {r.ku_id: r.content for r in synthesis.generate(ctx, cache, lambda c: "new").collect()}
    assert got == {"a": "new", "b": "kept"}


def test_crystallize(spark):
    rows = [(1, "memory.matured", True, "t", "c", ["m1"]), (2, "memory.matured", True, "t", "c", ["m1"]), (3, "memory.matured", True, "", " ", ["m2"]), (4, "other", False, "t", "c", ["m3"])]
    c = spark.createDataFrame(rows, "ord int, event string, translated boolean, title string, content string, event_refs array<string>")
    assert [r.outcome for r in crystallize.outcomes(c).orderBy("ord").collect()] == ["crystallized", "skipped_dup", "skipped_empty", "skipped_filter"]


def test_bus(spark, tmp_path):
    bus = Bus(spark, str(tmp_path / "log"))
    bus.publish(spark.range(240).select(F.lit("knowledge.created").alias("event"), F.lit("t").alias("source"), F.col("id").cast("string").alias("payload")))
    assert bus.log().count() == 240 and bus.recent(5).count() == 5
    seen = []
    bus.subscribe("c", "knowledge.created", lambda b, n: seen.append(b.count()), str(tmp_path / "state"), None).awaitTermination(60)
    assert sum(seen) == 240


def test_unit_length(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    got = [r[0] for r in rows.select(search.normalized(F.col("v"))).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1:] == [[0.0, 0.0], [], None]


def test_taxonomy_by_environment(spark, tmp_path, monkeypatch):
    from lorewright.sources import readers

    (tmp_path / "t.json").write_text('[{"ability_key": "a", "display_name": "A", "domain": "d", "required_skills": ["s"], "min_coverage": 0.5}]')
    monkeypatch.setenv(readers.TAXONOMY_ENV, str(tmp_path / "t.json"))
    assert [(r.ability_key, r.domains) for r in readers.taxonomy(spark).collect()] == [("a", ["d"])]
    monkeypatch.delenv(readers.TAXONOMY_ENV)
    with pytest.raises(ValueError):
        readers.taxonomy(spark)
