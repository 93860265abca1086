"""The facade from ingest to abilities."""

import time
from threading import Event

import pytest
from pyspark.sql import functions as F

from lorewright.sources import readers, tables
from lorewright.session import MODES, Engine, Invalid, NotFound

TEXT = "# Funds\n\nIndex funds are good value. Index funds are not good value. Momentum beats the market in 1993.\n\n## Risk\n\nDrawdown hurts Markowitz and Sharpe."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    tax = spark.createDataFrame([("risk", "Risk", "", [""], ["control"], [], 0.5, {"control": ["drawdown"]}, [("w", ["control"])])], "ability_key string, display_name string, domain string, domains array<string>, required_skills array<string>, optional_skills array<string>, min_coverage double, concept_checklist map<string,array<string>>, workflows array<struct<name:string,steps:array<string>>>")
    e = Engine(spark, str(tmp_path_factory.mktemp("kb")), taxonomy=tax, get=lambda url: "<html><title>T</title><body><p>A page on Momentum.</p></body></html>")
    e.ingest_text(TEXT, source="notes", domain="money")
    return e


def test_ingest_and_identity(engine):
    n = engine.units().where("status = 'active'").count()
    assert n > 5
    engine.ingest_text(TEXT + "\n\nMore words here.", source="notes", domain="money")
    names = engine.units().where("status = 'active'").groupBy("ku_type", "name", "domain").count()
    assert names.where("count > 1").count() == 0
    with pytest.raises(Invalid):
        engine.ingest_text("  ")
    assert engine.ingest_url("http://a/b").count() >= 1


def test_conflicts(engine):
    cards = engine.cards().collect()
    assert cards
    open_ = engine.list_conflicts().collect()
    assert open_ and engine.resolve_conflict(open_[0].conflict_id, open_[0].claim_a_id) and not engine.resolve_conflict(open_[0].conflict_id, "x")
    assert engine.recent_events(50, "conflict.detected").count() == len(cards)
    assert engine.recent_events(50, "conflict.resolved").count() >= 1 and engine.recent_events(50, "claim.status_changed").count() >= 1


def test_search_and_graph(engine):
    for mode in MODES:
        assert engine.search("momentum market", mode, 5, exclude_inactive=False).count() <= 5
    assert engine.search("momentum", "bm25", exclude_inactive=False).count() >= 1
    evidence = engine.units().where("ku_type = 'Evidence' AND status = 'active' AND name = 'Funds'").first().ku_id
    near = engine.neighbors(evidence, 1).collect()
    assert near
    assert engine.find_path(evidence, near[0].node).first().hops <= 1
    assert engine.synthesis(evidence).first().content and engine.synthesis(evidence).count() == 1
    units, edges = engine.graph(100)
    assert units.count() and edges.count() and engine.stats().count() > 4
    with pytest.raises(Invalid):
        engine.search("x", "psychic")
    with pytest.raises(NotFound):
        engine.get("nothing")


def test_abilities(engine):
    report, _ = engine.coverage_report("risk")
    assert report.first().can_compile
    with pytest.raises(NotFound):
        engine.get_ability("risk")
    assert engine.ensure_ability("risk").first().ability_key == "risk" and engine.get_ability("risk").count() == 1
    assert engine.recent_events(10, "ability.created").count() == 1


def test_operation(engine, spark, tmp_path):
    assert engine.health() and engine.config()["provider"] == "local"
    assert engine.set_config(provider="openai", api_key="sk-1234567890")["api_key"] == "sk-…90"
    with pytest.raises(Invalid):
        engine.set_config(provider="nobody")
    ready = Event()
    first = engine.submit("j1", lambda progress: (progress(1, 3), ready.wait(60)))
    second = engine.submit("j2", lambda progress: 1 / 0)
    assert second.result(120) == "error" and "ZeroDivisionError" in engine.job("j2").first().detail
    while engine.job("j1").first().done != 1:
        time.sleep(0.2)
    row = engine.job("j1").first()
    assert (row.status, row.done, row.total) == ("running", 1, 3)
    ready.set()
    assert first.result(120) == "done" and engine.job("j1").first().status == "done"
    assert engine.job("j2").first().status == "error"
    rows = [(1, "t", "Some matured memory", ["m1"]), (2, "t", "Some matured memory", ["m1"])]
    got = engine.crystallize(spark.createDataFrame(rows, "ord int, title string, content string, event_refs array<string>"))
    assert {r.outcome: r.n for r in got.collect()} == {"crystallized": 1, "skipped_dup": 1}
    got = engine.crystallize(spark.createDataFrame([(1, "t", "Some matured memory", ["m1"])], "ord int, title string, content string, event_refs array<string>"))
    assert {r.outcome: r.n for r in got.collect()} == {"skipped_dup": 1}
    spark.createDataFrame([(1, "t", "A streamed memory", ["m9"]), (2, "t", "x", ["m1"])], "ord int, title string, content string, event_refs array<string>").write.parquet(str(tmp_path / "in"))
    before = engine.units().count()
    engine.consume(spark.readStream.schema("ord int, title string, content string, event_refs array<string>").parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    assert engine.units().where("name LIKE '%streamed%'").count() >= 1 and engine.units().count() > before
    assert engine.reset() > 0 and engine.units().count() == 0


def test_search_reads_the_index_and_writes_nothing(spark, tmp_path):
    asked = []
    embedder = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    e = Engine(spark, str(tmp_path / "kb"), embedder=lambda c: asked.append(1) or embedder(c))
    assert e.search("anything", "bm25").count() == 0
    e.ingest_text("# One\n\nThe zeppelin is good value.", source="a", domain="d")
    before = e.index().terms.where("term = 'zeppelin'").first().df
    e.ingest_text("# Two\n\nThe zeppelin and the dirigible are good value.", source="b", domain="d")
    assert e.index().terms.where("term = 'zeppelin'").first().df > before
    # The merged statistics are those of the postings, as if the index were made anew.
    counted = e.index().postings.groupBy("term").count()
    assert {(r.term, r.df) for r in e.index().terms.collect()} == {(r[0], r[1]) for r in counted.collect()}
    at, versions = tables.mark(), {t: e.store.versions(t) for t in ("terms", "postings", "ku")}
    assert e.search("dirigible", "bm25", exclude_inactive=False).count() >= 1
    assert e.search("zeppelin", "hybrid", exclude_inactive=False).count() >= 2
    assert tables.mark() == at and versions == {t: e.store.versions(t) for t in versions} and asked
    old = {(r.id, r.score) for r in e.search("zeppelin", "bm25", 20, exclude_inactive=False).collect()}
    e.reindex()
    assert {r[0] for r in old} == {r.id for r in e.search("zeppelin", "bm25", 20, exclude_inactive=False).collect()}
    assert e.reset() > 0 and e.search("zeppelin", "bm25").count() == 0
    e.close()


def test_ingest_merges_evidence(spark, tmp_path):
    """A later claim along with an earlier one gives it its evidence and raises its confidence, once."""
    e = Engine(spark, str(tmp_path / "kb"))
    e.ingest_text("# A\n\nIndex funds are good value for patient people.", source="a", domain="m")
    first = e.units().where("ku_type = 'Claim'").first()
    e.ingest_text("# B\n\nIndex funds are good value for patient savers too.", source="b", domain="m")
    after = e.get(first.ku_id).first()
    assert len(after.extra.supports) == len(first.extra.supports) + 1 and after.confidence == pytest.approx(first.confidence + 0.02)
    e.ingest_text("# C\n\nNothing of the kind here.", source="c", domain="other")
    assert e.get(first.ku_id).first().confidence == after.confidence
    e.close()


def test_subscription_stays(spark, tmp_path):
    """What is published after the subscription arrives; memories become units by the default translator."""
    e = Engine(spark, str(tmp_path / "kb"))
    got = []
    e.bus.subscribe("mine", "memory.created", lambda b, n: got.extend(r.payload for r in b.collect()), str(tmp_path / "s1"), "200 milliseconds")
    publish = lambda event, payload: e.bus.publish(spark.createDataFrame([(event, "test", payload)], "event string, source string, payload string"))
    publish("memory.created", "one")
    deadline = time.time() + 60
    while got != ["one"] and time.time() < deadline:
        time.sleep(0.2)
    publish("memory.created", "two")
    while len(got) < 2 and time.time() < deadline:
        time.sleep(0.2)
    assert got == ["one", "two"]
    with pytest.raises(ValueError, match="subscribed"):
        e.bus.subscribe("mine", "memory.created", print, str(tmp_path / "s1"))
    e.bus.unsubscribe("mine")
    publish("memory.matured", '{"memory_id": "m1", "title": "Kites", "content": "Kites are good value in May."}')
    publish("memory.matured", '{"memory_id": "m1", "title": "Kites", "content": "Kites are good value in May."}')
    publish("memory.matured", '{"memory_id": "m2", "content": "  "}')
    for q in e.subscribe_crystallizer(str(tmp_path / "s2"), None):
        q.awaitTermination(120)
    assert e.store.read("seen", "key string").collect()[0].key == "m1" and e.units().where("name like '%Kites%' OR summary like '%Kites%'").count() >= 1
    e.register_translator("meeting.finished", lambda rows: rows.select("ord", "event", F.lit("").alias("title"), F.col("payload").alias("content"), F.array().cast("array<string>").alias("event_refs")))
    events = spark.createDataFrame([(1, "meeting.finished", "Minutes are good value."), (2, "nobody.cares", "x")], "ord bigint, event string, payload string")
    assert {r.outcome: r.n for r in e.crystallize_events(events).collect()} == {"crystallized": 1, "skipped_filter": 1}
    e.close()


def test_size_guards_tell(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "kb"))
    monkeypatch.setattr(readers, "MAX_CHARS", 40)
    monkeypatch.setattr(readers, "MAX_BYTES", 60)
    with pytest.raises(readers.TooLarge):
        e.ingest_text("x" * 41)
    docs = spark.createDataFrame([("a", "", "s", "y" * 41), ("b", "", "s", "fine")], "doc_id string, title string, source string, text string")
    with pytest.raises(readers.TooLarge, match="a: 41"):
        e.ingest(docs)
    with pytest.raises(Invalid):
        e.ingest(docs.where("doc_id = 'b'").withColumn("text", F.lit(None).cast("string")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.txt").write_text("z" * 61)
    with pytest.raises(readers.TooLarge, match="large.txt"):
        e.ingest_files(str(tmp_path / "in"))
    assert e.units().count() == 0
    e.close()


def test_pdf_files(spark, tmp_path):
    parse = lambda content: [(0, 0, 20.0, "A Study of Kites"), (0, 1, 10.0, "Kites are good value."), (1, 0, 14.0, "Strings"), (1, 1, 10.0, "Strings hold kites.")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k.PDF").write_bytes(b"%PDF-1.4")
    got = readers.read_any(spark, str(tmp_path / "in"), parse).first()
    assert (got.title, got.doc_type) == ("A Study of Kites", "PDF") and "# Strings\n\nStrings hold kites." in got.text
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_any(spark, str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "kb"), parse_pdf=parse)
    assert e.ingest_files(str(tmp_path / "in")).count() >= 1
    e.close()
