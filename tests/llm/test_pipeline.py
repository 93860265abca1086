"""The pipeline against brute force, stage by stage, and whole."""

import corpus_pipeline
from lorewright.llm import mixing, registry, sentencepiece, toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "sentencepiece"]
    docs = registry.table(spark, SF, "documents")
    want = {r.doc_id: r for r in docs.collect()}

    out = corpus_pipeline.toxicity(spark, docs, SF).cache()
    assert out.columns == COLUMNS
    model = toxicity.fit(docs, registry.labels(spark, SF))
    want = {i: r for i, r in want.items() if toxicity.document_score(r.text, model.weights)[0] < model.threshold}
    assert {r.doc_id: r for r in out.collect()} == want

    first = {}
    for i in sorted(want):
        first.setdefault(want[i].text, i)
    want = {i: want[i] for i in first.values()}
    out = corpus_pipeline.exact_dedup(spark, out, SF).cache()
    assert out.columns == COLUMNS and {r.doc_id: r for r in out.collect()} == want

    from test_dedup import close_pairs, led, prints_of, roots

    at = sorted(want)
    words = prints_of([want[i].text for i in at])[0]
    root = led(words, roots(len(at), close_pairs(words)))
    out = corpus_pipeline.near_dedup(spark, out, SF).cache()
    kept = {r.doc_id for r in out.collect()}
    brute = {at[k] for k in set(root)}
    assert out.columns == COLUMNS and brute <= kept and len(kept) <= len(brute) + 0.1 * (len(at) - len(brute))

    taken = {r.doc_id for r in mixing.select(out).collect() if r.taken}
    out = corpus_pipeline.source_mix(spark, out, SF).cache()
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == taken and len(taken) > 0.5 * len(kept)

    codec = sentencepiece.codec()
    ids = {r.doc_id: r.token_ids for r in corpus_pipeline.sentencepiece(spark, out, SF).collect()}
    assert ids == {r.doc_id: codec.encode(r.text) for r in out.collect()}
    assert {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_clashing_columns(spark, clashing):
    """Other columns go through all stages but the last, whatever their names."""
    frame = clashing((1, "one text here"), (2, "one text here"), (3, None), (4, ""), (None, "x y"), (5, "you idiot"), (6, "a b"), (6, "a b"))
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "/nowhere").cache()
        assert frame.columns == columns and all(r.keep_id == r.doc_id for r in frame.collect())
    assert 2 not in [r.doc_id for r in frame.collect()] and 5 not in [r.doc_id for r in frame.collect()]
    assert corpus_pipeline.sentencepiece(spark, frame, "/nowhere").count() == frame.count()


def test_only_the_result_is_left(spark):
    from lorewright.llm._store import mark

    at = mark()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and mark() == at + 1


def test_empty_and_odd_documents(spark, docs):
    odd = docs((1, None), (2, ""), (3, "z " * 100_000), (None, "q"), (4, "a b c"), (4, "a b c"))
    for frame in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, "/nowhere").cache()
            frame.count()
        assert "token_ids" in frame.columns
