import random

import pytest

from lorewright.llm import toxicity as t

W = t.built_in().weights


def s(text):
    return t.document_score(text, W)[0]


def test_grammar():
    plain = s("what an idiot")
    assert plain == pytest.approx(4.0)
    assert s("you are an idiot") > plain and s("idiot you") > plain
    assert s("not an idiot") < plain / 2
    assert s("the report said he is an idiot") < s("he is an idiot")
    assert s('he wrote "idiot"') < plain
    assert s("i will kill you") > t.DEFAULT_THRESHOLD > s("kill the process")
    assert s("never. idiot") == plain  # negation ends with its clause
    assert s("a fine day") == 0 and s("") == 0


def brute(text, weights):
    """The grammar's effects written out by hand, without machines."""
    total = 0.0
    for clause in t._CLAUSE.split(text.lower()):
        neg = tgt = pend = 0
        kind, mode, last = None, 0, 0.0
        for w in t._TOKEN.findall(clause):
            c, weight = t.classify(w, weights)
            if c in (t.INSULT, t.THREAT):
                f = (0.3 if neg else 1.0) * (0.5 if mode else 1.0) * ((8.0 if c == t.THREAT else 1.5) if tgt else 1.0)
                last, kind, pend, neg, tgt = weight * f, c, 3, 0, 0
                total += last
                continue
            if c == t.TARGET:
                if pend:
                    total += last * (7.0 if kind == t.THREAT else 0.5)
                tgt, pend = 3, 0
            else:
                tgt, pend = max(0, tgt - 1), max(0, pend - 1)
            neg = 2 if c == t.NEG else max(0, neg - 1)
            if c == t.REPORT and not mode:
                mode = 1
            elif c == t.QUOTE and mode != 1:
                mode = 0 if mode == 2 else 2
    return total


def test_machine_against_brute_force():
    r = random.Random(3)
    words = ["idiot", "scum", "kill", "you", "he", "not", "said", '"', "table", "walk", ".", "!", "\n", "burn"]
    for _ in range(3000):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
        assert t.document_score(text, W)[0] == pytest.approx(brute(text, W), abs=1e-5), text


def test_cases(spark, docs):
    long = "word " * 200_000 + "idiot"
    df = docs(None, "", "you idiot", "you idiot", long, (None, "worthless scum"))
    got = sorted(t.score(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.toxic for r in got] == [False, False, True, True, True, True] and got[0].toxicity == 0.0
    assert t.score(docs().limit(0)).count() == 0


def test_score_with_clashing_columns(clashing):
    df = clashing("you idiot", "a clean text", None).selectExpr("*", "1 AS toxicity", "2 AS clauses")
    got = sorted((r.doc_id, r.toxic) for r in t.score(df).collect())
    assert got == [(0, True), (1, False), (2, False)] and t.score(df).columns == ["doc_id", "toxicity", "clauses", "toxic"]


def test_drop_keeps_columns(clashing):
    df = clashing("you idiot", "a clean text", None)
    kept = t.drop_toxic(df, t.built_in())
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_fit(spark, docs):
    r = random.Random(5)
    vocabulary = ["w" + "".join(r.choice("abcdef") for _ in range(4)) for _ in range(300)]
    prose = lambda: [r.choice(vocabulary) for _ in range(40)]
    rows, labels = [], []
    for i in range(400):
        words = prose()
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(40), "zorgle")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df, lab = docs(*rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    m = t.fit(df, lab.where("doc_id < 200"))
    assert "zorgle" in m.weights and not set(m.weights) & set(vocabulary)
    held = {r.doc_id: r.toxic for r in t.score(df, m).where("doc_id >= 200").collect()}
    assert held == {i: bool(b) for i, b in labels if i >= 200}
    again = t.fit(df.repartition(3), lab.where("doc_id < 200").repartition(5))
    assert (again.weights, again.threshold) == (m.weights, m.threshold)
    assert t.fit(df, lab.limit(0)).threshold == t.DEFAULT_THRESHOLD and t.fit(df, None).weights == W


def test_threshold():
    assert 1 < t.best_threshold([0, 1, 5, 6], [0, 0, 1, 1]) < 5
    assert t.best_threshold([], []) == t.DEFAULT_THRESHOLD and t.best_threshold([0.0], [1]) == t.DEFAULT_THRESHOLD


def test_on_labels(spark):
    from lorewright.llm import registry

    sf = "/root/testdata/sf0.01"
    got = registry.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "y"), "doc_id").join(registry.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    hit = sum(r.toxic and r.y for r in got)
    assert hit / sum(r.toxic for r in got) > 0.95 and hit / sum(r.y for r in got) > 0.85
