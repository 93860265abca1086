import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorewright.llm import registry, secrets as s

SF = "/root/testdata/sf0.01"
LANGUAGE = s.Language(frozenset("the house index reader window table value".split()), np.full((27, 27), -3.3))


def test_candidates():
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    text = f'x token = "{key}" and 4952935900253052 password: hunter2hunter2 plain words abcdefghijklmnopqrstuvw'
    got = [(text[a:b], x) for a, b, x in s.candidates(text)]
    assert got == [(key, True), ("4952935900253052", False), ("hunter2hunter2", True)]
    assert s.candidates("") == []
    assert s.candidates("token" * 100_000) == [] and len(s.candidates("a1" * 300_000)) == 1


def test_language_of_all_documents(docs):
    """A small source's words are known however few its documents are, and every document counts."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(8))
    hot, small = [word("abcdefgh") for _ in range(30_000)], [word("qrstuvwxyz") for _ in range(10)]
    rows = [(i, " ".join(hot[(20 * i + k) % len(hot)] for k in range(20)), "hot") for i in range(6000)]
    rows += [(6000 + i, " ".join(small), "small") for i in range(4)]
    got = s.learn_language(docs(*rows))
    assert set(small) <= got.words and len(set(hot) & got.words) == len(set(hot))
    table = np.full((27, 27), 0.5)
    for _, text, _ in rows:
        for w in text.split():
            codes = s._codes(f" {w} ")
            np.add.at(table, (codes[:-1], codes[1:]), 1)
    assert np.allclose(got.transition, np.log(table / table.sum(axis=1, keepdims=True)))


def test_held_out_accuracy(spark):
    rows = s.synthetic_findings(sorted(LANGUAGE.words), 3000, seed=1)
    model = s.train(spark, LANGUAGE, spark.createDataFrame(rows[:2000], s.LABELLED))
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector

    held = rows[2000:]
    df = spark.createDataFrame(pa.table({"f": [s.features(LANGUAGE, *r[:5]) for r in held], "y": [float(r[5]) for r in held]})).select(array_to_vector("f").alias("features"), "y")
    assert model.transform(df).where("prediction = y").count() / len(held) > 0.95


def test_bare_keys_and_names(spark, docs):
    r = random.Random(2)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    rows = [f"the index window Authorization: Bearer {key()} reader table value" for _ in range(20)] + [f"the house reader private_key: {key()} index" for _ in range(20)]
    rows += [f"the house commit {r.randrange(16**39, 16**40):040x} reader table" for _ in range(20)]
    got = {x.doc_id: x.secret for x in s.scan(docs(*rows)).collect()}
    assert sum(got[i] for i in range(20)) >= 18 and sum(got[i] for i in range(20, 40)) >= 18 and sum(got[i] for i in range(40, 60)) <= 2
    assert [x for _, _, x in s.candidates(f"passphrase = hunter2hunter2 private_key: {key()}")] == [True, True]
    assert s.candidates("author: somebody authority = somewhere") == []


def plain_features(language, text, before, after, path, assigned):
    """The forest's features by plain loops."""
    low, i, covered = text.lower(), 0, 0
    while i < len(low):
        size = max((n for n in range(4, 17) if i + n <= len(low) and low[i : i + n] in language.words), default=0)
        covered, i = covered + size, i + max(1, size)
    kind = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0
    steps = [language.transition[kind(a), kind(b)] for a, b in zip(low, low[1:])]
    share = [n / len(text) for n in Counter(text).values()]
    runs, run = [0], 0
    for c in text:
        run = run + 1 if c.isdigit() else 0
        runs.append(run)
    near = {w.lower() for side in (before[-s.CONTEXT :], after[: s.CONTEXT]) for w in re.findall("[A-Za-z]{2,}", side)}
    classes = {"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in text}
    return [len(text), sum(steps) / len(steps) if steps else 0, covered / len(text), -sum(p * math.log2(p) for p in share), sum(map(str.isdigit, text)) / len(text), sum(map(str.isupper, text)) / len(text),
            not set(text) - set("0123456789abcdefABCDEF"), len(classes), max(runs) / len(text), any(map(text.startswith, s.PREFIXES)), assigned, before[-1:] in ('"', "'", "`"),
            len(near & s.SECRET_WORDS), len(near & s.PLAIN_WORDS), any(x in path.lower() for x in ("test", "example", "sample", "fixture", "docs")), any(x in path.lower() for x in ("config", "env", "deploy", "prod"))]


def test_findings_against_brute_force(spark):
    """Every document scanned by itself, without the vectorised screen, and its features by plain loops."""
    docs = registry.table(spark, SF, "documents")
    language = s.learn_language(docs)
    got = {(r.doc_id, r.start): r for r in s.findings(docs, language).collect()}
    want = {}
    for d in docs.collect():
        for a, b, assigned in s.candidates(d.text):
            want[(d.doc_id, a)] = (b - a, assigned, plain_features(language, d.text[a:b], d.text[:a], d.text[b:], d.source, assigned))
    assert got.keys() == want.keys() and len(want) > 30
    for k, (length, assigned, f) in want.items():
        assert (got[k].length, got[k].assigned) == (length, assigned) and np.allclose(got[k].features, np.array(f, float))


def plain_keys(text):
    """Maximal runs of key characters that no word character touches, with a digit, by a loop."""
    inside, out, i = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-"), [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in inside:
            j += 1
        if j - i >= 16 and any(c.isdigit() for c in text[i:j]) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and not (j < len(text) and (text[j].isalnum() or text[j] == "_")):
            out.append((i, j, False))
        i = max(j, i + 1)
    return out


def test_key_candidates_against_a_loop():
    r = random.Random(4)
    for _ in range(300):
        text = " ".join("".join(r.choice("aZ09_+/=-") for _ in range(r.randint(1, 40))) + r.choice(["", "", ",", "é", ";"]) for _ in range(8))
        assert [x for x in s.candidates(text) if not x[2]] == plain_keys(text)


def test_labelled_table(spark):
    """Nulls, repeats, other columns and order of the labelled table don't matter; the forest is the same."""
    rows = s.synthetic_findings(["reader", "window"], 400, seed=3)
    t = spark.createDataFrame(rows, s.LABELLED)
    odd = spark.createDataFrame([(None, "a", "b", "c", True, 1), ("x1x1x1x1x1x1x1x1", None, None, None, None, None), ("", "", "", "", False, 1)], s.LABELLED)
    a = s.train(spark, LANGUAGE, t)
    b = s.train(spark, LANGUAGE, t.union(t).union(odd).withColumn("at", F.lit(1)).withColumn("features", F.lit(2)).repartition(5))
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]


def test_labels_and_words_by_hash():
    words = [f"w{i:05d}" for i in range(9000)]
    got = s.by_hash(words, 900)
    assert got == s.by_hash(words[::-1], 900) and sum(w >= "w04500" for w in got) > 350


def test_documents(spark):
    got = registry.op6_secret_scan(spark, SF).collect()
    docs = {r.doc_id: r.text for r in registry.table(spark, SF, "documents").collect()}
    found = {(r.doc_id, r.start) for r in got if r.secret}
    planted = {(i, m.start(1)) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert planted and planted <= found
    cards = {(i, m.start()) for i, t in docs.items() for m in re.finditer(r"(?<!\S)\d{16}(?!\S)", t)}
    assert not cards & found
    assert "candidate" not in got[0].asDict()


def test_cases(spark, clashing, docs):
    r = random.Random(1)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    line = f'token = "{key}"'
    df = clashing((1, line), (2, None), (3, ""), (4, "w " * 200_000 + line), (None, line), (5, f"{line} {line}"), (1, line)).withColumn("source", F.lit(None).cast("string"))
    got = s.scan(df).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "4", "5", "5", "None"] and len({x.sha256 for x in got}) == 1
    at = got[0].probability  # a candidate at the threshold is a secret
    assert all(x.secret == (x.probability >= at) for x in s.scan(df, threshold=at).collect()) and any(x.probability == at for x in got)
    assert s.scan(docs().limit(0)).count() == 0
