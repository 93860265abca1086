import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import language as lid, registry

SF = "/root/testdata/sf0.01"
PAGES = "page_id bigint, url string, html string"


def test_held_out_accuracy(spark):
    docs = registry.table(spark, SF, "documents")
    seen = docs.where("doc_id % 2 = 0").select("doc_id", "text", F.col("lang").alias("language"))
    got = lid.identify(docs, registry.table(spark, SF, "pages"), seen)
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    assert right.where("language = lang").count() / right.count() > 0.98
    assert got.count() == docs.count() + registry.table(spark, SF, "pages").count()


def test_evidence(spark, docs):
    rows = [(i, "the house and the dog walk here") for i in range(30)] + [(100 + i, "der hund und das haus gehen hier") for i in range(30)]
    d = docs(*rows).withColumn("lang", F.when(F.col("doc_id") < 100, "en").otherwise("de"))
    extra = docs((500, ""), (501, None), (502, "12 34"), (503, "the dog"), (None, "der hund"), (504, "haus " * 100_000)).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("other"))
    html = lambda code, text: f'<html lang="{code}"><script>the the</script><p>{text}</p></html>'
    p = [(i, f"http://h{i % 2}.example.com/x", html("en" if i % 2 else "de", "the dog and the house" if i % 2 else "der hund und das haus")) for i in range(40)]
    p += [(100, "http://h1.example.com/", "<p>77</p>"), (101, "http://h0.example.com/", "<p>77</p>"), (102, "http://new.example.de/", html("de", "77")), (103, None, None), (104, "not a url", "")]
    pages = spark.createDataFrame(p, PAGES).withColumn("evidence", F.lit(1)).withColumn("host", F.lit("z"))
    got = lid.identify(d.unionByName(extra).withColumn("evidence", F.lit(1)), pages).collect()
    docs_ = {r.doc_id: r.language for r in got if r.page_id is None}
    pages_ = {r.page_id: r.language for r in got if r.page_id is not None}
    assert docs_[503] == "en" and docs_[None] == "de" and docs_[504] == "de" and docs_[500] in ("de", "en")
    assert pages_[100] == "en" and pages_[101] == "de" and pages_[102] == "de" and pages_[103] in ("de", "en")
    assert len(got) == 66 + 45


def test_without_labels(spark, docs):
    d = docs("a b").withColumn("lang", F.lit(None).cast("string"))
    pages = spark.createDataFrame([(1, "http://a.de/", "<p>x</p>")], PAGES)
    assert [r.language for r in lid.identify(d, pages).collect()] == ["und", "und"]
    assert lid.identify(d.limit(0), pages.limit(0)).count() == 0


def test_address(spark):
    rows = spark.createDataFrame([("http://a.b.de/x",), ("http://a.com/fr/y",), ("http://a.com/xx/y",), ("http://a.co.uk",), (None,)], "u string")
    assert [r[0] for r in rows.select(lid.suffix(F.col("u"))).collect()] == ["de", "fr", None, "en", None]


@pytest.mark.parametrize("host,domain", [("www.foo.com", "foo.com"), ("blog.foo.com", "foo.com"), ("a.b.foo.de", "foo.de"), ("x.site.co.uk", "site.co.uk"), ("co.uk", "co.uk"), ("m.h.example.com", "h.example.com"), ("src0", "src0"), (None, None), ("a." * 5000 + "de", "a.de")])
def test_registered_domain(spark, host, domain):
    assert spark.createDataFrame([(host,)], "h string").select(lid.registered(F.col("h"))).first()[0] == domain


@pytest.mark.parametrize("html,code", [('<html lang="fil">', "fil"), ("<HTML class=x LANG='haw-US'>", "haw"), ("<html lang=de>", "de"), ('<html lang="en-GB">', "en"), ('<html lang="zh_Hant">', "zh"), ("<html lang='english'>", None), ('<html data-lang="de">', None), ("<htmlx lang=de>", None), ("", None), (None, None)])
def test_declared(spark, html, code):
    assert spark.createDataFrame([(html,)], "h string").select(lid.declared(F.col("h"))).first()[0] == code


def brute_fuse(rows, names):
    """rows: (evidence or None, markup, suffix, host) -> (language, confidence), by plain loops."""
    first = lambda v: names[max(range(len(names)), key=lambda k: (v[k], -k))]
    domain = lambda h: ".".join(h.split(".")[-(3 if ".".join(h.split(".")[-2:]) in lid.SHARED_SUFFIXES else 2) :])
    text = [first(e) if e and max(e) > min(e) else None for e, *_ in rows]
    root, hosts, tables = Counter(x for x in text if x), defaultdict(Counter), [defaultdict(Counter), defaultdict(Counter)]
    for x, (_, *seen, host) in zip(text, rows):
        if x:
            if host is not None:
                hosts[host][x] += 1
            for table, s in zip(tables, seen):
                if s is not None:
                    table[s][x] += 1
    up = {x: (root[x] + 1) / (sum(root.values()) + len(names)) for x in names}
    domains = defaultdict(list)
    for h in hosts:
        domains[domain(h)].append(h)
    out = []
    for e, *seen, host in rows:
        prior = up
        if host in hosts:
            d = domains[domain(host)]
            pooled = Counter()
            for h in d:
                pooled += hosts[h]
            parent = {x: (pooled[x] + lid.DOMAIN_PSEUDO * up[x]) / (sum(pooled.values()) + lid.DOMAIN_PSEUDO) for x in names} if len(d) > 1 else up
            prior = {x: (hosts[host][x] + lid.HOST_PSEUDO * parent[x]) / (sum(hosts[host].values()) + lid.HOST_PSEUDO) for x in names}
        post = [(e[k] if e else 0.0) + math.log(prior[x]) for k, x in enumerate(names)]
        for table, s in zip(tables, seen):
            if s in table:
                for k, x in enumerate(names):
                    total = sum(c[x] for c in table.values()) + lid.TABLE_PSEUDO * (len(table) + 1)
                    post[k] += math.log((table[s][x] + lid.TABLE_PSEUDO) / total)
        out.append((first(post), 1 / sum(math.exp(v - max(post)) for v in post)))
    return out


def test_fusion_against_brute_force(spark):
    r = random.Random(3)
    names = ["de", "en", "fr"]
    hosts = ["www.foo.com", "blog.foo.com", "foo.com", "a.site.co.uk", "b.site.co.uk", "src1", "lone.de", None]
    rows = [(r.choice([None, [0.0, 0.0, 0.0], [r.uniform(-9, 0) for _ in names]]), r.choice(["de", "fil", "en", "fr", None]), r.choice(["de", "en", None]), r.choice(hosts)) for _ in range(400)]
    rows += rows[:50]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id bigint, evidence array<double>, markup string, suffix string, host string")
    got = {x.id: (x.language, x.confidence) for x in lid.fuse(df, names).collect()}
    want = brute_fuse(rows, names)
    assert len(got) == len(rows)
    for i, (language, confidence) in enumerate(want):
        assert got[i][0] == language and abs(got[i][1] - confidence) < 2e-6


def test_ties_and_repeats(spark, docs):
    """Even evidence goes to the first language by name; repeated rows are each decided; the model counts them once."""
    rows = [(1, "abc abc"), (2, "xyz xyz"), (3, "777"), (3, "777"), (1, "abc abc")]
    d = docs(*rows).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").when(F.col("doc_id") == 2, "zz")).withColumn("source", F.lit(None).cast("string"))
    pages = spark.createDataFrame([], PAGES)
    got = sorted((x.doc_id, x.language) for x in lid.identify(d, pages).collect())
    assert got == [(1, "aa"), (1, "aa"), (2, "zz"), (3, "aa"), (3, "aa")]
    labelled = d.where("lang IS NOT NULL").select("doc_id", "text", F.col("lang").alias("language"))
    once, twice = lid.fit_text(labelled.where("doc_id < 9").distinct()), lid.fit_text(labelled)
    assert once.grams == twice.grams and np.allclose(once.table, twice.table)


def test_sample_is_the_lowest_hashes(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("language"))
    got = {(x.language, x.doc_id) for x in lid.sample_ids(rows.repartition(7), 50).collect()}
    want = set()
    for name in ("de", "en"):
        own = rows.where(F.col("language") == name).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(50).collect()
        want |= {(name, x.doc_id) for x in own}
    assert got == want and len(got) == 100


def test_text_scores_against_plain_loops(spark, docs):
    """Word scores are means over n-grams of smoothed log frequencies of all n-grams of the sample."""
    rows = [("the house", "en"), ("the dog", "en"), ("das haus", "de"), ("der hund", "de")]
    labelled = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, language string")
    model = lid.fit_text(labelled)
    counts = {x: Counter(g for t, y in rows if y == x for w in t.split() for g in lid.grams(w)) for x in ("de", "en")}
    for word in ("house", "hund", "zzz"):
        want = []
        for x in ("de", "en"):
            logs = []
            for g in lid.grams(word):
                alphabet = {a for c in counts.values() for a in c if len(a) == len(g)}
                total = lambda n: sum(v for a, v in counts[x].items() if len(a) == n) + lid.GRAM_PSEUDO * (len({a for c in counts.values() for a in c if len(a) == n}) + 1)
                logs.append(math.log((counts[x][g] + lid.GRAM_PSEUDO) / total(len(g))) if g in alphabet else np.mean([math.log(lid.GRAM_PSEUDO / total(n)) for n in range(1, lid.ORDER + 1)]))
            want.append(np.mean(logs))
        assert np.allclose(model.words([word], {})[0], want)
