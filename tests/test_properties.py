"""Invariants over random inputs, and the watermark extension."""

import json
import math
import random
import unicodedata
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lorewright.functions import embed, text as X
from lorewright.operators import evolve, identity, nearpairs, relate
from lorewright.sources import tables
from lorewright.streaming import crystallize

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SLOW
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_normalized_names(spark, names):
    rows = spark.createDataFrame([(i, n.replace("\x00", "")) for i, n in enumerate(names)], "i int, n string")
    got = rows.select("n", X.normalize_name(F.col("n")).alias("a")).withColumn("b", X.normalize_name(F.col("a"))).collect()
    for r in got:
        assert all(unicodedata.category(c)[0] in "LN" for c in r.a)
        if r.n.isascii():
            assert r.a == r.b == "".join(c for c in r.n.lower() if c.isalnum())


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ABCDE"), st.sampled_from("ABCDE"), st.sampled_from("xy")), min_size=1, max_size=25), st.dictionaries(st.sampled_from("ABCDE"), st.sampled_from("AB"), max_size=3))
def test_redirection(spark, edges, moves):
    moves = {a: b for a, b in moves.items() if a != b and b not in moves}
    rel = spark.createDataFrame([(str(i), a, b, t, 1.0, i) for i, (a, b, t) in enumerate(edges)], "rel_id string, from_ku string, to_ku string, rel_type string, weight double, ord bigint")
    ids = spark.createDataFrame([(a, "f", b) for a, b in moves.items()], "ku_id string, fp string, canonical_id string")
    want, have = [], {(a, b, t) for a, b, t in edges if a not in moves and b not in moves}
    for a, b, t in edges:
        new = (moves.get(a, a), moves.get(b, b), t)
        if new == (a, b, t):
            want.append(new)
        elif new[0] != new[1] and new not in have:
            have.add(new)
            want.append(new)
    assert sorted((r.from_ku, r.to_ku, r.rel_type) for r in identity.redirect(rel, ids).collect()) == sorted(want)


def test_watermark(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=m), k) for m, k in ((0, "a"), (1, "a"), (2, "b"), (3, "a"))]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    out = crystallize.deduplicated(stream, F.col("k"), "10 minutes")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.dedup_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def plain_pairs(rows):
    """(a, b, overlap, against) of claims (id, domain, statement, ord), claim by claim."""
    out = set()
    for i, d, s, o in rows:
        for j, e, t, p in rows:
            if d is not None and d == e and s is not None and t is not None and o < p:
                a, b = set(s.lower().split()), set(t.lower().split())
                neg = set(evolve.NEGATIONS)
                if n := len((a & b) - neg):
                    out.add((i, j, n, bool(a & neg) != bool(b & neg)))
    return out


def test_claim_pairs_against_plain_loops(spark, monkeypatch):
    """Frequent and rare words, several pieces, null statements and domains, repeats of a word, equal order."""
    r = random.Random(2)
    monkeypatch.setattr(evolve, "PIECE", 40)
    monkeypatch.setattr(evolve, "COMMON", 6)
    words = [f"w{i}" for i in range(400)] + ["not", "never", "Bad"]
    text = lambda: " ".join(words[min(len(words) - 1, int(403 * r.random() ** 2))] if r.random() < 0.95 else r.choice(words[-3:]) for _ in range(r.randint(1, 25)))
    rows = [(f"c{i}", r.choice(["x", "y", None]), r.choice([None, "", text(), text(), text()]), i // 2) for i in range(220)]
    rows.append(("long", "x", "w1 " * 50_000 + "w2", 500))
    claims = spark.createDataFrame(rows, "ku_id string, domain string, statement string, ord int").withColumn("confidence", F.lit(0.5)).withColumn("p", F.lit(1)).withColumn("topic", F.lit("t"))
    got = {(x.a, x.b, x.overlap, x.score == -0.5) for x in evolve.pairs(claims).collect()}
    assert got == plain_pairs(rows) and len(got) > 300
    assert evolve.pairs(claims.limit(0)).count() == 0


def plain_fold(rows):
    """The ordered fold by sets, a claim against all others in turn; rows are (id, domain, statement, confidence, status, supports)."""
    rows = [dict(zip(("id", "domain", "s", "conf", "status", "sup"), x[:5] + (list(x[5]),))) for x in rows]
    neg, cards = set(evolve.NEGATIONS), set()
    for r in rows:
        gap, found = 0.0, False
        for o in rows:
            a, b = set(r["s"].lower().split()), set(o["s"].lower().split())
            n = len((a & b) - neg)
            if o is r or o["domain"] != r["domain"] or not n:
                continue
            if bool(a & neg) != bool(b & neg):
                d = abs(r["conf"] - o["conf"])
                gap, found = min(gap, d) if found else d, True
                pair = frozenset((r["id"], o["id"]))
                if pair not in cards:
                    if d < evolve.AUTO_GAP:
                        cards.add(pair)
                    else:
                        win, lose = (o, r) if o["conf"] >= r["conf"] else (r, o)
                        win["status"], lose["status"] = "active", "superseded"
            elif min(0.8, n * 0.15) > 0.3:
                new = [e for e in r["sup"] if e not in o["sup"]]
                o["sup"] += new
                o["conf"] = min(evolve.CAP, o["conf"] + evolve.STEP * len(new)) if new else o["conf"]
        r["status"] = evolve.next_status(r["status"], r["conf"], found, gap)
    return {r["id"]: (r["status"], round(r["conf"], 6), len(r["sup"])) for r in rows}


def test_fold_against_plain_loops(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice([f"w{i}" for i in range(30)] + ["not"]) for _ in range(8))
    rows = [(f"c{i:03d}", r.choice("xy"), text(), round(r.uniform(0.2, 0.9), 2), r.choice(["pending", "active", "disputed"]), [f"e{r.randrange(5)}"]) for i in range(60)]
    claims = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "ku_id string, domain string, statement string, confidence double, claim_status string, supports array<string>, ord int")
    got = {x.ku_id: (x.claim_status, x.confidence, x.supports) for x in evolve.fold(claims).collect()}
    assert got == plain_fold(rows) and len({x[0] for x in got.values()}) >= 3


def test_near_pairs_against_plain_loops(spark):
    """The rare trigrams find every pair at or above the threshold."""
    r = random.Random(7)
    base = ["".join(r.choice("abcdefg") for _ in range(30)) for _ in range(25)]
    texts = [b[: r.randint(3, 30)] + "".join(r.choice("abcxyz") for _ in range(r.randint(0, 12))) for b in base for _ in range(4)] + ["", "ab", "ab", None]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    grams = [Counter(t[i : i + 3] for i in range(len(t) - 2)) if t and len(t) >= 3 else Counter([t] if t else []) for t in texts]
    for threshold in (0.3, 0.62, 0.9):
        want = {}
        for i in range(len(texts)):
            for j in range(i + 1, len(texts)):
                if dot := sum(n * grams[j][g] for g, n in grams[i].items()):
                    cosine = round(dot / (math.sqrt(sum(n * n for n in grams[i].values())) * math.sqrt(sum(n * n for n in grams[j].values()))), 6)
                    if cosine >= threshold:
                        want[i, j] = cosine
        got = {(x.a, x.b): x.cosine for x in nearpairs.near_pairs(items, threshold).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_containing_against_plain_loops(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    small = [(f"s{i}", r.choice([word(1), word(2), word(4), word(6), "abc", "", None])) for i in range(60)]
    large = [(f"l{i}", r.choice([word(0), word(1), word(3), word(12), "abc", None])) for i in range(80)]
    s, t = spark.createDataFrame(small, "id string, needle string"), spark.createDataFrame(large, "id string, hay string")
    for proper in (False, True):
        got = sorted((x.a, x.b) for x in relate.containing(s, t, proper).collect())
        assert got == sorted((a, b) for a, n in small for b, h in large if n and h and n in h and not (proper and n == h))


def test_edges_are_kept_once(spark):
    rows = [("a", "b", "T", 1, 2), ("a", "b", "T", 2, 1), ("a", "b", "U", 3, 1)]
    got = relate.first_wins(spark.createDataFrame(rows, "from_ku string, to_ku string, rel_type string, ord int, rule int"))
    assert sorted((x.rel_type, x.ord) for x in got.collect()) == [("T", 1), ("U", 3)]


def test_scratch_tables_can_be_dropped(spark):
    at = tables.mark()
    kept, gone = tables.written(spark.range(3), "kept"), tables.written(spark.range(4), "gone")
    assert tables.drop_written(spark, at, kept) == 1 and kept.count() == 3 and tables.mark() == at + 1
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        gone.count()


@pytest.mark.parametrize("master,fits", [("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("yarn", False), ("spark://h:7077", False)])
def test_no_local_folder_on_a_cluster(monkeypatch, master, fits):
    class Conf(dict):
        set = dict.__setitem__

    session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
    if fits:
        assert tables.scratch(session).startswith("file:///")
    else:
        with pytest.raises(RuntimeError, match="checkpoint"):
            tables.scratch(session)


def test_embedding_backends(spark):
    class Server(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            self.answer({"error": "x"} if "bad" in asked else [[3.0 * len(t), 4.0 * len(t)] for t in asked])

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert embed.healthy(url) and not embed.healthy("http://127.0.0.1:9")
    rows = spark.createDataFrame([("ab",), ("",), (None,), ("abc",)], "t string")
    got = [x.v for x in rows.select("t", embed.backend("service", url=url, batch=2)("t").alias("v")).collect()]
    assert [round(x, 3) for x in got[0]] == [0.6, 0.8] and got[1] == got[2] == [0.0, 0.0]
    with pytest.raises(Exception, match="not a list"):
        spark.createDataFrame([("bad",)], "t string").select(embed.service(url)("t")).collect()
    server.shutdown()

    def broken():
        raise ImportError("no model here")

    local = embed.backend("auto", load=lambda: lambda texts: [[1.0, 0.0]] * len(texts))
    assert rows.select(local("t").alias("v")).first().v == [1.0, 0.0] and len(rows.select(embed.backend("auto", dim=8, load=broken)("t").alias("v")).first().v) == 8
    with pytest.raises(ValueError):
        embed.backend("local")
    with pytest.raises(ValueError):
        embed.backend("psychic")
