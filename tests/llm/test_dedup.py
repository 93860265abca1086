"""Exact dedup, line dedup and SimHash near-dedup."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same

from lorewright.llm import exact_dedup as ex, line_dedup as ln, registry, simhash as sh

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_line_dedup", "op7_exact_dedup"])
def test_oracles(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


def test_exact_cases(clashing, docs):
    long = "z" * 300_000
    df = clashing((0, "a"), (1, "a"), (2, ""), (3, ""), (4, None), (5, None), (6, long), (7, long), (8, long + "x"), (9, "b"), (9, "b"), (None, "a"))
    kept = ex.deduplicate(df)
    assert kept.columns == df.columns and ids(kept) == [0, 2, 4, 5, 6, 8, 9, None]
    got = {(r.doc_id, r.keep_id, r.duplicate) for r in ex.groups(df).collect()}
    assert {(1, 0, True), (3, 2, True), (7, 6, True), (8, 8, False), (None, None, False), (4, 4, False)} <= got
    assert ex.groups(df).count() == 12
    assert ex.deduplicate(docs().limit(0)).count() == 0 and ex.groups(docs().limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_exact_any_number_of_batches(docs, batches):
    r = random.Random(batches)
    rows = [(i * 3, f"text {r.randrange(60)}") for i in range(200)]
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    got = {x.doc_id: x.keep_id for x in ex.groups(docs(*rows), batches).collect()}
    assert got == {i: first[text] for i, text in rows}


def test_equal_digests_with_other_bytes_stay(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ex.F, "xxhash64", lambda *c: F.length(F.col("text")).cast("bigint"))
    assert ids(ex.deduplicate(docs("ab", "cd", "ab", "e"))) == [0, 1, 3]


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_exact_both_ways_to_the_suspects(docs, monkeypatch, limit):
    """The same result with the suspects' digests broadcast and without."""
    monkeypatch.setattr(ex, "BROADCAST_DIGESTS", limit)
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(90)}") for i in range(300)]
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    assert {x.doc_id: x.keep_id for x in ex.groups(docs(*rows)).collect()} == {i: first[t] for i, t in rows}
    assert ids(ex.deduplicate(docs(*rows))) == sorted(first.values())


def test_only_suspects_texts_are_shuffled(spark, docs, capsys):
    """In the plan of the byte check the text side of the semi-join is not exchanged."""
    base = docs("a", "b").select("doc_id", "text", ex.digest().alias("digest"))
    plan = ex.suspects_of(base, base.select("digest").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_text_in_every_row(docs):
    assert ids(ex.deduplicate(docs(*["same text"] * 3000))) == [0]
    assert sum(x.duplicate for x in ex.groups(docs(*["same text"] * 3000)).collect()) == 2999


def test_one_id_over_two_texts(docs):
    """Decisions go by id and text."""
    df = docs((1, "a copy"), (5, "a copy"), (5, "another text"), (7, "another text"), (5, "a third"))
    assert sorted((r.doc_id, r.text) for r in ex.deduplicate(df).collect()) == [(1, "a copy"), (5, "a third"), (5, "another text")]
    r = random.Random(1)
    base, other = prose(r, 200), prose(r, 200)
    rows = [(1, " ".join(base)), (5, " ".join(edited(r, base, 0.01))), (5, " ".join(other)), (7, " ".join(edited(r, other, 0.01)))]
    assert sorted((x.doc_id, x.text) for x in sh.deduplicate(docs(*rows)).collect()) == [rows[0], rows[2]]
    near = [(3, " ".join(base)), (3, " ".join(edited(r, base, 0.01))), (4, " ".join(edited(r, base, 0.01)))]
    assert len(sh.deduplicate(docs(*near)).collect()) == 1
    lines = [(1, "x\ny\nz"), (1, "y\nq"), (2, "q\nr\nx")]
    got = sorted((x.doc_id, x.text, x.n_dropped) for x in ln.dedup_lines(docs(*lines)).collect())
    assert sum(x[2] for x in got) == 3 and sorted("\n".join(x[1] for x in got).split("\n")) == ["q", "r", "x", "y", "z"]


def test_line_repeated_rows(docs):
    """Rows of the same id and text count as one document: each of them keeps what it has first."""
    got = [(x.doc_id, x.text, x.n_dropped) for x in ln.dedup_lines(docs((1, "a\nb"), (1, "a\nb"), (2, "b\nc"))).orderBy("doc_id").collect()]
    assert got == [(1, "a\nb", 0), (1, "a\nb", 0), (2, "c", 1)]


def test_line_one_line_in_every_document(docs, monkeypatch):
    """The streams of a shard grow with the lines that probe it, so no task holds a hot line whole."""
    monkeypatch.setattr(ln, "STREAM_LINES", 100)
    df = docs(*[f"hot line\nown {i}" for i in range(2000)])
    lines = ln.line_table(df)
    index, shards = ln.line_index(lines)
    assert index.select("salts").first()[0] == 40
    asked = ln.probes(lines, index, shards).groupBy("shard", "salt").count()
    assert asked.count() == 40 and max(x["count"] for x in asked.collect()) < 200
    got = {x.doc_id: x.text for x in ln.dedup_lines(df).collect()}
    assert got == {0: "hot line\nown 0"} | {i: f"own {i}" for i in range(1, 2000)}


def test_line_cases(clashing, docs):
    df = clashing((0, "one\n\ntwo\none"), (1, "two\nthree\n  "), (2, None), (3, ""), (None, "one\none"), (4, "four"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in ln.dedup_lines(df).collect()}
    assert got == {0: ("one\n\ntwo", 4, 1), 1: ("three\n  ", 3, 1), 2: (None, 0, 0), 3: ("", 1, 0), None: ("one\none", 2, 0), 4: ("four", 1, 0)}
    assert ln.dedup_lines(docs().limit(0)).count() == 0


def test_line_many_shards_and_hot_lines(docs):
    r = random.Random(2)
    rows = [(i, "\n".join(["header"] + [f"line {r.randrange(300)}" for _ in range(20)])) for i in range(120)]
    seen, want = set(), {}
    for i, text in rows:
        out = []
        for line in text.split("\n"):
            if line not in seen:
                seen.add(line)
                out.append(line)
        want[i] = "\n".join(out)
    assert {x.doc_id: x.text for x in ln.dedup_lines(docs(*rows), shard_lines=37).collect()} == want


def test_line_long_document(docs):
    got = {r.doc_id: r.n_dropped for r in ln.dedup_lines(docs("\n".join(["same", "other"] * 40_000), "same")).collect()}
    assert got == {0: 79_998, 1: 1}


# --- SimHash ---


def prose(r, n, size=4000):
    return [f"w{int(size * r.random() ** 2)}" for _ in range(n)]


def edited(r, words, share):
    return [f"x{r.randrange(4000)}" if r.random() < share else w for w in words]


def corpus(seed, groups=60, singles=300):
    r = random.Random(seed)
    rows = [" ".join(prose(r, r.randint(60, 500))) for _ in range(singles)]
    for _ in range(groups):
        base = prose(r, r.randint(80, 500))
        rows += [" ".join(base)] + [" ".join(edited(r, base, r.uniform(0.005, 0.05))) for _ in range(r.randint(1, 5))]
    r.shuffle(rows)
    return rows


def prints_of(texts):
    return sh.pack(sh.margins(pa.array(texts, pa.string())))


def close_pairs(words):
    d = np.bitwise_count((words[:, None, :] ^ words[None, :, :]).view(np.uint64)).sum(axis=2)
    return {(i, j) for i, j in zip(*np.nonzero(d <= sh.TAU)) if i < j}


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def led(words, root):
    """Components divided by leaders, pair by pair."""
    out = {}
    for x in sorted(set(root)):
        left = [i for i, y in enumerate(root) if y == x]
        while left:
            near = [i for i in left if np.bitwise_count((words[i] ^ words[left[0]]).view(np.uint64)).sum() <= sh.RADIUS]
            out |= dict.fromkeys(near, left[0])
            left = [i for i in left if i not in near]
    return [out[i] for i in range(len(root))]


def test_pigeonring_loses_no_pair():
    r = np.random.default_rng(0)
    x = r.integers(-(2**63), 2**63 - 1, (20_000, 4))
    flips = np.zeros((20_000, sh.BITS), np.uint8)
    for row, n in zip(flips, r.integers(0, sh.TAU + 1, 20_000)):
        row[r.choice(sh.BITS, n, replace=False)] = 1
    y = x ^ np.packbits(flips, axis=1).view(np.int64)
    assert sh.pigeonring(x, y).all() and sh.within(x, y).all()
    z = r.integers(-(2**63), 2**63 - 1, (20_000, 4))
    assert sh.pigeonring(x, z).mean() < 0.05 and not sh.within(x, z).any()


def test_recall_against_brute_force(docs):
    texts = corpus(1)
    words, _ = prints_of(texts)
    pairs = close_pairs(words)
    want = led(words, roots(len(texts), pairs))
    got = {r.doc_id: r.keep_id for r in sh.groups(docs(*texts)).collect()}
    assert len(pairs) > 100
    together = [(a, b) for a, b in pairs if want[a] == want[b]]
    assert len(together) > 0.97 * len(pairs)
    assert sum(got[a] == got[b] for a, b in together) / len(together) >= 0.9
    # Nothing is joined that brute force keeps apart.
    assert all(want[i] == want[got[i]] for i in range(len(texts)))


def test_recall_on_documents(spark):
    rows = registry.table(spark, SF, "documents").orderBy("doc_id").collect()
    words, _ = prints_of([r.text for r in rows])
    pairs = close_pairs(words)
    got = {r.doc_id: r.keep_id for r in registry.op8_simhash_dedup(spark, SF).collect()}
    at = [r.doc_id for r in rows]
    want = led(words, roots(len(at), pairs))
    together = [(a, b) for a, b in pairs if want[a] == want[b]]
    assert sum(got[at[a]] == got[at[b]] for a, b in together) / len(together) >= 0.9


def test_recall_at_every_distance(docs):
    """Lone pairs with edits up to what TAU covers; all pairs within TAU count."""
    r = random.Random(3)
    bases = [prose(r, r.randint(300, 500)) for _ in range(900)]
    texts = [" ".join(x) for base in bases for x in (base, edited(r, base, r.uniform(0.02, 0.16)))]
    words, _ = prints_of(texts)
    distance = np.bitwise_count((words[::2] ^ words[1::2]).view(np.uint64)).sum(axis=1)
    got = {x.doc_id: x.keep_id for x in sh.groups(docs(*texts)).collect()}
    found = np.array([got[2 * i] == got[2 * i + 1] for i in range(len(bases))])
    for low, high in ((0, 20), (21, 30), (31, 35), (36, sh.TAU)):
        band = (distance >= low) & (distance <= high)
        assert band.sum() >= 50 and found[band].mean() >= 0.9, (low, high, band.sum(), found[band].mean())


def test_simhash_cases(clashing, docs):
    r = random.Random(4)
    long = " ".join(prose(r, 60_000))
    base = prose(r, 200)
    df = clashing((0, " ".join(base)), (1, " ".join(edited(r, base, 0.01))), (2, ""), (3, ""), (4, None), (5, None), (6, long), (7, long + " end"), (8, "!!!"), (9, "???"), (10, "solo here"), (10, "solo here"), (None, "q"))
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns and ids(kept) == [0, 2, 4, 5, 6, 8, 9, 10, None]
    assert sh.groups(df).count() == 13
    assert sh.deduplicate(docs().limit(0)).count() == 0 and sh.groups(docs().limit(0)).count() == 0


def test_large_group(docs):
    r = random.Random(6)
    base = prose(r, 300)
    rows = [" ".join(edited(r, base, 0.02)) for _ in range(700)] + [" ".join(prose(r, 300)) for _ in range(50)]
    kept = ids(sh.deduplicate(docs(*rows)))
    assert len([k for k in kept if k < 700]) == 1 and len([k for k in kept if k >= 700]) == 50


def test_large_buckets_are_divided(spark):
    """Unlike fingerprints in one bucket: what a worker leaves is compared piece by piece, and no pair is lost."""
    r = np.random.default_rng(7)
    n = 3000
    words = r.integers(-(2**63), 2**63 - 1, (n, 4))
    words[n // 2 :] = words[: n // 2] ^ np.left_shift(np.int64(1), r.integers(0, 60, (n // 2, 4)))  # every print has one twin
    edges, rest = sh.forest(np.arange(n), words, effort=2)
    assert len(rest) > sh.PIECE // 2 and len(edges) < n // 2
    nodes = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    bucket = nodes.selectExpr("CAST(1 AS bigint) AS bucket", "id")
    want = {(i, i + n // 2) for i in range(n // 2)}
    for effort in (2, float("inf")):
        got = sh.compared_in_full(bucket, nodes, effort)
        assert {(x.a, x.b) for x in got.collect()} == want


def test_runs_are_not_divided():
    r = random.Random(1)
    keys = sorted(r.choice([1, 1, 1, 2, 5, 9, 9, 12]) for _ in range(500))
    for size in (1, 3, 50, 600):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(range(i, min(500, i + size)))], names=["k", "v"]) for i in range(0, 500, size)]
        parts = list(sh._runs(("k", "v"), iter(batches)))
        assert np.concatenate([p[1] for p in parts]).tolist() == list(range(500))
        assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:]))


def test_chains_are_divided(docs):
    """Each document shares most words with the next, the ends nothing."""
    r = random.Random(9)
    words = prose(r, 600)
    rows = [" ".join(words[i * 8 : i * 8 + 100]) for i in range(60)]
    got = {x.doc_id: x.keep_id for x in sh.groups(docs(*rows)).collect()}
    assert got[0] != got[59] and len(set(got.values())) > 3


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(80)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    got = {x.id: x.root for x in sh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = defaultdict(int)
    for i, x in enumerate(roots(400, [(a, b) for a, b in edges])):
        want[i] = x
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert {n: got.get(n, n) for n in touched} == {n: want[n] for n in touched}
    assert sh.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
