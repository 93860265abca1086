import math
import random
from collections import Counter, defaultdict

import pytest
from compare import assert_same

from lorewright.llm import mixing as m
from lorewright.llm import registry

SF = "/root/testdata/sf0.01"


def test_oracle(spark):
    assert_same(registry.op2_source_mix(spark, SF), m.oracle_sql(), SF)


def sainte_lague(available, weights, keep=m.KEEP):
    """Block by block to the highest quotient among the sources that have blocks left; ties to the first by name."""
    quota = dict.fromkeys(available, 0)
    for _ in range(math.ceil(sum(available.values()) * keep)):
        live = [s for s in available if (weights.get(s) or 0) > 0 and quota[s] < available[s]]
        if not live:
            break
        quota[min(live, key=lambda s: (-weights[s] / (2 * quota[s] + 1), s is not None, s or ""))] += 1
    return quota


def quotas(spark, available, weights, keep=m.KEEP):
    cut = spark.createDataFrame([(0, s, n - 1) for s, n in available.items()], "shard int, source string, block bigint")
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    return {r.source: r.quota for r in m.quotas(cut, w, keep).collect()}


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 5.0, "b": 2.0, "c": 0.5}, {"a": 1.0, "b": 3.0}, {"a": 0.0}])
def test_quotas_against_the_loop(spark, docs, weights):
    rows = [(i, "w " * (5 + i % 7), "abc"[(i % 10 > 5) + (i % 10 > 8)]) for i in range(400)]
    df = docs(*rows)
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    cut = m.blocks(df, 40, 3).cache()
    have = defaultdict(dict)
    for r in cut.groupBy("shard", "source").max("block").collect():
        have[r.shard][r.source] = r[2] + 1
    got = {(r.shard, r.source): r.quota for r in m.quotas(cut, w).collect()}
    for shard, available in have.items():
        want = sainte_lague(available, weights)
        assert {s: got[(shard, s)] for s in available} == want


def test_tied_quotients(spark):
    """Equal weights, weights with equal quotients at other k, and sources that run out."""
    r = random.Random(5)
    cases = [({"a": 24, "b": 240}, {"a": 1.0, "b": 1.0}, 48 / 264), ({"a": 24, "b": 240}, {"a": 1.0, "b": 1.0}, m.KEEP), ({"a": 3, "b": 9, None: 9}, {"a": 1.005, "b": 3.015, None: 1.005}, 0.6)]
    cases += [({s: r.randint(1, 40) for s in "abcde"}, {s: r.choice([1.0, 3.0, 5.0, 0.7, 2.1]) for s in "abcd"}, r.choice([0.1, 0.5, 0.8, 1.0])) for _ in range(12)]
    for available, weights, keep in cases:
        assert quotas(spark, available, weights, keep) == sainte_lague(available, weights, keep)
    assert quotas(spark, {"a": 24, "b": 240}, {"a": 1.0, "b": 1.0}, 48 / 264) == {"a": 24, "b": 24}


def test_tiny_sources_bound_nobody(spark):
    """However few blocks some sources have, the documented share of all blocks is allotted."""
    available = {"hot": 900, "mid": 90} | {f"tiny{i}": 1 for i in range(10)}
    got = quotas(spark, available, {s: n**0.7 for s, n in available.items()})
    assert sum(got.values()) == 800 and got["mid"] == 90 and all(got[f"tiny{i}"] == 1 for i in range(10))


def test_target_weights_hold(spark, docs):
    df = docs(*[(i, "w " * 10, "hot" if i % 10 else "cold") for i in range(4000)])
    w = spark.createDataFrame([("hot", 1.0), ("cold", 1.0)], "source string, weight double")
    taken = Counter(r.source for r in m.mix(df, weights=w, block_tokens=50, keep=0.2).collect())
    assert taken["cold"] >= 380 and abs(taken["hot"] - taken["cold"]) <= 25


def test_cases(clashing, docs):
    df = clashing((1, None), (2, ""), (3, "x " * 50_000), (4, "a b", None), (None, "a b c"), (5, "d e"), (5, "d e"))
    got = m.select(df)
    assert got.count() == 7 and {r.doc_id: r.tokens for r in got.collect()}[1] == 0
    kept = m.mix(df)
    assert kept.columns == df.columns and 0 < kept.count() <= 7
    assert m.select(docs().limit(0)).count() == 0 and m.mix(docs().limit(0)).count() == 0


def test_deterministic(docs):
    df = docs(*[(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)])
    a = {r.doc_id for r in m.mix(df, block_tokens=30).collect()}
    assert a == {r.doc_id for r in m.mix(df.repartition(7), block_tokens=30).collect()}
