import numpy as np
import pytest
from compare import assert_same

from lorewright.llm import registry, topk

SF = "/root/testdata/sf0.01"


def brute(ids, v, k):
    s = np.round(v @ v.T, topk.DIGITS)
    out = {}
    for i, own in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[own] = [(ids[j], s[i, j]) for j in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append((r.neighbor, r.score))
    return out


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v)], "vec_id bigint, embedding array<float>")


def test_oracle(spark):
    assert_same(registry.op5_exact_topk(spark, SF), topk.oracle_sql(), SF)


@pytest.mark.parametrize("shape", ["lengths", "low rank", "ties", "unit"])
def test_against_brute_force(spark, shape):
    r = np.random.default_rng(3)
    n, d = 600, 24
    v = r.standard_normal((n, d))
    if shape == "lengths":
        v *= r.pareto(1.5, (n, 1))
    elif shape == "low rank":
        v = r.standard_normal((n, 3)) @ r.standard_normal((3, d))
    elif shape == "ties":
        v = r.integers(-1, 2, (n, d)).astype(float)
    else:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.round(v * 64) / 64  # exact in single precision
    ids = r.permutation(n * 2)[:n]
    got = result(topk.nearest(frame(spark, ids, v), k=7, block=97, lead=8))
    want = brute(ids.tolist(), v, 7)
    assert got.keys() == want.keys()
    for i in want:
        assert [x for x, _ in got[i]] == [x for x, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])


def test_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id AS id", "vec_id AS block", "vec_id AS v", "1 AS n")
    got = result(topk.nearest(df, k=10))
    assert {k: [x for x, _ in v] for k, v in got.items()} == {1: [5, 4], 4: [1, 5], 5: [1, 4]}
    assert topk.nearest(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        topk.nearest(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")).count()


def test_blocks_that_cannot_reach_are_not_read(spark, monkeypatch):
    """Vectors of falling length: a group stops at the bound, and nothing is exchanged for the products."""
    r = np.random.default_rng(5)
    v = r.standard_normal((800, 8))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) * 2.0 ** -np.arange(0, 8, 0.01)[:, None] * 4096) / 4096
    q = topk.Best(np.arange(100), v[:100], np.eye(8), 5, 4)
    q.offer(q.reach(2.0), np.arange(100), v[:100])
    assert len(q.reach(1.0)) and not len(q.reach(1e-4))
    df = frame(spark, range(800), v)
    found = topk.nearest(df, k=5, block=50, lead=4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = result(found), brute(list(range(800)), v, 5)
    assert {i: [x for x, _ in got[i]] for i in got} == {i: [x for x, _ in want[i]] for i in want}
