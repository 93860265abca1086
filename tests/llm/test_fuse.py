import numpy as np
import pytest

from lorewright.llm.fuse import FuseFilter, PerfectHash


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
def test_structures(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    f = FuseFilter.loads(FuseFilter.build(keys).dumps())
    assert f.contains(keys).all()
    others = r.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert f.contains(others).mean() < 0.006
    p = PerfectHash.loads(PerfectHash.build(keys).dumps())
    assert sorted(p.slot(keys).tolist()) == list(range(len(keys)))
    if n == 100_000:
        assert len(f.dumps()) < 1.35 * n and len(p.dumps()) * 8 < 4 * n


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))
    with pytest.raises(ValueError):
        FuseFilter.build(np.array([5, 5], np.uint64))
