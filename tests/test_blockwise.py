"""Nearest references of a block against all distances."""

import numpy as np
import pytest

from terrasift.operators import blockwise


def far_block(null=False):
    """Queries of two folds, whose nearest row of another fold is across an edge; one fold holds most rows."""
    rng = np.random.default_rng(4)
    R = rng.uniform(0, 1000, (6000, 2))
    rg = np.where(R[:, 0] > 900, 1, np.where(R[:, 1] > 950, 2, 0))
    if null:
        rg = np.where(rng.uniform(size=len(R)) < 0.001, np.nan, rg.astype(float))
    at = np.flatnonzero((R[:, 0] < 950) & (R[:, 1] < 700))[:800]
    return R[at], R, rg[at], rg


def plain(Q, R, qg, rg, k):
    d = np.round(np.sqrt(((Q[:, None] - R[None]) ** 2).sum(axis=2)), 3)
    d[qg[:, None] == rg[None]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


@pytest.mark.parametrize("null", [False, True])
@pytest.mark.parametrize("k", [1, 5])
def test_far_references_match_all_distances(k, null):
    Q, R, qg, rg = far_block(null)
    order, d = plain(Q, R, qg, rg, k)
    i, j, got = blockwise._nearest(Q, R, k, 3, qg, rg, limit=np.full(len(Q), 1500.0))
    at = np.argsort(i, kind="stable")  # tiles come in turn, the neighbours of a query together and from the nearest on
    i, j, got = i[at], j[at], got[at]
    assert (i == np.repeat(np.arange(len(Q)), k)).all()
    assert (j.reshape(-1, k) == order).all() and (got.reshape(-1, k) == d).all()


def test_tiles_far_from_all_they_may_match_meet_few_references(monkeypatch):
    """Without it each query is compared with every reference in a reach that is mostly its own fold."""
    Q, R, qg, rg = far_block()
    met, made = [], np.partition
    monkeypatch.setattr(blockwise.np, "partition", lambda a, *k, **kw: met.append(a.size) or made(a, *k, **kw))
    blockwise._nearest(Q, R, 1, 3, qg, rg, limit=np.full(len(Q), 1500.0))
    assert sum(met) < len(Q) * len(R) / 4
