"""Links between vectors of a crowd, beside many easy copies: recall of the passes and their stop rule."""

import math

import numpy as np
import pytest

from cellweave.llm import embeddings


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def crowd(n, dim, common, hard, easy, seed=1):
    """n vectors of cosine `common` with each other, a partner at 0.905 for the first `hard`, near copies of the next `easy`."""
    rng = np.random.default_rng(seed)
    c = unit(rng.standard_normal((1, dim)))
    u = rng.standard_normal((n, dim))
    x = math.sqrt(common) * c + math.sqrt(1 - common) * unit(u - (u @ c.T) * c)
    h, v = x[:hard], rng.standard_normal((hard, dim))
    y = 0.905 * h + math.sqrt(1 - 0.905**2) * unit(v - (v * h).sum(1, keepdims=True) * h)
    return np.vstack([x, y, unit(x[hard : hard + easy] + 0.05 * unit(rng.standard_normal((easy, dim))))])


@pytest.mark.parametrize(("n", "dim", "common", "easy"), [(50_000, 64, 0.7, 0), (50_000, 64, 0.7, 30_000), (30_000, 256, 0.8, 29_000)])
def test_recall_by_keys_windows_and_rule(n, dim, common, easy):
    hard = 300
    x = crowd(n, dim, common, hard, easy)
    pairs = np.vstack([np.stack([np.arange(hard), n + np.arange(hard)], 1), np.stack([hard + np.arange(easy), n + hard + np.arange(easy)], 1)])
    found = np.zeros(len(pairs), bool)

    def one_pass(number):
        place = np.empty(len(x), np.int64)
        place[np.argsort(embeddings.sort_key(x, number, 1), kind="stable")] = np.arange(len(x))
        lo, hi = np.sort(place[pairs], 1).T
        return hi < lo // embeddings.WINDOW * embeddings.WINDOW + 2 * embeddings.WINDOW

    needed = embeddings.passes_needed(len(x), dim, 0.9)
    check = max(2, needed // 4)
    for done in range(needed - check):
        found |= one_pass(done)
    joins, done = [], needed - check
    while not joins or not embeddings.settled(joins):
        before = found.sum()
        for number in range(done, done + check):
            found |= one_pass(number)
        joins.append(int(found.sum() - before))
        done += check
    assert found[:hard].mean() >= 0.95
    assert found[hard:].all()


def test_settled():
    assert embeddings.settled([0]) and embeddings.settled([500, 0])
    assert not embeddings.settled([1])
    assert not embeddings.settled([30_000, 100, 90])
    assert embeddings.settled([30_000, 100, 30, 9])


def test_crowd_through_the_operator(spark):
    n, hard, easy = 4000, 100, 2000
    x = crowd(n, 32, 0.7, hard, easy, 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embeddings.near_vectors(df).collect()}
    # what random partners share with the rest of the crowd stays below the limit
    sims = x[:hard] @ x[:n].T
    assert (sims - np.eye(hard, n) < 0.9).mean() > 0.999
    assert np.mean([got[i] == got[n + i] for i in range(hard)]) >= 0.97
    assert all(got[hard + i] == got[n + hard + i] for i in range(easy))
