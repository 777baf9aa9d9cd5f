"""Vector links against all pairs."""

import numpy as np
import pytest

from codonframe.llm import embedding_dedup as E


def expected(vectors):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x = x / np.abs(x).max(axis=1)[:, None]  # else squares overflow or vanish
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(linked)):
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: (int(linked[k].sum()) - 1, ids[root(k)]) for k, i in enumerate(ids)}


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 24))
    vectors = {i: rng.standard_normal(24) for i in range(60)}
    for k, spread in enumerate((0.02, 0.15, 0.3, 0.45)):  # from certain links to doubtful ones
        vectors |= {100 * (k + 1) + i: centre[k] + spread * rng.standard_normal(24) for i in range(40)}
    vectors |= {900: vectors[0] * 1e-200, 901: vectors[1] * 1e200, 902: vectors[2]}
    odd = [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [None] * 24), (704, [float("inf")] + [0.0] * 23), (None, [float(v) for v in vectors[0]]), (705, [])]
    rows = [(i, [float(v) for v in x], "clash") for i, x in vectors.items()] + [(i, x, "clash") for i, x in odd] + [(902, [float(v) for v in vectors[2]], "again")]
    found = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()
    want = expected(vectors)
    assert len(found) == len(rows)
    sure = 0
    for r in found:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        sure += r.n_links == n and r.component_id == c
        assert r.n_links <= n and r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    assert sure >= 0.97 * len(found)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    dim, rounds = 32, 6
    turn = E.rotations(dim, rounds, 3)
    x, y = rng.standard_normal((2, 4000, dim))
    y = x + 0.5 * y
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    signs, factors = E.encode(x, turn)
    found, error = E.estimate(signs, factors, y @ turn)
    true = (x * y).sum(axis=1)
    assert (found - true).mean() == pytest.approx(0, abs=0.01)
    assert (np.abs(found - true) <= 5 * error).mean() > 0.999


def test_nothing_to_compare(spark):
    schema = "vec_id long, embedding array<float>"
    assert E.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert E.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], schema)).where("kept").count() == 2
