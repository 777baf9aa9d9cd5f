"""Mined negatives against every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonframe.llm import hard_negatives as hn


def expected(rows, options):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (label, [math.floor(options.scale * x) for x in v])
        kept[i] = min(kept.get(i, q), q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in kept.items():
        if a % 5:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][: options.positives]:
            fit = [x for x in scored if x[2] != label and options.low * -s <= 100 * -x[0] <= options.high * -s]
            out += [(a, p, rank, n, -s, -m) for rank, (m, n, _) in enumerate(fit[: options.negatives], 1)]
    return sorted(out)


def rows_of(seed, n, dim=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, rnd.randrange(3), [x + rnd.gauss(0, 0.05) for x in c]))
    alike = rows[3][2]
    rows += [(n + i, i % 3, list(alike)) for i in range(n // 3)]  # a third more of one vector
    return rows


@pytest.mark.parametrize("options", [hn.HardNegatives(tree=64, leaf=8, block=6000), hn.HardNegatives(), hn.HardNegatives(2, 3, 50, 110, 16, 50, 1)])
def test_mined_negatives_are_those_of_all_pairs(spark, options):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(1, 240) + [(400, None, [0.1]), (None, 1, [0.2]), (405, 1, None), (410, 1, [nan]), (415, 1, [0.1, inf]), (420, 2, [0.1, None]), (425, 1, []), (430, 1, [0.3, -0.1]), (10, 1, [0.4] * 6), (10, 1, [0.4] * 6)]
    random.Random(2).shuffle(rows)
    data = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, score double, query string").repartition(5)
    found = hn.mine(data, F.col("vec_id") % 5 == 0, F.col("label"), options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == expected(rows, options)


def test_without_rows_anchors_or_exact_scores(spark):
    schema = "vec_id long, label int, embedding array<float>"
    mine = lambda rows: hn.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0, F.col("label")).collect()
    assert mine([]) == [] and mine([(1, 1, [0.5])]) == [] and mine([(5, 1, [0.5])]) == []
    with pytest.raises(ValueError, match="exact"):
        mine([(5, 1, [1e30])])


def test_bounds_hold_for_every_row_of_a_ball():
    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (500, 8)).astype(float)
    tree = hn.BallTree(np.arange(500), rng.integers(0, 3, 500), rows, 16)
    anchor = rng.integers(-50, 50, 8).astype(float)
    for lo, hi, centre, radius, *_ in tree.nodes:
        reach = np.linalg.norm(anchor) * radius
        products = tree.rows[lo:hi] @ anchor
        assert (products <= anchor @ centre + reach + 1e-6).all() and (products >= anchor @ centre - reach - 1e-6).all()
    assert sorted(tree.ids) == list(range(500))


def test_subtrees_outside_the_window_are_not_scored(monkeypatch):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(c, 0.5, (200, 4)) for c in (-40, 0, 40)]).round()
    tree = hn.BallTree(np.arange(600), np.zeros(600, int), rows, 20)
    seen = []
    real = hn.Search.score
    monkeypatch.setattr(hn.Search, "score", lambda self, t, part, q: (seen.append(part.stop - part.start), real(self, t, part, q)))
    found = hn.Search(rows[:1], np.array([0]), np.array([-1]), np.array([1]), np.array([-100.0]), np.array([100.0]), 3, False)
    found.visit(tree, 0, np.array([0]))
    assert 0 < sum(seen) <= 240 and (found.found >= 200).all() and (found.found < 400).all()
