"""Near duplicates against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from codonframe.llm import minhash
from codonframe.llm.components import components

from .fixtures import awkward, prose


def weights(text):
    w = (text or "").split()
    return {k: 1 + math.log(n) for k, n in Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))).items()} if w else {}


def changed(text, at):
    w = text.split()
    for i in at:
        w[i] = f"other{i}"
    return " ".join(w)


def expected(rows):
    ids = [i for i, t in rows if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, weights(t)) for i, t in rows if i is not None and weights(t)]
    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            if minhash.probability_jaccard(x, y) >= 0.8:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_groups_match_all_pairs(spark, rounds):
    rnd = random.Random(1)
    base = prose(1, 120)
    rows = [(i, prose(100 + i, 80)) for i in range(10)]
    rows += [(20 + i, changed(base, rnd.sample(range(120), rnd.randrange(6)))) for i in range(40)]
    chain = prose(7, 90)
    rows += [(70 + i, changed(chain, range(10, 10 + 3 * i, 3))) for i in range(6)]
    rows += [(90, "one two three"), (91, "one  two\nthree"), (92, ""), (93, None), (94, " \n"), (95, "one two four"), (20, base)]
    rows += [(96, (base + " ") * 400), (97, "spam line here again now " * 500 + prose(8, 300)), (98, "spam line here again now " * 500 + prose(9, 300))]
    docs = awkward(spark, [(i, t, None) for i, t in rows + [(None, base), (None, None)]])
    found = minhash.near_duplicates(docs, minhash.ProbMinHash(star_rounds=rounds)).collect()
    want = expected(rows)
    assert len(found) == len(rows) + 2
    for r in found:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])


def test_registers_agree_as_often_as_the_similarity():
    rnd = np.random.default_rng(3)
    x = {int(k): float(w) for k, w in zip(rnd.integers(1, 2**62, 300), rnd.uniform(1, 4, 300))}
    y = {k: w * (1 if i % 4 else 3) for i, (k, w) in enumerate(x.items()) if i % 6}
    sign = lambda s: minhash.signature(np.array(list(s), np.uint64), np.array(list(s.values())), 3000)
    assert (sign(x) == sign(y)).mean() == pytest.approx(minhash.probability_jaccard(x, y), abs=0.04)


def test_similarity_by_its_definition():
    x, y = {"a": 1.0, "b": 2.0, "c": 1.0}, {"a": 2.0, "b": 1.0, "d": 3.0}
    both = set(x) | set(y)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in set(x) & set(y))
    assert minhash.probability_jaccard(x, y) == pytest.approx(want)
    assert minhash.probability_jaccard({}, {}) == 0.0


def test_no_documents(spark):
    assert minhash.near_duplicates(awkward(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (205, 201), (201, 203)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[100 + i] == 100 for i in range(20)) and found[205] == found[203] == 201
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
