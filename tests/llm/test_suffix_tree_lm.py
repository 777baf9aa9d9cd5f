"""Scores against a tree of Python dictionaries, and against what a distribution must hold."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codonframe.llm import suffix_tree_lm as lm
from codonframe.llm.shared import in_fold

from .fixtures import awkward, prose

TEXTS = [None, "", "  \n\t ", "the cat sat on the mat the cat sat", "The CAT sat on the mat. the cat sat", "É the cat é", "no word in here twice \x85 x\xa0y", prose(1, 3000), prose(1, 3000), prose(2, 800), "the cat sat on the mat " * 40, "a", "cat sat on", *[prose(i, 60) + " the cat sat on the mat" for i in range(20, 60)]]


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b"\n"]


class Plain:
    """The tree of the module's description, one string at a time."""

    def __init__(self, texts, o):
        self.counts = [Counter() for _ in range(o.depth + 1)]
        for t in texts:
            w = words(t)
            for size in range(o.depth + 1):
                self.counts[size].update(tuple(w[i : i + size + 1]) for i in range(len(w) - size))
        self.total, self.distinct = sum(self.counts[0].values()), len(self.counts[0])
        self.states: dict = {}
        for size in range(1, o.depth + 1):
            held: dict = {}
            for s, n in self.counts[size].items():
                if n >= max(o.least, math.ceil(o.share * self.total)):
                    held.setdefault(s[:-1], {})[s[-1]] = n
            fresh = {}
            for context, after in held.items():
                seen = self.counts[size - 1][context]
                own = {w: (n - o.discount) / seen for w, n in after.items()}
                below = {w: self.p(context[1:], w) for w in after}
                left, left_below = 1 - sum(own.values()), max(1 - sum(below.values()), 1e-12)
                apart = sum(own[w] * math.log(own[w] / below[w]) for w in own) + left * math.log(left / left_below)
                if apart >= o.divergence and apart * seen >= o.evidence:
                    fresh[context] = (own, left / left_below)
            self.states |= fresh

    def p(self, context, w):
        if not context:
            return (self.counts[0][w,] + 1) / (self.total + self.distinct + 1)
        if context not in self.states:
            return self.p(context[1:], w)
        own, scale = self.states[context]
        return own[w] if w in own else scale * self.p(context[1:], w)

    def score(self, text, depth):
        w = words(text)
        return sum(math.log10(self.p(tuple(w[max(i - depth, 0) : i]), w[i])) for i in range(len(w)))


@pytest.mark.parametrize("options", [lm.SuffixTree(), lm.SuffixTree(depth=1, chunk=500, shard=50), lm.SuffixTree(depth=3, share=2e-4, least=3, discount=0.7, divergence=0.5, evidence=2, chunk=4000, shard=100)])
def test_scores_are_those_of_a_plain_tree(spark, options):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "the cat", None), (3, "same id", None)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    docs = awkward(spark, rows).repartition(3)
    found = lm.score_texts(docs, ~in_fold("doc_id", 7, 2), options).collect()
    plain = Plain([t for i, t, _ in rows if not held(i)], options)
    assert plain.states and len(found) == len(rows)
    expected = []
    for i, t, _ in rows:
        w = words(t)
        base = sum(math.log10((plain.counts[0][x,] + 1) / (plain.total + plain.distinct + 1)) for x in w)
        expected.append((i, len(w), sum(plain.counts[0][x,] > 0 for x in w), plain.total, base, plain.score(t, options.depth)))
    for a, b in zip(sorted(map(tuple, found), key=repr), sorted(expected, key=repr)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_a_state_is_a_distribution():
    plain = Plain(TEXTS, lm.SuffixTree())
    rest = 1 / (plain.total + plain.distinct + 1)  # of a word never seen
    for context in list(plain.states)[:50]:
        unseen = plain.p(context, b"\x00never")
        assert sum(plain.p(context, w) for (w,) in plain.counts[0]) + unseen == pytest.approx(1)
    assert plain.p((), b"\x00never") == rest


def test_without_training_texts_and_without_texts(spark):
    found = lm.score_texts(awkward(spark, [(1, "a b", None)]), F.lit(False)).collect()
    assert [tuple(r) for r in found] == [(1, 3, 0, 0, 0.0, 0.0)]
    assert lm.score_texts(awkward(spark, []), F.lit(True)).collect() == []


def test_rare_strings_count_in_a_long_corpus(spark):
    """Over a million tokens, strings that occur twice or once are in the tree like all others, whichever chunks have them."""
    rare = [" ".join(f"r{i}x{j % 7}" for j in range(i, i + 40)) for i in range(4)]
    texts = ["the cat sat on the mat " * 260_000, *rare, *rare, *[f"the cat {r} sat" for r in rare], *[prose(i, 40) for i in range(30)]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    found = {r.doc_id: r for r in lm.score_texts(docs, ~in_fold("doc_id", 7, 2)).collect()}
    whole = lm.SuffixTree(share=0.0, least=1)
    plain = Plain([t for i, t in rows if not held(i)], whole)
    assert plain.total > 1_000_000 and not held(0) and len(found) == len(rows)
    for i, t in rows:
        assert found[i].score == pytest.approx(plain.score(t, whole.depth), rel=1e-9)
