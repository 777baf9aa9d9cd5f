"""Quality, toxicity and language on invented documents: held-out rows, and awkward ones."""

import bisect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonframe.llm import language_id, quality_model, toxicity
from codonframe.llm.chars import letters
from codonframe.llm.shared import in_fold

from .fixtures import awkward, labels, prose

ODD = [(9001, None, None), (9002, "", "en"), (9003, "12 34 ...", "en"), (9004, "word " * 30_000, None), (None, "some text", "en"), (9005, "٣٤", "xx"), (9006, "́", None)]


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(1)
    good = [(i, prose(i, rnd.randrange(30, 120)).capitalize() + ".", "en") for i in range(300)]
    bad = [(1000 + i, (rnd.choice(["BUY NOW!! ", "### *** ", "word word "]) * rnd.randrange(10, 60)) + prose(i, 10), "en") for i in range(300)]
    marks = labels(spark, [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(9001, None, None), (1, 1, 0), (None, 1, 1)])
    docs = awkward(spark, good + bad + ODD)
    out = in_fold("doc_id", 4, 2)
    rows = quality_model.score_quality(docs, marks, ~out).collect()
    found = {r.doc_id: r.score for r in rows}
    assert len(rows) == 607 and all(0 <= s <= 1 for s in found.values())
    held = {r.doc_id for r in docs.where(out).select("doc_id").collect()}
    assert len(held) > 80
    right = [(found[i] >= 0.5) == (i < 1000) for i in held if i < 9000]
    assert np.mean(right) > 0.97
    # Labels of held-out rows change nothing.
    other = {r.doc_id: r.score for r in quality_model.score_quality(docs, marks.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))), ~out).collect()}
    assert other == pytest.approx(found)


def test_quality_finds_a_pair_of_features():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and {frozenset(p[:2]) for p in m.pairs} >= {frozenset((0, 1))}


def test_quality_without_labels_or_documents(spark):
    none = labels(spark, [])
    docs = awkward(spark, ODD)
    assert {r.score for r in quality_model.score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    assert quality_model.score_quality(docs.limit(0), none, F.lit(True)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(2)
    bad_words = ["zzgrub", "vexling", "mockfly"]

    def text(i, bad):
        words = prose(i, rnd.randrange(40, 120)).split()
        for _ in range(3 if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad_words) + rnd.choice(["", "s", "er"])
        return " ".join(words)

    docs = [(i, text(i, i % 5 == 0), "en") for i in range(900)]
    marks = labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(900)] + [(9001, 0, None)])
    table = awkward(spark, docs + ODD)
    out = in_fold("doc_id", 3, 1)
    rows = toxicity.score_toxicity(table, marks, ~out).collect()
    found = {r.doc_id: r.score for r in rows}
    assert len(rows) == 907 and all(0 <= s <= 1 for s in found.values())
    held = {r.doc_id for r in table.where(out).select("doc_id").collect() if r.doc_id and r.doc_id < 9000}
    assert np.mean([(found[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.97


def test_toxicity_without_labels_or_documents(spark):
    docs = awkward(spark, ODD)
    assert {r.score for r in toxicity.score_toxicity(docs, labels(spark, []), F.lit(True)).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels(spark, [(1, 1, 1)]), F.lit(True)).count() == 0


def plain_model(rows, order, d):
    """Kneser-Ney by plain counting over (label, text): log ratios of grams and of contexts, and a check that the shared orders sum to 1."""
    seen, tops = Counter(), ({}, {})
    for label, text in rows:
        codes = "".join(map(chr, letters([text])[0]))
        for i in range(1, len(codes)):
            back = i - codes.rindex(" ", 0, i) + 1
            tail = lambda k: codes[i + 1 - min(back, k) : i + 1]  # noqa: B023, E731
            seen[tail(5), tail(4), tail(2), back > 4] += 1
            if label is not None:
                tops[label].setdefault((tail(order), tail(4)), Counter())[0] += 1
    low, lowest = Counter(), Counter()
    for (_, four, two, free), n in seen.items():
        low[four, two] += 1 if free else n
    for _, two in low:
        lowest[two] += 1

    def level(counts, below):
        whole, kinds = Counter(), Counter()
        for g, n in counts.items():
            whole[g[:-1]] += n
            kinds[g[:-1]] += 1
        return {g: max(n - d, 0) / whole[g[:-1]] + d * kinds[g[:-1]] / whole[g[:-1]] * below(g) for g, n in counts.items()}, whole, kinds

    p2, whole, kinds = level(lowest, lambda g: 1 / 256)
    for c in whole:  # letters seen after a context, and the rest of 256
        unseen = (256 - sum(g[:-1] == c for g in p2)) * d * kinds[c] / whole[c] / 256
        assert sum(p for g, p in p2.items() if g[:-1] == c) + unseen == pytest.approx(1)
    two_of = dict(low.keys())
    p4, *_ = level({four: n for (four, _), n in low.items()}, lambda g: p2[two_of[g]])
    of_class = []
    for top in tops:
        whole, kinds = Counter(), Counter()
        for (g, _), n in top.items():
            whole[g[:-1]] += n[0]
            kinds[g[:-1]] += 1
        of_class.append((whole, kinds))

    def left(k, c):
        whole, kinds = of_class[k]
        return d * kinds[c] / whole[c] if whole[c] else 1.0

    def p(k, g, four):
        n = tops[k].get((g, four), Counter())[0]
        whole = of_class[k][0][g[:-1]]
        return (max(n - d, 0) / whole if whole else 0.0) + left(k, g[:-1]) * p4[four]

    grams = {g: np.log(p(1, g, four) / p(0, g, four)) for top in tops for g, four in top}
    return grams, {g[:-1]: np.log(left(1, g[:-1]) / left(0, g[:-1])) for g in grams}


def test_ratios_are_those_of_plain_kneser_ney(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([0, 0, 1, None]), prose(i, rnd.randrange(1, 30)) + (" zzgrub!" if i % 3 == 0 else "")) for i in range(60)] + [(1, None), (0, ""), (None, "x")]
    options = toxicity.KneserNey(order=6)
    tables = toxicity.ratio_table(toxicity.gram_counts(spark.createDataFrame(rows, "label int, text string"), options.order), options)
    for table, want in zip(tables, plain_model(rows, options.order, options.discount)):
        assert len(table.keys) == len(want) == len(set(table.keys.tolist()))
        codes = [np.array([ord(c) for c in g], np.uint32) for g in want]
        keys = np.array([toxicity._mixed(toxicity._keys(c, len(c))[len(c)][-1:])[0] for c in codes], np.uint64)
        assert table.find(keys) == pytest.approx(np.array(list(want.values())), abs=1e-5)
        assert np.isnan(table.find(keys ^ np.uint64(1))).all()


def test_letters_of_texts():
    codes, rows = letters(["ab ab ac", None, "B!a"])
    assert "".join(map(chr, codes)) == " ab ab ac b a " and rows.tolist() == [0] * 10 + [2] * 4


def test_quality_scores_are_sums_of_table_entries(spark):
    rnd = random.Random(4)
    docs = awkward(spark, [(i, prose(i, rnd.randrange(5, 90)) + "!#$ 12\n" * rnd.randrange(9) * (i % 2), "en") for i in range(160)] + ODD)
    marks = labels(spark, [(i, i % 2, 0) for i in range(150)])
    rows = {r.doc_id: r for r in quality_model.features(docs).collect()}
    learnt = [r for i, r in rows.items() if i is not None and i < 150]
    x = np.array([[r[f] for f in quality_model.FEATURES] for r in learnt], np.float64)
    m = quality_model.fit(x, np.array([r.doc_id % 2 for r in learnt], np.float64))
    assert m.pairs and any(t.any() for t in m.tables)
    for r in quality_model.score_quality(docs, marks, F.lit(True)).collect():
        v = [rows[r.doc_id][f] for f in quality_model.FEATURES]
        margin = m.base + sum(t[bisect.bisect_right(e.tolist(), u)] for u, e, t in zip(v, m.edges, m.tables))
        margin += sum(t[bisect.bisect_right(m.coarse[i].tolist(), v[i]), bisect.bisect_right(m.coarse[j].tolist(), v[j])] for i, j, t in m.pairs)
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-6)


LANGS = {"xx": "zuzu kaka wowo yaya", "yy": "stren blonk grist plomf", "zz": "éàü öñé ßüa çéo"}


def test_language_on_held_out_rows(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choices(LANGS[k].split(), k=2)) for _ in range(30)), k) for i, k in enumerate(rnd.choices(list(LANGS), k=200))]
    docs = awkward(spark, rows + ODD)
    out = in_fold("doc_id", 4, 2)
    found = {r.doc_id: r for r in language_id.identify(docs, ~out).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows)
    assert [found[i].lang_pred for i in (9001, 9002, 9003, 9005, 9006)] == ["und"] * 5
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_ranks_by_definition(spark):
    docs = awkward(spark, [(1, "aab", "p"), (2, "bba", "q")])
    found = {r.doc_id: r for r in language_id.identify(docs, F.lit(True)).collect()}
    assert (found[1].lang_pred, found[1].score, found[2].lang_pred, found[2].score) == ("p", 1.0, "q", 1.0)
    keys = language_id.gram_keys(np.array([32, 97, 98, 32], np.uint32))
    assert len(keys) == 2 + 3 + 2


def plain_distances(learn, texts, top):
    """(name, score) of each text by ranking and comparing n-grams one by one."""

    def ranked(own):
        counts = Counter()
        for t in own:
            codes = letters([t])[0].tolist()
            for i in range(len(codes)):
                for k in (1, 2, 3):
                    g = codes[i : i + k]
                    if len(g) == k and (g != [32] if k == 1 else k == 2 or g[1] != 32):
                        counts[sum(c << 21 * (k - 1 - j) for j, c in enumerate(g))] += 1
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]

    models = {lang: {g: r for r, g in enumerate(ranked([t for t, x in learn if x == lang and t]))} for lang in sorted({x for _, x in learn if x is not None})}
    out = []
    for t in texts:
        own = ranked([t or ""])
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(m[g] - r) if g in m else top for r, g in enumerate(own)) for lang, m in models.items()}
        best = min(far, key=lambda x: (far[x], x))
        out.append((best, 1 - far[best] / (top * len(own))))
    return out


@pytest.mark.parametrize("block", [2, 2000])
def test_language_equals_plain_out_of_place_distances(spark, block):
    rnd = random.Random(9)
    words = {f"l{k}": ["".join(rnd.choices("abcdefgé", k=rnd.randrange(1, 6))) for _ in range(25)] for k in range(5)}
    rows = [(i, " ".join(rnd.choices(words[k] + words["l0"], k=rnd.randrange(1, 120))) + rnd.choice(["", ".", " 12 ", "\n"]), k) for i, k in enumerate(rnd.choices(list(words), k=200))]
    rows += [(i, t, k) for i, t, k in ODD if i is not None]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(awkward(spark, rows), F.lit(True), language_id.Ranks(top=60, block=block)).collect()}
    for (i, _, _), (name, score) in zip(rows, plain_distances([(t, k) for _, t, k in rows], [t for _, t, _ in rows], 60)):
        assert found[i][0] == name and found[i][1] == pytest.approx(score)


def test_language_without_documents_or_names(spark):
    assert language_id.identify(awkward(spark, []), F.lit(True)).count() == 0
    assert language_id.identify(awkward(spark, [(1, "text", None)]), F.lit(True)).first().lang_pred == "und"
