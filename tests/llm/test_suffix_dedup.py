"""Repeated passages against a set of all strings."""

import hashlib

import numpy as np
import pytest

from codonframe.llm import suffix_dedup as S
from codonframe.llm.shared import stored

from .fixtures import awkward, prose


def expected(rows):
    seen, out = set(), {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - S.LENGTH + 1):
            piece = data[s : s + S.LENGTH]
            if piece in seen:
                gone[s : s + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


ROWS = [
    (7, prose(1, 40)), (3, prose(2, 10) + prose(1, 30) + prose(3, 20)), (9, prose(1, 40)), (1, None), (2, ""), (4, "ab" * 400), (5, "ñü" * 120 + prose(1, 12)), (6, "x" * 99), (8, "x" * 99), (10, "x" * 250),
    (11, prose(5, 6000) + prose(2, 25)), (12, prose(4, 15) + prose(2, 25)[:150]), (13, prose(2, 25)[20:200]), (14, prose(6, 14) + prose(2, 25)[20:160] + prose(7, 9)),
]


@pytest.mark.parametrize("size", [1, 600, 1 << 19])
def test_removed_bytes_match(spark, size, monkeypatch):
    monkeypatch.setattr(S, "SORTED_BYTES", size)
    docs = awkward(spark, [(i, t, None) for i, t in ROWS] + [(None, prose(1, 40), None)])
    found = {r.doc_id: tuple(r)[1:] for r in S.dedup(docs).collect()}
    whole = prose(1, 40).encode()
    assert found.pop(None) == (len(whole), 0, 0, hashlib.sha256(whole).hexdigest())
    assert found == expected(ROWS)


def test_texts_without_repeats_keep_their_columns(spark):
    docs = awkward(spark, [(1, prose(1, 40), "en"), (2, "a " + prose(1, 40), "en"), (3, None, None)])
    found = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert found[1].text == prose(1, 40) and found[2].text == "a " and found[3].text is None and found[2].score == "x"
    assert S.without_repeats(docs).schema == docs.schema


def test_rows_that_share_an_id(spark):
    docs = awkward(spark, [(1, prose(1, 40), None), (1, prose(1, 40), None)])
    assert [r.n_removed for r in S.dedup(docs).collect()] == [0, 0]
    # Unlike texts are documents of their own; what is in none but them stays.
    one, two = prose(1, 25) + prose(3, 25), prose(2, 25) + prose(4, 25)
    rows = [(1, one), (1, two), (1, one), (2, prose(5, 9) + one[40:200] + prose(6, 9)), (3, prose(7, 9) + two[40:200] + prose(8, 9))]
    found = [tuple(r)[:4] for r in S.dedup(awkward(spark, [(i, t, None) for i, t in rows])).collect()]
    want = expected([(1, one), (2, two), (3, rows[3][1]), (4, rows[4][1])])
    assert sorted(found) == sorted([(1, *want[1][:3]), (1, *want[2][:3]), (1, *want[1][:3]), (2, *want[3][:3]), (3, *want[4][:3])])
    assert want[1][1] == want[2][1] == 0 and want[3][1] >= 160 and want[4][1] >= 160
    with pytest.raises(TypeError):
        S.dedup(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


@pytest.mark.parametrize("n", [150, 2500])
def test_rows_stay_few_around_a_passage_of_many_documents(spark, n, monkeypatch):
    """Whatever the group's size, a context gives a few rows, and the result is that of the set of all strings."""
    kept = []
    monkeypatch.setattr(S, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    rows = [(i, prose(i, 9) + prose(77_000, 30)[:150] + prose(50_000 + i, 9)) for i in range(n)]
    found = {r.doc_id: tuple(r)[1:] for r in S.dedup(awkward(spark, [(i, t, None) for i, t in rows], extra=False)).collect()}
    assert found == expected(rows)
    made = [x.count() for x in kept if "string" in x.columns or "lo" in x.columns]
    assert max(made) < 12 * n


def test_no_documents(spark):
    assert S.dedup(awkward(spark, [])).count() == 0


def test_maximal_repeats_have_all_occurrences():
    a, b, c = (prose(i, 30).encode() for i in (1, 2, 3))
    contexts = [b"1" + a[:150] + b"2", b"3" + a[:150] + b"4", a[:120] + b"5", b"6" + b[:150], c[:150]]
    owner, offset, prefix, before = S.suffixes(contexts)
    found = {(n, frozenset((int(owner[k]), int(offset[k])) for k in range(x, y))) for n, x, y in S.maximal_repeats(prefix, before)}
    assert found == {(150, frozenset({(0, 1), (1, 1)})), (120, frozenset({(0, 1), (1, 1), (2, 0)}))}


def test_equal_strings_have_equal_anchors():
    data = np.frombuffer(prose(1, 200).encode(), np.uint8)
    begin, last, anchor, context = S.anchors(data)
    assert begin[0] == 0 and last[-1] == len(data) - S.LENGTH and (begin[1:] == last[:-1] + 1).all()
    begin2, last2, anchor2, _ = S.anchors(data[37:900])
    of = lambda b, l, a, shift: {s + shift: int(x) for f, e, x in zip(b, l, a) for s in range(f, e + 1)}
    whole, part = of(begin, last, anchor, 0), of(begin2, last2, anchor2, 37)
    assert all(whole[s] == x for s, x in part.items())


def test_columns_of_any_name(spark):
    """Names that the operator might use itself, and columns whose names differ from them in capitals alone."""
    passage = prose(5, 60)
    names = ["__doc", "__sub", "__spans", "__mark", "__several", "__id", "__ID2", "___doc", "doc", "sub", "first", "last", "anchor", "context", "one", "two", "_n", "_m", "_lo", "bytes"]
    rows = [(i, f"{i} {passage}", *[f"{n}{i}" for n in names]) for i in (1, 2)] + [(2, "other", *["x"] * len(names)), (None, passage, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = S.without_repeats(docs)
    assert found.columns == docs.columns
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert {r[2:] for r in got} == {r[2:] for r in rows} and len(got) == 4
    kept = {(r[0], len(r[1])) for r in got}
    assert (1, len(rows[0][1])) in kept and (2, 5) in kept and len([x for x in kept if x[0] == 2 and x[1] < 12]) == 2
    assert S.dedup(docs).count() == 4
