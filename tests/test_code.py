"""Invariants of the generated codon tables, and documented values."""

import pytest

from codonframe.genetics.code import CODE, CODONS, pair_differences, site_counts


def total(codon):
    return tuple(sum(x) for x in zip(*site_counts(codon)))


def test_sites_of_every_codon():
    for codon in CODONS:
        assert sum(total(codon)) == pytest.approx(0 if CODE[codon] == "*" else 3)


@pytest.mark.parametrize("codon,n,s", [("ATG", 3, 0), ("AAA", 8 / 3, 1 / 3), ("AGA", 13 / 6, 5 / 6), ("CTG", 5 / 3, 4 / 3), ("TGC", 2.5, 0.5), ("TAC", 2, 1), ("TAA", 0, 0)])
def test_known_sites(codon, n, s):
    assert total(codon) == (pytest.approx(n), pytest.approx(s))


@pytest.mark.parametrize("a,b,n,s", [("AAA", "AAG", 0, 1), ("AAA", "ACC", 1.5, 0.5), ("AAA", "CTG", 13 / 6, 5 / 6), ("AAA", "TGC", 3, 0), ("CTG", "TTA", 0, 2), ("TAA", "TGG", 0, 0)])
def test_known_differences(a, b, n, s):
    assert pair_differences(a, b) == (pytest.approx(n), pytest.approx(s))


def test_differences_are_symmetric_and_complete():
    for a in CODONS:
        for b in CODONS:
            assert pair_differences(a, b) == pytest.approx(pair_differences(b, a))
            if "*" not in (CODE[a], CODE[b]):
                assert sum(pair_differences(a, b)) == pytest.approx(sum(x != y for x, y in zip(a, b)))
