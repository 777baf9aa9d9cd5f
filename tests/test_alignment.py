"""Within and between groups: golden alignments, and all pairs by brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from codonframe.functions.stats import jukes_cantor, stars, two_sided_p, z_score
from codonframe.genetics.code import CODE, pair_differences, site_counts
from codonframe.operators import alleles, between, bootstrap, codons, pieces, windows, within
from codonframe.sources.gtf import coding_products

ONE = ["ATGAAACTGGCA", "ATGAAGCTAGCA", "ATGAAATTAGCG", "ATGNNNCTGG-A"]
TWO = ["ATGAGACTGGCA", "ATGAAACTGGCC", "ATGTAACTGGCA"]


def sequences(spark, **groups):
    return spark.createDataFrame([(g, i, f"s{i}", s) for g, rows in groups.items() for i, s in enumerate(rows)], "group string, seq_idx long, header string, seq string")


def counts(spark, segments=((1, 12),), **groups):
    products = coding_products(spark.createDataFrame([("P", a, b, "+") for a, b in segments], "product string, start int, stop int, strand string"))
    return codons.codon_counts(codons.codon_columns(sequences(spark, **groups), products))


def rows(df, *by):
    return {tuple(r[b] for b in by): r for r in df.collect()}


def test_within_golden(spark):
    found = rows(within.within_codon(counts(spark, g=ONE)), "codon_num")
    expected = {1: ("conserved", 4, 3, 0, 0, 0), 2: ("polymorphic", 3, 8 / 3, 1 / 3, 0, 2 / 3), 3: ("polymorphic", 4, 11 / 6, 7 / 6, 0, 7 / 6), 4: ("polymorphic", 3, 2, 1, 0, 2 / 3)}
    for k, (kind, n, *measures) in expected.items():
        r = found[(k,)]
        assert (r.variability, r.num_defined_seqs) == (kind, n)
        assert [r.N_sites, r.S_sites, r.N_diffs, r.S_diffs] == pytest.approx(measures)
    whole = within.product_results(within.within_codon(counts(spark, g=ONE))).first()
    assert [whole.N_sites, whole.S_sites, whole.N_diffs, whole.S_diffs, whole.dN, whole.dS] == pytest.approx([9.5, 2.5, 0, 2.5, 0, 1])


def test_variants_and_sites_golden(spark):
    v = rows(alleles.variant_results(counts(spark, g=ONE)), "codon_num")[(2,)]
    assert (v.codons, v.codon_counts, v.variant_type, v.consensus_codon, v.min_codon_count) == (["AAA", "AAG"], [2, 1], "Synonymous", "AAA", 1)
    sites = rows(alleles.site_diversity(alleles.site_counts(sequences(spark, g=ONE))), "site")
    assert {k[0]: round(r.pi, 9) for k, r in sites.items() if r.pi} == {6: 0.666666667, 7: 0.5, 9: 0.666666667, 12: 0.5}
    assert sites[(9,)].maj_nt == "A" and sites[(4,)].coverage == 3


def test_between_golden(spark):
    found = rows(between.between_codon(counts(spark, a=ONE, b=TWO)), "codon_num")
    expected = {1: (3, 0, 0, 0), 2: (2.138888889, 0.361111111, 0.333333333, 0.222222222), 3: (1.75, 1.25, 0, 0.75), 4: (2, 1, 0, 0.555555556)}
    for k, measures in expected.items():
        r = found[(k,)]
        assert [r.N_sites, r.S_sites, r.N_diffs, r.S_diffs] == pytest.approx(measures)
    whole = between.between_product(between.between_codon(counts(spark, a=ONE, b=TWO))).first()
    assert (whole.dN, whole.dS) == (pytest.approx(0.0375), pytest.approx(0.585106383))


def test_one_group_without_defined_codons(spark):
    found = between.between_codon(counts(spark, ((1, 3),), a=["NNN", "A-C"], b=["CTG", "AAA"])).first()
    assert (found.num_defined_codons_g1, found.num_defined_codons_g2, found.N_diffs, found.variability) == (0, 2, 0, "conserved")
    assert found.N_sites == pytest.approx(8 / 3)  # of AAA, the least codon


def test_brute_force_over_all_pairs(spark):
    rnd = random.Random(4)
    letters = "ACGTN"
    groups = {g: ["".join(rnd.choices(letters, [5, 5, 5, 5, 1], k=9)) for _ in range(7)] for g in "ab"}
    c = counts(spark, ((1, 9),), **groups)
    inner, outer = rows(within.within_codon(c), "group", "codon_num"), rows(between.between_codon(c), "codon_num")
    for k in range(3):
        cut = {g: [s[3 * k : 3 * k + 3] for s in rows_ if "N" not in s[3 * k : 3 * k + 3]] for g, rows_ in groups.items()}
        for g in "ab":
            pairs = list(itertools.combinations(cut[g], 2))
            if pairs:
                r = inner[g, k + 1]
                assert r.N_diffs == pytest.approx(sum(pair_differences(x, y)[0] for x, y in pairs) / len(pairs))
                sites = [sum(n for n, _ in site_counts(x)) for p in pairs for x in p]
                assert r.N_sites == pytest.approx(sum(sites) / len(sites))
        if cut["a"] and cut["b"]:
            pairs = list(itertools.product(cut["a"], cut["b"]))
            assert outer[(k + 1,)].S_diffs == pytest.approx(sum(pair_differences(x, y)[1] for x, y in pairs) / len(pairs))


def test_segments_in_any_order_and_lengths(spark):
    found = counts(spark, ((7, 12), (1, 3)), g=["ATGCCCAAATTT"]).orderBy("codon_num").collect()
    assert [r.codon for r in found] == ["ATG", "AAA", "TTT"]
    with pytest.raises(Exception, match="multiple of 3"):
        counts(spark, ((1, 4),), g=["ATGC"]).collect()
    with pytest.raises(Exception, match="beyond the end"):
        counts(spark, ((1, 6),), g=["ATGC"]).collect()
    with pytest.raises(ValueError, match="different lengths"):
        codons.validated(sequences(spark, g=["ATG", "AT"]))
    assert codons.validated(sequences(spark, g=["ATG"], h=["AT"])).count() == 2


def test_annotations_of_any_size(spark, monkeypatch):
    """Products in several buckets and pieces, sent out or joined."""
    monkeypatch.setattr(codons, "BUCKET_ROWS", 3)
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("ACGTN-", k=40)) for _ in range(5)]
    seqs = sequences(spark, g=texts[:2], h=texts[2:])
    segments = {f"P{i}": [(1 + i % 4, 6 + i % 4)] if i % 2 else [(2 + i, 4 + i), (7 + i, 7 + i), (9 + i, 13 + i)] for i in range(20)}
    products = coding_products(spark.createDataFrame([(p, a, b, "+") for p, parts in segments.items() for a, b in parts], "product string, start int, stop int, strand string"))
    spliced = lambda t, p: "".join(t[a - 1 : b] for a, b in segments[p])
    want = sorted((g, p, k // 3 + 1, spliced(t, p)[k : k + 3]) for g, rows_ in (("g", texts[:2]), ("h", texts[2:])) for t in rows_ for p in segments for k in range(0, len(spliced(t, p)), 3))
    for limit, piece in ((0, 5), (64 << 20, 3), (64 << 20, 1 << 14), (0, 16)):
        monkeypatch.setattr(pieces, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(pieces, "PIECE", piece)
        assert sorted(tuple(r) for r in codons.codon_columns(seqs, products).collect()) == want
        named = pieces.cut(seqs.select("group", F.col("header").alias("sequence"), "seq"), "group", "sequence")
        assert sorted(tuple(r) for r in pieces.codon_rows(named, products).drop("sequence").collect()) == want
        sites = sorted((r.group, r.site, r.A) for r in alleles.site_counts(seqs).collect())
        assert sites == sorted((g, i + 1, sum(t[i] == "A" for t in rows_)) for g, rows_ in (("g", texts[:2]), ("h", texts[2:])) for i in range(40))
    assert codons.codon_columns(seqs, products.limit(0)).count() == 0


def test_products_beyond_two_thousand_million_bases(spark):
    far = 3_000_000_000
    products = coding_products(spark.createDataFrame([("P", far, far + 3, "+"), ("P", far + 16384, far + 16388, "+")], "product string, start long, stop long, strand string"))
    assert [(r.piece * 16384 < r.site <= (r.piece + 1) * 16384, r.site - far, r.codon_num, r.n) for r in pieces.runs(products).orderBy("site").collect()] == [(True, 0, 1, 1), (True, 16386, 3, 1)]
    assert [(r.codon_num, [x - far for x in r.sites]) for r in pieces.spliced_codons(products).collect()] == [(2, [3, 16384, 16385])]


def test_codons_are_cut_from_runs_and_pieces_stay_with_their_numbers(spark):
    products = coding_products(spark.createDataFrame([("P", 1, 9, "+")], "product string, start int, stop int, strand string"))
    lines = spark.createDataFrame([("a", 0, 0, ">s"), ("a", 0, 1, "ACGTACGTAC")], "group string, part int, line long, value string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = pieces.codon_rows(pieces.pieces_of_lines(lines), products)
    assert sorted((r.codon_num, r.codon) for r in found.collect()) == [(1, "ACG"), (2, "TAC"), (3, "GTA")]
    assert "transform(sequence(" not in plan(found)  # which copies the piece for each codon
    joins = [x for x in plan(pieces.pieces_of_lines(lines)).splitlines() if "Join Inner" in x]
    assert "piece" in joins[0]  # not by sequence alone, which is one key


@pytest.mark.parametrize("piece", [3, 7, 1 << 14])
def test_fasta_lines_become_pieces(spark, tmp_path, piece):
    """Several records, headers at the edge of a part, empty records and lines, parts of any size."""
    records = {"one": "ACGTA" * 9, "none": "", "two": "acgunn-", "three": "G" * 16, "last": "TT"}
    (tmp_path / "a.fa").write_text("lost\n\n" + "".join(f">{h}\r\n" + "\n".join(s[i : i + 5] for i in range(0, len(s), 5)) + "\n\n" for h, s in records.items()))
    want = {h: s.upper().replace("U", "T") for h, s in records.items() if s}
    lines = (tmp_path / "a.fa").read_text().splitlines()
    for size in (1, 2, 3, 100):
        rows_ = spark.createDataFrame([("a", i // size, i, x) for i, x in enumerate(lines)], "group string, part int, line long, value string").repartition(3)
        found = pieces.pieces_of_lines(rows_, piece).collect()
        whole = {}
        for r in sorted(found, key=lambda r: r.piece):
            assert r.length == len(want[r.header]) and r.bases == want[r.header][r.piece * piece : (r.piece + 1) * piece + 2]
            whole[r.header] = whole.get(r.header, "") + r.bases[:piece]
        assert whole == want and len({r.sequence for r in found}) == len(want)
    read = {(r.group, r.header, r.piece): r.bases for r in pieces.read_fasta_pieces(spark, str(tmp_path)).collect()}
    assert read == {("a.fa", h, 0): s for h, s in want.items()}


def table(spark, numbers, product="P"):
    return spark.createDataFrame([(product, n, 2.0, 1.0, 0.1 * n, 0.2, 5.0) for n in numbers], "product string, codon_num int, N_sites double, S_sites double, N_diffs double, S_diffs double, num_defined_seqs double")


def test_windows_by_number_and_by_row(spark):
    found = windows.sliding_windows(table(spark, [1, 2, 4, 5, 6]), 3, 1).orderBy("window").collect()
    assert [(r.first_codon, r.N_sites) for r in found] == [(1, 4.0), (2, 4.0), (3, 4.0)]  # 3 is missing and adds nothing
    found = windows.row_windows(table(spark, [5, 6, 8, 9]), 3).orderBy("sw_start").collect()
    assert [(r.sw_start, r.sw_end, r.sw_N_sites) for r in found] == [(5, 8, 6.0), (6, 9, 6.0)]
    assert windows.sliding_windows(table(spark, [1, 2]), 3).count() == 0
    ratio = windows.row_windows(table(spark, [1, 2, 3]), 2, numerator="S", denominator="N").first()
    assert ratio.sw_ratio == "dSdN" and ratio.sw_N_diffs == pytest.approx(0.4)


@pytest.mark.parametrize("block", [1, 3, 4, 4096])
def test_windows_of_a_product_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    numbers = [n for n in range(3, 40) if n not in (5, 11, 12, 30)]
    df = table(spark, numbers).unionByName(table(spark, range(1, 8), "Q")).repartition(3)
    for size, step in ((1, 1), (5, 2), (9, 3)):
        found = {(r.product, r.window): (r.first_codon, r.N_diffs) for r in windows.sliding_windows(df, size, step).collect()}
        want = {}
        for p, held in (("P", numbers), ("Q", list(range(1, 8)))):
            for k, first in enumerate(range(held[0], held[0] + len(held) - size + 1, step)):
                want[p, k + 1] = (first, pytest.approx(sum(0.1 * n for n in held if first <= n < first + size)))
        assert found == want
        rows_ = {(r.product, r.codon_num): (r.sw_start, r.sw_end, r.sw_center) for r in windows.row_windows(df, size, step).collect()}
        assert rows_ == {(p, held[i]): (held[i], held[i + size - 1], pytest.approx(sum(held[i : i + size]) / size)) for p, held in (("P", numbers), ("Q", list(range(1, 8)))) for i in range(0, len(held) - size + 1, step)}


def test_guards_of_codon_tables(spark):
    df = table(spark, [1, 2, 2, 3, 4])
    for made in (windows.sliding_windows(df, 3), windows.row_windows(df, 3)):
        with pytest.raises(Exception, match="codon number twice"):
            made.collect()
    assert [tuple(r) for r in windows.table_guards(df).collect()] == [("P", "repeated", 2, 2)]
    none = df.withColumn("codon_num", F.when(F.col("codon_num") == 2, None).otherwise(F.col("codon_num")))
    assert [tuple(r) for r in windows.table_guards(none).collect()] == [("P", "no number", None, 2)]
    assert windows.table_guards(df.limit(0)).count() == windows.several_products(df).count() == 0
    two = df.unionByName(table(spark, [1], "Q"))
    assert sorted(map(tuple, windows.several_products(two).collect())) == [("P", "several products", 5), ("Q", "several products", 1)]
    assert [tuple(r)[:2] for r in windows.window_log(two, 3).collect()] == [("Q", 1)] and windows.window_log(two, 3, min_defined=6).count() == 2
    with pytest.raises(ValueError, match="S_sites"):
        windows.row_windows(df.drop("S_sites"), 3)


def test_normal_tail_without_python(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.8284271, 2.8284272, 3.5, 5.0, 9.0, 37.0, 60.0]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", two_sided_p(F.col("z")).alias("p"), two_sided_p(-F.col("z")).alias("q"))
    for r in df.collect():
        assert r.p == r.q == pytest.approx(two_tails(r.z), rel=1e-12, abs=1e-300)
    assert "Python" not in df._jdf.queryExecution().toString()


def two_tails(z):
    return math.erfc(abs(z) / math.sqrt(2))


def test_bootstrap_error_is_near_the_analytic_one(spark):
    rnd = random.Random(2)
    values = [rnd.random() for _ in range(60)]
    df = spark.createDataFrame([("P", i + 1, 1.0, 1.0, v, 0.1) for i, v in enumerate(values)], "product string, codon_num int, N_sites double, S_sites double, N_diffs double, S_diffs double")
    reps = bootstrap.replicates(df, 1500, 5)
    error = bootstrap.standard_errors(reps).first()
    mean = sum(values) / 60
    assert error.SE_dN == pytest.approx((sum((v - mean) ** 2 for v in values) / 60 / 60) ** 0.5, rel=0.1)
    assert error.SE_dS == pytest.approx(0, abs=1e-12)
    again = {r.rep: r.N_diffs for r in bootstrap.replicates(df, 1500, 5).collect()}
    assert all(again[r.rep] == pytest.approx(r.N_diffs) for r in reps.collect())
    with_p = bootstrap.with_p_values(bootstrap.with_z_test(within.rates(within.totals(df, "product")), bootstrap.standard_errors(reps)), ratio_null=1.0).first()
    assert with_p.dN_minus_dS_P < 1e-9 and with_p.dN_over_dS_P == pytest.approx(two_tails((with_p.dN_over_dS - 1) / with_p.SE_dN_over_dS), abs=1e-9)
    z = bootstrap.with_z_test(within.rates(within.totals(df, "product")), bootstrap.standard_errors(reps)).first()
    assert z.significance == "***"


def test_replicates_of_one_product_use_all_tasks(spark, monkeypatch):
    df = table(spark, range(1, 30))
    whole = {r.rep: r.N_diffs for r in bootstrap.replicates(df, 120, 5).collect()}
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    dealt = bootstrap.replicates(df, 120, 5).withColumn("task", F.spark_partition_id()).collect()
    assert {r.rep: r.N_diffs for r in dealt} == whole and sorted(whole) == list(range(1, 121)) and len({r.task for r in dealt}) == 4


def test_significance_level_of_replicates(spark):
    df = spark.createDataFrame([("P", r, 1.0, 1.0, d, 0.5) for r, d in enumerate([0.6, 0.7, 0.5, 0.2])], "product string, rep int, N_sites double, S_sites double, N_diffs double, S_diffs double")
    r = bootstrap.achieved_significance(df).first()
    assert (r.dN_gt_dS_count, r.dN_eq_dS_count, r.dN_lt_dS_count, r.ASL_dNdS_P) == (2, 1, 1, 0.5)


def test_scalar_functions(spark):
    r = spark.range(1).select(jukes_cantor(F.lit(0.3)).alias("a"), jukes_cantor(F.lit(0.8)).alias("b"), z_score(F.lit(1.0), F.lit(0.0)).alias("c"), stars(F.lit(-2.0)).alias("d"), two_sided_p(F.lit(1.959963985)).alias("e"), two_sided_p(F.lit(None).cast("double")).alias("f")).first()
    assert r.a == pytest.approx(0.38312, abs=1e-4) and r.b is None and r.c is None and r.d == "**" and r.e == pytest.approx(0.05, abs=1e-8) and r.f is None


def test_translation_covers_the_code(spark):
    from codonframe.functions.sequence import translated

    df = spark.createDataFrame([(c,) for c in CODE], "c string")
    assert {r.c: r.a for r in df.select("c", translated(F.col("c")).alias("a")).collect()} == CODE
    assert spark.range(1).select(translated(F.lit("auG")).alias("a"), translated(F.lit("NNN")).alias("b")).first() == ("M", "?")
