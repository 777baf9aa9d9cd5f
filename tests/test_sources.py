"""Readers, converters and pooled samples on small files."""

import random

import pytest
from pyspark.sql import functions as F

from codonframe.genetics.code import site_counts
from codonframe.operators import pieces, pool, revcom
from codonframe.sources import fasta, gtf, tables, variants
from codonframe.streaming.alignments import stream_fasta, stream_within


def test_fasta_files_and_quirks(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">one > two\r\nacgu\r\nAC\r\n>three\r\nTTTTTT\r\n")
    (tmp_path / "b.fas").write_text(">x\nACG\nTNN")
    (tmp_path / "c.txt").write_text(">no\nAAA\n")
    found = {(r.group, r.header): r.seq for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert found == {("a.fasta", "one > two"): "ACGTAC", ("a.fasta", "three"): "TTTTTT", ("b.fas", "x"): "ACGTNN"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "d.fa").write_bytes(b">one\racgu\rAC\r>two > x\rTTT\r")
    assert {r.header: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "m")).collect()} == {"one": "ACGTAC", "two > x": "TTT"}
    with pytest.raises(ValueError):
        fasta.read_reference(spark, str(tmp_path / "a.fasta"))
    assert fasta.read_reference(spark, str(tmp_path / "b.fas")).first().seq == "ACGTNN"


def test_fasta_round_trip_of_the_other_strand(spark, tmp_path):
    seqs = spark.createDataFrame([("g", 0, "s", "ACGTN" * 30)], "group string, seq_idx long, header string, seq string")
    once = revcom.revcom_sequences(seqs)
    fasta.write_fasta(once, str(tmp_path / "out"))
    line = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert line[0] == ">s_revcom" and max(map(len, line[1:])) == 50 and "".join(line[1:]) == once.first().seq
    assert revcom.revcom_sequences(once).first().seq == "ACGTN" * 30


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text('r\tC\tCDS\t9\t11\t.\t+\t0\tgene_id "gene:b c";\nr\tC\tCDS\t1\t3\t.\t+\t0\tgene_id "gene:b c";\nr\tC\tCDS\t2\t4\t.\t-\t0\tgene_id "m";\nr\tC\texon\t2\t4\t.\t+\t0\tgene_id "e";')
    segments = gtf.read_gtf(spark, str(tmp_path / "x.gtf"))
    assert {(r.product, r.start, r.stop) for r in segments.collect()} == {("b c", 9, 11), ("b c", 1, 3)}
    sites = gtf.cds_sites(segments).orderBy("site").collect()
    assert [(r.site, r.codon_num, r.position_in_codon, r.codon_start_site) for r in sites] == [(1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 3, 1), (9, 2, 1, 9), (10, 2, 2, 9), (11, 2, 3, 9)]
    turned = revcom.revcom_segments(segments, 20).orderBy("start").first()
    assert (turned.start, turned.stop, turned.strand) == (10, 12, "-")
    (tmp_path / "bad.gtf").write_text("r\tC\tCDS\t1\t3\t.\t+\t0\tnothing")
    with pytest.raises(Exception, match="gene_id"):
        gtf.read_gtf(spark, str(tmp_path / "bad.gtf")).collect()


def test_vcf_reader_and_other_strand(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##h\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc\t5\t.\tA\tG,T\t.\t.\tAA=A\tGT:AD:DP\t0/1:6,3,1:99\t0/1:0,0,0:0\n")
    found = {(r.file, r.alt): (r["count"], r.coverage) for r in variants.read_vcf(spark, str(tmp_path / "x.vcf"), 4).collect()}
    assert found == {("x.vcf:S1", "G"): (3, 10), ("x.vcf:S1", "T"): (1, 10), ("x.vcf:S2", "G"): (0, 0), ("x.vcf:S2", "T"): (0, 0)}
    rows = spark.createDataFrame([(5, "AC", "g,TT", "AF=0.1,0.2;AA=AC;Z")], "POS int, REF string, ALT string, INFO string")
    r = revcom.revcom_vcf(rows, 10).first()
    assert (r.POS, r.REF, r.ALT, r.INFO) == (5, "GT", "c,AA", "AF=0.1,0.2;AA=GT;Z")
    assert revcom.revcom_vcf(rows, 10, legacy_alt_order=True).first().ALT == "AA,c"


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_vcf_files_with_headers_of_their_own(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(variants, "HEADER_BYTES", limit)
    top = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(f"##h\n{top}A1\nc\t5\t.\tA\tG\t.\t.\t.\tAD\t6,3\n")
    (tmp_path / "b.vcf").write_text(f"{top}B2\tB1\nc\t5\t.\tA\tG\t.\t.\t.\tAD\t1,1\t2,6\nc\t9\t.\tA\tG\t.\t.\t.\tAD\t4,0\n")
    (tmp_path / "d.vcf").write_text(f"{top}D1\n")  # no variants
    (tmp_path / "e.vcf").write_text("#CHROM\tPOS\tREF\tALT\tINFO\nc\t7\tA\tG\tDP=8;AF=0.5\n")  # no samples, fewer columns
    found = sorted((r.file, r.site, r["count"], r.coverage) for r in variants.read_vcf(spark, str(tmp_path / "*.vcf"), 4).collect())
    assert found == [("a.vcf:A1", 5, 3, 9), ("b.vcf:B1", 5, 6, 8), ("b.vcf:B2", 5, 1, 2), ("b.vcf:B2", 9, 0, 4)]  # a line that ends early has no more samples
    assert [(r.file, r.site, r["count"]) for r in variants.read_vcf(spark, [str(tmp_path / "e.vcf"), str(tmp_path / "d.vcf")], 2).collect()] == [("e.vcf", 7, 4)]
    (tmp_path / "f.vcf").write_text("c\t7\t.\tA\tG\t.\t.\tDP=8;AF=0.5\n")
    with pytest.raises(Exception, match="no #CHROM line in f.vcf"):
        variants.read_vcf(spark, str(tmp_path), 2).collect()
    (tmp_path / "f.vcf").write_text(f"{top}F1\n{top}F2\nc\t7\t.\tA\tG\t.\t.\tDP=8;AF=0.5\tAD\t1,1\n")
    with pytest.raises(Exception, match="two different"):
        variants.read_vcf(spark, str(tmp_path), 4).collect()


def test_reads_of_vcf_samples_are_whole_and_summed_once(spark):
    top = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"
    line = lambda pos, alt, form, *values: "\t".join(["c", str(pos), ".", "A", alt, ".", ".", ".", form, *values])
    rows = [
        line(1, "G", "GT:AD:DP", "0/1:20,29:9", "0/1:6,7:9"), line(2, "G,T", "AD", "1,x,2", ".,.,."), line(3, "G", "GT:AD", "0/1", "."), line(4, "G,T", "AD:DP", "3,4:7", "0,0,0,5"),
        line(5, "G", "GT:DP", "0/1:9", "0/1:9"), line(6, "G", "AD", "", "1,2,3"), line(7, ".", "AD", "7", "0,0"), line(8, "G", "ADF:AD", "8,9:1,3"),
    ]
    lines = spark.createDataFrame([("f", x) for x in (top, *rows)], "file string, value string")
    found = variants.parse_vcf_lines(lines, 4)
    at = {(r.site, r.file[2:], r.alt): (r["count"], r.coverage, r.freq) for r in found.collect()}
    assert at == {
        (1, "S1", "G"): (29, 49, 29 / 49), (1, "S2", "G"): (7, 13, 7 / 13), (2, "S1", "T"): (2, 3, 2 / 3), (2, "S2", "G"): (0, 0, 0), (2, "S2", "T"): (0, 0, 0), (4, "S1", "G"): (4, 7, 4 / 7),
        (4, "S2", "G"): (0, 5, 0), (4, "S2", "T"): (0, 5, 0), (6, "S2", "G"): (2, 6, 2 / 6), (7, "S2", "."): (0, 0, 0), (8, "S1", "G"): (3, 4, 0.75),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1  # not once more for each alternative
    with pytest.raises(Exception, match="AD is twice"):
        variants.parse_vcf_lines(spark.createDataFrame([("f", top), ("f", line(1, "G", "AD:GT:AD", "1,2:3:4,5"))], "file string, value string"), 4).collect()


def test_vcf_files_are_headed_without_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(60).select((59 - F.col("id")).alias("POS"), F.lit("A").alias("REF"), F.when(F.col("id") > 9, "G").alias("ALT"))
    variants.write_vcf(rows, str(tmp_path / "out"), ["##h", "##i"], ["POS", "REF", "ALT"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert len(parts) > 1 and all(x[:3] == ["##h", "##i", "#POS\tREF\tALT"] for x in parts)
    assert [y for x in parts for y in x[3:]] == [f"{i}\tA\t{'G' if i < 50 else '.'}" for i in range(60)]


def test_clc_and_geneious_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text('Mapping\tReference Position\tType\tReference\tAllele\tCount\tCoverage\tFrequency\tOverlapping annotations\nm\t7\tSNV\tA\tG\t30\t"1,200"\t2.5\t"CDS: O1, CDS: O2"\nm\t8\tMNV\tAA\tGG\t1\t2\t50\t\n')
    r = variants.read_clc(spark, str(tmp_path / "c.txt")).collect()
    assert [(x.site, x["count"], x.coverage, round(x.freq, 4), x.products) for x in r] == [(7, 30, 1200, 0.025, ["O1", "O2"])]
    (tmp_path / "g.csv").write_text("Minimum,Maximum,product,Change,Coverage,Polymorphism Type,Variant Frequency\n4,4,P1,A -> G,100,SNP (transition),2.90%\n4,4,P2,A -> G,100,SNP (transition),2.90%\n")
    r = variants.read_geneious(spark, str(tmp_path / "g.csv")).collect()
    assert [(x.site, x.alt, round(x["count"], 6), x.products) for x in r] == [(4, "G", 2.9, ["P1", "P2"])]


def test_pool_counts_classes_and_warnings(spark):
    v = spark.createDataFrame([("f", 3, "G", "A", 10.0, 100.0), ("f", 3, "G", "C", 5.0, 100.0), ("f", 8, "A", "T", 100.0, 100.0), ("f", 9, "A", "T", 0.0, 0.0)], "file string, site int, ref string, alt string, count double, coverage double")
    v = v.withColumns({"freq": F.lit(0.1), "products": F.lit(None).cast("array<string>")})
    reference = spark.createDataFrame(list(enumerate("GAGAAACCAA", 1)), "site int, ref_nt string")
    cds = gtf.cds_sites(spark.createDataFrame([("P", 1, 6, "+")], "product string, start int, stop int, strand string"))
    sites = pool.pool_sites(v, cds, reference).collect()
    assert len(sites) == 1  # a fixed difference is no polymorphism, nor is a site without reads
    r = sites[0]
    assert (r["A"], r["C"], r["G"], r.maj_nt, r["class"], r.class_vs_ref) == (10, 5, 85, "G", "Ambiguous", "Ambiguous")  # GAG, GAA and GAC
    assert r.pi == pytest.approx((10 * 5 + 10 * 85 + 5 * 85) / (100 * 99 / 2)) and r.gdiv == pytest.approx(1 - 0.01 - 0.0025 - 0.7225)
    assert {(x.site, x.message) for x in pool.warnings(v).collect()} == {(9, "coverage is 0")}


def test_pooled_codon_with_two_variable_sites(spark):
    """AAA with G at a quarter of the first base's reads and at half of the third's: AAA, AAG, GAA and GAG."""
    v = spark.createDataFrame([("f", 1, "A", "G", 25.0, 100.0), ("f", 3, "A", "G", 10.0, 20.0)], "file string, site int, ref string, alt string, count double, coverage double")
    reference = spark.createDataFrame(list(enumerate("AAACCC", 1)), "site int, ref_nt string")
    cds = gtf.cds_sites(spark.createDataFrame([("P", 1, 6, "+")], "product string, start int, stop int, strand string"))
    one, two = pool.pool_codons(v, cds, reference).orderBy("codon_num").collect()
    share = {"AAA": 0.375, "AAG": 0.375, "GAA": 0.125, "GAG": 0.125}
    assert one.N_sites == pytest.approx(sum(p * sum(n for n, _ in site_counts(c)) for c, p in share.items())) and one.S_sites == pytest.approx(sum(p * sum(s for _, s in site_counts(c)) for c, p in share.items()))
    assert (one.N_diffs_vs_ref, one.S_diffs_vs_ref) == (pytest.approx(0.25), pytest.approx(0.5)) and one.variable_sites == 2
    assert (one.N_diffs, one.S_diffs) == (pytest.approx(25 * 75 / (100 * 99 / 2)), pytest.approx(100 / 190))
    assert (two.variable_sites, two.N_diffs, two.N_sites, two.S_sites) == (0, 0, 2, 1)


def test_overlaps_by_sweep(spark, monkeypatch):
    rnd = random.Random(3)
    segments = [(f"P{rnd.randrange(6)}", rnd.choice("+-"), a, a + rnd.randrange(12)) for a in (rnd.randrange(1, 60) for _ in range(30))]
    df = spark.createDataFrame([*segments, ("none", "+", 9, 8)], "product string, strand string, start int, stop int")
    want = {x: len({(p, s) for p, s, a, b in segments if a <= x <= b}) - 1 for x in range(80)}
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(pool, "BLOCK", block)
        found = pool.interval_sites(pool.overlap_intervals(df)).collect()
        assert {r.site: r.overlapping_ORFs for r in found} == {x: n for x, n in want.items() if n >= 0} and len(found) == len({r.site for r in found})
    assert pool.overlap_intervals(df.limit(0)).count() == 0


def test_reference_letters_at_coding_sites_alone(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 7)
    reference = spark.createDataFrame([("c", "ACGTACGTTTNACGTACGTA")], "chrom string, seq string")
    segments = spark.createDataFrame([("P", 6, 8, "+"), ("P", 14, 16, "+"), ("Q", 7, 9, "+"), ("R", 19, 40, "+")], "product string, start int, stop int, strand string")
    for limit in (0, 1 << 20):
        monkeypatch.setattr(pieces, "BROADCAST_BYTES", limit)
        found = pool.reference_at(reference, segments).orderBy("site").collect()
        assert [(r.site, r.ref_nt) for r in found] == [(i, "ACGTACGTTTNACGTACGTA"[i - 1]) for i in (6, 7, 8, 9, 14, 15, 16, 19, 20)]


def test_reference_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pool, "PIECE", 7)
    for seq in ("", "ACGTACG", "ACGTACGTTTNACGT"):
        found = pool.reference_sites(spark.createDataFrame([("c", seq)], "chrom string, seq string")).orderBy("site").collect()
        assert [(r.site, r.ref_nt) for r in found] == list(enumerate(seq, 1))


def test_codon_tables_of_each_kind(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("product\tcodon\tnum_defined_codons_g1\tnum_defined_codons_g2\tN_sites\nP\tcodon_3 \t7\t5\t*\n")
    r = tables.read_codon_results(spark, str(tmp_path / "b.tsv")).first()
    assert (r.codon_num, r.num_defined_seqs, r.N_sites) == (3, 5.0, None)
    framed = spark.createDataFrame([("P", 4, 0.0), ("P", 10, 0.0), ("Q", 4, 0.0), ("Q", 8, 0.0)], "product string, site int, N_diffs_vs_ref double")
    assert {(r.product, r.site): r.codon_num for r in tables.with_codon_numbers(framed).collect()} == {("P", 4): 1, ("P", 10): 3, ("Q", 4): 1, ("Q", 8): 2}
    two = framed.withColumn("file", F.lit("a")).unionByName(framed.withColumns({"site": F.col("site") + 3, "file": F.lit("b")}))
    assert {(r.file, r.product, r.site): r.codon_num for r in tables.with_codon_numbers(two).collect()}["b", "P", 13] == 3  # each file has its own frame
    (tmp_path / "c.csv").write_text("##note\nproduct,codon_num\nP,1\n")
    (tmp_path / "none.txt").write_text("product codon\n")
    assert [tables.detect_delimiter(spark, str(tmp_path / f)) for f in ("b.tsv", "c.csv")] == ["\t", ","]
    with pytest.raises(ValueError):
        tables.detect_delimiter(spark, str(tmp_path / "none.txt"))
    out = str(tmp_path / "out")
    tables.write_tsv(spark.createDataFrame([("a", ["x", "y"], None)], "k string, v array<string>, n double"), out)
    assert {x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()} == {"k\tv\tn", "a\tx,y\tNA"}


def test_stream_of_alignments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.fa").write_text(">a\nATGAAA\n>b\nATGAAG\n")
    products = gtf.coding_products(spark.createDataFrame([("P", 1, 6, "+")], "product string, start int, stop int, strand string"))
    out, keep = str(tmp_path / "out"), str(tmp_path / "check")
    stream_within(stream_fasta(spark, str(tmp_path / "in")), products, out, keep).awaitTermination()
    (tmp_path / "in" / "h.fa").write_text(">a\nATGAAA\n")
    stream_within(stream_fasta(spark, str(tmp_path / "in")), products, out, keep).awaitTermination()
    found = {r.group: r.S_diffs for r in spark.read.parquet(out).collect()}
    assert found == {"g.fa": 1.0, "h.fa": 0.0}
