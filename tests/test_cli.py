"""The command line from files to tables."""

import glob

import pytest

from codonframe import cli

GTF = 'r\tC\tCDS\t1\t12\t.\t+\t0\tgene_id "P";\nr\tC\tCDS\t4\t9\t.\t+\t0\tgene_id "Q";\n'


def rows(folder):
    lines = [x for p in sorted(glob.glob(f"{folder}/part-*")) for x in open(p).read().splitlines()]
    head = lines[0].split("\t")
    return [dict(zip(head, x.split("\t"))) for x in lines if x.split("\t") != head]


def run(*arguments):
    cli.main([str(a) for a in arguments])


def test_alignments(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">1\nATGAAACTGGCA\n>2\nATGAAGCTAGCA\n>3\nATGAAATTAGCG\n>4\nATGNNNCTGG-A\n")
    (tmp_path / "b.fa").write_text(">1\nATGAGACTGGCA\n>2\nATGAAACTGGCC\n>3\nATGTAACTGGCA\n")
    (tmp_path / "x.gtf").write_text(GTF)
    run("within", "--fasta", tmp_path / "a.fa", "--gtf", tmp_path / "x.gtf", "--out", tmp_path / "w", "--num_bootstraps", 20, "--sliding_window_size", 2)
    found = {r["product"]: r for r in rows(tmp_path / "w/within_group_product_results")}
    assert (found["P"]["N_sites"], found["P"]["S_diffs"], set(found)) == ("9.5", "2.5", {"P", "Q"}) and {"dN_minus_dS_P", "dN_over_dS_P"} <= set(found["P"])
    assert len(rows(tmp_path / "w/within_group_codon_results")) == 6 and len(rows(tmp_path / "w/bootstrap_results")) == 40
    run("windows", "--codon_file", tmp_path / "w/within_group_codon_results", "--out", tmp_path / "s", "--sliding_window_size", 2, "--num_bootstraps", 5)
    found = rows(tmp_path / "s/sliding_windows_dNdS_WINDOWS_")
    # Every row of the table with its own columns; windows begin on all but a product's last.
    assert len(found) == 6 and sorted(r["sw_num_replicates"] for r in found) == ["5"] * 4 + ["NA"] * 2 and {"variability", "N_sites", "sw_ASL_dNdS_P"} <= set(found[0])
    found = rows(tmp_path / "w/within_group_sliding_window_results")
    assert len(found) == 4 and {"SE_dN", "Z_value", "ASL_dNdS_P", "dN_gt_total_dS"} <= set(found[0])
    run("between", "--fasta", tmp_path, "--gtf", tmp_path / "x.gtf", "--out", tmp_path / "b", "--num_bootstraps", 5, "--sliding_window_size", 2)
    found = {r["product"]: r for r in rows(tmp_path / "b/between_group_product_results")}
    assert abs(float(found["P"]["dN"]) - 0.0375) < 1e-9 and {"SE_JC_dN", "JC_Z_value", "JC_significance"} <= set(found["P"])
    found = rows(tmp_path / "b/between_group_sliding_window_results")
    assert len(found) == 4 and {"min_num_defined_codons", "JC_dNdS", "SE_dN", "ASL_dNdS_P"} <= set(found[0])
    assert {r["polymorphic"] for r in rows(tmp_path / "b/between_group_polymorphism")} == {"0,1,1,1", "1,1"}
    with pytest.raises(SystemExit):
        run("within", "--fasta", tmp_path / "a.fa", "--gtf", tmp_path / "x.gtf", "--out", tmp_path / "w", "--num_bootstraps", 1)


def test_pool_and_other_strand(spark, tmp_path):
    (tmp_path / "r.fasta").write_text(">ref\nATGAAACTGGCATTT\n")
    (tmp_path / "x.gtf").write_text(GTF)
    (tmp_path / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t6\t.\tA\tG\t.\t.\tDP=100;AF=0.25\nc\t14\t.\tT\tC\t.\t.\tDP=50;AF=0.5\nc\t1\t.\tA\tC\t.\t.\tDP=100;AF=0.001\n")
    run("pool", "--snpreport", tmp_path / "v.vcf", "--fasta", tmp_path / "r.fasta", "--gtf", tmp_path / "x.gtf", "--report", "vcf", "--vcfformat", 2, "--minfreq", 0.01, "--slidingwindow", 2, "--out", tmp_path / "p")
    sites = {(r["product"], r["site"]): r for r in rows(tmp_path / "p/site_results")}
    assert set(sites) == {("P", "6"), ("Q", "6"), ("noncoding", "14")} and sites["P", "6"]["class"] == "Synonymous" and sites["P", "6"]["overlapping_ORFs"] == "1"
    whole = rows(tmp_path / "p/population_summary")[0]
    assert (whole["sites"], whole["sites_coding"], whole["sites_polymorphic"]) == ("15", "12", "2")
    assert {(r["site"], r["message"]) for r in rows(tmp_path / "p/log")} == {("1", "left out by its frequency: C")}
    assert not (tmp_path / "p/minus_strand").exists()
    run("revcom", "--fasta", tmp_path / "r.fasta", "--gtf", tmp_path / "x.gtf", "--vcf", tmp_path / "v.vcf", "--out", tmp_path / "rc")
    lines = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/rc/vcf/part-*"))).splitlines()
    assert lines[0].startswith("#CHROM") and [x.split("\t")[1:5:1] for x in lines[1:]] == [["2", ".", "A", "G"], ["10", ".", "T", "C"], ["15", ".", "T", "G"]]
    text = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/rc/gtf/part-*"))
    assert "\t4\t15\t.\t-\t" in text and "\t7\t12\t.\t-\t" in text


def test_pool_of_both_strands(spark, tmp_path):
    """Products of the other strand are analysed in its coordinates, as a run on the turned files would; overlaps count on both."""
    (tmp_path / "r.fasta").write_text(">ref\nATGAAACTGGCATTT\n")
    (tmp_path / "x.gtf").write_text(GTF + 'r\tC\tCDS\t7\t15\t.\t-\t0\tgene_id "M";\n')
    (tmp_path / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t8\t.\tT\tG\t.\t.\tDP=100;AF=0.25\n")
    common = ("--report", "vcf", "--vcfformat", 2, "--slidingwindow", 2)
    run("pool", "--snpreport", tmp_path / "v.vcf", "--fasta", tmp_path / "r.fasta", "--gtf", tmp_path / "x.gtf", *common, "--out", tmp_path / "p")
    (tmp_path / "rr.fasta").write_text(">ref\nAAATGCCAGTTTCAT\n")
    (tmp_path / "xx.gtf").write_text('r\tC\tCDS\t1\t9\t.\t+\t0\tgene_id "M";\n')
    (tmp_path / "vv.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t8\t.\tA\tC\t.\t.\tDP=100;AF=0.25\n")
    run("pool", "--snpreport", tmp_path / "vv.vcf", "--fasta", tmp_path / "rr.fasta", "--gtf", tmp_path / "xx.gtf", *common, "--out", tmp_path / "q")
    drop = {"file", "strand", "overlapping_ORFs", "num_overlap_ORF_nts"}
    for name in ("site_results", "codon_results", "product_results"):
        one, two = ([{k: v for k, v in r.items() if k not in drop} for r in rows(f) if r["product"] != "noncoding"] for f in (tmp_path / "p/minus_strand" / name, tmp_path / "q" / name))
        key = lambda r: sorted(r.items())
        assert sorted(one, key=key) == sorted(two, key=key) and one
    plus = {r["product"]: r["overlapping_ORFs"] for r in rows(tmp_path / "p/site_results")}
    minus = {r["product"]: (r["strand"], r["overlapping_ORFs"]) for r in rows(tmp_path / "p/minus_strand/site_results")}
    assert plus == {"P": "2", "Q": "2"} and minus == {"M": ("-", "2")}
