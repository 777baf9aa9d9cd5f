"""Named queries over the test tables, one per operator, with oracle SQL.

Each query is one function; measures are rounded, as sums of floating-point
numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonframe.functions import sequence, stats, tajima
from codonframe.genetics.code import codon_dim, codon_pair_dim
from codonframe.operators import alleles, between, bootstrap, codons, pieces, pool, revcom, windows, within
from codonframe.sources import fasta, gtf, tables
from codonframe.sources import variants as reports

from . import oracle as o
from . import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def _off_ties(df: DataFrame) -> DataFrame:
    """Doubles a little larger: products of short fractions often lie halfway between two rounded values."""
    return df.withColumns({c: F.col(c) + 1e-11 for c, t in df.dtypes if t == "double"})


def _counts(spark, d):
    return codons.codon_counts(views.alignment(spark, d))


def _within(spark, d):
    return within.within_codon(_counts(spark, d))


def _between(spark, d):
    return between.between_codon(_counts(spark, d))


W = o.with_(o.TABLES, o.ALIGNMENT, o.WITHIN)
B = o.with_(o.TABLES, o.ALIGNMENT, o.WITHIN, o.BETWEEN)
P = o.with_(o.TABLES, o.POOL)
FOUR = ("N_sites", "S_sites", "N_diffs", "S_diffs")


# --- the codon tables -------------------------------------------------------------------------------------------


_DNA = "dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
_CUT = f"{_DNA}, pieces AS (SELECT doc_id, i, substr(seq, CAST(i * 3 + 1 AS INT), 3) AS codon FROM (SELECT doc_id, seq, unnest(range(length(seq) // 3)) AS i FROM dna))"


def _codons(spark, d):
    return views.dna(spark, d).select("doc_id", F.posexplode(sequence.codons(F.col("seq"))).alias("i", "codon"))


@query(o.with_(o.TABLES, _CUT) + """, t AS (SELECT codon, aa, max(n) FILTER (WHERE p = 1) AS n1, max(s) FILTER (WHERE p = 1) AS s1, max(n) FILTER (WHERE p = 2) AS n2, max(s) FILTER (WHERE p = 2) AS s2,
 max(n) FILTER (WHERE p = 3) AS n3, max(s) FILTER (WHERE p = 3) AS s3, sum(n) AS n_sites, sum(s) AS s_sites FROM place GROUP BY codon, aa), k AS (SELECT codon, count(*) AS times FROM pieces GROUP BY codon)
SELECT codon, aa, times, round(n1, 8) AS n1, round(s1, 8) AS s1, round(n2, 8) AS n2, round(s2, 8) AS s2, round(n3, 8) AS n3, round(s3, 8) AS s3, round(n_sites, 8) AS n_sites, round(s_sites, 8) AS s_sites FROM k JOIN t USING (codon)""")
def codon_dim_sites(spark, d):
    """The sites of each codon that the documents' letters make."""
    return rounded(_codons(spark, d).groupBy("codon").agg(F.count("*").alias("times")).join(codon_dim(spark), "codon"))


@query(o.with_(o.TABLES, _CUT) + """, k AS (SELECT x.codon AS codon_a, y.codon AS codon_b, count(*) AS times FROM pieces x JOIN pieces y ON x.doc_id = y.doc_id AND y.i = x.i + 1 GROUP BY ALL)
SELECT codon_a, codon_b, times, round(coalesce(n_diff, 0.0), 8) AS n_diff, round(coalesce(s_diff, 0.0), 8) AS s_diff FROM k LEFT JOIN pdim ON pdim.a = codon_a AND pdim.b = codon_b""")
def codon_pair_diffs(spark, d):
    """The differences between each two codons that follow each other in a document."""
    all_of = sequence.codons(F.col("seq"))
    pair = F.explode(F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda y, i: F.struct(F.get("c", i).alias("codon_a"), y.alias("codon_b")))).alias("p")
    pairs = views.dna(spark, d).select(all_of.alias("c")).select(pair).groupBy("p.codon_a", "p.codon_b").agg(F.count("*").alias("times"))
    return rounded(pairs.join(codon_pair_dim(spark), ["codon_a", "codon_b"]))


# --- sequences --------------------------------------------------------------------------------------------------

@query(o.with_(o.TABLES, o.ALIGNMENT) + """
SELECT product, coalesce(aa, '?') AS amino_acid, count(*) AS n FROM align LEFT JOIN code USING (codon) GROUP BY ALL""")
def translate_codon(spark, d):
    return views.alignment(spark, d).groupBy("product", sequence.translated(F.col("codon")).alias("amino_acid")).agg(F.count("*").alias("n"))


@query(f"WITH {_DNA}, cut AS (SELECT seq, unnest(range(length(seq) // 3)) AS i FROM dna) SELECT substr(seq, CAST(i * 3 + 1 AS INT), 3) AS codon, count(*) AS n FROM cut GROUP BY ALL")
def tokenise_codons(spark, d):
    return views.dna(spark, d).select(F.explode(sequence.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))


@query(f"WITH {_DNA} SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS revcomp FROM dna")
def revcomp(spark, d):
    return views.dna(spark, d).select("doc_id", sequence.reverse_complement(F.col("seq")).alias("revcomp"))


@query(f"WITH {_DNA} SELECT doc_id, trim(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)) AS wrapped FROM dna")
def fasta_wrap(spark, d):
    return views.dna(spark, d).select("doc_id", sequence.wrapped(F.col("seq")).alias("wrapped"))


@query(f"WITH {_DNA} SELECT doc_id, substr(seq, 1, length(seq) // 3) || substr(seq, length(seq) - length(seq) // 3 + 1, length(seq) // 3) AS cds FROM dna")
def splice_segments(spark, d):
    """The first and the last third of each sequence."""
    size = F.length("seq")
    third = F.floor(size / 3).cast("int")
    parts = F.array(F.struct(F.lit(1).alias("start"), third.alias("stop")), F.struct((size - third + 1).alias("start"), size.alias("stop")))
    return views.dna(spark, d).select("doc_id", sequence.spliced(F.col("seq"), parts).alias("cds"))


_FEATURES = "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS start, l_partkey + l_suppkey * 3 - 1 AS stop, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem"


@query(f"SELECT id, 1000000 - stop + 1 AS start, 1000000 - start + 1 AS stop, CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand FROM ({_FEATURES})")
def revcom_gtf_coords(spark, d):
    rows = views.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey") * 3 - 1).alias("stop"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    return revcom.revcom_segments(rows, 1_000_000)


@query("""
WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS pos, substr('ACGTac', CAST(l_suppkey % 6 + 1 AS INT), 1) || CASE WHEN l_linenumber % 3 = 0 THEN 'GT' ELSE '' END AS ref,
                  substr('TGCAtg', CAST(l_suppkey % 6 + 1 AS INT), 1) AS a1, CASE WHEN l_linenumber % 2 = 0 THEN substr('CATGca', CAST(l_suppkey % 6 + 1 AS INT), 1) || 'A' END AS a2 FROM lineitem)
SELECT id, 1000000 - pos + 1 - (length(ref) - 1) AS POS, translate(reverse(ref), 'acgtuACGTU', 'tgcaaTGCAA') AS REF,
       translate(a1, 'acgtuACGTU', 'tgcaaTGCAA') || coalesce(',' || translate(reverse(a2), 'acgtuACGTU', 'tgcaaTGCAA'), '') AS ALT,
       'DP=9;AA=' || translate(reverse(ref), 'acgtuACGTU', 'tgcaaTGCAA') || ';AF=0.5' AS INFO FROM v""")
def revcom_vcf(spark, d):
    pick = lambda letters: F.substring(F.lit(letters), (F.col("l_suppkey") % 6 + 1).cast("int"), F.lit(1))
    ref = F.concat(pick("ACGTac"), F.when(F.col("l_linenumber") % 3 == 0, "GT").otherwise(""))
    two = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(","), pick("CATGca"), F.lit("A"))).otherwise("")
    rows = views.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("POS"), ref.alias("REF"), F.concat(pick("TGCAtg"), two).alias("ALT"))
    return revcom.revcom_vcf(rows.withColumn("INFO", F.concat(F.lit("DP=9;AA="), "REF", F.lit(";AF=0.5"))), 1_000_000)


# --- counts, within and between groups --------------------------------------------------------------------------


def _from_fasta(spark, d):
    seqs = codons.validated(fasta.parse_fasta(views.fasta_records(spark, d)))
    return codons.codon_counts(codons.codon_columns(seqs, views.fasta_products(spark)))


@query(o.with_(o.TABLES, o.FASTA) + ' SELECT grp AS "group", product, codon_num, codon, cnt FROM cc')
def fasta_codons(spark, d):
    """From FASTA records and annotated products to codon counts."""
    return _from_fasta(spark, d)


@query(o.with_(o.TABLES, o.FASTA, o.WITHIN) + f' SELECT grp AS "group", product, {o.FOUR}, {o.RATES} FROM wp')
def fasta_within(spark, d):
    return rounded(within.product_results(within.within_codon(_from_fasta(spark, d))))


@query(o.with_(o.TABLES, o.FASTA, o.WITHIN, o.BETWEEN) + f" SELECT product, group_1, group_2, {o.FOUR}, {o.RATES} FROM bp")
def fasta_between(spark, d):
    return rounded(between.between_product(between.between_codon(_from_fasta(spark, d))))


@query(o.with_(o.FASTA) + """ SELECT grp AS "group", CAST(i AS INT) AS site, count(*) FILTER (WHERE nt = 'A') AS "A", count(*) FILTER (WHERE nt = 'C') AS "C", count(*) FILTER (WHERE nt = 'G') AS "G", count(*) FILTER (WHERE nt = 'T') AS "T" FROM fb GROUP BY grp, i""")
def fasta_sites(spark, d):
    return alleles.site_counts(codons.validated(fasta.parse_fasta(views.fasta_records(spark, d))))


# All documents as one sequence, base by base; two products, the second of three segments, and their bases in order.
_LONG = f"""WITH {_DNA}, d AS (SELECT seq, coalesce(sum(length(seq)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dna),
b AS (SELECT CAST(before + i AS BIGINT) AS site, nt FROM (SELECT before, unnest(string_split(seq, '')) AS nt, generate_subscripts(string_split(seq, ''), 1) AS i FROM d WHERE length(seq) > 0)),
l AS (SELECT CAST(sum(length(seq)) AS BIGINT) AS l FROM dna),
p AS (SELECT 'P1' AS product, 1 AS a, 3 * (l // 6) AS z FROM l UNION ALL SELECT 'P2', 2, 1 + l // 5 FROM l UNION ALL SELECT 'P2', l // 2, l // 2 + l // 5 FROM l UNION ALL SELECT 'P2', l // 2 + l // 5 + 5, l // 2 + 2 * (l // 5) + 6 FROM l),
c AS (SELECT product, nt, row_number() OVER (PARTITION BY product ORDER BY site) - 1 AS q FROM b JOIN p ON site BETWEEN a AND z),
k AS (SELECT product, q // 3 + 1 AS codon_num, string_agg(nt, '' ORDER BY q) AS codon FROM c GROUP BY ALL)"""


def _kept(spark, df):
    path = views.scratch(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _long(spark, d):
    """Pieces of one sequence that all documents make, and its products. Texts are read once: their letters and the pieces are kept as tables, as both are read several times."""
    dna = _kept(spark, views.dna(spark, d))
    lines = dna.select(F.lit("all").alias("group"), F.floor(F.col("doc_id") / 100).alias("part"), F.col("doc_id").alias("line"), F.col("seq").alias("value"))
    # Before the first document.
    head = dna.agg(F.min("doc_id").alias("least")).select(F.lit("all").alias("group"), F.floor(F.col("least") / 100).alias("part"), (F.col("least") - 1).alias("line"), F.lit(">all").alias("value"))
    n = F.lit(dna.agg(F.sum(F.length("seq"))).first()[0]).cast("long")
    fifth, half = F.floor(n / 5), F.floor(n / 2)
    parts = [("P1", F.lit(1), 3 * F.floor(n / 6)), ("P2", F.lit(2), 1 + fifth), ("P2", half, half + fifth), ("P2", half + fifth + 5, half + 2 * fifth + 6)]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("product"), a.cast("long").alias("start"), z.cast("long").alias("stop"), F.lit("+").alias("strand")) for p, a, z in parts])).alias("_s")
    segments = spark.range(1).select(each).select("_s.*")
    return _kept(spark, pieces.pieces_of_lines(lines.unionByName(head))), gtf.coding_products(segments)


@query(_LONG + " SELECT product, codon, count(*) AS n, CAST(sum(codon_num) AS BIGINT) AS numbers FROM k GROUP BY ALL")
def fasta_long(spark, d):
    """Codons of products as long as a chromosome: no row holds the sequence."""
    return pieces.codon_rows(*_long(spark, d)).groupBy("product", "codon").agg(F.count("*").alias("n"), F.sum("codon_num").alias("numbers"))


@query(_LONG + " SELECT nt, count(*) AS n, CAST(sum(site) AS BIGINT) AS sites FROM b GROUP BY nt")
def fasta_long_sites(spark, d):
    return pieces.site_rows(_long(spark, d)[0]).groupBy("nt").agg(F.count("*").alias("n"), F.sum("site").alias("sites"))


@query(o.with_(o.TABLES, o.ALIGNMENT) + ' SELECT grp AS "group", product, codon_num, codon, cnt FROM cc')
def codon_counts(spark, d):
    return _counts(spark, d)


@query(W + ' SELECT grp AS "group", product, codon_num, n AS num_defined, alleles AS num_alleles FROM ws')
def defined_counts(spark, d):
    return codons.defined_counts(_counts(spark, d))


@query(W + f' SELECT grp AS "group", product, codon_num, variability, n AS num_defined_seqs, {o.FOUR} FROM wc')
def within_codon(spark, d):
    return rounded(_within(spark, d).drop("comparisons"))


@query(W + """ SELECT x.grp AS "group", x.product, x.codon_num, string_agg(x.codon || '-' || y.codon, ',' ORDER BY x.codon || '-' || y.codon) AS comparisons
FROM cc x JOIN cc y ON x.grp = y.grp AND x.product = y.product AND x.codon_num = y.codon_num AND x.codon < y.codon GROUP BY ALL""")
def within_comparisons(spark, d):
    return _within(spark, d).where(F.size("comparisons") > 0).select("group", "product", "codon_num", F.array_join("comparisons", ",").alias("comparisons"))


@query(W + f' SELECT grp AS "group", product, {o.FOUR}, {o.RATES} FROM wp')
def within_product(spark, d):
    return rounded(within.product_results(_within(spark, d)))


@query(W + " SELECT " + ", ".join(f"round(sum({m}), 6) AS {m}" for m in FOUR) + " FROM wc")
def within_totals(spark, d):
    return rounded(within.totals(_within(spark, d)), 6)


@query(B + f" SELECT product, group_1, group_2, codon_num, variability, d1 AS num_defined_codons_g1, d2 AS num_defined_codons_g2, {o.FOUR} FROM bc")
def between_codon(spark, d):
    return rounded(_between(spark, d))


@query(B + f" SELECT product, group_1, group_2, {o.FOUR}, {o.RATES} FROM bp")
def between_product(spark, d):
    return rounded(between.between_product(_between(spark, d)))


@query(B + " SELECT product, group_1, group_2, " + ", ".join(f"round(sum({m}), 8) AS {m}" for m in FOUR) + " FROM bc WHERE d1 + d2 >= 120 AND least(d1, d2) >= 45 GROUP BY ALL")
def between_min_taxa(spark, d):
    return rounded(between.between_product(_between(spark, d), 120, 45).select("product", "group_1", "group_2", *FOUR))


@query(B + " SELECT product, group_1, group_2, string_agg(CASE variability WHEN 'polymorphic' THEN '1' ELSE '0' END, '' ORDER BY codon_num) AS polymorphic FROM bc GROUP BY ALL")
def between_polymorphism(spark, d):
    return between.polymorphism_vectors(_between(spark, d)).withColumn("polymorphic", F.array_join(F.transform("polymorphic", lambda x: x.cast("string")), ""))


@query(o.with_(o.TABLES, o.ALIGNMENT) + " SELECT DISTINCT x.grp AS group_1, y.grp AS group_2 FROM cc x JOIN cc y ON x.grp < y.grp")
def group_pairs(spark, d):
    return between.group_pairs(_counts(spark, d))


_JC = "CASE WHEN {0} < 0.75 THEN -0.75 * ln(1 - {0} * 4 / 3) END"


@query(B + f""", r AS (SELECT product, group_1, group_2, {_JC.format(o.DN)} AS jn, {_JC.format(o.DS)} AS js FROM bp)
SELECT product, group_1, group_2, round(jn, 8) AS JC_dN, round(js, 8) AS JC_dS, round(jn - js, 8) AS JC_dN_minus_dS, round(jn / nullif(js, 0), 8) AS JC_dNdS FROM r""")
def jc_correction(spark, d):
    found = between.with_jukes_cantor(between.between_product(_between(spark, d)))
    return rounded(found.select("product", "group_1", "group_2", "JC_dN", "JC_dS", "JC_dN_minus_dS", "JC_dNdS"))


# --- alleles and sites ------------------------------------------------------------------------------------------

_VAR = """, va AS (
  SELECT grp AS "group", product, codon_num, list(codon ORDER BY codon) AS codons, list(aa ORDER BY codon) AS amino_acids, list(cnt ORDER BY codon) AS codon_counts, CAST(sum(cnt) AS BIGINT) AS count_total,
         max(cnt) AS max_codon_count, count(*) AS num_alleles, count(DISTINCT aa) AS kinds, (list(codon ORDER BY cnt DESC, codon))[1] AS consensus_codon
  FROM cc JOIN code USING (codon) GROUP BY ALL HAVING count(*) > 1)"""


def _variants(spark, d):
    return alleles.variant_results(_counts(spark, d))


@query(W + _VAR + """ SELECT "group", product, codon_num, array_to_string(codons, ',') AS codons, array_to_string(amino_acids, ',') AS amino_acids, array_to_string(codon_counts, ',') AS codon_counts,
 array_to_string(list_transform(codon_counts, lambda x: CAST(round(x / count_total, 3) AS VARCHAR)), ',') AS codon_freqs, count_total, max_codon_count, count_total - max_codon_count AS min_codon_count, num_alleles FROM va""")
def variant_alleles(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _variants(spark, d).select("group", "product", "codon_num", text("codons"), text("amino_acids"), text("codon_counts"), text("codon_freqs"), "count_total", "max_codon_count", "min_codon_count", "num_alleles")


@query(W + _VAR + """ SELECT "group", product, codon_num, CASE WHEN kinds = 1 THEN 'Synonymous' WHEN kinds = num_alleles THEN 'Nonsynonymous' ELSE 'Ambiguous' END AS variant_type FROM va""")
def variant_type(spark, d):
    return _variants(spark, d).select("group", "product", "codon_num", "variant_type")


@query(W + _VAR + ' SELECT "group", product, codon_num, consensus_codon FROM va')
def consensus_codon(spark, d):
    return _variants(spark, d).select("group", "product", "codon_num", "consensus_codon")


@query(W + _VAR + " SELECT count_total - max_codon_count AS min_codon_count, num_alleles, count(*) AS places FROM va GROUP BY ALL")
def minor_count_histogram(spark, d):
    return alleles.minor_count_histogram(_variants(spark, d))


def _sites(spark, d):
    return alleles.site_diversity(alleles.base_counts(views.reads(spark, d), "site"))


@query(o.with_(o.READS) + """ SELECT site, a AS "A", c AS "C", g AS "G", t AS "T", a + c + g + t AS coverage,
 round((a * c + a * g + a * t + c * g + c * t + g * t) / nullif((a + c + g + t) * (a + c + g + t - 1) / 2.0, 0), 8) AS pi FROM sc""")
def site_pi(spark, d):
    return rounded(_sites(spark, d).select("site", "A", "C", "G", "T", "coverage", "pi"))


@query(o.with_(o.READS) + """ SELECT site, CASE WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END AS maj_nt,
 greatest(a, c, g, t) AS maj_nt_count FROM sc""")
def site_majority_nt(spark, d):
    return _sites(spark, d).select("site", "maj_nt", "maj_nt_count")


# --- windows ----------------------------------------------------------------------------------------------------

_RANGE = """, span AS (SELECT grp, product, min(codon_num) AS lo, max(codon_num) AS hi, count(*) AS n FROM wc GROUP BY ALL),
starts AS (SELECT grp, product, CAST(unnest(range(lo, lo + n - 9 + 1, 3)) AS INT) AS f FROM span WHERE n >= 9),
win AS (SELECT s.grp, s.product, s.f, {sums} FROM starts s LEFT JOIN wc ON wc.grp = s.grp AND wc.product = s.product AND wc.codon_num BETWEEN f AND f + 8 GROUP BY ALL)""".format(sums=", ".join(f"coalesce(sum({m}), 0) AS {m}" for m in FOUR))


def _windows(spark, d):
    return windows.sliding_windows(_within(spark, d), 9, 3, ("group", "product"))


@query(W + _RANGE + f' SELECT grp AS "group", product, CAST(row_number() OVER (PARTITION BY grp, product ORDER BY f) AS INT) AS "window", f AS first_codon, f + 8 AS last_codon, {o.FOUR}, {o.RATES} FROM win')
def window_range(spark, d):
    return rounded(_windows(spark, d))


@query(W + """, ok AS (SELECT *, row_number() OVER (PARTITION BY grp, product ORDER BY codon_num) AS r, count(*) OVER (PARTITION BY grp, product) AS n FROM wc WHERE n >= 50),
rw AS (SELECT s.grp, s.product, s.codon_num, min(e.codon_num) AS sw_start, avg(e.codon_num) AS sw_center, max(e.codon_num) AS sw_end, sum(e.N_diffs) AS nd, sum(e.S_diffs) AS sd, sum(e.N_sites) AS ns, sum(e.S_sites) AS ss
 FROM ok s JOIN ok e ON e.grp = s.grp AND e.product = s.product AND e.r BETWEEN s.r AND s.r + 9 WHERE (s.r - 1) % 2 = 0 GROUP BY s.grp, s.product, s.codon_num HAVING count(*) = 10)
SELECT grp AS "group", product, codon_num, 'dNdS' AS sw_ratio, sw_start, round(sw_center, 8) AS sw_center, sw_end, round(nd, 8) AS "sw_N_diffs", round(sd, 8) AS "sw_S_diffs", round(ns, 8) AS "sw_N_sites", round(ss, 8) AS "sw_S_sites",
 round(nd / nullif(ns, 0), 8) AS "sw_dN", round(sd / nullif(ss, 0), 8) AS "sw_dS", round((nd / nullif(ns, 0)) / nullif(sd / nullif(ss, 0), 0), 8) AS "sw_dNdS", round(nd / nullif(ns, 0) - sd / nullif(ss, 0), 8) AS "sw_dN_m_dS" FROM rw""")
def window_rows(spark, d):
    return rounded(windows.row_windows(_within(spark, d), 10, 2, 50, by=("group", "product")))


@query(B + """, keep AS (SELECT * FROM bc WHERE least(d1, d2) >= 40),
bspan AS (SELECT product, group_1, group_2, min(codon_num) AS lo, count(*) AS n FROM bc GROUP BY ALL),
bst AS (SELECT product, group_1, group_2, CAST(unnest(range(lo, lo + n - 9 + 1, 1)) AS INT) AS f FROM bspan WHERE n >= 9)
SELECT s.product, s.group_1, s.group_2, f AS first_codon, CAST(coalesce(sum(d1), 0) AS BIGINT) AS num_defined_codons_g1, CAST(coalesce(sum(d2), 0) AS BIGINT) AS num_defined_codons_g2,
 coalesce(sum(d1) + sum(d2), 0) / 2.0 AS mean_num_defined_codons, CAST(min(least(d1, d2)) AS BIGINT) AS min_num_defined_codons, round(coalesce(sum(N_diffs), 0), 8) AS N_diffs, round(coalesce(sum(S_sites), 0), 8) AS S_sites
FROM bst s LEFT JOIN keep k ON k.product = s.product AND k.group_1 = s.group_1 AND k.group_2 = s.group_2 AND k.codon_num BETWEEN f AND f + 8 GROUP BY s.product, s.group_1, s.group_2, f""")
def window_taxa_stats(spark, d):
    found = windows.between_windows(_between(spark, d), 9, 1, 0, 40)
    return rounded(found.select("product", "group_1", "group_2", "first_codon", "num_defined_codons_g1", "num_defined_codons_g2", "mean_num_defined_codons", F.col("min_num_defined_codons").cast("long").alias("min_num_defined_codons"), "N_diffs", "S_sites"))


@query(W + _RANGE + f""", tot AS (SELECT grp, product, S_diffs / nullif(S_sites, 0) AS ds FROM wp)
SELECT win.grp AS "group", win.product, f AS first_codon, CASE WHEN {o.DN} > ds THEN '*' ELSE '' END AS "dN_gt_total_dS" FROM win JOIN tot USING (grp, product)""")
def window_dn_gt_total_ds(spark, d):
    products = within.product_results(_within(spark, d))
    return windows.with_excess_flag(_windows(spark, d), products, ("group", "product")).select("group", "product", "first_codon", "dN_gt_total_dS")


@query(W + """, ok AS (SELECT *, row_number() OVER (PARTITION BY grp, product ORDER BY codon_num) AS r FROM wc WHERE n >= 50),
rw AS (SELECT s.grp, s.product, s.codon_num, max(e.codon_num) AS sw_end, sum(e.N_diffs + e.S_diffs) AS d FROM ok s JOIN ok e ON e.grp = s.grp AND e.product = s.product AND e.r BETWEEN s.r AND s.r + 9
 WHERE (s.r - 1) % 2 = 0 GROUP BY s.grp, s.product, s.codon_num HAVING count(*) = 10)
SELECT wc.grp AS "group", wc.product, wc.codon_num, wc.variability, wc.n AS num_defined_seqs, round(wc.N_sites, 8) AS N_sites, sw_end, round(d, 8) AS sw_diffs FROM wc LEFT JOIN rw ON rw.grp = wc.grp AND rw.product = wc.product AND rw.codon_num = wc.codon_num""")
def window_rows_on_table(spark, d):
    """Every row of the codon table with its columns, and the windows that begin there."""
    found = windows.row_windows(_within(spark, d), 10, 2, 50, by=("group", "product"), keep_columns=True)
    return rounded(found.select("group", "product", "codon_num", "variability", "num_defined_seqs", "N_sites", "sw_end", (F.col("sw_N_diffs") + F.col("sw_S_diffs")).alias("sw_diffs")))


_LINES = "SELECT 'O' || CAST(l_orderkey % 9973 AS VARCHAR) AS product, CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_linenumber + l_partkey % 3 END AS codon_num, l_quantity AS n FROM lineitem"


def _codon_lines(spark, d):
    """Codon tables of many small products, with repeated and missing numbers."""
    number = F.when(F.col("l_suppkey") % 41 == 0, None).otherwise(F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int")
    return views.table(spark, d, "lineitem").select(F.concat(F.lit("O"), (F.col("l_orderkey") % 9973).cast("string")).alias("product"), number.alias("codon_num"), F.col("l_quantity").cast("double").alias("num_defined_seqs"))


@query(f"""WITH t AS ({_LINES}) SELECT product, CASE WHEN codon_num IS NULL THEN 'no number' ELSE 'repeated' END AS guard, CAST(codon_num AS INT) AS codon_num, count(*) AS rows FROM t GROUP BY product, codon_num HAVING codon_num IS NULL OR count(*) > 1""")
def codon_table_guards(spark, d):
    """What a codon table holds twice, or without a number."""
    return windows.table_guards(_codon_lines(spark, d))


@query(f"""WITH t AS ({_LINES}), c AS (SELECT product, count(codon_num) FILTER (WHERE n >= 10) AS codons FROM t GROUP BY product)
SELECT product, codons, 'no window of 4 codons: it has ' || CAST(codons AS VARCHAR) AS message FROM c WHERE codons < 4""")
def window_log(spark, d):
    """Products that have no window, as they have fewer codons than one."""
    return windows.window_log(_codon_lines(spark, d), 4, min_defined=10)


# --- bootstrap --------------------------------------------------------------------------------------------------

REPS = 50
_BOOT = f""", cod AS (SELECT *, row_number() OVER (PARTITION BY grp, product ORDER BY codon_num) AS i FROM wc),
drawn AS (SELECT grp, product, n, r, ((r * 7919 + dr * 104729 + 3 * 31) % 1000003) % n + 1 AS i FROM (SELECT grp, product, count(*) FROM wc GROUP BY ALL) p(grp, product, n), range(1, {REPS + 1}) t(r), range(1, 61) u(dr) WHERE dr <= n),
boot AS (SELECT drawn.grp, drawn.product, CAST(r AS INT) AS rep, {", ".join(f"sum({m}) AS {m}" for m in FOUR)} FROM drawn JOIN cod ON cod.grp = drawn.grp AND cod.product = drawn.product AND cod.i = drawn.i GROUP BY ALL)"""


def _boot(spark, d):
    return bootstrap.replicates(_within(spark, d), REPS, 3, ("group", "product"), arithmetic=True)


@query(W + _BOOT + f' SELECT grp AS "group", product, rep, {o.FOUR} FROM boot')
def boot_product(spark, d):
    return rounded(_boot(spark, d))


@query(W + _RANGE + f""", wcod AS (SELECT s.grp, s.product, s.f, codon_num - f + 1 AS i, N_sites, S_sites, N_diffs, S_diffs FROM starts s JOIN wc ON wc.grp = s.grp AND wc.product = s.product AND codon_num BETWEEN f AND f + 8),
wdr AS (SELECT s.grp, s.product, s.f, r, ((r * 7919 + dr * 104729 + 3 * 31) % 1000003) % 9 + 1 AS i FROM starts s, range(1, 21) t(r), range(1, 10) u(dr))
SELECT wdr.grp AS "group", wdr.product, CAST((wdr.f - 1) // 3 + 1 AS INT) AS "window", CAST(r AS INT) AS rep, {", ".join(f"round(coalesce(sum({m}), 0), 8) AS {m}" for m in FOUR)}
FROM wdr LEFT JOIN wcod ON wcod.grp = wdr.grp AND wcod.product = wdr.product AND wcod.f = wdr.f AND wcod.i = wdr.i GROUP BY ALL""")
def boot_window(spark, d):
    codons_ = _within(spark, d)
    inside = bootstrap.window_codons(codons_, _windows(spark, d), ("group", "product"))
    return rounded(bootstrap.replicates(inside, 20, 3, ("group", "product", "window"), arithmetic=True))


_STARS = "CASE WHEN abs(z) > 2.81 THEN '***' WHEN abs(z) > 1.96 THEN '**' WHEN abs(z) > 1.64 THEN '*' WHEN z IS NOT NULL THEN '' ELSE 'NA' END"


@query(W + _BOOT + f""", se AS (SELECT grp, product, stddev_samp({o.DN}) AS sn, stddev_samp({o.DS}) AS ss, stddev_samp({o.DN} - {o.DS}) AS sd FROM boot GROUP BY ALL),
zz AS (SELECT wp.grp, wp.product, sn, ss, sd, CASE WHEN sd > 0 THEN ({o.DN} - {o.DS}) / sd END AS z FROM wp JOIN se USING (grp, product))
SELECT grp AS "group", product, round(sn, 8) AS "SE_dN", round(ss, 8) AS "SE_dS", round(sd, 8) AS "SE_dN_minus_dS", round(z, 6) AS "Z_value", {_STARS} AS significance FROM zz""")
def boot_se_z_stars(spark, d):
    codons_ = _within(spark, d)
    by = ("group", "product")
    errors = bootstrap.standard_errors(_boot(spark, d), by)
    found = bootstrap.with_z_test(within.product_results(codons_), errors, by).withColumn("Z_value", F.round("Z_value", 6) + F.lit(0.0))
    return rounded(found.select("group", "product", "SE_dN", "SE_dS", "SE_dN_minus_dS", "Z_value", "significance"))


@query(W + _BOOT + f""", df AS (SELECT grp, product, {o.DN} - {o.DS} AS x FROM boot),
ct AS (SELECT grp, product, count(*) FILTER (WHERE x > 0) AS gt, count(*) FILTER (WHERE x = 0) AS eq, count(*) FILTER (WHERE x < 0) AS lt FROM df GROUP BY ALL)
SELECT grp AS "group", product, gt AS "dN_gt_dS_count", eq AS "dN_eq_dS_count", lt AS "dN_lt_dS_count", round(lt / nullif(gt + eq + lt, 0), 8) AS "ASL_dN_gt_dS_P", round(gt / nullif(gt + eq + lt, 0), 8) AS "ASL_dN_lt_dS_P",
 round(CASE WHEN gt + eq + lt = 0 THEN 1.0 WHEN least(gt, lt) = 0 THEN 1.0 / {REPS} ELSE 2.0 * least(gt, lt) / (gt + eq + lt) END, 8) AS "ASL_dNdS_P" FROM ct""")
def boot_asl(spark, d):
    return rounded(bootstrap.achieved_significance(_boot(spark, d), ("group", "product")))


_ROWS = """, ok AS (SELECT *, row_number() OVER (PARTITION BY grp, product ORDER BY codon_num) AS r FROM wc WHERE n >= 50),
top AS (SELECT grp, product, max(r) AS m FROM ok GROUP BY ALL),
st AS (SELECT ok.grp, ok.product, ok.r, ok.codon_num AS sw_start FROM ok JOIN top USING (grp, product) WHERE (r - 1) % 2 = 0 AND r + 9 <= m),
rd AS (SELECT st.*, rep, ((rep * 7919 + dr * 104729 + 3 * 31) % 1000003) % 10 AS i FROM st, range(1, 21) t(rep), range(1, 11) u(dr)),
rb AS (SELECT rd.grp, rd.product, sw_start, rep, sum(N_sites) AS N_sites, sum(S_sites) AS S_sites, sum(N_diffs) AS N_diffs, sum(S_diffs) AS S_diffs FROM rd JOIN ok ON ok.grp = rd.grp AND ok.product = rd.product AND ok.r = rd.r + rd.i GROUP BY ALL)"""


@query(W + _ROWS + f""" SELECT grp AS "group", product, sw_start, count(*) AS sw_num_replicates, round(stddev_samp({o.DN}), 8) AS "sw_boot_dN_SE", round(stddev_samp({o.DN} - {o.DS}), 8) AS "sw_boot_dN_m_dS_SE",
 count(*) FILTER (WHERE {o.DN} - {o.DS} > 0) AS "sw_boot_dN_gt_dS_count", count(*) FILTER (WHERE {o.DN} - {o.DS} < 0) AS "sw_boot_dN_lt_dS_count",
 round(CASE WHEN least(count(*) FILTER (WHERE {o.DN} - {o.DS} > 0), count(*) FILTER (WHERE {o.DN} - {o.DS} < 0)) = 0 THEN 1.0 / count(*)
  ELSE 2.0 * least(count(*) FILTER (WHERE {o.DN} - {o.DS} > 0), count(*) FILTER (WHERE {o.DN} - {o.DS} < 0)) / count({o.DN} - {o.DS}) END, 8) AS "sw_ASL_dNdS_P" FROM rb GROUP BY ALL""")
def boot_row_windows(spark, d):
    found = bootstrap.row_window_tests(_within(spark, d), 10, 20, 3, 2, 50, by=("group", "product"), arithmetic=True)
    return rounded(found.select("group", "product", "sw_start", "sw_num_replicates", "sw_boot_dN_SE", "sw_boot_dN_m_dS_SE", "sw_boot_dN_gt_dS_count", "sw_boot_dN_lt_dS_count", "sw_ASL_dNdS_P"))


_WBOOT = """, {p}sums AS (SELECT {k}, f, rep, {sums} FROM {p}draw GROUP BY ALL),
{p}se AS (SELECT {k}, f, stddev_samp({dn}) AS sn, stddev_samp({dn} - {ds}) AS sd, count(*) FILTER (WHERE {dn} - {ds} > 0) AS gt, count(*) FILTER (WHERE {dn} - {ds} = 0) AS eq, count(*) FILTER (WHERE {dn} - {ds} < 0) AS lt FROM {p}sums GROUP BY ALL),
{p}z AS (SELECT {p}se.*, N_diffs, {dn} - {ds} AS x, CASE WHEN sd > 0 THEN ({dn} - {ds}) / sd END AS z FROM {p}se JOIN {p}win USING ({k}, f))
SELECT {names}, CAST(f AS INT) AS first_codon, round(N_diffs, 8) AS N_diffs, round(sn, 8) AS "SE_dN", round(sd, 8) AS "SE_dN_minus_dS", round(z, 6) AS "Z_value", {stars} AS significance, gt AS "dN_gt_dS_count", lt AS "dN_lt_dS_count",
 round(CASE WHEN gt + eq + lt = 0 THEN 1.0 WHEN least(gt, lt) = 0 THEN 1.0 / 20 ELSE 2.0 * least(gt, lt) / (gt + eq + lt) END, 8) AS "ASL_dNdS_P" FROM {p}z"""
_WTESTS = ("first_codon", "N_diffs", "SE_dN", "SE_dN_minus_dS", "Z_value", "significance", "dN_gt_dS_count", "dN_lt_dS_count", "ASL_dNdS_P")


def _window_tests(sql, p, k, names):
    sums = ", ".join(f"sum({m}) AS {m}" for m in FOUR)
    return sql + _WBOOT.format(p=p, k=k, names=names, dn=o.DN, ds=o.DS, sums=sums, stars=_STARS)


def _tested(df, *by):
    return rounded(df.withColumn("Z_value", F.round("Z_value", 6) + F.lit(0.0)).select(*by, *_WTESTS))


_ZERO = ", ".join(f"coalesce({m}, 0) AS {m}" for m in FOUR)


@query(_window_tests(W + _RANGE + f""", xwin AS (SELECT * FROM win),
xdraw AS (SELECT s.grp, s.product, s.f, rep, {_ZERO} FROM starts s CROSS JOIN range(1, 21) t(rep) CROSS JOIN range(1, 10) u(dr)
 LEFT JOIN wc ON wc.grp = s.grp AND wc.product = s.product AND wc.codon_num = s.f + ((rep * 7919 + dr * 104729 + 3 * 31) % 1000003) % 9)""", "x", "grp, product", 'grp AS "group", product'))
def window_boot_within(spark, d):
    by = ("group", "product")
    return _tested(bootstrap.window_tests(_within(spark, d), _windows(spark, d), 20, 3, by, arithmetic=True), *by)


@query(_window_tests(B + f""", keep AS (SELECT * FROM bc WHERE least(d1, d2) >= 40),
bspan AS (SELECT product, group_1, group_2, min(codon_num) AS lo, count(*) AS n FROM bc GROUP BY ALL),
bst AS (SELECT product, group_1, group_2, CAST(unnest(range(lo, lo + n - 9 + 1, 3)) AS INT) AS f FROM bspan WHERE n >= 9),
ywin AS (SELECT s.product, s.group_1, s.group_2, f, {", ".join(f"coalesce(sum({m}), 0) AS {m}" for m in FOUR)} FROM bst s LEFT JOIN keep k ON k.product = s.product AND k.group_1 = s.group_1 AND k.group_2 = s.group_2 AND k.codon_num BETWEEN f AND f + 8 GROUP BY ALL),
ydraw AS (SELECT s.product, s.group_1, s.group_2, s.f, rep, {_ZERO} FROM bst s CROSS JOIN range(1, 21) t(rep) CROSS JOIN range(1, 10) u(dr)
 LEFT JOIN keep k ON k.product = s.product AND k.group_1 = s.group_1 AND k.group_2 = s.group_2 AND k.codon_num = s.f + ((rep * 7919 + dr * 104729 + 3 * 31) % 1000003) % 9)""", "y", "product, group_1, group_2", "product, group_1, group_2"))
def window_boot_between(spark, d):
    """Windows between groups with their bootstrap; codons with too few taxa are drawn and add nothing."""
    codons_, by = _between(spark, d), ("product", "group_1", "group_2")
    found = windows.between_windows(codons_, 9, 3, 0, 40)
    return _tested(bootstrap.window_tests(codons_, found, 20, 3, by, arithmetic=True, keep=between.enough_taxa(0, 40)), *by)


_BBOOT = f""", bn AS (SELECT product, group_1, group_2, count(*) AS n FROM bc GROUP BY ALL), bi AS (SELECT *, row_number() OVER (PARTITION BY product, group_1, group_2 ORDER BY codon_num) AS i FROM bc),
bdraw AS (SELECT bn.product, bn.group_1, bn.group_2, rep, ((rep * 7919 + dr * 104729 + 3 * 31) % 1000003) % n + 1 AS i FROM bn, range(1, {REPS + 1}) t(rep), range(1, 61) u(dr) WHERE dr <= n),
bb AS (SELECT bdraw.product, bdraw.group_1, bdraw.group_2, rep, {", ".join(f"sum({m}) AS {m}" for m in FOUR)} FROM bdraw JOIN bi ON bi.product = bdraw.product AND bi.group_1 = bdraw.group_1 AND bi.group_2 = bdraw.group_2 AND bi.i = bdraw.i GROUP BY ALL),
bz AS (SELECT product, group_1, group_2, stddev_samp({_JC.format(o.DN)}) AS sjn, stddev_samp({_JC.format(o.DN)} - {_JC.format(o.DS)}) AS sjd FROM bb GROUP BY ALL),
bx AS (SELECT product, group_1, group_2, {_JC.format(o.DN)} - {_JC.format(o.DS)} AS x FROM bp), byz AS (SELECT *, CASE WHEN sjd > 0 THEN x / sjd END AS z FROM bx JOIN bz USING (product, group_1, group_2))"""


@query(B + _BBOOT + f' SELECT product, group_1, group_2, round(sjn, 8) AS "SE_JC_dN", round(sjd, 8) AS "SE_JC_dN_minus_dS", round(z, 6) AS "JC_Z_value", {_STARS} AS "JC_significance" FROM byz')
def jc_z(spark, d):
    """Standard errors, Z and significance of corrected rates between groups."""
    codons_, by = _between(spark, d), ("product", "group_1", "group_2")
    errors = bootstrap.standard_errors(bootstrap.replicates(codons_, REPS, 3, by, arithmetic=True), by, jukes_cantor=True)
    found = bootstrap.with_z_test(between.with_jukes_cantor(between.between_product(codons_)), errors, by)
    found = found.withColumn("JC_Z_value", F.round("JC_Z_value", 6) + F.lit(0.0))
    return rounded(found.select(*by, "SE_JC_dN", "SE_JC_dN_minus_dS", "JC_Z_value", "JC_significance"))


@query()
def boot_product_random(spark, d):
    """Hashed draws: a standard error for each product, held against the analytic one in the tests."""
    by = ("group", "product")
    return bootstrap.standard_errors(bootstrap.replicates(_within(spark, d), 100, 1, by), by, jukes_cantor=True)


# The normal integral by Simpson's rule from 0 to |z|, 400 steps.
@query("""
WITH z AS (SELECT DISTINCT (l_partkey % 401 - 200) / 50.0 AS z FROM lineitem),
s AS (SELECT z, abs(z) / 400 AS h, CAST(i AS DOUBLE) * abs(z) / 400 AS x, CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM z, range(401) t(i))
SELECT CAST(z AS DOUBLE) AS z, round(greatest(1 - 2 * sum(w * exp(-x * x / 2)) * max(h) / 3 / sqrt(2 * pi()), 0), 8) AS p FROM s GROUP BY z""")
def normal_p(spark, d):
    z = ((F.col("l_partkey") % 401 - 200) / 50.0).alias("z")
    return views.table(spark, d, "lineitem").select(z).distinct().select("z", (F.round(stats.two_sided_p(F.col("z")), 8)).alias("p"))


@query("""
WITH e AS (SELECT l_suppkey AS id, avg(l_quantity) / 25.0 AS v, stddev_samp(l_quantity) / 25.0 AS se FROM lineitem GROUP BY l_suppkey),
z AS (SELECT id, v, se, CASE WHEN se > 0 THEN (v - 1) / se END AS z, CASE WHEN se > 0 THEN v / se END AS y FROM e),
s AS (SELECT id, i, z, y, abs(z) / 400 AS h, abs(y) / 400 AS g, CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM z, range(401) t(i))
SELECT id, round(greatest(1 - 2 * sum(w * exp(-((i * h) ** 2) / 2)) * max(h) / 3 / sqrt(2 * pi()), 0), 8) AS p_of_one, round(greatest(1 - 2 * sum(w * exp(-((i * g) ** 2) / 2)) * max(g) / 3 / sqrt(2 * pi()), 0), 8) AS p_of_zero FROM s GROUP BY id""")
def ratio_p(spark, d):
    """P values of ratios against 1 and against 0."""
    q = F.col("l_quantity").cast("double")
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.avg(q) / 25.0).alias("v"), (F.stddev_samp(q) / 25.0).alias("se"))
    p = lambda null: F.round(stats.ratio_p(F.col("v"), F.col("se"), null), 8) + F.lit(0.0)
    return rows.select("id", p(1.0).alias("p_of_one"), p(0.0).alias("p_of_zero"))


# --- Tajima's D -------------------------------------------------------------------------------------------------

_TAJIMA = """
WITH g AS (SELECT l_suppkey AS id, count(*) AS n, count(DISTINCT l_partkey) % 97 + 1 AS s, (sum(l_linenumber) % 1000) / 37.0 AS k FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1),
h AS (SELECT *, list_sum(list_transform(range(1, CAST(n AS INT)), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, CAST(n AS INT)), lambda i: 1.0::DOUBLE / (i * i))) AS a2, CAST(n AS DOUBLE) AS m FROM g),
e AS (SELECT *, ((m + 1) / (3 * (m - 1)) - 1 / a1) / a1 AS e1, (2 * (m * m + m + 3) / (9 * m * (m - 1)) - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM h)"""


def _tajima(spark, d):
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count("*").alias("n"), (F.count_distinct("l_partkey") % 97 + 1).alias("s"), ((F.sum("l_linenumber") % 1000) / 37.0).alias("k")
    )
    return rows.where(F.col("n") > 1).select("id", "n", "s", tajima.tajima_d(F.col("n"), F.col("s"), F.col("k")).alias("D"))


@query(_TAJIMA + ' SELECT id, n, s, round((k - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) AS "D" FROM e')
def tajima_d(spark, d):
    return rounded(_tajima(spark, d), 6)


@query()
def tajima_sig(spark, d):
    """Bounds are beta quantiles, which SQL lacks; the tests hold them against published values."""
    return rounded(tajima.with_significance(_tajima(spark, d)), 6)


@query(o.with_(o.READS) + """, w AS (SELECT site // 50 AS stretch, a + c + g + t AS n, CAST(a > 0 AS INT) + CAST(c > 0 AS INT) + CAST(g > 0 AS INT) + CAST(t > 0 AS INT) > 1 AS seg,
 (a * c + a * g + a * t + c * g + c * t + g * t) / nullif((a + c + g + t) * (a + c + g + t - 1) / 2.0, 0) AS pi FROM sc),
g AS (SELECT stretch, max(n) AS n, count(*) FILTER (WHERE seg) AS s, coalesce(sum(pi), 0) AS k FROM w GROUP BY stretch),
h AS (SELECT *, list_sum(list_transform(range(1, CAST(n AS INT)), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, CAST(n AS INT)), lambda i: 1.0::DOUBLE / (i * i))) AS a2, CAST(n AS DOUBLE) AS m FROM g),
e AS (SELECT *, ((m + 1) / (3 * (m - 1)) - 1 / a1) / a1 AS e1, (2 * (m * m + m + 3) / (9 * m * (m - 1)) - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM h)
SELECT stretch, CAST(n AS BIGINT) AS n, s AS "S", round(k, 7) AS pi, round(CASE WHEN n >= 2 AND e1 * s + e2 * s * (s - 1) > 0 THEN (k - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)) END, 6) AS "D" FROM e""")
def tajima_sites(spark, d):
    """D of stretches of sites, from reads."""
    found = tajima.tajima_sites(_sites(spark, d).withColumn("stretch", F.floor(F.col("site") / 50)), "stretch")
    return rounded(found.withColumn("D", F.round("D", 6)), 7)


# --- pooled samples ---------------------------------------------------------------------------------------------


def _pool(spark, d):
    return views.variants(spark, d), views.coding(spark), views.reference(spark)


@query(P + """ SELECT file, site, ref_nt, maj_nt, coverage, a AS "A", c AS "C", g AS "G", t AS "T", round(pi, 8) AS pi FROM pd""")
def pool_site_pi(spark, d):
    found = pool.with_diversity(pool.pool_counts(views.variants(spark, d))).where("polymorphic")
    return rounded(found.select("file", "site", "ref_nt", "maj_nt", "coverage", "A", "C", "G", "T", "pi"))


@query(P + " SELECT file, site, round(gdiv, 8) AS gdiv FROM pd")
def pool_gdiv(spark, d):
    return rounded(pool.with_diversity(pool.pool_counts(views.variants(spark, d))).where("polymorphic").select("file", "site", "gdiv"))


@query(P + """ SELECT file, product, site, position_in_codon, "overlapping_ORFs", codon, class_vs_ref, class, round(pi, 8) AS pi FROM ps""")
def pool_sites(spark, d):
    return rounded(pool.pool_sites(*_pool(spark, d)).select("file", "product", "site", "position_in_codon", "overlapping_ORFs", "codon", "class_vs_ref", "class", "pi"))


_PC = ("N_diffs", "S_diffs", "N_sites", "S_sites", "N_sites_ref", "S_sites_ref", "N_diffs_vs_ref", "S_diffs_vs_ref", "gdiv", "N_gdiv", "S_gdiv")


@query(P + ' SELECT file, product, CAST(codon_num AS INT) AS codon_num, site, codon, "num_overlap_ORF_nts", variable_sites, ' + ", ".join(f'round({m} + 1e-11, 8) AS "{m}"' for m in _PC) + " FROM pcod")
def pool_codon(spark, d):
    return rounded(_off_ties(pool.pool_codons(*_pool(spark, d))))


@query(P + """ SELECT file, product, CAST(codon_num AS INT) AS codon_num, codon, round(p + 1e-13, 10) AS p FROM hp WHERE p > 0""")
def pool_haplotypes(spark, d):
    """The haplotypes of each codon and their frequencies."""
    variants, cds, reference = _pool(spark, d)
    rows = pool.variant_codons(pool.with_diversity(pool.pool_counts(variants)), cds, pool.reference_codons(cds, reference))
    return rows.select("file", "product", "codon_num", F.explode(pool.haplotypes()).alias("h")).select("file", "product", "codon_num", F.col("h.b").alias("codon"), F.round(F.col("h.w") + 1e-13, 10).alias("p"))


_SUMS = ", ".join(f'round(sum({m}), 7) AS "{m}"' for m in pool.SUMS)
_PRATES = """round(sum(N_diffs) / nullif(sum(N_sites), 0), 7) AS "piN", round(sum(S_diffs) / nullif(sum(S_sites), 0), 7) AS "piS",
 round(sum(N_diffs_vs_ref) / nullif(sum(N_sites), 0), 7) AS "mean_dN_vs_ref", round(sum(S_diffs_vs_ref) / nullif(sum(S_sites), 0), 7) AS "mean_dS_vs_ref" """


@query(P + f""", pp AS (SELECT file, product, {_SUMS}, {_PRATES} FROM pcod GROUP BY file, product),
gg AS (SELECT file, product, round(avg(gdiv), 7) AS mean_gdiv_polymorphic, round(avg(gdiv) FILTER (WHERE class = 'Nonsynonymous'), 7) AS "mean_N_gdiv", round(avg(gdiv) FILTER (WHERE class = 'Synonymous'), 7) AS "mean_S_gdiv" FROM ps GROUP BY ALL)
SELECT pp.*, mean_gdiv_polymorphic, "mean_N_gdiv", "mean_S_gdiv" FROM pp LEFT JOIN gg USING (file, product)""")
def pool_product(spark, d):
    parts = _pool(spark, d)
    return rounded(pool.pool_products(pool.pool_codons(*parts), pool.pool_sites(*parts)), 7)


@query(P + f""", pp AS (SELECT file, {_SUMS}, {_PRATES} FROM pcod GROUP BY file),
n AS (SELECT (SELECT count(*) FROM pref) AS sites, (SELECT count(DISTINCT site) FROM cds) AS sites_coding),
q AS (SELECT file, sum(pi) AS sp, sum(pi) FILTER (WHERE coding) AS spc, sum(gdiv) AS sg, avg(gdiv) AS ag, avg(gdiv) FILTER (WHERE class = 'Nonsynonymous') AS an, avg(gdiv) FILTER (WHERE class = 'Synonymous') AS asyn,
 count(*) AS np, avg(gdiv) FILTER (WHERE coding) AS agc, count(*) FILTER (WHERE coding) AS nc, avg(gdiv) FILTER (WHERE NOT coding) AS agn, count(*) FILTER (WHERE NOT coding) AS nn FROM once GROUP BY file)
SELECT pp.*, sites, sites_coding, sites - sites_coding AS sites_noncoding, round(sp / sites, 7) AS pi, round(coalesce(spc, 0) / sites_coding, 7) AS pi_coding, round((sp - coalesce(spc, 0)) / (sites - sites_coding), 7) AS pi_noncoding,
 round(sg / sites, 7) AS mean_gdiv, round(ag, 7) AS mean_gdiv_polymorphic, round(an, 7) AS "mean_N_gdiv", round(asyn, 7) AS "mean_S_gdiv", np AS sites_polymorphic, nc AS sites_coding_poly, nn AS sites_noncoding_poly,
 round(agc, 7) AS mean_gdiv_coding_poly, round(agn, 7) AS mean_gdiv_noncoding_poly FROM pp JOIN q USING (file), n""")
def pool_population(spark, d):
    variants, cds, reference = _pool(spark, d)
    return rounded(pool.pool_population(pool.pool_codons(variants, cds, reference), pool.pool_sites(variants, cds, reference), cds, reference), 7)


@query(P + f""", slide AS (SELECT file, product, CAST(f AS INT) AS first_codon, round(coalesce(sum(N_diffs), 0), 8) AS N_diffs, round(coalesce(sum(S_sites), 0), 8) AS S_sites
 FROM (SELECT file, product, unnest(range(min(codon_num), max(codon_num) - 9 + 2)) AS f FROM pcod GROUP BY file, product) s JOIN pcod c USING (file, product) WHERE c.codon_num BETWEEN f AND f + 8 GROUP BY file, product, f)
SELECT * FROM slide""")
def pool_window(spark, d):
    found = windows.sliding_windows(pool.pool_codons(*_pool(spark, d)), 9, 1, ("file", "product"))
    return rounded(found.select("file", "product", "first_codon", "N_diffs", "S_sites"))


@query(o.with_(o.TABLES, o.MINUS) + ' SELECT file, product, CAST(codon_num AS INT) AS codon_num, site, codon, ' + ", ".join(f'round({m} + 1e-11, 8) AS "{m}"' for m in _PC) + " FROM pcod")
def pool_minus_strand(spark, d):
    """Codons of the other strand's products, in its coordinates."""
    variants = reports.revcom_variants(views.variants(spark, d), views.GENOME)
    segments = revcom.revcom_segments(views.both_segments(spark), views.GENOME).where("strand = '+'")
    reference = views.reference(spark).select((F.lit(views.GENOME + 1) - F.col("site")).alias("site"), sequence.reverse_complement(F.col("ref_nt")).alias("ref_nt"))
    return rounded(_off_ties(pool.pool_codons(variants, gtf.cds_sites(segments), reference).drop("num_overlap_ORF_nts", "variable_sites")))


# Segments from the line items: a product for each order, whose lines alternate between the strands.
_ORFS = "WITH seg AS (SELECT 'G' || CAST(l_orderkey AS VARCHAR) AS product, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey * 7 AS a, l_partkey * 7 + l_suppkey % 40 * 3 + 2 AS b FROM lineitem), at AS (SELECT product, strand, unnest(range(a, b + 1)) AS site FROM seg)"


def _orfs(spark, d):
    start = F.col("l_partkey") * 7
    return views.table(spark, d, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("product"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.col("l_suppkey") % 40 * 3 + 2).alias("stop")
    )


@query(_ORFS.replace(" at AS", " sites AS") + ' SELECT site, count(DISTINCT (product, strand)) - 1 AS "overlapping_ORFs" FROM sites GROUP BY site')
def overlap_both_strands(spark, d):
    """Products of both strands, by a sweep over the ends of their segments."""
    return pool.interval_sites(pool.overlap_intervals(_orfs(spark, d)))


@query(P + """ SELECT file, site, 'left out by its frequency: ' || alt AS message FROM v WHERE freq < 0.1""")
def pool_log(spark, d):
    return pool.warnings(views.variants(spark, d), 0.1)


@query(P + """, m AS (SELECT file, product, min(site) AS lo, max((site - 100) % 3) AS x FROM pcod GROUP BY ALL), b AS (SELECT pcod.*, (pcod.site - lo) % 3 AS rest, (pcod.site - lo) // 3 + 1 AS frame FROM pcod JOIN m USING (file, product))
SELECT file, product, site, CAST(CASE WHEN max(rest) OVER (PARTITION BY file, product) > 0 THEN row_number() OVER (PARTITION BY file, product ORDER BY site) ELSE frame END AS INT) AS codon_num FROM b""")
def pool_codon_numbers(spark, d):
    """Codon numbers of a pool table of several files, from the first sites of its codons."""
    return tables.with_codon_numbers(pool.pool_codons(*_pool(spark, d)).drop("codon_num")).select("file", "product", "site", "codon_num")


@query(_ORFS.replace(" at AS", " sites AS") + """ SELECT site, count(DISTINCT product) - 1 AS "overlapping_ORFs" FROM sites WHERE strand = '+' GROUP BY site""")
def overlap_orfs(spark, d):
    return pool.interval_sites(pool.overlap_intervals(_orfs(spark, d).where("strand = '+'")))


@query(_LONG.replace("SELECT product, nt, row_number()", "SELECT product, site, nt, row_number()") + " SELECT nt AS ref_nt, count(*) AS n, CAST(sum(site) AS BIGINT) AS sites FROM (SELECT DISTINCT site, nt FROM c) GROUP BY nt")
def pool_reference_at(spark, d):
    """The letters of a long reference at coding sites alone."""
    whole, products = _long(spark, d)
    segments = products.select("product", "strand", F.explode("segments").alias("_s")).select("product", "strand", "_s.start", "_s.stop")
    return pool.letters_at(whole, segments).groupBy("ref_nt").agg(F.count("*").alias("n"), F.sum("site").alias("sites"))


@query(P + " SELECT file, site, alt, round(freq, 8) AS freq FROM v WHERE freq >= 0.1")
def minfreq_filter(spark, d):
    return rounded(reports.minimum_frequency(views.variants(spark, d), 0.1).select("file", "site", "alt", "freq"))


# --- parsers over report lines made of the tables ---------------------------------------------------------------

_REPORT = """
WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS site, l_partkey % 50 + 1 AS n1, l_suppkey % 30 AS n2, l_partkey % 50 + l_suppkey % 30 + 10 AS dp, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS ref,
  substr('CGTA', CAST(l_partkey % 4 + 1 AS INT), 1) AS x, substr('GTAC', CAST(l_partkey % 4 + 1 AS INT), 1) AS y, l_linenumber % 2 = 0 AS two, l_suppkey AS sk FROM lineitem),
u AS (SELECT site, ref, x AS alt, n1 AS n, 0 AS k, n1, n2, dp, two FROM r UNION ALL SELECT site, ref, y, n2, 1, n1, n2, dp, two FROM r WHERE two)"""


def _report(spark, d):
    pick = lambda letters: F.substring(F.lit(letters), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    n1, n2 = F.col("l_partkey") % 50 + 1, F.col("l_suppkey") % 30
    return views.table(spark, d, "lineitem").select(
        F.lit("f").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("POS"), n1.alias("n1"), n2.alias("n2"), (F.col("l_partkey") % 50 + n2 + 10).alias("dp"),
        pick("ACGT").alias("REF"), pick("CGTA").alias("x"), pick("GTAC").alias("y"), (F.col("l_linenumber") % 2 == 0).alias("two"), F.col("l_suppkey").alias("sk"),
    )


def _vcf(spark, d, info, vcf_format):
    rows = _report(spark, d).withColumn("ALT", F.when(F.col("two"), F.concat_ws(",", "x", "y")).otherwise(F.col("x")))
    rows = rows.withColumn("INFO", info).withColumn("FORMAT", F.lit("GT:AD:DP"))
    ad = F.when(F.col("two"), F.concat_ws(",", F.lit("7"), "n1", "n2")).otherwise(F.concat_ws(",", F.lit("7"), "n1"))
    rows = rows.withColumn("S1", F.concat_ws(":", F.lit("0/1"), ad, F.col("dp").cast("string")))
    return rounded(reports.parse_vcf(rows, vcf_format, ["S1"]).select("file", "site", "ref", "alt", "count", "coverage", "freq"), 6)


def _shares(*extra):
    share = lambda n: F.format_string("%.4f", F.col(n) / 100.0)
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in extra], F.lit(";AF="), F.when(F.col("two"), F.concat_ws(",", share("n1"), share("n2"))).otherwise(share("n1")), F.lit(";X=1"))


_AF = "SELECT 'f' AS file, CAST(site AS INT) AS site, ref, alt, round(n / 100.0 * {cov}, 6) AS count, CAST({cov} AS DOUBLE) AS coverage, round(n / 100.0, 6) AS freq FROM u"


@query(_REPORT + _AF.format(cov="(CASE WHEN two THEN 60 ELSE 30 END)"))
def vcf_format1(spark, d):
    return _vcf(spark, d, _shares(F.when(F.col("two"), "AN=60").otherwise("NS=30")), 1)


@query(_REPORT + _AF.format(cov="dp"))
def vcf_format2(spark, d):
    return _vcf(spark, d, _shares("Q=2;DP=", F.col("dp").cast("string")), 2)


@query(_REPORT + """ SELECT 'f' AS file, CAST(site AS INT) AS site, ref, alt, round((n1 + n2) / (CASE WHEN two THEN 2.0 ELSE 1.0 END), 6) AS count, CAST(dp + 5 + n1 + n2 AS DOUBLE) AS coverage,
 round((n1 + n2) / (CASE WHEN two THEN 2.0 ELSE 1.0 END) / (dp + 5 + n1 + n2), 6) AS freq FROM u""")
def vcf_format3(spark, d):
    return _vcf(spark, d, F.concat(F.lit("DP4="), F.concat_ws(",", "dp", F.lit("5"), "n1", "n2")), 3)


@query(_REPORT + """ SELECT 'f:S1' AS file, CAST(site AS INT) AS site, ref, alt, CAST(n AS DOUBLE) AS count, CAST(7 + n1 + CASE WHEN two THEN n2 ELSE 0 END AS DOUBLE) AS coverage,
 round(n / (7.0 + n1 + CASE WHEN two THEN n2 ELSE 0 END), 6) AS freq FROM u""")
def vcf_format4(spark, d):
    return _vcf(spark, d, F.lit("."), 4)


_CLC = _REPORT + """ SELECT 'f' AS file, CAST(site AS INT) AS site, ref, x AS alt, CAST(n1 AS DOUBLE) AS count, CAST(dp AS DOUBLE) AS coverage, round(n1 / 100.0, 6) AS freq,
 CASE WHEN sk % 3 = 0 THEN '' WHEN sk % 3 = 1 THEN 'ORF1' ELSE 'ORF1,ORF2' END AS products FROM r WHERE two"""
_GENEIOUS = _REPORT + """ SELECT 'f' AS file, CAST(site AS INT) AS site, ref, x AS alt, round(max(n1) / 100.0 * max(dp), 6) AS count, CAST(max(dp) AS DOUBLE) AS coverage, round(max(n1) / 100.0, 6) AS freq,
 CASE max(sk % 3) WHEN 0 THEN '' WHEN 1 THEN 'ORF1' ELSE 'ORF1,ORF2' END AS products FROM r WHERE two GROUP BY site, ref, x"""


def _clc_report(spark, d):
    text = lambda c: F.col(c).cast("string")
    return _report(spark, d).select(
        "file", text("POS").alias("Reference Position"), F.when(F.col("two"), "SNV").otherwise("MNV").alias("Type"), F.col("REF").alias("Reference"), F.col("x").alias("Allele"), text("n1").alias("Count"),
        F.concat(F.lit(" "), text("dp")).alias("Coverage"), text("n1").alias("Frequency"), F.when(F.col("sk") % 3 == 0, "").when(F.col("sk") % 3 == 1, "CDS: ORF1").otherwise("CDS: ORF1, CDS: ORF2").alias("Overlapping annotations"),
    )


def _geneious_report(spark, d):
    rows = _report(spark, d)
    product = F.explode(F.when(F.col("sk") % 3 == 0, F.array(F.lit(""))).when(F.col("sk") % 3 == 1, F.array(F.lit("ORF1"))).otherwise(F.array(F.lit("ORF2"), F.lit("ORF1"))))
    return rows.select(
        "file", F.col("POS").cast("string").alias("Minimum"), F.col("POS").cast("string").alias("Maximum"), F.when(F.col("two"), "SNP (transition)").otherwise("Deletion").alias("Polymorphism Type"), product.alias("product"),
        F.concat_ws(" -> ", "REF", "x").alias("Change"), F.col("dp").cast("string").alias("Coverage"), F.format_string("%.2f%%", F.col("n1").cast("double")).alias("Variant Frequency"),
    )


def _named(df):
    return rounded(df.withColumn("products", F.array_join(F.coalesce("products", F.array().cast("array<string>")), ",")), 6)


@query(_CLC)
def clc_parse(spark, d):
    return _named(reports.parse_clc(_clc_report(spark, d)))


@query(_GENEIOUS)
def geneious_parse(spark, d):
    return _named(reports.parse_geneious(_geneious_report(spark, d)))


# --- files: written, and read again -------------------------------------------------------------------------------


def _written(df, path, sep):
    df.write.option("sep", sep).option("header", True).option("quoteAll", True).csv(path)
    return path


@query(f"SELECT * EXCLUDE (file) FROM ({_CLC})")
def clc_files(spark, d):
    path = _written(_clc_report(spark, d).drop("file"), views.scratch(spark), "\t")
    return _named(reports.read_clc(spark, path)).drop("file")


@query(f"SELECT site, ref, alt, count, coverage, freq, products FROM ({_GENEIOUS})")
def geneious_files(spark, d):
    # A variant's rows for several products stand in the same report.
    path = _written(_geneious_report(spark, d).drop("file").repartition("Minimum", "Change"), views.scratch(spark), ",")
    return _named(reports.read_geneious(spark, path)).drop("file")


_HEAD = ["##fileformat=VCFv4.2"]
_NAMES = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


@query(_REPORT + """ SELECT CAST(4000000 - site + 1 AS INT) AS site, translate(ref, 'ACGT', 'TGCA') AS ref, translate(alt, 'ACGT', 'TGCA') AS alt, round(n / 100.0 * dp, 6) AS count, CAST(dp AS DOUBLE) AS coverage, round(n / 100.0, 6) AS freq FROM u""")
def vcf_files(spark, d):
    """A VCF is written, its other strand is made from file to file, and that is read as variants."""
    rows = _report(spark, d).withColumn("ALT", F.when(F.col("two"), F.concat_ws(",", "x", "y")).otherwise(F.col("x")))
    rows = rows.select(F.lit("c").alias("CHROM"), "POS", F.lit(".").alias("ID"), "REF", "ALT", F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), _shares("DP=", F.col("dp").cast("string")).alias("INFO"))
    there, back = views.scratch(spark), views.scratch(spark)
    reports.write_vcf(rows, there, _HEAD, _NAMES)
    read, head, names = reports.read_vcf_lines(spark, there)
    reports.write_vcf(revcom.revcom_vcf(read, 4_000_000), back, head, names)
    return rounded(reports.read_vcf(spark, back, 2).select("site", "ref", "alt", "count", "coverage", "freq"), 6)


#: Samples of three reports, in the order of their columns.
_SAMPLES = (("A1",), ("B1", "B2"), ("C3", "A1", "C2"))


@query(_REPORT + ", s(k, sample, j) AS (VALUES " + ", ".join(f"({k}, '{s}', {j})" for k, names in enumerate(_SAMPLES) for j, s in enumerate(names)) + """),
v AS (SELECT s.k AS report, sample, CAST(site AS INT) AS site, ref, alt, u.k AS nth, 7 + j AS n0, n1 + j AS n1, n2, two FROM u JOIN s ON u.dp % 3 = s.k)
SELECT report, sample, site, ref, alt, CAST(CASE WHEN nth = 0 THEN n1 ELSE n2 END AS DOUBLE) AS count, CAST(n0 + n1 + CASE WHEN two THEN n2 ELSE 0 END AS DOUBLE) AS coverage,
 round(CASE WHEN nth = 0 THEN n1 ELSE n2 END / CAST(n0 + n1 + CASE WHEN two THEN n2 ELSE 0 END AS DOUBLE), 6) AS freq FROM v""")
def vcf_many_files(spark, d):
    """Reports with unlike samples, written to one folder and read together: each line's samples are those of its own file."""
    path = views.scratch(spark)
    rows = _report(spark, d).withColumn("ALT", F.when(F.col("two"), F.concat_ws(",", "x", "y")).otherwise(F.col("x")))
    for k, samples in enumerate(_SAMPLES):
        reads = lambda j: F.concat_ws(",", F.lit(7 + j), F.col("n1") + j, F.when(F.col("two"), F.col("n2")))
        values = [F.concat_ws(":", F.lit("0/1"), reads(j), F.col("dp").cast("string")).alias(s) for j, s in enumerate(samples)]
        part = rows.where(F.col("dp") % 3 == k).select(F.lit(f"r{k}").alias("CHROM"), "POS", F.lit(".").alias("ID"), "REF", "ALT", F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.lit(".").alias("INFO"), F.lit("GT:AD:DP").alias("FORMAT"), *values)
        reports.write_vcf(part, f"{path}/{k}", _HEAD, [*_NAMES, "FORMAT", *samples])
    # A file by its report and its name.
    lines = spark.read.text(f"{path}/*").select(F.substring_index("_metadata.file_path", "/", -2).alias("file"), "value")
    found = reports.parse_vcf_lines(lines, 4)
    # Reads of format 4 are whole numbers, so that shares alone are rounded.
    return found.select(F.substring("file", 1, 1).cast("int").alias("report"), F.substring_index("file", ":", -1).alias("sample"), "site", "ref", "alt", "count", "coverage", (F.floor(F.col("freq") * 1e6 + 0.5) / 1e6).alias("freq"))


@query(W + f' SELECT grp AS "group", product, codon_num, variability, CAST(n AS DOUBLE) AS num_defined_seqs, {o.FOUR} FROM wc')
def codon_result_files(spark, d):
    """The codon table, written and read again by its own delimiter."""
    path = views.scratch(spark)
    tables.write_tsv(_within(spark, d), path)
    return rounded(tables.read_codon_results(spark, path).select("group", "product", "codon_num", "variability", "num_defined_seqs", *FOUR))


@query(f"WITH {_DNA} SELECT 's' || CAST(doc_id AS VARCHAR) || '_revcom' AS header, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM dna WHERE length(seq) > 0")
def fasta_files(spark, d):
    """Sequences turned, written as FASTA and read again."""
    seqs = views.dna(spark, d).where(F.length("seq") > 0).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("header"), "seq")
    path = views.scratch(spark)
    fasta.write_fasta(revcom.revcom_sequences(seqs), path)
    return fasta.read_fasta(spark, path, extensions="part-*").select("header", "seq")


@query("""
WITH l AS (SELECT l_partkey AS a, l_partkey + l_suppkey * 3 + 2 AS b, 'G' || CAST(l_orderkey AS VARCHAR) AS g, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS s FROM lineitem)
SELECT g AS product, s AS strand, count(*) AS n_segments, CAST(sum(b - a + 1) AS BIGINT) AS bases, CAST(min(a) AS INT) AS first_start, CAST((list(b ORDER BY a DESC, b DESC))[1] AS INT) AS last_stop FROM l GROUP BY ALL""")
def gtf_files(spark, d):
    """Segments written as GTF, read again and gathered by product and strand."""
    rows = views.table(spark, d, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("product"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey") * 3 + 2).alias("stop"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
    )
    path = views.scratch(spark)
    gtf.write_gtf(rows, path)
    found = gtf.coding_products(gtf.read_gtf(spark, path, None))
    bases = F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"] + 1)
    return found.select("product", "strand", F.size("segments").cast("long").alias("n_segments"), bases.alias("bases"), F.col("segments")[0]["start"].alias("first_start"), F.element_at("segments", -1)["stop"].alias("last_stop"))


@query("""
WITH l AS (SELECT l_partkey AS a, l_partkey + l_suppkey * 3 + 2 AS b, 'G' || CAST(l_suppkey % 7 AS VARCHAR) AS g, l_linenumber % 3 AS kind FROM lineitem)
SELECT g AS product, CAST(a AS INT) AS start, CAST(b AS INT) AS stop, '+' AS strand FROM l WHERE kind = 1""")
def gtf_parse(spark, d):
    kind = F.col("l_linenumber") % 3
    gene = F.concat(F.when(F.col("l_suppkey") % 2 == 0, 'gene_id "gene:').otherwise('gene_id "'), F.lit("G"), (F.col("l_suppkey") % 7).cast("string"), F.lit('"; x "1";'))
    line = F.concat_ws("\t", F.lit("ref"), F.lit("CALLER"), F.when(kind == 0, "exon").otherwise("CDS"), F.col("l_partkey").cast("string"), (F.col("l_partkey") + F.col("l_suppkey") * 3 + 2).cast("string"), F.lit("."), F.when(kind == 2, "-").otherwise("+"), F.lit("0"), gene)
    return gtf.parse_gtf(views.table(spark, d, "lineitem").select(line.alias("value")))
