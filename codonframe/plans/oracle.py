"""Oracle SQL: the same answers from scratch, the codon tables included."""

from __future__ import annotations

from .views import FASTA_PRODUCTS, GENOME, MINUS_SEGMENTS, SEGMENTS

# Fixed value: the genetic code in the order AAA, AAC ... TTT.
CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"

TABLES = f"""
code AS (
  SELECT substr('ACGT', CAST(i // 16 AS INT) + 1, 1) || substr('ACGT', CAST(i // 4 % 4 AS INT) + 1, 1) || substr('ACGT', CAST(i % 4 AS INT) + 1, 1) AS codon,
         substr('{CODE}', CAST(i AS INT) + 1, 1) AS aa FROM range(64) t(i)),
pos AS (SELECT * FROM (VALUES (1), (2), (3)) v(p)),
step AS (
  SELECT c.codon, c.aa, p, m.aa AS to_aa FROM code c CROSS JOIN pos JOIN code m
    ON m.codon <> c.codon AND substr(m.codon, 1, p - 1) = substr(c.codon, 1, p - 1) AND substr(m.codon, p + 1) = substr(c.codon, p + 1)),
place AS (
  SELECT codon, aa, p, CASE WHEN aa = '*' THEN 0.0 ELSE coalesce(avg(CASE WHEN to_aa = '*' THEN NULL WHEN to_aa <> aa THEN 1.0 ELSE 0.0 END), 0.0) END AS n,
         CASE WHEN aa = '*' THEN 0.0 ELSE coalesce(avg(CASE WHEN to_aa = '*' THEN NULL WHEN to_aa = aa THEN 1.0 ELSE 0.0 END), 0.0) END AS s
  FROM step GROUP BY codon, aa, p),
sdim AS (SELECT codon, aa, sum(n) AS n_sites, sum(s) AS s_sites FROM place GROUP BY codon, aa),
perm AS (SELECT * FROM (VALUES (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)) v(o1, o2)),
path0 AS (SELECT a.codon AS a, a.aa AS aa0, b.codon AS b, b.aa AS aa3, o1, o2,
         substr(a.codon, 1, o1 - 1) || substr(b.codon, o1, 1) || substr(a.codon, o1 + 1) AS c1 FROM code a CROSS JOIN code b CROSS JOIN perm WHERE a.aa <> '*' AND b.aa <> '*'),
path1 AS (SELECT *, substr(c1, 1, o2 - 1) || substr(b, o2, 1) || substr(c1, o2 + 1) AS c2 FROM path0),
path AS (SELECT p.*, x.aa AS aa1, y.aa AS aa2 FROM path1 p JOIN code x ON x.codon = c1 JOIN code y ON y.codon = c2 WHERE x.aa <> '*' AND y.aa <> '*'),
pdim AS (
  SELECT a, b, avg(CAST(aa0 <> aa1 AS INT) + CAST(aa1 <> aa2 AS INT) + CAST(aa2 <> aa3 AS INT)) AS n_diff,
         avg(CAST(a <> c1 AND aa0 = aa1 AS INT) + CAST(c1 <> c2 AND aa1 = aa2 AS INT) + CAST(c2 <> b AND aa2 = aa3 AS INT)) AS s_diff
  FROM path GROUP BY a, b)"""

ALIGNMENT = """
raw AS (SELECT l_returnflag AS grp, l_suppkey % 5 AS pr, l_partkey % 60 + 1 AS place, l_orderkey AS o, l_linenumber AS ln FROM lineitem),
ids AS (SELECT *, (place * 7 + pr * 11 + CASE WHEN (o + ln) % 3 = 0 THEN 1 + (o * 7 + ln * 13) % 5 ELSE 0 END) % 64 AS id FROM raw),
align AS (
  SELECT grp, 'P' || CAST(pr AS VARCHAR) AS product, CAST(place AS INT) AS codon_num,
         CASE WHEN o % 17 = 0 THEN 'NNN' WHEN o % 19 = 0 THEN 'A-C'
              ELSE substr('ACGT', CAST(id // 16 AS INT) + 1, 1) || substr('ACGT', CAST(id // 4 % 4 AS INT) + 1, 1) || substr('ACGT', CAST(id % 4 AS INT) + 1, 1) END AS codon FROM ids),
cc AS (
  SELECT grp, product, codon_num, CASE WHEN regexp_matches(codon, '^[ACGT]{3}$') THEN codon END AS codon, CAST(count(*) AS BIGINT) AS cnt
  FROM align GROUP BY ALL)"""

WITHIN = """
ws AS (
  SELECT grp, product, codon_num, CAST(sum(CASE WHEN cc.codon IS NULL THEN 0 ELSE cnt END) AS BIGINT) AS n, count(cc.codon) AS alleles,
         coalesce(sum(cnt * n_sites) / nullif(sum(CASE WHEN cc.codon IS NULL THEN 0 ELSE cnt END), 0), 0.0) AS ns,
         coalesce(sum(cnt * s_sites) / nullif(sum(CASE WHEN cc.codon IS NULL THEN 0 ELSE cnt END), 0), 0.0) AS ss
  FROM cc LEFT JOIN sdim ON sdim.codon = cc.codon GROUP BY ALL),
wd AS (
  SELECT x.grp, x.product, x.codon_num, sum(x.cnt * y.cnt * coalesce(n_diff, 0)) AS nd, sum(x.cnt * y.cnt * coalesce(s_diff, 0)) AS sd
  FROM cc x JOIN cc y ON x.grp = y.grp AND x.product = y.product AND x.codon_num = y.codon_num AND x.codon < y.codon
  LEFT JOIN pdim ON pdim.a = x.codon AND pdim.b = y.codon GROUP BY ALL),
wc AS (
  SELECT ws.grp, ws.product, ws.codon_num, CASE WHEN alleles > 1 THEN 'polymorphic' ELSE 'conserved' END AS variability, n,
         ns AS N_sites, ss AS S_sites, coalesce(nd / nullif(n * (n - 1) / 2.0, 0), 0.0) AS N_diffs, coalesce(sd / nullif(n * (n - 1) / 2.0, 0), 0.0) AS S_diffs
  FROM ws LEFT JOIN wd USING (grp, product, codon_num)),
wp AS (
  SELECT grp, product, sum(N_sites) AS N_sites, sum(S_sites) AS S_sites, sum(N_diffs) AS N_diffs, sum(S_diffs) AS S_diffs FROM wc GROUP BY ALL)"""

BETWEEN = """
bl AS (SELECT grp, product, codon_num, min(codon) AS least FROM cc GROUP BY ALL),
bs AS (SELECT ws.*, bl.least, coalesce(l.n_sites, 0.0) AS ln, coalesce(l.s_sites, 0.0) AS ls FROM ws JOIN bl USING (grp, product, codon_num) LEFT JOIN sdim l ON l.codon = bl.least),
bd AS (
  SELECT x.grp AS g1, y.grp AS g2, x.product, x.codon_num, sum(x.cnt * y.cnt * coalesce(n_diff, 0)) AS nd, sum(x.cnt * y.cnt * coalesce(s_diff, 0)) AS sd
  FROM cc x JOIN cc y ON x.grp < y.grp AND x.product = y.product AND x.codon_num = y.codon_num AND x.codon <> y.codon
  LEFT JOIN pdim ON pdim.a = x.codon AND pdim.b = y.codon GROUP BY ALL),
bc AS (
  SELECT x.product, x.grp AS group_1, y.grp AS group_2, x.codon_num,
         CASE WHEN x.n > 0 AND y.n > 0 AND NOT (x.alleles = 1 AND y.alleles = 1 AND x.least = y.least) THEN 'polymorphic' ELSE 'conserved' END AS variability,
         x.n AS d1, y.n AS d2,
         CASE WHEN x.n > 0 AND y.n > 0 THEN (x.ns + y.ns) / 2 WHEN x.n > 0 THEN x.ln ELSE y.ln END AS N_sites,
         CASE WHEN x.n > 0 AND y.n > 0 THEN (x.ss + y.ss) / 2 WHEN x.n > 0 THEN x.ls ELSE y.ls END AS S_sites,
         coalesce(nd / nullif(CAST(x.n * y.n AS DOUBLE), 0), 0.0) AS N_diffs, coalesce(sd / nullif(CAST(x.n * y.n AS DOUBLE), 0), 0.0) AS S_diffs
  FROM bs x JOIN bs y ON x.product = y.product AND x.codon_num = y.codon_num AND x.grp < y.grp
  LEFT JOIN bd ON bd.g1 = x.grp AND bd.g2 = y.grp AND bd.product = x.product AND bd.codon_num = x.codon_num),
bp AS (
  SELECT product, group_1, group_2, sum(N_sites) AS N_sites, sum(S_sites) AS S_sites, sum(N_diffs) AS N_diffs, sum(S_diffs) AS S_diffs FROM bc GROUP BY ALL)"""

FOUR = ", ".join(f"round({m}, 8) AS {m}" for m in ("N_sites", "S_sites", "N_diffs", "S_diffs"))
DN, DS = "(N_diffs / nullif(N_sites, 0))", "(S_diffs / nullif(S_sites, 0))"
RATES = f"round({DN}, 8) AS dN, round({DS}, 8) AS dS, round({DN} - {DS}, 8) AS dN_minus_dS, round({DN} / nullif({DS}, 0), 8) AS dN_over_dS"

READS = """
base AS (SELECT l_partkey AS site, substr('ACGT', CAST(l_suppkey % 4 AS INT) + 1, 1) AS nt FROM lineitem),
sc AS (SELECT site, CAST(sum(CAST(nt = 'A' AS INT)) AS BIGINT) AS a, CAST(sum(CAST(nt = 'C' AS INT)) AS BIGINT) AS c, CAST(sum(CAST(nt = 'G' AS INT)) AS BIGINT) AS g, CAST(sum(CAST(nt = 'T' AS INT)) AS BIGINT) AS t FROM base GROUP BY site)"""

_SEGMENTS = ", ".join(f"('{p}', {a}, {b})" for p, a, b in SEGMENTS)
POOL = f"""
pref AS (SELECT CAST(i AS INT) AS site, substr('ACGT', CAST((i * i + i // 7) % 4 AS INT) + 1, 1) AS ref_nt FROM range(1, {GENOME + 1}) t(i)),
seg AS (SELECT * FROM (VALUES {_SEGMENTS}) v(product, a, b)),
segsite AS (SELECT product, CAST(i AS INT) AS site FROM seg, range(1, {GENOME + 1}) t(i) WHERE i BETWEEN a AND b),
cds AS (SELECT product, site, (row_number() OVER (PARTITION BY product ORDER BY site) - 1) // 3 + 1 AS codon_num, (row_number() OVER (PARTITION BY product ORDER BY site) - 1) % 3 + 1 AS pc FROM segsite),
rc AS (SELECT product, codon_num, string_agg(ref_nt, '' ORDER BY pc) AS codon, min(site) AS start_site FROM cds JOIN pref USING (site) GROUP BY ALL),
ov AS (SELECT site, count(DISTINCT product) - 1 AS overlapping FROM cds GROUP BY site),
vraw AS (SELECT 'F' || CAST(l_linenumber % 2 AS VARCHAR) AS file, l_partkey % {GENOME} + 1 AS site, l_suppkey AS sk FROM lineitem),
vidx AS (SELECT file, CAST(site AS INT) AS site, (site * site + site // 7) % 4 AS ix, sk FROM vraw),
v1 AS (SELECT file, site, substr('ACGT', CAST(ix AS INT) + 1, 1) AS ref, substr('ACGT', CAST((ix + 1 + sk % 3) % 4 AS INT) + 1, 1) AS alt, CAST(count(*) AS DOUBLE) AS cnt FROM vidx GROUP BY ALL),
vdep AS (SELECT file, site, sum(cnt) + 20 + site % 13 AS coverage FROM v1 GROUP BY file, site),
v AS (SELECT v1.*, coverage, cnt / coverage AS freq FROM v1 JOIN vdep USING (file, site)),
pc AS (
  SELECT file, site, max(ref) AS ref_nt, max(coverage) AS coverage,
         sum(CASE WHEN alt = 'A' THEN cnt ELSE 0 END) + CASE WHEN max(ref) = 'A' THEN max(coverage) - sum(cnt) ELSE 0 END AS a,
         sum(CASE WHEN alt = 'C' THEN cnt ELSE 0 END) + CASE WHEN max(ref) = 'C' THEN max(coverage) - sum(cnt) ELSE 0 END AS c,
         sum(CASE WHEN alt = 'G' THEN cnt ELSE 0 END) + CASE WHEN max(ref) = 'G' THEN max(coverage) - sum(cnt) ELSE 0 END AS g,
         sum(CASE WHEN alt = 'T' THEN cnt ELSE 0 END) + CASE WHEN max(ref) = 'T' THEN max(coverage) - sum(cnt) ELSE 0 END AS t
  FROM v GROUP BY file, site),
pd AS (
  SELECT *, (a * c + a * g + a * t + c * g + c * t + g * t) / (coverage * (coverage - 1) / 2) AS pi,
         1 - (a / coverage) ** 2 - (c / coverage) ** 2 - (g / coverage) ** 2 - (t / coverage) ** 2 AS gdiv,
         CASE WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END AS maj_nt
  FROM pc WHERE CAST(a > 0 AS INT) + CAST(c > 0 AS INT) + CAST(g > 0 AS INT) + CAST(t > 0 AS INT) > 1),
long AS (
  SELECT file, site, coverage, ref_nt, nt, cnt FROM (SELECT * FROM pc UNPIVOT (cnt FOR nt IN (a, c, g, t))) WHERE cnt > 0),
al AS (
  SELECT long.file, long.site, cds.product, cds.codon_num, CAST(pc AS INT) AS pos, rc.codon AS ref_codon, coverage, ref_nt, upper(nt) AS nt, cnt,
         substr(rc.codon, 1, CAST(pc AS INT) - 1) || upper(nt) || substr(rc.codon, CAST(pc AS INT) + 1) AS codon
  FROM long JOIN cds ON cds.site = long.site JOIN rc ON rc.product = cds.product AND rc.codon_num = cds.codon_num),
cls AS (
  SELECT file, site, product, CASE WHEN count(DISTINCT k.aa) = 1 THEN 'Synonymous' WHEN count(DISTINCT k.aa) = count(*) THEN 'Nonsynonymous' ELSE 'Ambiguous' END AS class,
         CASE WHEN coalesce(bool_and(k.aa = r.aa) FILTER (WHERE nt <> ref_nt), TRUE) THEN 'Synonymous' WHEN bool_and(k.aa <> r.aa) FILTER (WHERE nt <> ref_nt) THEN 'Nonsynonymous' ELSE 'Ambiguous' END AS class_vs_ref
  FROM al JOIN code k ON k.codon = al.codon JOIN code r ON r.codon = al.ref_codon GROUP BY file, site, product),
ps AS (
  SELECT pd.file, coalesce(cds.product, 'noncoding') AS product, pd.site, ref_nt, maj_nt, cds.codon_num, CAST(cds.pc AS INT) AS position_in_codon, CAST(coalesce(overlapping, 0) AS BIGINT) AS overlapping_ORFs,
         rc.codon, pi, gdiv, class_vs_ref, class, coverage, a, c, g, t
  FROM pd LEFT JOIN cds USING (site) LEFT JOIN rc ON rc.product = cds.product AND rc.codon_num = cds.codon_num LEFT JOIN ov USING (site)
  LEFT JOIN cls ON cls.file = pd.file AND cls.site = pd.site AND cls.product = cds.product),
vc AS (SELECT file, product, codon_num, ref_codon, count(*) FILTER (WHERE letters > 1) AS variable_sites FROM (SELECT file, product, codon_num, ref_codon, pos, count(*) AS letters FROM al GROUP BY ALL) GROUP BY ALL),
fq AS (
  SELECT file, product, codon_num, pos, nt, cnt / coverage AS f FROM al
  UNION ALL SELECT file, product, codon_num, p, substr(ref_codon, p, 1), 1.0 FROM vc, pos WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.file = vc.file AND al.product = vc.product AND al.codon_num = vc.codon_num AND al.pos = p)),
hp AS (
  SELECT file, product, codon_num, x.nt || y.nt || z.nt AS codon, x.f * y.f * z.f AS p
  FROM (SELECT * FROM fq WHERE pos = 1) x JOIN (SELECT * FROM fq WHERE pos = 2) y USING (file, product, codon_num) JOIN (SELECT * FROM fq WHERE pos = 3) z USING (file, product, codon_num)),
pm AS (
  SELECT file, product, codon_num, max(variable_sites) AS variable_sites, sum(p * n_sites) AS hn, sum(p * s_sites) AS hs, sum(p * coalesce(n_diff, 0)) AS nr, sum(p * coalesce(s_diff, 0)) AS sr
  FROM hp JOIN vc USING (file, product, codon_num) JOIN sdim USING (codon) LEFT JOIN pdim ON pdim.a = ref_codon AND pdim.b = hp.codon GROUP BY ALL),
pw AS (
  SELECT x.file, x.product, x.codon_num, sum(x.cnt * y.cnt / (x.coverage * (x.coverage - 1) / 2) * coalesce(n_diff, 0)) AS nd, sum(x.cnt * y.cnt / (x.coverage * (x.coverage - 1) / 2) * coalesce(s_diff, 0)) AS sd
  FROM al x JOIN al y ON x.file = y.file AND x.product = y.product AND x.codon_num = y.codon_num AND x.site = y.site AND x.codon < y.codon LEFT JOIN pdim ON pdim.a = x.codon AND pdim.b = y.codon GROUP BY ALL),
pg AS (SELECT file, product, codon_num, sum(gdiv) / 3 AS gdiv, avg(gdiv) FILTER (WHERE class = 'Nonsynonymous') AS N_gdiv, avg(gdiv) FILTER (WHERE class = 'Synonymous') AS S_gdiv FROM ps WHERE product <> 'noncoding' GROUP BY ALL),
po AS (SELECT product, codon_num, CAST(sum(CAST(overlapping > 0 AS INT)) AS BIGINT) AS num_overlap_ORF_nts FROM cds JOIN ov USING (site) GROUP BY ALL),
pcod AS (
  SELECT f.file, rc.product, rc.codon_num, rc.start_site AS site, rc.codon, num_overlap_ORF_nts, coalesce(nd, 0.0) AS N_diffs, coalesce(sd, 0.0) AS S_diffs,
         coalesce(hn, n_sites) AS N_sites, coalesce(hs, s_sites) AS S_sites, n_sites AS N_sites_ref, s_sites AS S_sites_ref, CAST(coalesce(variable_sites, 0) AS INT) AS variable_sites,
         coalesce(nr, 0.0) AS N_diffs_vs_ref, coalesce(sr, 0.0) AS S_diffs_vs_ref, coalesce(pg.gdiv, 0.0) AS gdiv, N_gdiv, S_gdiv
  FROM rc CROSS JOIN (SELECT DISTINCT file FROM v) f JOIN sdim ON sdim.codon = rc.codon JOIN po ON po.product = rc.product AND po.codon_num = rc.codon_num
  LEFT JOIN pm ON pm.file = f.file AND pm.product = rc.product AND pm.codon_num = rc.codon_num
  LEFT JOIN pw ON pw.file = f.file AND pw.product = rc.product AND pw.codon_num = rc.codon_num
  LEFT JOIN pg ON pg.file = f.file AND pg.product = rc.product AND pg.codon_num = rc.codon_num),
once AS (
  SELECT file, site, max(pi) AS pi, max(gdiv) AS gdiv, min(class) AS class, bool_or(product <> 'noncoding') AS coding FROM ps GROUP BY file, site)"""


# A base of the made-up sequences; codons from the sites of each product in order of their starts.
FASTA = """
fp(product, a, b) AS (VALUES {products}),
fs AS (SELECT product, CAST(i AS INT) AS i, row_number() OVER (PARTITION BY product ORDER BY a, i) - 1 AS place FROM fp, range(1, 61) t(i) WHERE i BETWEEN a AND b),
fb AS (SELECT c_custkey AS k, 'g' || CAST(c_nationkey % 3 AS VARCHAR) AS grp, i,
  CASE WHEN (c_custkey + i) % 41 = 0 THEN 'N' ELSE substr('ACGT', CAST((c_custkey * (i + 3) + i * i + (c_custkey * c_custkey // 7) % (i + 2)) % 4 AS INT) + 1, 1) END AS nt FROM customer, range(1, 61) t(i)),
fc AS (SELECT k, grp, product, CAST(place // 3 + 1 AS INT) AS codon_num, string_agg(nt, '' ORDER BY place) AS codon FROM fb JOIN fs USING (i) GROUP BY k, grp, product, place // 3),
cc AS (SELECT grp, product, codon_num, CASE WHEN regexp_matches(codon, '^[ACGT]{{3}}$') THEN codon END AS codon, CAST(count(*) AS BIGINT) AS cnt FROM fc
  GROUP BY ALL)""".format(products=", ".join(f"('{p}', {a}, {b})" for p, a, b in FASTA_PRODUCTS))

# The reference, the variants and the products of the other strand, in its own coordinates.
MINUS = (
    POOL.replace(_SEGMENTS, ", ".join(f"('{p}', {GENOME} - {b} + 1, {GENOME} - {a} + 1)" for p, a, b in MINUS_SEGMENTS))
    .replace("pref AS (SELECT CAST(i AS INT) AS site, substr('ACGT'", "pref AS (SELECT CAST(%d - i AS INT) AS site, substr('TGCA'" % (GENOME + 1))
    .replace("v1 AS (SELECT file, site, substr('ACGT', CAST(ix AS INT) + 1, 1) AS ref, substr('ACGT'", "v1 AS (SELECT file, %d - site AS site, substr('TGCA', CAST(ix AS INT) + 1, 1) AS ref, substr('TGCA'" % (GENOME + 1))
    .replace("site % 13 AS coverage", "(%d - site) %% 13 AS coverage" % (GENOME + 1))
)


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
