"""SQL that computes what the training-data queries return, from the tables alone."""

from __future__ import annotations

from .quality_rules import COMMON_MARKS, TOP_BAND, Limits, common_words

WARC = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.url, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

# Every pair of vectors, then everything that links reach.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT s, b FROM reach JOIN link ON t = a),
least AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY s),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""

# Every string of 100 bytes by its digest; bytes as pairs of hexadecimal digits.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS begins FROM c),
r AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY doc_id, run),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
 UNION ALL SELECT doc_id, coalesce(max(runs.b), 0), max(length(h) // 2) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, length(h) // 2 - length(k) // 2 AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def rules(limits: Limits = Limits()) -> str:
    """Counts, both distances and the verdict of every document."""
    words = "[" + ", ".join(f"'{w}'" for w in common_words()) + "]"
    taken = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    share = lambda c: f"list_transform({c}, lambda x: CAST(x AS DOUBLE) / list_sum({c}))"
    part = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"
    pair = f"{part('z[1]', '(z[1] + z[2]) / 2')} + {part('z[2]', '(z[1] + z[2]) / 2')}"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {pair})) / 2, 0))"
    pooled = lambda c, by: f"SELECT {by} list(n ORDER BY k) AS ref FROM (SELECT {by} k, sum(v) AS n FROM (SELECT lang, unnest({c}) AS v, generate_subscripts({c}, 1) AS k FROM h WHERE NOT base_failed) GROUP BY ALL) GROUP BY ALL"
    limit = f"least(greatest((med + {limits.word_spreads} * spread) / 10000, {limits.min_word_limit}), {limits.max_word_distance})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (SELECT doc_id, i, ws[i : i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) x(k) WHERE times > 1 GROUP BY doc_id),
c AS (SELECT doc_id, lang, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {taken("[#*$%&|<>]")} AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words, list_filter(list_transform(ws, lambda x: lower(x)), lambda x: list_contains({words}, x)) AS hits
  FROM d LEFT JOIN cov USING (doc_id)),
k AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [{taken("\\p{Lu}")}, {taken("\\p{Ll}")}, {taken("[0-9]")}, {taken("[" + COMMON_MARKS.replace("'", "''") + "]")}, n_symbols, length(t) - word_chars] AS six, list_transform({words}, lambda w: len(list_filter(hits, lambda x: x = w))) AS own FROM c),
h AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, list_append(six, greatest(length(t) - list_sum(six), 0)) AS chars, list_append(own, greatest(n_words - list_sum(own), 0)) AS bins FROM k),
enough AS (SELECT lang FROM h WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {limits.min_docs}),
rc AS ({pooled("chars", "lang,")}), rb AS ({pooled("bins", "lang,")}), oc AS ({pooled("chars", "")}), ob AS ({pooled("bins", "")}),
j AS (SELECT h.*, CASE WHEN enough.lang IS NULL THEN '' ELSE '=' || h.lang END AS key, least(floor(log2(greatest(n_words, 2))), {TOP_BAND}) AS band,
  CASE WHEN enough.lang IS NULL THEN oc.ref ELSE rc.ref END AS qc, CASE WHEN enough.lang IS NULL THEN ob.ref ELSE rb.ref END AS qb
  FROM h LEFT JOIN enough USING (lang) LEFT JOIN rc USING (lang) LEFT JOIN rb USING (lang) LEFT JOIN oc ON TRUE LEFT JOIN ob ON TRUE),
s AS (SELECT * EXCLUDE (chars, bins, qc, qb), CASE WHEN word_chars >= {limits.min_chars} THEN {distance(share("chars"), share("qc"))} END AS cd, CASE WHEN n_words >= {limits.min_words} THEN {distance(share("bins"), share("qb"))} END AS wd FROM j),
near AS (SELECT key, b AS band, round(wd * 10000) AS step FROM s, (VALUES (0), (1)) x(one), LATERAL (SELECT CASE WHEN one = 0 THEN 0 ELSE s.band END AS b) WHERE NOT base_failed AND wd IS NOT NULL),
m AS (SELECT key, band, quantile_cont(step, 0.5) AS med, count(*) AS n FROM near GROUP BY ALL),
sp AS (SELECT key, band, med, n, quantile_cont(abs(step - med), 0.5) AS spread FROM near JOIN m USING (key, band) GROUP BY ALL),
lim AS (SELECT key, band, {limit} AS most FROM sp WHERE n >= {limits.min_docs})
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance,
  NOT base_failed AND coalesce(cd, 0) <= {limits.max_char_distance} AND coalesce(wd, 0) <= coalesce(own.most, whole.most, {limits.max_word_distance}) AS kept
FROM s LEFT JOIN lim own ON own.key = s.key AND own.band = s.band LEFT JOIN lim whole ON whole.key = s.key AND whole.band = 0"""


# Every anchor against every row.
NEGATIVES = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s, a.label = b.label AS same FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
FROM t JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op3_embedding_dedup": EMBEDDINGS, "op5_suffix_dedup": SUFFIX, "op10_quality_rules": rules(), "op11_hard_negatives": NEGATIVES}
