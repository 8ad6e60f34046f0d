"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, html_extract, mixing, ngram_join, packing, secret_scan, token_counts, toxicity, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("repeated")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Starts are sums of gaps and matches before; overlaps are compared pair by pair."""
    kinds = [
        (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "regexp_extract(hit, {0}, 1)", "len(value) >= 6"), ("AKIA[A-Z0-9]+", "hit", "len(value) >= 20"), ("[0-9a-f]+", "hit", "len(value) >= 24"),
        ("[A-Za-z0-9_-]+", "hit", "len(value) >= 24 AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') AND random"),
    ]
    quoted = ["'" + p.replace("'", "''") + "'" for p, _, _ in kinds]
    found = " UNION ALL ".join(f"SELECT rk, owner, repository, {k} AS kind, regexp_extract_all(text, {q}, 0) AS hits, string_split_regex(text, {q}) AS gaps FROM t" for k, q in enumerate(quoted))
    value = "CASE kind " + " ".join(f"WHEN {k} THEN {v.format(quoted[k])}" for k, (_, v, _) in enumerate(kinds)) + " END"
    keep = "CASE kind " + " ".join(f"WHEN {k} THEN {c}" for k, (_, _, c) in enumerate(kinds)) + " END"
    name = "['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rk, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '-') AS owner,
         coalesce('=' || source, '-') || chr(1) || coalesce('=' || lang, '-') AS repository FROM documents),
found AS ({found}),
hits AS (SELECT rk, owner, repository, kind, i, hits[i] AS hit, len(gaps[i]) + len(hits[i]) AS size FROM found, unnest(range(1, len(hits) + 1)) u(i)),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rk, kind ORDER BY i) AS BIGINT) AS stop, {value} AS value FROM hits),
judged AS (
  SELECT *, stop - len(hit) AS start,
         len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(value, '(?i)example|sample|dummy|xxxx|test')
         AND NOT list_contains(list_transform(range(1, greatest(len(value) - 4, 1)), lambda j: substr(value, j, 6) = repeat(substr(value, j, 1), 6)), TRUE) AS random
  FROM placed),
kept AS (SELECT * FROM judged WHERE {keep}),
spans AS (
  SELECT * FROM kept m WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.rk = m.rk AND b.kind < 3 AND b.start < m.stop AND b.stop > m.start)),
owned AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY value),
every AS (SELECT s.*, owners = 1 AND random AS live, owners >= 3 AS example, {name} AS name FROM spans s JOIN owned USING (value)),
docs AS (
  SELECT rk, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans,
         count(*) FILTER (WHERE kind = 3 AND live) AS n_owned, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example
  FROM every GROUP BY rk)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN docs USING (rk)"""


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_html_extraction, op4_packing, op5_nearest_neighbours, op6_secret_scan, op7_ngram_join, op8_toxicity, op9_warc, op10_token_counts)}

ORACLE_SQL = {
    "op1_mixing": r"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, digest) AS nth FROM keyed),
base AS (
  SELECT doc_id, source, size,
         ('0x' || substr(CASE WHEN nth = 1 THEN digest ELSE md5(digest || ':' || nth) END, 1, 15))::BIGINT AS h
  FROM numbered),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM sizes),
weighted AS (
  SELECT *, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap,
         CAST(source_size * 3 AS DOUBLE) / CAST((rk - 1) % 3 + 1 AS DOUBLE) AS room, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY room, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY room, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
lowest AS (SELECT *, arg_min(level, {'a': room, 'b': rk}) FILTER (WHERE level <= room) OVER () AS low FROM levels),
targets AS (
  SELECT source, rk, source_size, total, CASE WHEN low IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), low * weight) END AS target FROM lowest),
queue AS (
  SELECT b.doc_id, b.size, b.h, t.*, sum(b.size) OVER (PARTITION BY b.source ORDER BY h) AS upto
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT rk, h, size, total, epoch, ((epoch - 1) * source_size + upto) / target AS finish
  FROM queue, (VALUES (1), (2), (3)) e(epoch) WHERE target > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, rk) AS used FROM copies),
cuts AS (SELECT rk, epoch, max(h) AS cut FROM ordered WHERE used <= total GROUP BY rk, epoch),
taken AS (
  SELECT q.doc_id, q.size, q.source_size, q.target, q.size * (SELECT count(*) FROM cuts c WHERE c.rk = q.rk AND q.h <= c.cut) AS taken FROM queue q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken FROM taken""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op6_secret_scan": _secrets_sql(),
    "op7_ngram_join": r"""
WITH RECURSIVE entries AS (
  SELECT row_number() OVER () AS e, coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS copies, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w
  FROM documents GROUP BY coalesce(text, '')),
sets AS (SELECT e, rep, copies, text, CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END AS grams FROM entries),
grams AS (SELECT e, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT a.e AS a, b.e AS b, count(*) AS met, any_value(a.n) AS n, any_value(b.n) AS m FROM grams a JOIN grams b ON a.gram = b.gram AND a.e < b.e GROUP BY 1, 2),
found AS (SELECT a, b FROM pairs WHERE met >= 0.8 * (n + m - met) - 1e-9),
links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
reach AS (SELECT e, e AS r FROM sets UNION SELECT reach.e, links.b FROM reach JOIN links ON links.a = reach.r),
classes AS (SELECT reach.e, min(s.rep) AS class_id FROM reach JOIN sets s ON s.e = reach.r GROUP BY 1),
linked AS (SELECT a AS e, sum(copies) AS others FROM links JOIN sets s ON s.e = links.b GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(grams) = 0 THEN d.doc_id ELSE class_id END AS class_id,
       CAST(CASE WHEN len(grams) = 0 THEN 0 ELSE coalesce(others, 0) + copies - 1 END AS BIGINT) AS n_links, CAST(len(grams) AS BIGINT) AS n_grams
FROM documents d JOIN sets s ON coalesce(d.text, '') = s.text JOIN classes USING (e) LEFT JOIN linked USING (e)""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p""",
}
