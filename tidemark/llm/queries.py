"""The operators on their whole tables, under the driver's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import convrepair, crosstoken, decontam, langid, linededup, metricjoin, packing, quality, secrets, simhash, tokenindex, urlfilter, warc
from tidemark.llm.common import table
from tidemark.llm.tokens import vocabulary


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back."""
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of every document against the index of them all."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", linededup.kept_digest().alias("kept_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and entropy spans of every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.93 within labels, and their components."""
    return metricjoin.range_join(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the best alignment of each."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.language(table(spark, sf_dir, "documents"))


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id shards of all documents, read back through their indexes."""
    return tokenindex.token_index(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    out = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark, urlfilter.RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document, with corpus-wide counts of the linked pairs."""
    return crosstoken.alignments(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of every conversation."""
    return convrepair.repair(convrepair.damage(table(spark, sf_dir, "conversations")), gone="gone")


def op1_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, sha256(html) AS digest, octet_length(encode(html)) AS size FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE size >= {warc.LEAST_REVISIT} GROUP BY digest)
SELECT d.page_id, d.size::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND (d.page_id IS NULL OR d.page_id > f.first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS NULL OR d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (digest)"""


def op3_sql() -> str:
    """Matches lie between the pieces that splitting leaves; windows are written out and counted one by one."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    runs = "[A-Za-z0-9+/_=-]+"
    kinds = [(0, secrets.ASSIGN, 2, f"length(g) >= {secrets.LEAST_VALUE}"), (1, "AKIA[A-Z0-9]+", 0, "length(v) >= 16"), (2, "[0-9a-f]+", 0, "length(v) >= 32"), (9, runs, 0, f"length(v) >= {secrets.WINDOW}")]
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, v, st, st + length(v) AS en FROM (SELECT r, v, g, sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM (SELECT r, unnest(regexp_extract_all(t, {quoted(p)})) AS v, unnest(regexp_extract_all(t, {quoted(p)}, {g})) AS g, unnest(string_split_regex(t, {quoted(p)})) AS gap, unnest(range(len(string_split_regex(t, {quoted(p)})))) AS i FROM d)
  WINDOW w AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE v IS NOT NULL AND {test}"""
        for k, p, g, test in kinds
    )
    weights = "[" + ",".join(f"{w}::BIGINT" for w in secrets._WEIGHT) + "]"
    n = secrets.WINDOW
    names = "[" + ",".join(map(quoted, secrets.KINDS)) + "]"
    written = f"{names}[k + 1] || ':' || CAST(st AS BIGINT) || ':' || CAST(en AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
c0 AS (SELECT r, st, string_split_regex(v, {quoted(secrets.PIECE)}) AS gaps, regexp_extract_all(v, {quoted(secrets.PIECE)}) AS hits FROM f WHERE k = 9 AND regexp_matches(v, '[0-9]') AND NOT regexp_full_match(v, {quoted(secrets.ALLOW[0])}) AND v <> repeat(v[1], length(v))),
c AS (SELECT r, st, array_to_string(list_transform(range(len(gaps)), lambda i: gaps[i + 1] || CASE WHEN hits[i + 1] IS NULL THEN '' WHEN regexp_matches(hits[i + 1], {quoted(secrets.ALLOW_WORDS)}) THEN repeat('=', length(hits[i + 1])) ELSE hits[i + 1] END), '') AS v FROM c0),
x AS (SELECT r, st, a, substr(v, a + 1, {n}) AS x FROM (SELECT r, st, v, unnest(range(length(v) - {n - 1})) AS a FROM c)),
h AS (SELECT r, st, a, any_value(x) AS x, sum({weights}[n + 1]) AS weight FROM (SELECT r, st, a, x, ch, count(*) AS n FROM (SELECT r, st, a, x, unnest(string_split(x, '')) AS ch FROM x) GROUP BY ALL) GROUP BY 1, 2, 3),
hot AS (SELECT r, st, a, CASE WHEN regexp_full_match(x, '[0-9a-fA-F]+') THEN CASE WHEN regexp_matches(x, '[a-fA-F]') AND weight <= {secrets.most_weight(secrets.HEX_BITS)} THEN 3 END
    WHEN regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') THEN CASE WHEN weight <= {secrets.most_weight(secrets.BASE64_BITS)} THEN 4 END
    WHEN (regexp_full_match(x, '[0-9a-z]+') OR regexp_full_match(x, '[0-9A-Z]+')) AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= {secrets.ONE_CASE_DIGITS} AND regexp_matches(x, '[A-Za-z]') AND weight <= {secrets.most_weight(secrets.ONE_CASE_BITS)} THEN 5 END AS k FROM h WHERE regexp_matches(x, '[0-9]')),
j AS (SELECT *, CASE WHEN a - lag(a) OVER w <= {n} THEN 0 ELSE 1 END AS fresh FROM hot WHERE k IS NOT NULL WINDOW w AS (PARTITION BY r, st, k ORDER BY a)),
e AS (SELECT r, k, st + min(a) AS st, st + max(a) + {n} AS en FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, st, k ORDER BY a) AS island FROM j) GROUP BY r, st, k, island),
s AS (SELECT r, k, st, en FROM f WHERE k < 9 UNION ALL SELECT r, k, st, en FROM e),
g AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
    string_agg({written}, ',' ORDER BY st, k) FILTER (WHERE k < 3) AS base, string_agg({written}, ',' ORDER BY st, k) AS spans FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def op11_sql() -> str:
    """Every URL against every rule by text comparison."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    return f"""
WITH r(rh, rp, v) AS (VALUES {rules}),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS i FROM pages),
u AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter._UPPER}', '{urlfilter._LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (i)"""


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

OP4_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN n USING (vec_id)"""

QUERIES = {f.__name__: f for f in (op1_warc, op2_line_dedup, op3_secrets, op4_metric_join, op5_decontamination, op6_language, op7_token_index, op8_quality, op9_packing, op10_simhash, op11_url_filter, op12_cross_tokens, op13_conversation_repair)}
ORACLE_SQL = {"op1_warc": op1_sql(), "op2_line_dedup": OP2_SQL, "op3_secrets": op3_sql(), "op4_metric_join": OP4_SQL, "op11_url_filter": op11_sql()}
