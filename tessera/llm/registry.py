"""The subpackage's queries: one ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.clusters import centroid_clusters
from tessera.llm.codes import vector_codes
from tessera.llm.common import table
from tessera.llm.decontamination import contamination_report
from tessera.llm.embeddings import embedding_dedup
from tessera.llm.jaccard import jaccard_components
from tessera.llm.language import language
from tessera.llm.packing import packing_digest
from tessera.llm.pii import personal_data
from tessera.llm.quality import quality
from tessera.llm.suffixes import remove_repeats
from tessera.llm.token_counts import sample_edits, token_counts
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import url_filter


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, sample_edits(docs["text"]))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_jaccard_join, op3_suffix_dedup, op4_decontamination, op5_toxicity, op6_embedding_dedup, op7_language, op8_packing, op9_quality, op10_url_filter, op11_pii, op12_vector_codes, op13_centroid_clusters)}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
         FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM spots JOIN wins USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


_OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 4) - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a) l USING (vec_id)
"""


_OP10 = r"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, ruled) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(ruled, length(rule_host || rule_path)) AS ruled
         FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
judged AS (SELECT p.page_id, html, host, path, rule, ruled FROM p LEFT JOIN fits USING (page_id)),
targets AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]*)', 1)) AS target FROM p WHERE host <> ''),
edges AS (SELECT src, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(*) AS n FROM targets WHERE target <> '' GROUP BY ALL HAVING src <> dst),
walks AS (SELECT 'trust' AS walk, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
          UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
steps AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, CAST(count(*) AS DOUBLE) AS mass FROM judged WHERE ruled IS NOT NULL GROUP BY ALL
          UNION ALL SELECT w.walk, w.b, 0.85 * s.mass * w.share FROM steps s JOIN walks w ON w.walk = s.walk AND w.a = s.host WHERE s.mass > 1e-9),
hosts AS (SELECT host, count(*) AS pages FROM judged GROUP BY host),
scores AS (SELECT host, sum(CASE walk WHEN 'distrust' THEN mass ELSE -mass END) AS s FROM steps GROUP BY host),
blocked AS (SELECT host FROM hosts JOIN scores USING (host) WHERE s / pages >= 0.5 AND host <> '')
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op12(rounds: int = 2) -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM embeddings WHERE {_FINITE}),
parts AS (SELECT r, vec_id, p, len(x) // 16 AS w, list_slice(x, 1 + p * (len(x) // 16), (p + 1) * (len(x) // 16)) AS x FROM v, range(16) AS _(p)),
book0 AS (SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"""]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS (SELECT r, p, any_value(x) AS x, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e]) AS found FROM parts JOIN book{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, found[2] AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, 1 + len(x)) AS _(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return f"""
WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT r, string_agg(lpad(printf('%x', found[2]), 2, '0'), '' ORDER BY p) AS code, CAST(sum(found[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), digest
"""


def _op13(rounds: int = 3) -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"""]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS (SELECT r, any_value(x) AS x, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k]) AS found FROM v, c{k} GROUP BY r)")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT found[2] AS k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, 65) AS _(i) GROUP BY ALL) GROUP BY k),
c{k + 1} AS (SELECT k, coalesce(m.c, b.c) AS c FROM c{k} b LEFT JOIN mean{k} m USING (k))""")
    return f"""
WITH {", ".join(steps)},
placed AS (SELECT r, found[2] AS k, CAST(found[1] AS BIGINT) AS distance FROM near{rounds})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN placed USING (r) JOIN c{rounds} USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": _OP2, "op4_decontamination": _OP4, "op6_embedding_dedup": _OP6, "op10_url_filter": _OP10, "op12_vector_codes": _op12(), "op13_centroid_clusters": _op13()}
