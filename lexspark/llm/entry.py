"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import clusters, conversations, decontaminate, html, media, neardup, packing, quality, rules, secrets, sharding, tokens, warc

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(html) AS digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY sha256(html)) ELSE page_id END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM d
"""

OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
links AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, k.b FROM r JOIN links k ON k.a = r.root),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_bfd_shards": sharding.query,
        "op2_simhash_leaks": decontaminate.query,
        "op3_avi_clips": media.query,
        "op4_main_text": html.query,
        "op5_token_files": tokens.query,
        "op6_cutting_stock": packing.query,
        "op7_warc_chain": warc.query,
        "op8_setsketch_neardup": neardup.query,
        "op9_byte_cnn_quality": quality.query,
        "op10_secret_spans": secrets.query,
        "op11_mean_variance_clusters": clusters.query,
        "op12_line_field": rules.query,
        "op13_target_alignment": conversations.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict:
    return {"op7_warc_chain": OP7, "op8_setsketch_neardup": OP8, "op11_mean_variance_clusters": clusters.oracle(), "op13_target_alignment": conversations.ORACLE}
