"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import decontam, htmltext, knn, linededup, mixing, pii, simhash, substrings, toxicity, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name, op):
    return lambda spark, sf_dir: op(_table(spark, sf_dir, name))


QUERIES = {
    "op1_warc": _on("pages", warc.op1_digest),
    "op2_line_dedup": _on("documents", linededup.op2_lines),
    "op3_topk": _on("embeddings", knn.op3_topk),
    "op4_html": _on("pages", htmltext.extract),
    "op5_decontam": lambda spark, sf_dir: decontam.op5_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    "op6_toxicity": lambda spark, sf_dir: toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op7_mixing": _on("documents", mixing.op7_mix),
    "op8_simhash": _on("documents", simhash.op8_components),
    "op9_pii": _on("documents", pii.op9_spans),
    "op10_substrings": _on("documents", substrings.op10_bytes),
}

SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
g AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN g.first IS NOT NULL AND q.page_id <> g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first IS NOT NULL AND q.page_id <> g.first THEN g.first END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d AND q.n >= 100
""",
    "op2_line_dedup": linededup.OP2_SQL,
    "op3_topk": knn.OP3_SQL,
}
