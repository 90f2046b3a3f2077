"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onceflow.llm.common import table
from onceflow.llm.license import oracle as license_oracle
from onceflow.llm.mixing import ORACLE as MIX


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.decontam import edit_matches

    return edit_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.warc import capture_index

    return capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_max_score_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onceflow.llm.license import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


_ALL = (
    op1_source_mix, op2_quality_classifier, op3_attention_lm, op4_toxicity, op5_ngram_jaccard_join, op6_benchmark_decontamination, op7_warc_index_merge, op8_separator_scan,
    op9_max_score_top_k, op10_license_scan,
)
QUERIES = {q.__name__: q for q in _ALL}
ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op7_warc_index_merge": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d""",
    "op1_source_mix": MIX,
    "op10_license_scan": license_oracle(),
    "op9_max_score_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, q.r AS q_r, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
     t AS (SELECT *, row_number() OVER (PARTITION BY q_r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM t WHERE n <= 20""",
}
