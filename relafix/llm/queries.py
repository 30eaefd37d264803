"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relafix.llm import alignment, ann, chat, gridjoin, jaccard, mixing, pieces, pii, quality, quantise, tiff, toxicity, urlfilter
from relafix.tables import table

#: (verdict, host, path) of the url query.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


#: A SentencePiece model of the machine; read by path, never copied into the repository.
PIECE_MODEL = os.environ.get("RELAFIX_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: A byte-level BPE in the JSON form, likewise.
BYTE_MODEL = os.environ.get("RELAFIX_BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "content_score", "metadata_score", (F.col("quality_score") >= 0.5).alias("accepted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL)


_URL_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), best AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n
)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (n)
"""

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 6) -> str:
    """The quantiser round by round; distances and means on whole numbers."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_KEPT})",
        "cut AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, range(8) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM cut WHERE r <= 16)",
    ]
    near = "SELECT cut.r, cut.p, any_value(cut.v) AS v, min(list_sum(list_transform(list_zip(cut.v, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 16 + b.e) AS m FROM cut JOIN book{i} b ON b.p = cut.p GROUP BY cut.r, cut.p"
    for i in range(rounds):
        steps.append(f"code{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(f"sum{i} AS (SELECT p, m % 16 AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM code{i}, range(1, 65) AS t(i) WHERE i <= len(v) GROUP BY 1, 2, 3)")
        steps.append(f"mean{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sum{i} GROUP BY p, e)")
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(mean{i}.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} ON mean{i}.p = b.p AND mean{i}.e = b.e)")
    steps.append(f"code{rounds} AS MATERIALIZED ({near.format(i=rounds)})")
    steps.append(f"told AS (SELECT r, string_agg(printf('%02x', (m % 16)::INT), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM code{rounds} GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN told USING (r), digest"


_NEAR_SQL = f"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND {_KEPT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, coalesce(low, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id
"""


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_toxicity": op2_toxicity,
        "op3_mixing": op3_mixing,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_tiff": op5_tiff,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_quality": op7_quality,
        "op8_url_filters": op8_url_filters,
        "op9_personal_data": op9_personal_data,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_vector_codes": op11_vector_codes,
        "op12_embedding_near_dedup": op12_embedding_near_dedup,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": _URL_SQL, "op11_vector_codes": _codes_sql(), "op12_embedding_near_dedup": _NEAR_SQL}
