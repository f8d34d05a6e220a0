"""The queries of the ten operators, one opN_<name> each, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import chosen_path, decontamination, embedding_dedup, kneser_ney, mixing, pii_tagger, suffix_dedup, suffix_tree, token_counts, warc
from lattica.llm.common import read_table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(read_table(spark, sf_dir, "embeddings"))


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.find(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_chosen_path, op3_suffix_dedup, op4_decontamination, op5_mixing, op6_embedding_dedup, op7_pii_tagger, op8_token_counts, op9_suffix_tree, op10_warc)}


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op4_decontamination": f"""
WITH w AS (SELECT doc_id, {WORDS} ws FROM documents), b AS (SELECT item_id, {WORDS} ws FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR item, ws[i:i + 9] g, len(ws[i:i + 9]) n FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, ws[i:i + n - 1] g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM w), lens WHERE i + n - 1 <= len(ws)),
hit AS (SELECT doc_id, i, n, item FROM pos JOIN win USING (g, n)),
hw AS (SELECT doc_id, count(DISTINCT k) c FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) c, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) s FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.c, 0) AS n_hit, coalesce(it.c, 0) AS n_items, coalesce(it.s, sha256('')) AS items_sha256, coalesce(hw.c, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id v, embedding::DOUBLE[] x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) l FROM embeddings),
p AS MATERIALIZED (SELECT a.v a, b.v b FROM e a JOIN e b ON a.v <> b.v WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.95),
r(a, b) AS (SELECT v, v FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
d AS (SELECT a, count(*) n FROM p GROUP BY a), c AS (SELECT a, min(b) m FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(d.n, 0) AS n_links, c.m AS component_id, c.a = c.m AS kept FROM c LEFT JOIN d ON d.a = c.a""",
    "op10_warc": """
WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT b, sha1(coalesce(html, '')) d FROM pages), m AS (SELECT d, max(page_id) m FROM q WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q LEFT JOIN m USING (d)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
