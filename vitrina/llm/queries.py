"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import decontamination, fingerprints, licenses, near_vectors, pii, piece_bpe, quality, resample, sharding, text_join, token_files, url_filter, whitening
from vitrina.sources.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("pii")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95).drop("embedding")


def op5_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return text_join.classify(table(spark, sf_dir, "documents"), n=4, num=85, den=100).drop("text_hash")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the 32k piece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)


# The rules of the query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Re-Pair blocks of word-model ids, written and read back."""
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_files.read_token_files(spark, path, ids=False)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents drawn by their likeness to the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_vectors": op4_vectors,
    "op5_text_join": op5_text_join,
    "op6_pieces": op6_pieces,
    "op7_urls": op7_urls,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_token_files": op10_token_files,
    "op11_resample": op11_resample,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op11_resample": resample.ORACLE,
    "op5_text_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
            FROM documents
        ), g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS s FROM d
        ), e AS (
            SELECT doc_id, len(s) AS n, UNNEST(s) AS x FROM g
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb
            FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        )
        SELECT doc_id, len(s) AS n_shingles, (SELECT MIN(b) FROM reach r WHERE r.a = doc_id) AS component_id FROM g
    """,
    "op4_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), component AS (
            SELECT a, MIN(b) AS component_id FROM reach GROUP BY a
        ), degree AS (
            SELECT a, COUNT(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN component c ON c.a = vec_id LEFT JOIN degree d ON d.a = vec_id
    """,
}
