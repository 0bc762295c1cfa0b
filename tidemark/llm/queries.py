"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, fingerprints, hard_negatives, html_text, licenses, mixing, near_dedup, packing, sentencepiece_ids, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    return str(public_tokenizers.path(name))


def op1_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False).drop("ids")


def op3_improbable_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumns({"licenses": F.array_join("licenses", ","), "matches": F.to_json("matches")})


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url", "block_bytes")


def op7_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_ids.encode_documents(docs, vocabulary("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op9_block_rules_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), partial(vocabulary, "byte_bpe_50k.json"), partial(vocabulary, "piece_bpe_32k.model"))


def op12_tree_bound_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chained_passages,
        op2_curve_packing,
        op3_improbable_fingerprints,
        op4_fm_toxicity,
        op5_license_scan,
        op6_warc_dictionary,
        op7_weighted_near_dedup,
        op8_sentencepiece_ids,
        op9_block_rules_text,
        op10_cuckoo_exact_dedup,
        op11_arrow_alignment,
        op12_tree_bound_negatives,
        op13_hypergeometric_mix,
    )
}

SQL = {
    "op6_warc_dictionary": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                 CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
          FROM pages),
        q AS (
          SELECT page_id, payload_bytes, payload_digest,
                 CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
          FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q
    """,
    "op10_cuckoo_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_tree_bound_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (
          SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    # which words the mix takes follows from a document's place on its source's line, however blocks are dealt
    "op13_hypergeometric_mix": r"""
        WITH s AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS draw
          FROM documents),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
        w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM g),
        r AS (
          SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                    / CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
          FROM w),
        f AS (SELECT max(share) AS share FROM r WHERE share * weight <= 3 * source_size),
        t AS (SELECT w.source, w.source_size, least(f.share * w.weight, CAST(3 * w.source_size AS DOUBLE)) AS target FROM w CROSS JOIN f),
        l AS (
          SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
                 CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
          FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(place + size, take) - place) + greatest(0, least(source_size + place + size, take) - source_size - place)
                    + greatest(0, least(2 * source_size + place + size, take) - 2 * source_size - place) AS BIGINT) AS taken
        FROM l
    """,
}
