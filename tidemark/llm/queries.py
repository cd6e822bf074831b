"""The registered queries of the training-data operators, over the whole given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, lbl, lines, media, mixing, negatives, packing, rules, search, simhash, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_log_bilinear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_texts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def bpe_codec(spark: SparkSession) -> bpe.ByteBpe:
    return bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again."""
    codec = bpe_codec(docs.sparkSession)
    back = codec.round_trip(docs)
    ids = F.sha2(bpe.ids_text(F.col("ids")), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored rules first, mined ones for the rest. In the given tables labels do not follow the URL: no combination of tokens is surely
    bad often enough, none is mined, and what no authored rule decides is allowed. Tests hold the mining on tables where labels do."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "line_counts.lines_in", "line_counts.lines_out", "text")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.vectors(rows.withColumn("label", shifted)), F.col("vec_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_simhash_near_duplicates": op1_simhash_near_duplicates,
    "op2_media_chunks": op2_media_chunks,
    "op3_language_id": op3_language_id,
    "op4_log_bilinear_score": op4_log_bilinear_score,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_duplicates": op6_exact_duplicates,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_packing": op13_vector_packing,
}

QUERY_ORACLE_SQL = {
    "op6_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
              FROM documents)
        WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op10_source_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
            FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
        ranked AS (
            SELECT *, 2 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
            FROM totals),
        levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                      / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
            FROM ranked
            WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source IS NULL, source)),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN cap > level * weight THEN max(CASE WHEN cap > level * weight THEN level END) OVER () * weight ELSE cap END::DOUBLE AS target
            FROM levels),
        budgets AS (
            SELECT *, (target >= source_size)::INT AS base,
                   CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget
            FROM targets),
        steps AS (SELECT source, hash, sum(size) AS words FROM sizes GROUP BY source, hash),
        ends AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash)::DOUBLE AS upto FROM steps),
        chosen AS (
            SELECT e.source, e.hash, b.source_size, b.target,
                   b.base + (upto <= budget OR (upto - words < budget AND upto - budget < budget - (upto - words)))::INT AS copies
            FROM ends e JOIN budgets b ON e.source IS NOT DISTINCT FROM b.source)
        SELECT s.doc_id, s.size, c.source_size, c.target, s.size * c.copies AS taken
        FROM sizes s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.hash = c.hash
    """,
    "op11_hard_negatives": """
        WITH rows AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        pairs AS (
            SELECT DISTINCT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
        positives AS (
            SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
            FROM pairs WHERE label = anchor_label
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER best::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> p.anchor_label
             AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER best <= 5
    """,
    "op12_ranked_search": r"""
        WITH texts AS (
            SELECT 'd' || row_number() OVER () AS row, doc_id AS id, text FROM documents
            UNION ALL SELECT 'q' || row_number() OVER (), item_id, text FROM benchmark),
        words AS (
            SELECT row, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM texts),
        counts AS (SELECT row, id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY row)::BIGINT AS n FROM words GROUP BY row, id, term),
        docs AS (SELECT * FROM counts WHERE row[1] = 'd'),
        total AS (SELECT count(DISTINCT row) AS docs, sum(tf)::BIGINT AS terms FROM docs),
        weights AS (SELECT term, floor(1000 * ln((2 * max(total.docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM docs, total GROUP BY term),
        scored AS (
            SELECT q.row AS item, q.id AS item_id, d.row, d.id AS doc_id,
                   sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 75 + (75 * d.n * total.docs) // total.terms))))::BIGINT AS score
            FROM counts q JOIN docs d ON q.term = d.term JOIN weights ON weights.term = d.term, total
            WHERE q.row[1] = 'q'
            GROUP BY ALL)
        SELECT item_id, row_number() OVER best::INT AS rank, doc_id, score
        FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 10
    """,
}
