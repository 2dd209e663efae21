"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import conversation_repair, exact_dedup, lexical_search, license_scan, lm_scoring, mixing, near_dedup, packing, pivot_index, preference, quality, text_media, url_templates
from sparkloom.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))


def word_vocabulary() -> str:
    """The tokenizer file of the contracts; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary(), seq_len=2048, end_id=0)


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_maximum_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media.text_media(table(spark, sf_dir, "documents"))


#: The contract's rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op3_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_templates.labels_from(table(spark, sf_dir, "labels"))
    return url_templates.url_verdicts(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(table(spark, sf_dir, "conversations"))


def op11_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_tiff": op2_tiff,
    "op3_template_tree": op3_template_tree,
    "op4_license_scan": op4_license_scan,
    "op5_pattern_packing": op5_pattern_packing,
    "op10_dart_minhash": op10_dart_minhash,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_factorisation_machine": op7_factorisation_machine,
    "op8_maximum_entropy": op8_maximum_entropy,
    "op9_entropy_balancing": op9_entropy_balancing,
    "op11_pivot_permutations": op11_pivot_permutations,
    "op12_nra_search": op12_nra_search,
    "op13_auction_repair": op13_auction_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_pivot_permutations": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r(node, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
        c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings e JOIN c ON e.vec_id = c.node LEFT JOIN n ON e.vec_id = n.a""",
    "op12_nra_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents),
        q AS (
            SELECT item_id, t, count(*) AS q
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
            GROUP BY ALL),
        c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
        p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
        w AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM q) GROUP BY t), c),
        s AS (
            SELECT item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}
