"""Registered queries of the subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import (
    align, bilinear, bpe, decontaminate, html, language, preference, quality_rules, secrets, simhash, substrings, toxicity, variants,
)
from lakeops.llm.shared import documents, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def held_out(modulus: int = 5, remainder: int = 0):
    return (fold(F.col("doc_id"), modulus) == remainder).alias("held_out")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.fit_languages(docs))
    return found.select("doc_id", held_out(), F.col("nearest").alias("lang_pred"), "score", "rejected")


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(RANKS)
    both = documents(spark, sf_dir).select("doc_id", bpe.round_trip("text", tokens, public_tokenizers.PATTERN).alias("r")).select("doc_id", "r.*")
    return both.select(
        "doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = preference.rank_documents(docs, preference.fit_ranking(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(), "score", "predicted")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(), "score", "predicted")


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS row_no,
           coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents
), windows AS (
    SELECT doc_id, row_no, s, md5(array_to_string(words[s : s + 49], ' ')) AS h
    FROM (SELECT doc_id, row_no, words, unnest(range(1, len(words) - 48)) AS s FROM docs WHERE len(words) >= 50)
), firsts AS (
    SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT row_no, unnest(range(s, s + 50)) AS p
    FROM windows JOIN firsts USING (h) WHERE doc_id > first_id
), lists AS (
    SELECT row_no, count(*) AS n_removed, list(p) AS places FROM gone GROUP BY row_no
), spread AS (
    SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs JOIN lists USING (row_no)
), kept AS (
    SELECT s.row_no, string_agg(s.word, ' ' ORDER BY s.p) AS text
    FROM spread s ANTI JOIN gone g ON s.row_no = g.row_no AND s.p = g.p GROUP BY s.row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM docs LEFT JOIN lists USING (row_no) LEFT JOIN kept USING (row_no)
"""


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = bilinear.fit_bilinear(docs, fold(F.col("doc_id"), 7) != 2)
    found = bilinear.score_documents(docs, model)
    return found.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.vocabulary(variants.count_words(documents(spark, sf_dir))))


@query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = align.read_vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    docs = documents(spark, sf_dir)
    coded = align.tokenize(docs, both)
    found = align.align(coded, both, align.count_pairs(coded, both), groups=lambda text: F.when(text == "", "").otherwise(F.sha2(text, 256)))
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract("html").alias("r"))
    return pages.select("page_id", "url", "r.text", F.char_length("r.text").cast("long").alias("n_chars"))
