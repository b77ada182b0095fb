"""Training-data pipeline over ``documents``: quality rules, near-duplicate removal, benchmark
decontamination, removal of secrets, and byte-level BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. An empty table passes through;
null texts have no words and go with the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import bpe, decontaminate, quality_rules, secrets, simhash
from lakeops.llm.shared import documents, handover, table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _content() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the quality rules keep; the model is fitted on the labelled input documents."""
    model = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    verdict = _fresh(docs, "verdict")
    judged = docs.withColumn(verdict, quality_rules.verdict("text", model))
    return judged.filter(F.col(verdict)["kept"]).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, then the smallest hash of id and text; rows without
    an id come last. Rows are told apart by id and text, so two texts under one id are two documents."""
    row = _fresh(docs, "row_key")
    own = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.withColumn(row, own)
    groups = simhash.near_duplicates(keyed.select("doc_id", "text", row), keep=(row,))
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", F.col(row).alias("key"))).alias("first")
    stay = handover(groups.groupBy("root").agg(first).select(F.col("first.key").alias(row)), "stay")
    kept = keyed.join(stay.hint("merge"), row, "left_semi")  # one plan at every size
    return kept.dropDuplicates([row]).select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, told apart by their text: what their id is, or whether they have one,
    is no matter."""
    key = _fresh(docs, "content")
    keyed = docs.withColumn(key, _content())
    found = decontaminate.contaminated(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id_column=key)
    gone = handover(found.select(key).distinct(), "contaminated")
    return keyed.join(gone.hint("merge"), key, "left_anti").select(*_columns(docs))  # one plan at every size


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a placeholder; ``n_chars`` follows the new text. Spans belong
    to a content, so repeated rows and rows without an id are cleaned like any other."""
    key, spans = _fresh(docs, "content"), _fresh(docs, "found_spans")
    keyed = docs.withColumn(key, _content())
    found = secrets.find_secrets(keyed.select(key, "text"), key).filter(F.size("spans") > 0)
    marked = handover(found.groupBy(key).agg(F.first("spans").alias(spans)), "spans")
    joined = keyed.join(marked.hint("merge"), key, "left")  # one plan at every size
    hit = F.col(spans).isNotNull()
    cleaned = joined.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    cleaned = cleaned.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact): the ids of every text as little-endian 32-bit integers, and
    whether they decode to the text again."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = docs.select("doc_id", "text", bpe.round_trip("text", tokens, public_tokenizers.PATTERN).alias("r"))
    same = F.col("r.decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", bpe.n_tokens("r.ids").alias("n_tokens"), "r.ids", same.alias("intact"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", remove_secrets),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # the classifier, the hashes and the encoding have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = handover(stage(spark, docs, sf_dir), name)
    return docs
