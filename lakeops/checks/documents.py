"""Documents, chunks, retrieval and prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, r6, scratch_folder
from lakeops.functions import text as tx
from lakeops.operators import retrieval as rt
from lakeops.operators.events import newest, new_events
from lakeops.sources.tables import scan_knowledge
from lakeops.plans.documents import Stages, run_documents
from lakeops.streaming.ingest import append_new_chunks, document_chunks, stream_new_chunks

SIZE, OVERLAP = 800, 120
STEP = SIZE - OVERLAP

# ---- stand-ins: one page per document row, the source is the file ---------------------------------


def documents(t: Tables) -> DataFrame:
    """The test table is one file of one row group, so its texts are always spread over the cores."""
    return t.documents.repartition("doc_id")


def pages(t: Tables) -> DataFrame:
    return documents(t).select(
        F.col("source").alias("document_id"),
        F.concat("source", F.lit(".pdf")).alias("file_name"),
        F.col("doc_id").alias("page_number"),
        F.col("text").alias("page_text"),
        F.when(F.col("lang") == "de", "ocr").alias("extraction_method"),
    )


CLEAN_SQL = r"[\p{L}\p{N} \t\r\n.,;:!?''\"()\-/]+"
QUALITY_SQL = rf"""pages AS (SELECT source AS document_id, source || '.pdf' AS file_name, doc_id AS page_number, text AS page_text, CASE WHEN lang = 'de' THEN 'ocr' END AS extraction_method FROM documents),
  measured AS (SELECT *, coalesce(length(regexp_replace(page_text, '[^\p{{L}}]+', '', 'g')) / nullif(length(page_text), 0), 0) AS alpha_ratio,
    coalesce(length(regexp_replace(page_text, '{CLEAN_SQL}', '', 'g')) / nullif(length(page_text), 0), 0) AS ocr_noise_score FROM pages),
  quality AS (SELECT *, alpha_ratio >= 0.55 AND ocr_noise_score <= 0.06 AS is_usable FROM measured)"""
REPORT_SQL = """counted AS (SELECT document_id, file_name, count(*) AS total_pages, count(*) FILTER (is_usable) AS usable_pages, avg(ocr_noise_score) AS avg_ocr_noise_score FROM quality GROUP BY 1, 2),
  reports AS (SELECT *, total_pages - usable_pages AS unusable_pages, CASE WHEN usable_pages / total_pages >= 0.9 THEN 'high' WHEN usable_pages / total_pages >= 0.5 THEN 'medium' ELSE 'low' END AS quality_tier FROM counted)"""
WINDOWS_SQL = f"""windows AS (SELECT *, unnest(generate_series(0, CASE WHEN length(text) <= {SIZE} THEN 0 ELSE CAST(ceil((length(text) - {SIZE}) / {STEP}) AS BIGINT) END)) AS position FROM documents WHERE length(text) > 0),
  chunks AS (SELECT doc_id, source, lang, CAST(position AS INTEGER) AS position, substring(text, position * {STEP} + 1, {SIZE}) AS chunk_text FROM windows)"""
IDENTITY_SQL = r"""identified AS (SELECT *, doc_id || '-' || position AS chunk_id, lower(trim(regexp_replace(chunk_text, '[ \t\r\n]+', ' ', 'g'))) AS chunk_text_normalized FROM chunks)"""


def _hash_vector_sql(text: str) -> str:
    parts = ", ".join(
        f"CAST(CAST('0x' || substr(md5('{i}' || {text}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0 * 2.0 - 1.0" for i in range(8)
    )
    return f"[{parts}]::DOUBLE[]"


def chunks(t: Tables) -> DataFrame:
    rows = rt.chunk_rows(documents(t), "text", SIZE, OVERLAP, ["doc_id", "source", "lang"])
    return rt.chunk_identity(rows, ["doc_id"])


def text_of(column: str):
    return F.array_join(F.transform(column, lambda x: F.round(x, 6).cast("decimal(12,6)").cast("string")), ";")


VECTOR_TEXT_SQL = "array_to_string(list_transform({}, lambda x: CAST(CAST(round(x, 6) AS DECIMAL(12, 6)) AS VARCHAR)), ';')"

# ---- sources, quality, chunks ---------------------------------------------------------------------


@query("s2_knowledge_scan", "SELECT doc_id AS document_id, text AS document_text, lang, source FROM documents")
def s2(t: Tables) -> DataFrame:
    return scan_knowledge(t.spark, f"{t.sf_dir}/documents.parquet", "doc_id", "text", ["lang", "source"])


@query("k1_page_quality", f"WITH {QUALITY_SQL} SELECT page_number, round(alpha_ratio, 6) AS alpha_ratio, round(ocr_noise_score, 6) AS ocr_noise_score, is_usable FROM quality")
def k1(t: Tables) -> DataFrame:
    return rt.page_quality(pages(t)).select("page_number", r6("alpha_ratio"), r6("ocr_noise_score"), "is_usable")


@query("k2_document_report", f"""WITH {QUALITY_SQL}, {REPORT_SQL} SELECT document_id, total_pages, usable_pages, unusable_pages, round(avg_ocr_noise_score, 6) AS avg_ocr_noise_score, quality_tier,
  CASE WHEN quality_tier = 'high' THEN 'native' ELSE 'hybrid' END AS extraction_strategy, total_pages AS json_pages, quality_tier AS json_tier FROM reports""")  # fmt: skip
def k2(t: Tables) -> DataFrame:
    rows = rt.document_reports(rt.page_quality(pages(t)))
    return rows.select(
        "document_id", "total_pages", "usable_pages", "unusable_pages", r6("avg_ocr_noise_score"), "quality_tier", "extraction_strategy",
        F.get_json_object("report_json", "$.total_pages").cast("bigint").alias("json_pages"),
        F.get_json_object("report_json", "$.quality_tier").alias("json_tier"),
    )


@query("k3_page_rows", f"""WITH {QUALITY_SQL}, {REPORT_SQL} SELECT q.document_id, q.file_name, page_number, length(page_text) AS page_length, coalesce(extraction_method, 'native') AS extraction_method,
  quality_tier AS page_quality_tier, CASE WHEN page_number % 5 = 0 THEN true ELSE is_usable END AS is_usable FROM quality q JOIN reports r USING (document_id)""")  # fmt: skip
def k3(t: Tables) -> DataFrame:
    reports = rt.page_quality(pages(t))
    documents = rt.document_reports(reports)
    rows = rt.page_rows(pages(t), reports.filter(F.col("page_number") % 5 != 0), documents)
    return rows.withColumn("page_length", F.length("page_text")).drop("page_text")


@query("k4_chunks", f"WITH {WINDOWS_SQL} SELECT doc_id, position, chunk_text FROM chunks")
def k4(t: Tables) -> DataFrame:
    return rt.chunk_rows(documents(t), "text", SIZE, OVERLAP, ["doc_id"])


@query("k5_chunk_identity", f"WITH {WINDOWS_SQL}, {IDENTITY_SQL} SELECT chunk_id, doc_id, chunk_text_normalized, sha256(chunk_text_normalized) AS chunk_hash FROM identified")
def k5(t: Tables) -> DataFrame:
    return chunks(t).select("chunk_id", "doc_id", "chunk_text_normalized", "chunk_hash")


@query("k6_hash_embedding", f"SELECT doc_id, {VECTOR_TEXT_SQL.format(_hash_vector_sql('text'))} AS vector_text FROM documents")
def k6(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", tx.hash_embedding("text").alias("v")).select("doc_id", text_of("v").alias("vector_text"))


@query("k7_embedding_rows", f"WITH {WINDOWS_SQL}, {IDENTITY_SQL} SELECT chunk_id, 'offline-hash' AS embedding_model, {VECTOR_TEXT_SQL.format(_hash_vector_sql('chunk_text'))} AS vector_text FROM identified")
def k7(t: Tables) -> DataFrame:
    rows = rt.embedding_rows(chunks(t), "offline-hash")
    return rows.select("chunk_id", "embedding_model", text_of("embedding").alias("vector_text"))


@query("k7_embedding_provider", f"WITH {WINDOWS_SQL}, {IDENTITY_SQL} SELECT chunk_id, 'length' AS embedding_model, CAST(length(chunk_text) AS BIGINT) AS size FROM identified")
def k7_provider(t: Tables) -> DataFrame:
    def lengths(batches):
        for frame in batches:
            size = frame["chunk_text"].str.len().astype("float64")
            yield frame[["chunk_id"]].assign(embedding=[[s, 1.0] for s in size])

    rows = rt.embedding_rows(chunks(t), "length", lengths)
    return rows.select("chunk_id", "embedding_model", F.element_at("embedding", 1).cast("bigint").alias("size"))


@query("k18_index_rows", f"""WITH {WINDOWS_SQL}, {IDENTITY_SQL}, e AS (SELECT chunk_id, {_hash_vector_sql('chunk_text')} AS v FROM identified),
  n AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
  SELECT chunk_id, {VECTOR_TEXT_SQL.format('list_transform(v, lambda x: x / norm)')} AS vector_text FROM n""")  # fmt: skip
def k18(t: Tables) -> DataFrame:
    rows = rt.index_rows(rt.embedding_rows(chunks(t), "offline-hash"))
    return rows.select("chunk_id", text_of("vector").alias("vector_text"))


PLANES_SQL = " + ".join(
    f"CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(x) for x in plane]}::DOUBLE[]) > 0 THEN {1 << bit} ELSE 0 END"
    for bit, plane in enumerate(rt.hyperplanes(64, 8))
)


@query("k18_index_buckets", f"SELECT vec_id, {PLANES_SQL} AS bucket FROM embeddings")
def k18_buckets(t: Tables) -> DataFrame:
    return rt.index_rows(t.embeddings.select("vec_id", "embedding"), 64, 8).select("vec_id", "bucket")


CATALOG_SQL = "catalog AS (SELECT DISTINCT source AS document_id, upper(source) AS display_name FROM documents WHERE source <> 'src3')"


def catalog(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("document_id")).distinct().filter(F.col("document_id") != "src3")
    alias = F.concat(F.lit("doc "), "document_id")
    return rows.select("document_id", F.upper("document_id").alias("display_name"), F.array(alias, alias, F.col("document_id")).alias("aliases"))


@query("k17_catalog_aliases", f"WITH {CATALOG_SQL} SELECT document_id, display_name, unnest(['doc ' || document_id, document_id]) AS alias FROM catalog")
def k17(t: Tables) -> DataFrame:
    return rt.catalog_aliases(catalog(t))


@query("k17_display_names", f"WITH {CATALOG_SQL} SELECT doc_id, coalesce(display_name, source || '.pdf') AS display_name FROM documents LEFT JOIN catalog ON source = document_id")
def k17_names(t: Tables) -> DataFrame:
    named = rt.with_display_name(pages(t), catalog(t))
    return named.select(F.col("page_number").alias("doc_id"), "display_name")


# ---- search ---------------------------------------------------------------------------------------

CENTROIDS_SQL = """vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS vector FROM embeddings),
  parts AS (SELECT label, i, avg(vector[i]) AS x FROM vectors, generate_series(1, 64) s(i) GROUP BY 1, 2),
  centroids AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM parts GROUP BY 1),
  nearest AS (SELECT query_id, vec_id AS chunk_id, label, round(list_cosine_similarity(qv, vector), 12) AS score FROM centroids, vectors),
  top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM nearest QUALIFY rank <= {k})"""


def centroids(t: Tables) -> DataFrame:
    """One question per label: the mean of its vectors."""
    means = [F.avg(F.element_at("embedding", i).cast("double")) for i in range(1, 65)]
    return t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.array(*means).alias("vector"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query("k8_similar_chunks", f"WITH {CENTROIDS_SQL.format(k=5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def k8(t: Tables) -> DataFrame:
    return rt.similar_chunks(centroids(t), vectors(t), 5).select("query_id", "chunk_id", r6("score"), "rank")


# Small parts, so that blocks of questions meet many fragments of chunks.
@query("k8_similar_chunks_blocks", f"WITH {CENTROIDS_SQL.format(k=5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def k8_blocks(t: Tables) -> DataFrame:
    return rt.similar_chunks(centroids(t), vectors(t), 5, part_bytes=16_000).select("query_id", "chunk_id", r6("score"), "rank")


# The stated query set: every hundredth vector asks all vectors, each for its own number of results.
@query("k8_own_counts", f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0), w AS (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings),
  pairs AS (SELECT v.vec_id AS query_id, w.vec_id AS chunk_id, round(list_cosine_similarity(v.vector, w.vector), 12) AS score FROM v, w)
  SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM pairs
  QUALIFY rank <= 1 + query_id // 100 % 5""")  # fmt: skip
def k8_own(t: Tables) -> DataFrame:
    own = F.expr("CAST(1 + vec_id div 100 % 5 AS INT)").alias("wanted")
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), own)
    return rt.similar_chunks(asked, vectors(t), "wanted").select("query_id", "chunk_id", r6("score"), "rank")


def _fused_sql(questions: str) -> str:
    return f"""questions AS ({questions}),
  q AS (SELECT query_id, {_hash_vector_sql('question')} AS qv, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS qt FROM questions),
  c AS (SELECT chunk_id, {_hash_vector_sql('chunk_text')} AS cv, list_distinct(list_filter(regexp_split_to_array(lower(chunk_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS ct FROM identified),
  scored AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qv, cv), 12) AS vs FROM q, c),
  qterms AS (SELECT query_id, unnest(qt) AS term FROM q), cterms AS (SELECT chunk_id, unnest(ct) AS term FROM c),
  shared AS (SELECT query_id, chunk_id, count(*) AS ts FROM qterms JOIN cterms USING (term) GROUP BY 1, 2),
  lists AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vs DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 100
    UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, chunk_id) AS rank FROM shared QUALIFY rank <= 100),
  fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM lists GROUP BY 1, 2)"""


QUESTIONS_SQL = _fused_sql("SELECT item_id AS query_id, text AS question FROM benchmark")


def question_vectors(t: Tables) -> DataFrame:
    return t.benchmark.select(
        F.col("item_id").alias("query_id"), tx.hash_embedding("text").alias("vector"), tx.terms("text").alias("terms")
    )


@query("k9_hybrid_chunks", f"""WITH {WINDOWS_SQL}, {IDENTITY_SQL}, {QUESTIONS_SQL} SELECT query_id, chunk_id, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 5""")  # fmt: skip
def k9(t: Tables) -> DataFrame:
    index = chunks(t).select("chunk_id", tx.hash_embedding("chunk_text").alias("vector"), tx.terms("chunk_text").alias("terms"))
    return rt.hybrid_chunks(question_vectors(t), index, 5).select("query_id", "chunk_id", r6("score"), "rank")


@query("k10_manifest_columns", """SELECT doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS file_name FROM documents""")
def k10_manifest(t: Tables) -> DataFrame:
    """A third of the results name their columns in another order, a third without one, a third not at all."""
    doc, third = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    data = F.when(third == 0, F.array(doc, "source", "lang")).when(third == 1, F.array("lang", doc, "source")).otherwise(F.array("source", doc))
    names = F.when(third == 1, F.array(*map(F.lit, ("file_name", "chunk_id", "document_id")))).when(third == 2, F.array(F.lit("document_id"), F.lit("chunk_id")))
    rows = t.documents.select("doc_id", data.alias("data"), names.alias("names"))
    return rt.named_results(rows, ["chunk_id", "document_id", "file_name"], keep=["doc_id"], manifest="names")


@query("k10_named_results", """SELECT doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, CASE WHEN lang <> 'de' THEN lang END AS file_name FROM documents WHERE lang <> 'fr'""")
def k10(t: Tables) -> DataFrame:
    two = F.array(F.col("doc_id").cast("string"), F.col("source"))
    data = F.when(F.col("lang") == "de", two).when(F.col("lang") != "fr", F.concat(two, F.array("lang")))
    return rt.named_results(t.documents.select("doc_id", data.alias("data")), ["chunk_id", "document_id", "file_name"], keep=["doc_id"])


def _context_sql(limit: str) -> str:
    return rf"""whole AS (SELECT query_id, count(*) AS retrieved_chunks, string_agg(regexp_replace('[Fonte ' || pos || '] ' || name || coalesce(', página ' || page_number, '') || chr(10) || coalesce(chunk_text, ''), '\s+$', ''),
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS body, max({limit}) AS cap FROM ranked GROUP BY 1),
    contexts AS (SELECT query_id, retrieved_chunks, CASE WHEN length(body) > cap THEN regexp_replace(substring(body, 1, cap), '\s+$', '') || chr(10) || chr(10) || '[contexto truncado]' ELSE body END AS context_text FROM whole)"""


@query("k11_context", f"""WITH ranked AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'documento_desconhecido' END AS name,
    CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS page_number, CASE WHEN o_orderkey % 5 > 0 THEN 'linha ' || o_orderkey || '  ' END AS chunk_text FROM orders), {_context_sql('200')}
  SELECT query_id, context_text, retrieved_chunks FROM contexts""")  # fmt: skip
def k11(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    ranked = t.orders.select(
        F.col("o_custkey").alias("query_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("display_name"),
        F.when(key % 3 == 1, F.col("o_orderstatus")).alias("file_name"),
        F.when(key % 4 > 0, key).alias("page_number"),
        F.when(key % 5 > 0, F.concat(F.lit("linha "), key, F.lit("  "))).alias("chunk_text"),
    )
    return rt.context_rows(ranked, 200)


REQUESTS_SQL = """requests AS (SELECT conv_id || ':' || turn AS query_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS question, CASE WHEN turn % 4 = 0 THEN 3 ELSE 5 END AS num_results,
  CASE WHEN turn % 3 = 0 THEN 1500 ELSE 6000 END AS cap FROM conversations WHERE role = 'user' AND trim(text) <> '')"""


def requests(t: Tables) -> DataFrame:
    users = t.conversations.filter(F.col("role") == "user")
    odd = F.col("conv_id") % 2 == 1
    return users.select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"),
        F.when(odd, F.col("text")).otherwise("  ").alias("question"),
        F.col("text").alias("prompt"),
        F.when(F.col("turn") % 4 == 0, 3).otherwise(0).alias("num_results"),
        F.when(F.col("turn") % 3 == 0, 1500).alias("max_context_chars"),
    )


def prompts(t: Tables, mode: str = "hybrid") -> DataFrame:
    asked = rt.question_rows(requests(t))
    parts = chunks(t).select(
        "chunk_id",
        F.upper("source").alias("display_name"),
        F.col("source").alias("file_name"),
        F.col("doc_id").alias("page_number"),
        "chunk_text",
    )
    index = parts.select("chunk_id", tx.hash_embedding("chunk_text").alias("vector"), tx.terms("chunk_text").alias("terms"))
    asked_vectors = asked.filter(~F.col("is_rejected")).select(
        "query_id", tx.hash_embedding("question").alias("vector"), tx.terms("question").alias("terms")
    )
    return rt.answer_prompts(asked, index, parts, asked_vectors, mode=mode)


VECTOR_RANKED_SQL = f"""q AS (SELECT *, {_hash_vector_sql('question')} AS qv FROM requests), c AS (SELECT *, {_hash_vector_sql('chunk_text')} AS cv FROM identified),
  pairs AS (SELECT query_id, num_results, cap, chunk_id, doc_id, source, chunk_text, round(list_cosine_similarity(qv, cv), 12) AS s FROM q, c),
  ranked AS (SELECT query_id, cap, chunk_text, doc_id AS page_number, upper(source) AS name, num_results, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS pos FROM pairs QUALIFY pos <= num_results)"""
HYBRID_RANKED_SQL = f"""{_fused_sql('SELECT query_id, question FROM requests')},
  ranked AS (SELECT query_id, cap, chunk_text, doc_id AS page_number, upper(source) AS name, num_results, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos
    FROM fused JOIN requests USING (query_id) JOIN identified USING (chunk_id) QUALIFY pos <= num_results)"""


def _prompts_sql(ranked: str) -> str:
    return f"""WITH {WINDOWS_SQL}, {IDENTITY_SQL}, {REQUESTS_SQL}, {ranked}, {_context_sql('cap')}
  SELECT query_id, retrieved_chunks, 'Pergunta:' || chr(10) || question || chr(10) || chr(10) || 'Contexto recuperado:' || chr(10) || context_text || chr(10) || chr(10) || 'Responda em português brasileiro com base apenas no contexto acima.' AS rag_prompt,
  CAST(NULL AS VARCHAR) AS response, 800 AS max_tokens, 0.1::DOUBLE AS temperature FROM requests JOIN contexts USING (query_id)"""


PROMPT_COLUMNS = ["query_id", "retrieved_chunks", "rag_prompt", "response", "max_tokens", "temperature"]


@query("k12_prompts", _prompts_sql(HYBRID_RANKED_SQL))
def k12(t: Tables) -> DataFrame:
    return prompts(t).select(*PROMPT_COLUMNS)


@query("k12_prompts_vector", _prompts_sql(VECTOR_RANKED_SQL))
def k12_vector(t: Tables) -> DataFrame:
    return prompts(t, "vector").select(*PROMPT_COLUMNS)


@query("k12_model_hook", f"SELECT query_id, CAST(length(rag_prompt) AS VARCHAR) AS response FROM ({_prompts_sql(VECTOR_RANKED_SQL)})")
def k12_model(t: Tables) -> DataFrame:
    def shout(batches):
        for frame in batches:
            yield frame.assign(response=frame["rag_prompt"].str.len().astype(str))

    rows = prompts(t, "vector").select("query_id", "rag_prompt", "response")
    return rt.call_model(rows, shout, "rag_prompt", "response").select("query_id", "response")


@query("k13_summaries", rf"""WITH {WINDOWS_SQL}, {IDENTITY_SQL}, s AS (SELECT chunk_id, chunk_text, regexp_extract(trim(chunk_text), '(?s)^(.*?[.!?])(\s|$)', 1) AS first FROM identified)
  SELECT chunk_id, 'Resuma em uma frase o conteúdo deste trecho: ' || chunk_text AS request, CASE WHEN first = '' THEN trim(chunk_text) ELSE first END AS chunk_summary FROM s""")  # fmt: skip
def k13(t: Tables) -> DataFrame:
    return rt.summary_prompts(chunks(t)).select("chunk_id", "request", "chunk_summary")


@query("k14_newest_rows", "SELECT event_id AS request_id, ts AS event_time, event_type AS request, props AS response FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def k14(t: Tables) -> DataFrame:
    log = t.events.select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("event_time"), F.col("event_type").alias("request"), F.col("props").alias("response")
    )
    return rt.newest_rows(log, "event_time", 50, "request_id")


SCORES_SQL = """scores AS (SELECT query_id, CASE WHEN min(rank) FILTER (label = query_id) IS NOT NULL THEN 1 ELSE 0 END AS hit, coalesce(1.0::DOUBLE / min(rank) FILTER (label = query_id), 0.0) AS reciprocal_rank,
  avg(CASE WHEN label = query_id THEN 1.0::DOUBLE ELSE 0.0 END) AS precision_at_k FROM top GROUP BY 1)"""


def retrieval_scores(t: Tables) -> DataFrame:
    questions = centroids(t)
    found = rt.similar_chunks(questions, vectors(t), 10)
    labelled = found.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    return rt.retrieval_scores(labelled, questions, F.col("label") == F.col("query_id"))


@query("k15_retrieval_scores", f"WITH {CENTROIDS_SQL.format(k=10)}, {SCORES_SQL} SELECT query_id, hit, round(reciprocal_rank, 6) AS reciprocal_rank, round(precision_at_k, 6) AS precision_at_k FROM scores")
def k15(t: Tables) -> DataFrame:
    return retrieval_scores(t).select("query_id", "hit", r6("reciprocal_rank"), r6("precision_at_k"))


@query("k15_retrieval_summary", f"WITH {CENTROIDS_SQL.format(k=10)}, {SCORES_SQL} SELECT count(*) AS question_count, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg(precision_at_k), 6) AS mean_precision FROM scores")
def k15_summary(t: Tables) -> DataFrame:
    rows = rt.retrieval_summary(retrieval_scores(t))
    return rows.select("question_count", r6("hit_rate"), r6("mean_reciprocal_rank"), r6("mean_precision"))


@query("k16_document_run", f"""WITH {WINDOWS_SQL}, {IDENTITY_SQL}, counts AS (SELECT source AS project, count(*) AS knowledge_count, coalesce(sum(n), 0)::BIGINT AS chunks_count FROM documents
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM identified GROUP BY 1) USING (doc_id) GROUP BY 1)
  SELECT project, knowledge_count, chunks_count, chunks_count AS embeddings_count, chunks_count AS index_count, 0 AS rag_eval_count FROM counts""")  # fmt: skip
def k16(t: Tables) -> DataFrame:
    stages = Stages(chunking=True, embeddings=True, index=True)
    knowledge = scan_knowledge(t.spark, f"{t.sf_dir}/documents.parquet", "doc_id", "text", ["source"])
    result = run_documents(knowledge, stages, "offline-hash", size=SIZE, overlap=OVERLAP)
    return result.report("source").select(
        F.col("source").alias("project"), "knowledge_count", "chunks_count", "embeddings_count", "index_count", "rag_eval_count"
    )


NEW_SQL = f"""{WINDOWS_SQL}, {IDENTITY_SQL}, hashed AS (SELECT *, sha256(chunk_text_normalized) AS chunk_hash FROM identified),
  stored AS (SELECT DISTINCT chunk_hash FROM hashed WHERE source < 'src15')"""


@query("s9_new_chunks", f"""WITH {NEW_SQL} SELECT chunk_hash, doc_id, position FROM hashed ANTI JOIN stored USING (chunk_hash) WHERE source >= 'src15'
  QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY doc_id DESC, position DESC) = 1""")  # fmt: skip
def s9(t: Tables) -> DataFrame:
    rows = chunks(t)
    fresh = new_events(
        rows.filter(F.col("source") >= "src15"), rows.filter(F.col("source") < "src15"), ["chunk_hash"], newest("doc_id", "position")
    )
    return fresh.select("chunk_hash", "doc_id", "position")


@query("s9_streamed_chunks", f"WITH {NEW_SQL} SELECT DISTINCT chunk_hash FROM hashed")
def s9_stream(t: Tables) -> DataFrame:
    folder = f"{scratch_folder(t.spark)}/s9-{uuid.uuid4().hex}"
    stream_new_chunks(
        t.spark, f"{t.sf_dir}/documents.parquet", t.documents.schema, f"{folder}/chunks", f"{folder}/state", "text", ["doc_id"], SIZE, OVERLAP
    )
    return t.spark.read.parquet(f"{folder}/chunks").select("chunk_hash")


@query("s9_two_arrivals", f"""WITH {NEW_SQL} SELECT chunk_hash, CAST(1 AS BIGINT) AS copies, CAST(CASE WHEN bool_or(source < 'src15') THEN 0 ELSE 1 END AS INTEGER) AS arrival
  FROM hashed GROUP BY chunk_hash""")  # fmt: skip
def s9_arrivals(t: Tables) -> DataFrame:
    """Documents of two arrivals, the second with some of the first again; then its micro-batch runs once more."""
    folder = f"{scratch_folder(t.spark)}/s9-{uuid.uuid4().hex}"
    early = F.col("source") < "src15"
    again = t.documents.filter(early & (F.col("doc_id") % 10 == 0))
    for arrival in (t.documents.filter(early), t.documents.filter(~early).unionByName(again)):
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream_new_chunks(
            t.spark, f"{folder}/in", t.documents.schema, f"{folder}/chunks", f"{folder}/state", "text", ["doc_id"], SIZE, OVERLAP
        )
    append_new_chunks(document_chunks(arrival, "text", ["doc_id"], SIZE, OVERLAP), f"{folder}/chunks", 1)
    stored = t.spark.read.parquet(f"{folder}/chunks")
    return stored.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("batch").alias("arrival"))
