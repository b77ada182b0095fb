"""Documents to chunks, vectors, index and retrieval evaluation, each stage behind a switch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import retrieval as rt
from lakeops.operators.profile import union_all
from lakeops.operators.runs import STAGES, smoke_report
from lakeops.sources.tables import overwrite_table


@dataclass(frozen=True)
class Stages:
    """Switches of the optional stages; all off unless asked for."""

    chunking: bool = False
    embeddings: bool = False
    index: bool = False
    evaluation: bool = False


@dataclass(frozen=True)
class DocumentRun:
    """Results of the stages that ran; the others are None."""

    knowledge: DataFrame
    chunks: DataFrame | None = None
    embeddings: DataFrame | None = None
    index: DataFrame | None = None
    rag_eval: DataFrame | None = None

    def report(self, group: str) -> DataFrame:
        """Row counts of all stages per ``group`` with presence checks and the run status."""
        parts = []
        for stage in STAGES:
            rows = getattr(self, stage)
            if rows is not None and group in rows.columns:
                counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("row_count"))
                parts.append(counted.select(group, F.lit(stage).alias("stage"), "row_count"))
        return smoke_report(union_all(parts), [group])


def table_writer(schema: str, project: str) -> Callable[[str, DataFrame], DataFrame]:
    """Stage hand-over through tables ``tb_<project>_ai_<stage>``: write, then read back."""

    def write(stage: str, rows: DataFrame) -> DataFrame:
        name = f"{schema}.tb_{project}_ai_{stage}"
        overwrite_table(rows, name)
        return rows.sparkSession.table(name)

    return write


def run_documents(
    knowledge: DataFrame,
    stages: Stages,
    model: str,
    provider: Callable | None = None,
    size: int = 800,
    overlap: int = 120,
    questions: DataFrame | None = None,
    k: int = 5,
    write: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DocumentRun:
    """``knowledge`` has document_id, document_text and metadata columns, which all stages carry.

    A stage needs the one before it. ``write`` (see :func:`table_writer`) stores each stage, so that the
    next one reads it instead of computing it again; without it the stages stay lazy. ``questions`` (query_id, vector, document_id of the relevant
    document) feed the evaluation stage.
    """
    metadata = [c for c in knowledge.columns if c not in ("document_id", "document_text")]
    keep = ["document_id", *metadata]
    write = write or (lambda stage, rows: rows)
    chunks = embeddings = index = scores = None
    if stages.chunking:
        rows = rt.chunk_rows(knowledge, "document_text", size, overlap, keep)
        chunks = write("chunks", rt.chunk_identity(rows, ["document_id"]))
    if stages.embeddings and chunks is not None:
        embeddings = write("embeddings", rt.embedding_rows(chunks, model, provider, keep=["chunk_id", *keep]))
    if stages.index and embeddings is not None:
        index = write("index", rt.index_rows(embeddings))
    if stages.evaluation and index is not None and questions is not None:
        found = rt.similar_chunks(questions, index, k)
        relevant = questions.select("query_id", F.col("document_id").alias("wanted"))
        judged = found.join(index.select("chunk_id", "document_id"), "chunk_id").join(relevant, "query_id")
        scores = write("rag_eval", rt.retrieval_scores(judged, questions, F.col("document_id") == F.col("wanted")))
    return DocumentRun(knowledge, chunks, embeddings, index, scores)
