"""Incremental document ingestion: only chunks whose hash is not stored yet.

Stored chunks lie in ``batch=<n>/prefix=<p>`` folders, ``p`` being the first letters of the hash. A batch reads only the
hashes with its own prefixes, so a small arrival does not read the whole store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeops.functions.text import normalize_text
from lakeops.operators.events import latest_by, newest
from lakeops.operators.retrieval import chunk_identity, chunk_rows


# no folder yet, or one without a finished file
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
PREFIX_LETTERS = 2  # 256 prefixes of hexadecimal hashes
MOST_LETTERS = 4  # the driver lists the prefixes of a batch
FILES_PER_TRIGGER = 1000
MANY_COPIES = 1000  # of one hash in a batch
COPIED_HASHES = 16  # of a prefix that are cut to their newest chunk before the shuffle; the others are cut behind it


def document_chunks(documents: DataFrame, text: str, keys: Sequence[str], size: int, overlap: int) -> DataFrame:
    return chunk_identity(chunk_rows(documents, text, size, overlap, keys), keys)


def hash_prefix(letters: int):
    return F.substring("chunk_hash", 1, letters)


def stored_hashes(spark: SparkSession, path: str, prefixes: Sequence[str], batch: int) -> DataFrame:
    """Hashes with one of the prefixes that other batches stored; both are partition filters. A hash is stored once."""
    try:
        spark.read.parquet(path).select("chunk_hash", "batch", "prefix")  # a store of another shape is an error
        rows = spark.read.schema("chunk_hash STRING, batch INT, prefix STRING").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in NOTHING_STORED:
            raise
        rows = spark.createDataFrame([], "chunk_hash STRING, batch INT, prefix STRING")
    return rows.filter(F.col("prefix").isin(list(prefixes)) & (F.col("batch") != batch)).select("chunk_hash")


def append_new_chunks(chunks: DataFrame, path: str, batch: int, letters: int = PREFIX_LETTERS) -> None:
    """Write the new chunks of one batch to its own folder ``batch=<n>`` below ``path``, by hash prefix.

    The folder is overwritten, and the batch's own rows are not counted as stored, so a batch that is
    run again after a failure ends with the same rows. ``letters`` stays the same for one store.
    """
    if not 0 < letters <= MOST_LETTERS:
        raise ValueError(f"between 1 and {MOST_LETTERS} letters")
    spark = chunks.sparkSession
    met = prefix_copies(chunks, letters).collect()  # at most 16 ** MOST_LETTERS rows
    stored = stored_hashes(spark, path, [r.prefix for r in met], batch)
    copied = [(c.chunk_hash, c.newest) for r in met for c in r.copied]
    placed = placed_chunks(chunks, stored, spark.createDataFrame(copied, "chunk_hash STRING, newest STRING") if copied else None, letters)
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("prefix").parquet(f"{path}/batch={batch}")


def prefix_copies(chunks: DataFrame, letters: int) -> DataFrame:
    """The prefixes of a batch, each with its most copied hashes and the newest chunk of each."""
    counted = chunks.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("newest"))
    copied = F.collect_list(F.when(F.col("n") > MANY_COPIES, F.struct("n", "chunk_hash", "newest")))
    return counted.groupBy(hash_prefix(letters).alias("prefix")).agg(F.slice(F.sort_array(copied, asc=False), 1, COPIED_HASHES).alias("copied"))


def placed_chunks(chunks: DataFrame, stored: DataFrame, copied: DataFrame | None, letters: int) -> DataFrame:
    """The chunks whose hash is not stored, the newest per hash, by hash prefix.

    One shuffle by prefix serves the comparison and the folders, so a text moves once; the normalised text is made again
    behind it. Of the ``copied`` hashes only the newest chunk moves, so that many copies do not meet in one task.
    """
    slim = chunks.drop("chunk_text_normalized")
    if copied is not None:
        slim = slim.join(copied, "chunk_hash", "left").filter("newest IS NULL OR chunk_id = newest").drop("newest")
    both = slim.withColumn("seen", F.lit(False)).unionByName(stored.withColumn("seen", F.lit(True)), allowMissingColumns=True)
    placed = both.withColumn("prefix", hash_prefix(letters)).repartition("prefix")
    fresh = latest_by(placed, ["prefix", "chunk_hash"], newest("seen", "chunk_id")).filter("NOT seen")
    return fresh.withColumn("chunk_text_normalized", normalize_text("chunk_text")).select(*chunks.columns, "prefix")


def table_pattern(source: str) -> str:
    """A pattern that only ``source`` matches, where it is named like a parquet table. Without one a stream takes its path
    for a folder of partitions and cannot read a single file; a pattern fits a file and a folder of files alike."""
    return f"{source[:-1]}[{source[-1]}]" if source.endswith(".parquet") else source


def stream_new_chunks(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    text: str,
    keys: Sequence[str],
    size: int = 800,
    overlap: int = 120,
    files_per_trigger: int = FILES_PER_TRIGGER,
    letters: int = PREFIX_LETTERS,
) -> None:
    """Process all documents that arrived since the last call, then stop (available-now trigger).

    A micro-batch takes at most ``files_per_trigger`` files, so a long pause before a call does not make one huge batch.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    documents = reader.parquet(table_pattern(source))
    chunks = document_chunks(documents, text, keys, size, overlap)
    stream = (
        chunks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: append_new_chunks(batch, target, number, letters))
        .start()
    )
    stream.awaitTermination()
