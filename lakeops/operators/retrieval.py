"""Documents to pages, chunks, vectors and ranked context, for all documents and questions at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakeops.functions import nearest
from lakeops.functions import text as tx
from lakeops.functions.rules import as_column, blank
from lakeops.sources.tables import stored

# The kernels travel with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(nearest)

# Quality thresholds, header, separator, marker, answer and prompt texts, defaults.
MIN_ALPHA_RATIO, MAX_NOISE = 0.55, 0.06
SOURCE_HEADER, PAGE_PART = "[Fonte {}] ", ", página "
UNKNOWN_DOCUMENT = "documento_desconhecido"
CONTEXT_SEPARATOR, CONTEXT_MARKER = "\n\n---\n\n", "\n\n[contexto truncado]"
NO_EVIDENCE = "Não encontrei evidência suficiente no contexto recuperado para responder."
PROMPT_QUESTION, PROMPT_CONTEXT = "Pergunta:\n", "\n\nContexto recuperado:\n"
PROMPT_END = "\n\nResponda em português brasileiro com base apenas no contexto acima."
SUMMARY_PROMPT = "Resuma em uma frase o conteúdo deste trecho: "
MAX_RESULTS = 1000  # chunks a request may ask for
REQUEST_DEFAULTS = {"num_results": 5, "max_context_chars": 6000, "max_tokens": 800, "temperature": 0.1}
QUERY_COLUMNS = (
    "chunk_id", "document_id", "file_name", "display_name", "page_number", "chunk_text",
    "document_quality_tier", "page_extraction_method",
)

PART_BYTES = 16 << 20  # of questions, and of chunks, held by one task
RECIPROCAL_OFFSET = 60


# ---- pages and documents ---------------------------------------------------------------------


def page_quality(
    pages: DataFrame, text: str = "page_text", min_alpha: float = MIN_ALPHA_RATIO, max_noise: float = MAX_NOISE
) -> DataFrame:
    """Add letter share, noise share and ``is_usable``."""
    measured = pages.withColumns({"alpha_ratio": tx.alpha_ratio(text), "ocr_noise_score": tx.noise_ratio(text)})
    usable = (F.col("alpha_ratio") >= min_alpha) & (F.col("ocr_noise_score") <= max_noise)
    return measured.withColumn("is_usable", usable)


def document_reports(page_reports: DataFrame, high: float = 0.9, medium: float = 0.5) -> DataFrame:
    """One row per document: page counts, average noise, tier by usable share, strategy, JSON payload."""
    usable = F.sum(F.when(F.col("is_usable"), 1).otherwise(0))
    counted = page_reports.groupBy("document_id", "file_name").agg(
        F.count(F.lit(1)).alias("total_pages"),
        usable.alias("usable_pages"),
        F.avg("ocr_noise_score").alias("avg_ocr_noise_score"),
    )
    share = F.col("usable_pages") / F.col("total_pages")
    tier = F.when(share >= high, "high").when(share >= medium, "medium").otherwise("low")
    rows = counted.withColumns(
        {
            "unusable_pages": F.col("total_pages") - F.col("usable_pages"),
            "quality_tier": tier,
            "extraction_strategy": F.when(tier == "high", "native").otherwise("hybrid"),
        }
    )
    payload = F.to_json(
        F.struct(
            "file_name", "total_pages", "usable_pages", "unusable_pages", "avg_ocr_noise_score",
            "quality_tier", "extraction_strategy",
        )
    )
    return rows.withColumn("report_json", payload)


def catalog_aliases(catalog: DataFrame) -> DataFrame:
    """Distinct (document, alias) rows of a document catalog with repeating aliases."""
    return catalog.select("document_id", "display_name", F.explode(F.array_distinct("aliases")).alias("alias"))


def with_display_name(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalog's display name; documents outside the catalog keep their file name."""
    names = catalog.select("document_id", F.col("display_name").alias("__display"))
    joined = df.join(names, "document_id", "left")
    return joined.withColumn("display_name", F.coalesce("__display", "file_name")).drop("__display")


def page_rows(pages: DataFrame, page_reports: DataFrame, documents: DataFrame) -> DataFrame:
    """Page table: text, method, document tier and usability; a page without a report is usable."""
    reports = page_reports.select("document_id", "page_number", "is_usable")
    tiers = documents.select("document_id", F.col("quality_tier").alias("page_quality_tier"))
    joined = pages.join(reports, ["document_id", "page_number"], "left").join(tiers, "document_id", "left")
    return joined.select(
        "document_id",
        "file_name",
        "page_number",
        "page_text",
        F.coalesce("extraction_method", F.lit("native")).alias("extraction_method"),
        "page_quality_tier",
        F.coalesce("is_usable", F.lit(True)).alias("is_usable"),
    )


# ---- chunks, vectors, index ------------------------------------------------------------------


def chunk_rows(df: DataFrame, text: str, size: int = 800, overlap: int = 120, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed character windows: kept columns, ``position`` and ``chunk_text``."""
    return df.select(*keep, F.posexplode(tx.chunk_texts(text, size, overlap)).alias("position", "chunk_text"))


def chunk_identity(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add normalised text, its hash and a chunk id made of the keys and the position."""
    named = chunks.withColumn("chunk_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.col("position")))
    normal = named.withColumn("chunk_text_normalized", tx.normalize_text("chunk_text"))
    return normal.withColumn("chunk_hash", tx.text_hash("chunk_text_normalized"))


def embedding_rows(
    chunks: DataFrame,
    model: str,
    provider: Callable | None = None,
    dimensions: int = 8,
    text: str = "chunk_text",
    keep: Sequence[str] = ("chunk_id",),
) -> DataFrame:
    """Vector per chunk. Without a provider the offline hash vector is used; a provider is a
    ``mapInPandas`` function from (kept columns, text) to (kept columns, ``embedding``)."""
    if provider is None:
        rows = chunks.select(*keep, tx.hash_embedding(text, dimensions).alias("embedding"))
    else:
        given = chunks.select(*keep, text)
        fields = [given.schema[c] for c in keep]
        schema = T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        rows = given.mapInPandas(provider, schema)
    return rows.withColumn("embedding_model", F.lit(model))


def hyperplanes(dimensions: int, bits: int) -> np.ndarray:
    """Fixed pseudo-random directions, one row per bit."""
    return np.random.default_rng(0).standard_normal((bits, dimensions))


def hyperplane_bucket(vector, dimensions: int, bits: int) -> Column:
    """Bucket number from the signs of ``bits`` fixed pseudo-random projections."""
    v = as_column(vector)
    bucket = F.lit(0)
    for bit, plane in enumerate(hyperplanes(dimensions, bits)):
        weights = F.array(*[F.lit(float(x)) for x in plane])
        products = F.zip_with(v, weights, lambda a, b: a * b)
        dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
        bucket = bucket + F.when(dot > 0, 1 << bit).otherwise(0)
    return bucket


def index_rows(embeddings: DataFrame, dimensions: int | None = None, bucket_bits: int = 0) -> DataFrame:
    """Searchable rows: the vector normalised to length 1 and, if asked, its bucket."""
    rows = embeddings.withColumn("vector", tx.unit_vector("embedding"))
    if bucket_bits:
        rows = rows.withColumn("bucket", hyperplane_bucket("vector", dimensions, bucket_bits))
    return rows


# ---- search ----------------------------------------------------------------------------------

MERGE_FAN = 64  # fragments whose lists one task merges
MOST_PIVOTS = 4096  # chunks that the driver lists as pivots


def _bytes(rows: DataFrame, names: Sequence[str]) -> Column:
    """What a row of vectors and words takes in a task."""
    weight = {"vector": F.size("vector") * 8, "terms": F.octet_length(F.array_join("terms", " ")) + 8 * F.size("terms")}
    return sum((weight[name] for name in names), F.lit(16)).cast("long")


def _search(
    questions: DataFrame, chunks: DataFrame, names: Sequence[str], k: int | str, part_bytes: int, depth: int = 0, fuse_offset: int | None = None
) -> DataFrame:
    """Best chunks per question, exact: ``query_id``, ``chunk_id``, ``score``, ``rank``. ``k`` is a number or the column of
    ``questions`` with each one's own. With ``fuse_offset`` the lists of all rankers (``depth`` or ``k`` entries, whichever is
    more) are fused by reciprocal rank; without, the one ranker's list is the result.

    One plan at every size: both sides are stored once, so that what they are computed from runs once. Vectors are
    looked up by :func:`_near_lists`, words by :func:`_word_lists`. Their lists, one row a question and fragment, are
    merged ``MERGE_FAN`` fragments at a time.
    """
    complete = " AND ".join(f"{name} IS NOT NULL" for name in names)
    wanted = F.col(k) if isinstance(k, str) else F.lit(k)
    # a filter before the write would compute vectors and words once more
    q = stored(questions.select("query_id", wanted.cast("int").alias("k"), *names), "questions").filter(f"{complete} AND k > 0")
    c = stored(chunks.select("chunk_id", *names), "chunks").filter(complete)
    query_id, chunk_id = q.schema["query_id"], c.schema["chunk_id"]
    lists = T.StructType(
        [T.StructField("bucket", T.LongType()), T.StructField("fragment", T.LongType()), query_id, T.StructField("ranker", T.StringType()),
         T.StructField("k", T.IntegerType()), T.StructField("chunk_ids", T.ArrayType(chunk_id.dataType)), T.StructField("scores", T.ArrayType(T.DoubleType()))]
    )
    out = T.StructType([query_id, chunk_id, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    arrow, lists_arrow, out_arrow = to_arrow_schema(T.StructType(lists.fields[2:])), to_arrow_schema(lists), to_arrow_schema(out)

    cores = q.sparkSession.sparkContext.defaultParallelism
    entries = q.agg(F.sum(F.greatest("k", F.lit(depth)).cast("long"))).first()[0] or 0
    # an entry of a list is an id and a score, about 32 bytes
    buckets = max(cores, -(-32 * entries * len(names) * MERGE_FAN // part_bytes))

    def merge_some(some: pa.Table) -> pa.Table:
        queries, chunk_ids, merged, asked = nearest.merge_lists(some, depth)
        rows = [
            nearest.merged_rows(queries, chunk_ids, found, asked, name, arrow) for name, found in merged.items()
        ]
        table = pa.Table.from_batches(rows, schema=arrow)
        for i, column in enumerate(("bucket", "fragment")):
            table = table.add_column(i, lists_arrow.field(i), pa.array([some.column(column)[0].as_py()] * table.num_rows, pa.int64()))
        return table

    def merged(found: DataFrame, fragments: int, until: int) -> DataFrame:
        found = found.withColumn("bucket", F.pmod(F.xxhash64("query_id"), F.lit(buckets))).select(*lists.names)
        while fragments > until:
            fragments = -(-fragments // MERGE_FAN)
            found = found.withColumn("fragment", F.floor(F.col("fragment") / MERGE_FAN)).groupBy("bucket", "fragment").applyInArrow(merge_some, lists)
        return found

    def finish(some: pa.Table) -> pa.Table:
        queries, chunk_ids, merged, asked = nearest.merge_lists(some, depth)
        if fuse_offset is None:
            question, chunk, score, rank = next(iter(merged.values()))
        else:
            question, chunk, score, rank = nearest.first_of(*nearest.fuse(merged, len(chunk_ids), fuse_offset), asked)
        columns = [queries.take(pa.array(question)), chunk_ids.take(pa.array(chunk)), pa.array(score), pa.array(rank.astype("int32"))]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, out_arrow, strict=True)], schema=out_arrow)

    held = T.StructType(lists.fields[1:])
    searches = {"vector": _near_lists, "terms": _word_lists}
    parts = [
        merged(*searches[name](q.select("query_id", "k", name), c.select("chunk_id", name), held, depth, part_bytes, merged), MERGE_FAN) for name in names
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").applyInArrow(finish, out)


def _spread(rows: DataFrame, side: str, count: int) -> DataFrame:
    """Each row once for every number below ``count``, in the column ``side``."""
    return rows.withColumn(side, F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")))


def _near_lists(q: DataFrame, c: DataFrame, schema: T.StructType, depth: int, part_bytes: int, merged: Callable) -> tuple[DataFrame, int]:
    """Lists by cosine, and the number of fragments. A fragment holds the chunks nearest to one of the pivots (at most
    ``MOST_PIVOTS`` chunks); a large one is cut into parts by a hash.

    Every question first meets the fragment of its nearest pivot. The last score of that list is its bar: the question then
    goes only to the fragments in which a chunk can reach the bar, by the angles to the pivots (:func:`nearest.cosine_bounds`).
    """
    spark, arrow = q.sparkSession, to_arrow_schema(schema)
    cores = spark.sparkContext.defaultParallelism
    n, size = c.agg(F.count(F.lit(1)), F.sum(_bytes(c, ["vector"]))).first()
    asked_bytes = q.agg(F.sum(_bytes(q, ["vector"]))).first()[0]
    if not n or not asked_bytes:
        return spark.createDataFrame([], schema), 1
    blocks = max(1, -(-asked_bytes // part_bytes))
    count = min(max(4 * cores, -(-size // part_bytes)), MOST_PIVOTS, n)
    sample = c.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // (2 * count)))) == 0).select("vector").limit(count)
    vectors = [r.vector for r in sample.collect()] or [c.first().vector]
    pivots = np.unique(nearest.unit_rows(nearest.to_matrix(pa.array(vectors))), axis=0)

    def placed(parts: np.ndarray) -> DataFrame:
        def place(batches):
            for batch in batches:
                own, angle = nearest.nearest_pivots(nearest.unit_rows(nearest.to_matrix(batch.column("vector"))), pivots)
                spread = batch.column("spread").to_numpy()
                added = {"fragment": pa.array(own), "part": pa.array(spread % parts[own]), "angle": pa.array(angle)}
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("vector"), *added.values()], names=["chunk_id", "vector", *added])

        rows = c.select("chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 31)).alias("spread"))
        return rows.mapInArrow(place, T.StructType([*c.schema.fields, T.StructField("fragment", T.LongType()), T.StructField("part", T.LongType()), T.StructField("angle", T.DoubleType())]))

    radius, parts = np.full(len(pivots), -1.0), np.ones(len(pivots), dtype=np.int64)
    for r in placed(parts).groupBy("fragment").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.fragment], parts[r.fragment] = r.radius, max(1, -(-r.n * size // n // (2 * part_bytes)))

    asked = T.StructType([*q.schema.fields, T.StructField("bar", T.DoubleType())])
    sent = T.StructType([*asked.fields, T.StructField("fragment", T.LongType()), T.StructField("part", T.LongType())])

    def send(first: bool) -> Callable:
        def rows(batches):
            for batch in batches:
                vectors = nearest.unit_rows(nearest.to_matrix(batch.column("vector")))
                own, _ = nearest.nearest_pivots(vectors, pivots)
                bars = batch.column("bar").fill_null(-np.inf).to_numpy()
                for part in nearest.steps(batch.num_rows, len(pivots)):
                    meets = np.arange(len(pivots)) == own[part][:, None]
                    if not first:
                        bounds = nearest.cosine_bounds(vectors[part] @ pivots.T, pivots, radius)
                        meets = ~meets & (bounds >= bars[part][:, None] - nearest.MARGIN)
                    row, fragment = np.nonzero(meets)
                    many = parts[fragment]
                    taken = batch.take(pa.array(np.repeat(row + part.start, many)))
                    within = nearest.ranges(np.zeros(len(many), dtype=np.int64), many)
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.repeat(fragment, many)), pa.array(within)], names=sent.names)

        return rows

    def rank_block(some_questions: pa.Table, some_chunks: pa.Table) -> pa.Table:
        if not some_questions.num_rows or not some_chunks.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        held = nearest.Questions.from_table(some_questions, depth)
        ids, found = nearest.rank_near(some_chunks, held, some_questions.column("bar").combine_chunks().fill_null(-np.inf).to_numpy())
        return nearest.with_fragment(nearest.merged_rows(held.ids, ids, (*found, None), held.asked, "vector", pa.schema(list(arrow)[1:])), some_questions, arrow)

    right = _spread(placed(parts).drop("angle"), "block", blocks)
    keys = ["block", "fragment", "part"]

    def lists(barred: DataFrame, first: bool) -> DataFrame:
        left = barred.mapInArrow(send(first), sent).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank_block, schema), "near")

    near = lists(q.select("*", F.lit(None).cast("double").alias("bar")), True)
    last = F.greatest("k", F.lit(depth))
    bars = near.groupBy("query_id").agg(F.max(F.try_element_at("scores", last)).alias("bar"))
    far = lists(q.join(bars, "query_id", "left").select(*asked.names), False)
    return near.unionByName(far), len(pivots)


def _packed(rows: DataFrame) -> DataFrame:
    """``terms`` as one string ``joined``, which moves in a third of the space; a list that would not come back from it stays."""
    joined = F.array_join("terms", nearest.WORD_END)
    ends = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(nearest.WORD_END), F.lit("")))
    whole = ends == F.size("terms") - 1
    return rows.withColumns({"joined": F.when(whole, joined), "terms": F.when(~whole, F.col("terms"))})


def _word_lists(q: DataFrame, c: DataFrame, schema: T.StructType, depth: int, part_bytes: int, merged: Callable) -> tuple[DataFrame, int]:
    """Lists by shared words, and the number of fragments. The chunks are cut into fragments, one for every core at least, the
    questions into blocks; every block meets every fragment in a shuffle, and a task keeps the best per question.

    If the chunks fill several fragments, the first of them, the root of their number, run ahead: the last entry of their
    merged list is the question's bar, and later fragments count and list only what ranks before it."""
    arrow = to_arrow_schema(schema)
    cores = q.sparkSession.sparkContext.defaultParallelism
    least = max(1, -(-(q.agg(F.sum(_bytes(q, ["terms"]))).first()[0] or 0) // (2 * part_bytes)))
    taken = F.lit(16) + F.octet_length(F.array_join("terms", "")) + 4 * F.size("terms")
    full = -(-(c.agg(F.sum(taken.cast("long"))).first()[0] or 0) // (4 * part_bytes))
    fragments = max(cores, full)
    ahead = math.isqrt(fragments) if full > 1 else fragments
    bar_id = T.StructField("bar_id", c.schema["chunk_id"].dataType)
    q, c = _packed(q), _packed(c).withColumn("fragment", F.pmod(F.xxhash64("chunk_id"), F.lit(fragments)))

    def rank_block(some_questions: pa.Table, some_chunks: pa.Table) -> pa.Table:
        if not some_questions.num_rows or not some_chunks.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        some_questions, some_chunks = nearest.unpacked(some_questions), nearest.unpacked(some_chunks)
        held = nearest.Questions.from_table(some_questions, depth)
        bars = some_questions.column("bar").combine_chunks().fill_null(0.0).to_numpy()
        ids, found = nearest.rank_chunks(some_chunks, held, bars, some_questions.column("bar_id").combine_chunks())
        return nearest.with_fragment(nearest.merged_rows(held.ids, ids, (*found, None), held.asked, "terms", pa.schema(list(arrow)[1:])), some_questions, arrow)

    def lists(barred: DataFrame, first: int, last: int) -> DataFrame:
        blocks = max(least, -(-cores // (last - first)))
        left = _spread(barred.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "fragment", last - first)
        left = left.withColumn("fragment", F.col("fragment") + first)
        right = _spread(c.filter(F.col("fragment").between(first, last - 1)), "block", blocks)
        keys = ["block", "fragment"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank_block, schema)

    none = q.select("*", F.lit(None).cast("double").alias("bar"), F.lit(None).cast(bar_id.dataType).alias("bar_id"))
    first = merged(lists(none, 0, ahead), ahead, 1)
    if ahead == fragments:
        return first.select(*schema.names), 1
    first = stored(first.select(*schema.names), "words")
    last = F.greatest("k", F.lit(depth))
    bars = first.select("query_id", F.try_element_at("scores", last).alias("bar"), F.try_element_at("chunk_ids", last).alias("bar_id"))
    later = lists(q.join(bars, "query_id", "left"), ahead, fragments)
    return first.unionByName(later), fragments


def similar_chunks(questions: DataFrame, chunks: DataFrame, k: int | str = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """Exact top-k by cosine: ``query_id``, ``chunk_id``, ``score`` (12 digits), ``rank``.

    ``questions`` has ``query_id`` and ``vector``, ``chunks`` has a unique ``chunk_id`` and ``vector``; ``k`` is
    a number or a column of ``questions`` (none or NULL: no chunks). Equal scores rank by chunk id. Rows
    without a vector are left out; vectors of different lengths fail.
    """
    return _search(questions, chunks, ["vector"], k, part_bytes)


def hybrid_chunks(
    questions: DataFrame, chunks: DataFrame, k: int | str = 5, depth: int = 100, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Vector and keyword rankings fused by reciprocal rank.

    Both rankings list their best ``depth`` chunks, or ``k`` where that is more (keyword score: shared distinct
    words, at least one); a chunk's score is the sum of 1 / (60 + rank) over the lists it is in, to 12 digits. Both
    sides carry ``terms`` beside ``vector``. The keyword ranking is exact: each task holds an inverted index of its
    questions, the most frequent words as bit sets, and every question's last kept score shuts out the rest.
    """
    return _search(questions, chunks, ["vector", "terms"], k, part_bytes, depth, RECIPROCAL_OFFSET)


SEARCHES = {"hybrid": hybrid_chunks, "vector": similar_chunks}


def named_results(
    results: DataFrame, columns: Sequence[str], data: str = "data", keep: Sequence[str] = (), manifest: str | None = None
) -> DataFrame:
    """Positional result arrays as named columns; short rows are padded with NULL, NULL rows dropped.

    ``manifest`` names an array column with the result's own column names: a value is then found by its name,
    a column it does not list is NULL. Where it is NULL or empty the given ``columns`` name the positions.
    """

    def position(i: int, name: str) -> Column:
        if manifest is None:
            return F.lit(i + 1)
        listed = F.nullif(F.array_position(F.col(manifest), F.lit(name)), F.lit(0)).cast("int")
        return F.when(F.size(F.coalesce(manifest, F.array())) > 0, listed).otherwise(i + 1)

    values = [F.try_element_at(F.col(data), position(i, c)).alias(c) for i, c in enumerate(columns)]
    return results.filter(F.col(data).isNotNull()).select(*keep, *values)


# ---- context, prompts, evaluation ------------------------------------------------------------


def context_rows(ranked: DataFrame, max_chars: int | str = 6000, key: str = "query_id") -> DataFrame:
    """Context text per question from its ranked chunks, cut at ``max_chars`` with a marker.

    ``max_chars`` is a number or the name of a column with the question's own limit. ``ranked`` is a
    top-k result, so the list gathered per question has at most k entries.
    """

    def filled(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    def stripped(text: Column) -> Column:
        return F.regexp_replace(text, r"\s+\z", "")

    name = F.coalesce(filled("display_name"), filled("file_name"), F.lit(UNKNOWN_DOCUMENT))
    page = F.concat(F.lit(PAGE_PART), F.col("page_number").cast("string"))
    lead, tail = SOURCE_HEADER.split("{}")
    limit = F.max(max_chars) if isinstance(max_chars, str) else F.max(F.lit(max_chars))
    chunk = F.struct("rank", name.alias("n"), F.coalesce(page, F.lit("")).alias("p"), F.coalesce("chunk_text", F.lit("")).alias("t"))
    grouped = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(chunk)).alias("chunks"),
        F.count(F.lit(1)).alias("retrieved_chunks"),
        limit.alias("limit"),
    )
    parts = F.transform(
        F.col("chunks"),
        lambda c, i: stripped(
            F.concat(F.lit(lead), (i + 1).cast("string"), F.lit(tail), c["n"], c["p"], F.lit("\n"), c["t"])
        ),
    )
    whole = grouped.withColumn("text", F.array_join(parts, CONTEXT_SEPARATOR))
    cut = F.concat(stripped(F.substring(F.col("text"), F.lit(1), F.col("limit"))), F.lit(CONTEXT_MARKER))
    context = F.when(F.length("text") > F.col("limit"), cut).otherwise(F.col("text"))
    return whole.select(key, context.alias("context_text"), "retrieved_chunks")


def question_rows(
    requests: DataFrame, defaults: Mapping[str, float] = REQUEST_DEFAULTS, max_results: int = MAX_RESULTS
) -> DataFrame:
    """Requests with their question (``prompt`` where it is blank) and filled-in defaults. Requests with neither,
    or for more than ``max_results`` chunks, are flagged ``is_rejected`` with a ``reject_reason``: what one request
    asks for sets what a search task holds. Missing and zero settings take the default."""
    asked = F.when(~blank("question"), F.col("question")).when(~blank("prompt"), F.col("prompt"))
    question = F.regexp_replace(asked, r"^\s+|\s+\z", "")
    rows = requests.withColumn("question", question)
    for name, value in defaults.items():
        kind = "double" if isinstance(value, float) else "int"
        given = F.nullif(F.col(name), F.lit(0)) if name in requests.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(given, F.lit(value)).cast(kind))
    reason = F.when(F.col("question").isNull(), "no question")
    if "num_results" in rows.columns:
        reason = reason.when(F.col("num_results") > max_results, f"more than {max_results} results")
    return rows.withColumn("reject_reason", reason).withColumn("is_rejected", F.col("reject_reason").isNotNull())


def prompt_rows(questions: DataFrame, contexts: DataFrame, key: str = "query_id") -> DataFrame:
    """Prompt per question, or the no-evidence answer where its context is empty."""
    joined = questions.join(contexts, key, "left")
    empty = F.coalesce("context_text", F.lit("")) == ""
    prompt = F.concat(
        F.lit(PROMPT_QUESTION), F.col("question"), F.lit(PROMPT_CONTEXT), F.col("context_text"), F.lit(PROMPT_END)
    )
    return joined.withColumns(
        {
            "retrieved_chunks": F.coalesce("retrieved_chunks", F.lit(0)),
            "rag_prompt": F.when(~empty, prompt),
            "response": F.when(empty, NO_EVIDENCE),
        }
    )


def answer_prompts(
    questions: DataFrame,
    index: DataFrame,
    chunks: DataFrame,
    query_vectors: DataFrame,
    k: int | None = None,
    mode: str = "hybrid",
) -> DataFrame:
    """Requests to prompts: search, context and prompt for every accepted request.

    Each request gets as many chunks as its ``num_results``; ``k`` bounds them for all. The ``hybrid`` search
    needs ``terms`` beside ``vector`` on both sides, ``vector`` does not.
    """
    if mode not in SEARCHES:
        raise ValueError(f"unknown search mode: {mode}")
    accepted = questions.filter(~F.col("is_rejected"))
    count = F.col("num_results") if k is None else F.least("num_results", F.lit(k))
    asked = query_vectors.join(accepted.select("query_id", count.alias("__count")), "query_id")
    found = SEARCHES[mode](asked, index, "__count")
    wanted = found.join(accepted.select("query_id", "max_context_chars"), "query_id")
    contexts = context_rows(wanted.join(chunks, "chunk_id"), "max_context_chars")
    return prompt_rows(accepted, contexts)


def call_model(prompts: DataFrame, model: Callable, column: str, output: str) -> DataFrame:
    """Fill ``output`` by a caller's ``mapInPandas`` function over (all columns) where it is needed.

    The function receives and returns pandas frames with the input columns plus ``output``.
    """
    schema = T.StructType([f for f in prompts.schema.fields if f.name != output] + [T.StructField(output, T.StringType())])
    return prompts.select(*[c for c in prompts.columns if c != output]).filter(F.col(column).isNotNull()).mapInPandas(model, schema)


def summary_prompts(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Summary prompt per chunk and the offline summary: its first sentence."""
    first = F.regexp_extract(F.trim(text), r"(?s)^(.*?[.!?])(\s|$)", 1)
    summary = F.when(first == "", F.trim(text)).otherwise(first)
    return chunks.withColumns({"request": F.concat(F.lit(SUMMARY_PROMPT), F.col(text)), "chunk_summary": summary})


def newest_rows(df: DataFrame, timestamp: str, count: int = 50, tie: str | None = None) -> DataFrame:
    """The newest ``count`` log rows."""
    order = [F.col(timestamp).desc(), *([F.col(tie).desc()] if tie else [])]
    return df.orderBy(*order).limit(count)


def retrieval_scores(ranked: DataFrame, questions: DataFrame, relevant: Column, key: str = "query_id") -> DataFrame:
    """Per question: hit in the ranked list, reciprocal rank of the first relevant chunk, precision."""
    good = F.coalesce(relevant, F.lit(False))
    folded = ranked.groupBy(key).agg(
        F.min(F.when(good, F.col("rank"))).alias("first_rank"),
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("precision_at_k"),
    )
    joined = questions.select(key).join(folded, key, "left")
    return joined.select(
        key,
        F.when(F.col("first_rank").isNotNull(), 1).otherwise(0).alias("hit"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("precision_at_k", F.lit(0.0)).alias("precision_at_k"),
    )


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """Question count, hit rate, mean reciprocal rank and mean precision."""
    return scores.agg(
        F.count(F.lit(1)).alias("question_count"),
        F.avg("hit").alias("hit_rate"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.avg("precision_at_k").alias("mean_precision"),
    )
