"""Journal of decisions: a request is decided once, and what was decided is carried out once.

Layout below the journal's folder, which lies in shared storage; every decided batch of requests has

* ``rows/<name>/batch=<b>``: the plan and the event rows that follow from it;
* ``keys/batch=<b>/part=<p>``: the exact keys of the answered requests, by a part of their hash;
* ``bloom/batch=<b>``: a Bloom filter of those keys as (part, word, mask) rows; the bits of a key lie in one word;
* one row in ``commits``, written last, with the layout of the filter.

A batch without its commit row does not count. New requests first meet the Bloom filters; only the key parts in
which a filter names one of them are read for the exact comparison. A batch whose filter has another layout names
all parts. All of it is Spark work; the driver holds the numbers of parts and the names of the batches at hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.events import conform_events, null_safe
from lakeops.sources.tables import append_table, stored

PARTS = 256
FILTER_WORDS = 1 << 14  # of one part and batch, 64 bits to a row; rows without a set bit do not exist
PROBES = 5  # bits of a key, all in its word; six bits of a hash choose one
LAYOUT = 2  # of the filters; 1 (NULL in older commits) spread the bits of a key over its part


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])


def part_of(keys: Sequence[str]) -> Column:
    return F.pmod(_hash(keys, 0), F.lit(PARTS)).cast("int")


def with_mask(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``part``, ``word`` and ``mask`` of every row's key: one row a key, so that its test is one comparison."""
    bits = " | ".join(f"shiftleft(1L, CAST(shiftright(__bits, {6 * i}) & 63 AS INT))" for i in range(PROBES))
    word = F.pmod(_hash(keys, 1), F.lit(FILTER_WORDS)).cast("int")
    return rows.select(part_of(keys).alias("part"), word.alias("word"), _hash(keys, 2).alias("__bits")).select("part", "word", F.expr(bits).alias("mask"))


def filter_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bloom filter of the keys: the OR of their masks per part and word, built in the tasks."""
    return with_mask(rows, keys).groupBy("part", "word").agg(F.bit_or("mask").alias("mask"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/commits", "batch STRING, layout INT").distinct()


def named_parts(requests: DataFrame, path: str, keys: Sequence[str]) -> list[int]:
    """Parts in which a Bloom filter of a committed batch may hold one of the requests (at most ``PARTS``)."""
    spark = requests.sparkSession
    layouts = {r.layout for r in committed(spark, path).select("layout").distinct().collect()}
    if layouts - {LAYOUT}:
        return list(range(PARTS))
    if not layouts:
        return []
    filters = _read(spark, f"{path}/bloom", "part INT, word INT, mask BIGINT, batch STRING").join(committed(spark, path), "batch", "left_semi")
    merged = filters.groupBy("part", "word").agg(F.bit_or("mask").alias("stored"))
    probes = with_mask(requests, keys).repartition("part", "word").distinct()
    maybe = probes.join(merged, ["part", "word"]).filter(F.col("stored").bitwiseAND(F.col("mask")) == F.col("mask"))
    return sorted(r.part for r in maybe.select("part").distinct().collect())


def answered_keys(requests: DataFrame, path: str, keys: Sequence[str], parts: Sequence[int]) -> DataFrame:
    """(keys, batch) of all requests that committed batches answered, in the named parts only."""
    spark = requests.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*keys).schema.fields)
    known = _read(spark, f"{path}/keys", f"{fields}, batch STRING, part INT").filter(F.col("part").isin(list(parts)) if parts else F.lit(False))
    return known.join(committed(spark, path), "batch", "left_semi").select(*keys, "batch")


def answered(requests: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, batch) of the requests that a committed batch answered; only the named parts are read."""
    found = answered_keys(requests, path, keys, named_parts(requests, path, keys))
    asked = requests.select(*keys).distinct()
    return found.join(asked, null_safe(found, asked, keys), "left_semi")


def with_batch(requests: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """``requests`` with the batch that answered each as ``__batch``, NULL where none did: compared with the journal once
    and stored, as several steps go on from it."""
    parts = named_parts(requests, path, keys)
    if not parts:
        return requests.withColumn("__batch", F.lit(None).cast("string"))
    found = answered_keys(requests, path, keys, parts).withColumnRenamed("batch", "__batch")
    return stored(requests.join(found, null_safe(requests, found, keys), "left").select(*[requests[c] for c in requests.columns], "__batch"), "asked")


def decide_once(
    requests: DataFrame,
    path: str,
    keys: Sequence[str],
    decide: Callable[[DataFrame], DataFrame],
    derive: Callable[[DataFrame], Mapping[str, DataFrame]],
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Plan rows of ``requests`` and the event rows of the batches they belong to, decided now or earlier.

    ``decide`` turns undecided requests into a plan that has the keys, ``derive`` a plan into event rows by table name.
    Requests that a committed batch answered are not decided again. A call stopped before the commit row leaves
    nothing that counts.
    """
    spark = requests.sparkSession
    asked = with_batch(requests, path, keys)
    fresh, known = asked.filter("__batch IS NULL").drop("__batch"), asked.filter("__batch IS NOT NULL")
    before = sorted(r["__batch"] for r in known.select("__batch").distinct().collect())
    now = []
    plan = decide(fresh)
    if not fresh.isEmpty():
        batch = uuid.uuid4().hex
        plan.write.parquet(f"{path}/rows/plan/batch={batch}")
        decided = spark.read.schema(plan.schema).parquet(f"{path}/rows/plan/batch={batch}")
        for name, rows in derive(decided).items():
            rows.write.parquet(f"{path}/rows/{name}/batch={batch}")
        own = decided.select(*keys, part_of(keys).alias("part")).repartition("part").distinct()
        own.write.partitionBy("part").parquet(f"{path}/keys/batch={batch}")
        filter_rows(decided, keys).write.parquet(f"{path}/bloom/batch={batch}")
        spark.createDataFrame([(batch, LAYOUT)], "batch STRING, layout INT").coalesce(1).write.mode("append").parquet(f"{path}/commits")
        now.append(batch)

    def rows_of(name: str, schema, batches: Sequence[str]) -> DataFrame:
        paths = [f"{path}/rows/{name}/batch={b}" for b in batches]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    # older batches may answer more than was asked; what was decided now was asked
    older = rows_of("plan", plan.schema, before)
    plans = older.join(known, null_safe(older, known, keys), "left_semi").unionByName(rows_of("plan", plan.schema, now))
    return plans, {name: rows_of(name, rows.schema, [*before, *now]) for name, rows in derive(plan).items()}


def append_missing(rows: DataFrame, event_table: str, table: str) -> None:
    """Append the event rows that ``table`` does not hold yet, compared null-safe in every column; the stored side is
    narrowed to the time span of ``rows``."""
    spark = rows.sparkSession
    events = conform_events(rows, event_table)
    if spark.catalog.tableExists(table):
        low, high = events.agg(F.min("event_timestamp"), F.max("event_timestamp")).first()
        if low is None:
            return
        held = spark.table(table).filter(F.col("event_timestamp").between(F.lit(low), F.lit(high)))
        # rows differ in few columns, so a digest of all of them leads the comparison
        digest = F.xxhash64(*[F.col(f.name).cast(f.dataType) for f in events.schema.fields])
        events, held = events.withColumn("__digest", digest), held.withColumn("__digest", digest)
        columns = [c for c in events.columns if c != "__digest"]
        events = events.join(held, null_safe(events, held, ["__digest", *columns]), "left_anti").drop("__digest")
    append_table(events, table)
