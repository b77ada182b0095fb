"""Chunking, exact search with ties and hot terms, context, prompts."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import nearest
from lakeops.functions import text as tx
from lakeops.operators import retrieval as rt


def windows(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while text:
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


def test_chunk_fixture(spark):
    df = spark.createDataFrame([("abcdefghij" * 100,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.chunk_texts("t", 100, 20)).collect()]
    assert got[0] == windows("abcdefghij" * 100, 100, 20) and len(got[0]) > 1
    assert got[1] == [] and got[2] in ([], None)
    with pytest.raises(ValueError):
        tx.chunk_texts("t", 10, 10)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\n é😀", max_size=60), min_size=1, max_size=6), st.integers(1, 12), st.data())
def test_chunks_match_slicing(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = rt.chunk_rows(df, "t", size, overlap, ["i"]).collect()
    got = {i: [r.chunk_text for r in sorted(rows, key=lambda r: r.position) if r.i == i] for i in range(len(texts))}
    assert got == {i: windows(t, size, overlap) for i, t in enumerate(texts)}


def test_hash_embedding(spark):
    df = spark.createDataFrame([("texto de teste",), ("texto de teste",), ("texto diferente",)], "t string")
    a, b, c = [r[0] for r in df.select(tx.hash_embedding("t")).collect()]
    assert a == b != c and len(a) == 8 and all(-1 <= x <= 1 for x in a)


def vectors(n: int, dim: int, seed: int) -> list[list[float]]:
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(n)]
    for i in range(0, n, 3):
        base[i] = base[0]  # a third of all rows are copies
    return base


@pytest.mark.parametrize("part", [1 << 24, 200])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_similar_chunks_brute_force(spark, part, kind):
    chunks, questions = vectors(90, 6, 1), vectors(7, 6, 2) + [[0.0] * 6]
    questions[1] = chunks[0]
    name = (lambda i: f"c{i:03d}") if kind == "string" else (lambda i: i)
    c = spark.createDataFrame([(name(i), v) for i, v in enumerate(chunks)], f"chunk_id {kind}, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(questions)], "query_id bigint, vector array<double>")
    got = {}
    for r in rt.similar_chunks(q, c, 12, part_bytes=part).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id

    def unit(m):
        m = np.array(m)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(questions) @ unit(chunks).T, 12)
    for i in range(len(questions)):
        order = sorted(range(len(chunks)), key=lambda j: (-scores[i, j], name(j)))[:12]
        assert [got[i][k] for k in range(1, 13)] == [name(j) for j in order]


def test_missing_and_uneven_vectors(spark):
    kind = "vector array<double>"
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], f"chunk_id string, {kind}")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], f"query_id int, {kind}")
    assert [(r.query_id, r.chunk_id) for r in rt.similar_chunks(q, c, 5).orderBy("rank").collect()] == [(1, "a"), (1, "c")]
    uneven = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0, 1.0])], f"chunk_id string, {kind}").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        rt.similar_chunks(q, uneven, 5).collect()


def test_no_questions(spark):
    c = spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([], "query_id string, vector array<double>")
    assert rt.similar_chunks(q, c).count() == 0


def test_own_number_of_results(spark):
    c = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(9)], "chunk_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 1.0], 4), (3, [1.0, 1.0], None), (4, [1.0, 1.0], 0)], "query_id int, vector array<double>, n int")
    got = [(r.query_id, r["rank"], r.chunk_id) for r in rt.similar_chunks(q, c, "n").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 8), (2, 2, 7), (2, 3, 6), (2, 4, 5)]


def test_one_search_plan_at_every_size(spark):
    c = spark.range(50).selectExpr("id AS chunk_id", "array(double(id), 1D) AS vector")

    def nodes(count: int) -> list[str]:
        q = spark.range(count).selectExpr("id AS query_id", "array(1D, double(id)) AS vector")
        plan = rt.similar_chunks(q, c, 3)._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"^[ :+\-]*(?:\*\(\d+\) )?([A-Z]\w+)", plan, re.M)

    assert nodes(3) == nodes(5000)


def test_keyword_kernel_in_bounded_runs(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(nearest, "CELLS", 7)
    for lengths in ([], [0, 0], [9], [3, 3, 3, 0, 20, 1], rng.integers(0, 9, 40).tolist()):
        lengths = np.array(lengths, dtype=np.int64)
        runs = list(nearest.bounded(lengths))
        assert [i for run in runs for i in range(run.start, run.stop)] == list(range(len(lengths)))
        assert all(lengths[run].sum() - lengths[run][-1] <= 7 for run in runs)


def word_questions(rng, count, words):
    lists = [rng.choice(words, rng.integers(1, len(words)), replace=False).tolist() for _ in range(count)]
    table = pa.table({"query_id": list(range(count)), "k": pa.array([3] * count, pa.int32()), "terms": lists})
    return lists, nearest.Questions.from_table(table)


SHARE = nearest.SET_SHARE


@pytest.mark.parametrize("share, most", [(SHARE, nearest.MOST_SETS), (1e-9, 8), (1e-9, 1), (1e9, 8)])
def test_bit_sets_and_postings_count_alike(monkeypatch, share, most):
    monkeypatch.setattr(nearest, "SET_SHARE", share)
    monkeypatch.setattr(nearest, "MOST_SETS", most)
    rng = np.random.default_rng(1)
    asked, held = word_questions(rng, 20, [f"w{i}" for i in range(150)])
    chunks = [rng.choice([f"w{i}" for i in range(200)], 40, replace=False).tolist() for _ in range(30)]
    got = nearest.overlap_scores(held, pa.record_batch({"terms": pa.array([*chunks, []])}))
    assert got.tolist() == [[len(set(c) & set(a)) for a in asked] for c in [*chunks, []]]
    assert len(held.sets) == (0 if share > 1 else min(most, 3)) or share == SHARE


def test_slices_without_an_entry_sort_nothing():
    best = nearest.Best(np.array([2, 1]))
    best.add(np.array([[0.5, 0.9], [0.4, 0.8]]), 0)
    assert best.sorts == 1
    best.add(np.array([[0.4, 0.9], [0.3, 0.1]]), 2)  # equal scores rank by place, so they do not enter
    assert best.sorts == 1
    best.add(np.array([[0.45, 0.0]]), 4)
    assert best.sorts == 2
    question, place, score = best.lists()
    assert (question.tolist(), place.tolist(), score.tolist()) == ([0, 0, 1], [0, 4, 0], [0.5, 0.45, 0.9])


def test_large_merges_go_by_parts_of_the_questions(monkeypatch):
    rng = np.random.default_rng(5)
    keep, slices = rng.integers(1, 9, 40), rng.integers(0, 4, (3, 30, 40)).astype(float)
    lists = []
    for cells in (nearest.CELLS, 60):
        monkeypatch.setattr(nearest, "CELLS", cells)
        best = nearest.Best(keep, 0.0, nearest.count_steps)
        for i, scores in enumerate(slices):
            best.add(scores, 30 * i)
        lists.append([x.tolist() for x in best.lists()])
        assert (best.sorts > 3) == (cells == 60)
    assert lists[0] == lists[1]


def test_lists_of_many_fragments_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(rt, "MERGE_FAN", 2)
    rng = np.random.default_rng(6)
    c = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist(), [f"w{x}" for x in rng.integers(0, 9, 3)]) for i in range(120)], "chunk_id long, vector array<double>, terms array<string>")
    q = spark.createDataFrame([(f"q{i}", rng.integers(-2, 3, 4).astype(float).tolist(), [f"w{x}" for x in rng.integers(0, 9, 2)]) for i in range(9)], "query_id string, vector array<double>, terms array<string>")
    c = c.withColumn("terms", F.array_distinct("terms"))
    q = q.withColumn("terms", F.array_distinct("terms"))
    for search in (rt.similar_chunks, rt.hybrid_chunks):
        many = {tuple(r) for r in search(q, c, 7, part_bytes=300).collect()}
        monkeypatch.setattr(rt, "MERGE_FAN", 64)
        assert many == {tuple(r) for r in search(q, c, 7).collect()} and len(many) == 63
        monkeypatch.setattr(rt, "MERGE_FAN", 2)


def test_near_cells_give_the_same_lists_with_few_scores(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.uniform(-1, 1, (20_000, 8))
    vectors[::50] = vectors[0]
    ids = rng.permutation(len(vectors))
    asked = np.concatenate([rng.uniform(-1, 1, (60, 8)), vectors[:1], np.zeros((1, 8)), vectors[7:8]])
    chunks = pa.table({"chunk_id": ids, "vector": vectors.tolist()})
    held = nearest.Questions.from_table(pa.table({"query_id": range(len(asked)), "k": pa.array([7] * len(asked), pa.int32()), "vector": asked.tolist()}))
    made = []
    add = nearest.Found.add
    monkeypatch.setattr(nearest.Found, "add", lambda self, scores, *rest: (made.append(scores[:, :].size), add(self, scores, *rest))[1])
    by_id, (question, place, score) = nearest.rank_near(chunks, held, np.full(len(asked), -np.inf))
    whole = np.round(nearest.unit_rows(asked) @ nearest.unit_rows(vectors).T, 12)
    for i in range(len(asked)):
        wanted = sorted(range(len(vectors)), key=lambda j: (-whole[i, j], ids[j]))[:7]
        assert by_id.take(pa.array(place[question == i])).to_pylist() == ids[wanted].tolist()
    assert sum(made) < 0.6 * whole.size
    bars = np.array([score[question == i][-1] for i in range(len(asked))])
    made.clear()
    again = nearest.rank_near(chunks, held, bars)[1]
    assert all((a == b).all() for a, b in zip(again, (question, place, score))) and 0 < sum(made) < 0.6 * whole.size


def test_questions_go_only_to_near_fragments(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.uniform(-1, 1, (4000, 3))
    c = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(i, 3, x) for i, x in enumerate(v[:300].tolist())], "query_id long, k int, vector array<double>")
    kind = T.StructType.fromDDL("fragment long, query_id long, ranker string, k int, chunk_ids array<long>, scores array<double>")
    lists, fragments = rt._near_lists(q, c, kind, 0, 2000, None)
    assert fragments > 40 and 300 <= lists.count() < 300 * fragments / 4


def test_later_fragments_list_what_ranks_before_the_bar(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{x}" for x in np.unique(rng.integers(0, 12, n))]
    c = spark.createDataFrame([(f"c{i}", [1.0, float(i)], some(6)) for i in range(900)], "chunk_id string, vector array<double>, terms array<string>")
    q = spark.createDataFrame([(i, [1.0, float(i)], some(5)) for i in range(20)], "query_id long, vector array<double>, terms array<string>")
    whole = {tuple(r) for r in rt.hybrid_chunks(q, c, 6, depth=5).collect()}
    assert whole == {tuple(r) for r in rt.hybrid_chunks(q, c, 6, depth=5, part_bytes=150).collect()} and len(whole) == 120
    kind = T.StructType.fromDDL("fragment long, query_id long, ranker string, k int, chunk_ids array<string>, scores array<double>")
    q = q.select("query_id", F.lit(6).alias("k"), "terms")
    held = {}

    def merged(found, fragments, until):
        held[fragments] = found
        return found.groupBy("query_id", "ranker", "k").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("scores", "chunk_ids"))), lambda a, b: F.when(a.scores != b.scores, F.when(a.scores > b.scores, -1).otherwise(1)).when(a.chunk_ids < b.chunk_ids, -1).otherwise(1)), 1, 6).alias("x")).select(
            F.lit(0).cast("long").alias("fragment"), "query_id", "ranker", "k", "x.chunk_ids", "x.scores")

    lists, fragments = rt._word_lists(q, c.select("chunk_id", "terms"), kind, 5, 150, merged)
    assert fragments > 60 and lists.agg(F.sum(F.size("scores"))).first()[0] < 20 * 6 * fragments / 2


def ranked_words(chunks: list[list[str]], ids: list, asked: list[list[str]], keep: int) -> list[list[tuple[int, object]]]:
    counted = [[(-len(set(words) & set(a)), i) for words, i in zip(chunks, ids)] for a in asked]
    return [[(-n, i) for n, i in sorted(some)[:keep] if n] for some in counted]


@pytest.mark.parametrize("settings", [{}, {"ROW_SHARE": 1}, {"ROW_SHARE": 10**9}, {"ROWS_BYTES": 500, "ROW_SHARE": 10**9}, {"BATCH_BYTES": 1}])
@pytest.mark.parametrize("kind", ["string", "number"])
def test_word_rows_give_the_same_lists_with_few_scores(monkeypatch, settings, kind):
    for name, value in {"DENSE_ROWS": 40, "GROWTH": 3, "FIRST_ROWS": 16, **settings}.items():
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(9)
    draw = lambda most: [f"w{x}" for x in np.unique((rng.pareto(0.7, rng.integers(0, most)) * 3).astype(int) % 400)]
    chunks, asked = [draw(60) for _ in range(1500)], [*(draw(40) for _ in range(50)), ["nowhere"], [], ["w0"], [f"w{x}" for x in range(400)]]
    ids = [f"c{i}" if kind == "string" else int(i) for i in rng.permutation(len(chunks))]
    held = nearest.Questions.from_table(pa.table({"query_id": range(len(asked)), "k": pa.array([7] * len(asked), pa.int32()), "terms": pa.array(asked, pa.list_(pa.string()))}))
    table = pa.table({"chunk_id": ids, "terms": pa.array(chunks, pa.list_(pa.string()))})
    dense, scores = [], nearest.overlap_scores
    monkeypatch.setattr(nearest, "overlap_scores", lambda held, batch: (dense.append(batch.num_rows), scores(held, batch))[1])

    def lists(bars=None, bar_ids=None):
        by_id, (question, place, score) = nearest.rank_chunks(table, held, bars, bar_ids)
        return [list(zip(score[question == i].astype(int).tolist(), by_id.take(pa.array(place[question == i])).to_pylist())) for i in range(len(asked))]

    wanted = ranked_words(chunks, ids, asked, 7)
    assert lists() == wanted and sum(dense) == 40
    last = [some[-1] if len(some) == 7 else (0, None) for some in wanted]
    dense.clear()
    barred = lists(np.array([float(n) for n, _ in last]), pa.array([i for _, i in last], table.schema.field("chunk_id").type))
    assert barred == [some[:-1] if len(some) == 7 else some for some in wanted] and not dense


def test_planes_of_bits_add_up():
    rng = np.random.default_rng(0)
    for count in range(12):
        weights, rows = rng.integers(0, 3, count), rng.integers(0, 2, (count, 2, 130))
        levels = []
        for weight, row in zip(weights.tolist(), rows):
            bits = np.zeros((2, 3), dtype=np.uint64)
            nearest.set_bits(bits.reshape(-1), np.flatnonzero(np.pad(row, ((0, 0), (0, 62)))))
            nearest.add_bits(levels, bits, weight)
        total = (rows << weights[:, None, None]).sum(axis=0) if count else np.zeros((2, 130), dtype=int)
        beaten, before = np.array([2, int(total.max())]), np.array([0, 64 + count])
        got = list(zip(*(x.tolist() for x in nearest.reaching(nearest.settled(levels), beaten, before, 3))))
        assert got == [(i, j, total[i, j]) for i in range(2) for j in range(130) if total[i, j] > beaten[i] or (total[i, j] == beaten[i] and j < before[i])]


def test_words_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def terms(i):
        seen.add(1)
        return [f"w{i % 3}"]

    c = spark.range(30).repartition(2).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"), terms("id").alias("terms"))
    q = spark.createDataFrame([(1, [1.0, 1.0], ["w1"])], "query_id int, vector array<double>, terms array<string>")
    assert rt.hybrid_chunks(q, c, 3).count() == 3 and seen.value == 30


@pytest.mark.parametrize("part", [1 << 24, 40])
def test_any_words_come_back_from_one_string(spark, part):
    end = nearest.WORD_END
    lists = [["a", "b"], [f"a{end}b"], [], [""], ["b", ""], ["b", f"{end}"], None, ["a", "b", "c"]]
    kind = "vector array<double>, terms array<string>"
    c = spark.createDataFrame([(i, [1.0], words) for i, words in enumerate(lists)], f"chunk_id long, {kind}")
    q = spark.createDataFrame([(i, [1.0], words) for i, words in enumerate(lists)], f"query_id long, {kind}")
    some = [(i, words) for i, words in enumerate(lists) if words is not None]
    held = rt._packed(c.filter("terms IS NOT NULL")).orderBy("chunk_id").collect()
    assert [r.joined is None for r in held] == [False, True, True, False, False, True, False]
    wanted = set()
    for i, words in some:
        near = {j: 1 / (60 + k) for k, (j, _) in enumerate(some, 1)}
        shared = sorted((-len(set(words) & set(other)), j) for j, other in some if set(words) & set(other))
        for k, (_, j) in enumerate(shared, 1):
            near[j] += 1 / (60 + k)
        wanted |= {(i, j, k) for k, j in enumerate(sorted(near, key=lambda j: (-round(near[j], 12), j)), 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in rt.hybrid_chunks(q, c, 8, depth=8, part_bytes=part).collect()} == wanted


def test_requests_for_too_many_chunks_are_rejected(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("b", "x", 10_000), ("c", " ", 5)], "query_id string, question string, num_results int")
    got = {r.query_id: (r.is_rejected, r.reject_reason) for r in rt.question_rows(rows.withColumn("prompt", F.lit(None).cast("string"))).collect()}
    assert got == {"a": (False, None), "b": (True, "more than 1000 results"), "c": (True, "no question")}


@pytest.mark.parametrize("part", [1 << 24, 300])
def test_hybrid_brute_force(spark, part):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(["comum", *rng.sample(words, 4)]) for _ in range(60)]  # one word is in every chunk
    asked = [" ".join(["comum", *rng.sample(words, 3)]) for _ in range(5)] + ["nada disso"]
    c = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, t string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id bigint, t string")
    c = c.select("chunk_id", tx.hash_embedding("t").alias("vector"), tx.terms("t").alias("terms"))
    q = q.select("query_id", tx.hash_embedding("t").alias("vector"), tx.terms("t").alias("terms"))
    got = {(r.query_id, r["rank"]): r.chunk_id for r in rt.hybrid_chunks(q, c, 4, depth=10, part_bytes=part).collect()}
    cv, qv = {r.chunk_id: r for r in c.collect()}, {r.query_id: r for r in q.collect()}

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12)

    for i, question in qv.items():
        fused = {}
        by_vector = sorted(cv, key=lambda k: (-cosine(question.vector, cv[k].vector), k))[:10]
        overlap = {k: len(set(question.terms) & set(cv[k].terms)) for k in cv}
        by_terms = sorted((k for k in cv if overlap[k]), key=lambda k: (-overlap[k], k))[:10]
        for ranking in (by_vector, by_terms):
            for position, key in enumerate(ranking, 1):
                fused[key] = fused.get(key, 0) + 1 / (60 + position)
        best = sorted(fused, key=lambda k: (-round(fused[k], 12), k))[:4]
        assert [got[(i, n)] for n in range(1, 5)] == best


def test_named_results(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "d"],), (None,)], "data array<string>")
    rows = [tuple(r) for r in rt.named_results(df, ["x", "y", "z"]).collect()]
    assert rows == [("a", "b", None), ("a", "b", "c")]


RANKED = "query_id int, rank int, display_name string, file_name string, page_number int, chunk_text string"


def test_context_format(spark):
    rows = [(1, 2, "", "b.pdf", None, "dois \n"), (1, 1, "Livro", "a.pdf", 3, "um"), (1, 3, None, "", 0, None), (2, 1, "X", None, 1, "y" * 40)]
    got = {r.query_id: r for r in rt.context_rows(spark.createDataFrame(rows, RANKED), 70).collect()}
    assert got[1].retrieved_chunks == 3
    whole = {r.query_id: r.context_text for r in rt.context_rows(spark.createDataFrame(rows, RANKED)).collect()}
    assert whole[1] == "[Fonte 1] Livro, página 3\num\n\n---\n\n[Fonte 2] b.pdf\ndois\n\n---\n\n[Fonte 3] documento_desconhecido, página 0"
    assert got[1].context_text == whole[1][:70].rstrip() + "\n\n[contexto truncado]"
    assert got[2].context_text == whole[2]


def test_prompts_and_defaults(spark):
    rows = [("a", " oi ", None, 0), ("b", "  ", "sim", 2), ("c", None, " ", None)]
    asked = rt.question_rows(spark.createDataFrame(rows, "query_id string, question string, prompt string, num_results int"))
    got = {r.query_id: r for r in asked.collect()}
    assert (got["a"].question, got["a"].num_results, got["a"].max_context_chars, got["a"].temperature) == ("oi", 5, 6000, 0.1)
    assert (got["b"].question, got["b"].num_results, got["c"].is_rejected) == ("sim", 2, True)
    contexts = spark.createDataFrame([("a", "[Fonte 1] x", 1)], "query_id string, context_text string, retrieved_chunks bigint")
    out = {r.query_id: r for r in rt.prompt_rows(asked.filter("NOT is_rejected"), contexts).collect()}
    assert out["a"].rag_prompt == "Pergunta:\noi\n\nContexto recuperado:\n[Fonte 1] x\n\nResponda em português brasileiro com base apenas no contexto acima."
    assert out["a"].response is None
    assert (out["b"].rag_prompt, out["b"].response, out["b"].retrieved_chunks) == (None, rt.NO_EVIDENCE, 0)


def test_page_quality_thresholds(spark):
    rows = [("Texto limpo de teste",), ("12345 67890 1",), ("#@%&* §§ ¤¤ texto",), ("",), (None,)]
    got = [r.is_usable for r in rt.page_quality(spark.createDataFrame(rows, "page_text string")).collect()]
    assert got == [True, False, False, False, False]


def test_index_vectors_have_length_one(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    rows = {r.chunk_id: r for r in rt.index_rows(df, 2, 3).collect()}
    assert rows["a"].vector == [0.6, 0.8] and rows["b"].vector == [0.0, 0.0]
    assert 0 <= rows["a"].bucket < 8 and rows["b"].bucket == 0


def test_first_sentence(spark):
    df = spark.createDataFrame([("Um. Dois.",), ("sem fim",), ("a\nb! c",)], "chunk_text string")
    got = [r.chunk_summary for r in rt.summary_prompts(df).collect()]
    assert got == ["Um.", "sem fim", "a\nb!"]
    assert re.match(r"Resuma em uma frase", rt.summary_prompts(df).first().request)


def test_missing_page_report_is_usable(spark):
    pages = spark.createDataFrame([("d", "d.pdf", 1, "x", None), ("d", "d.pdf", 2, "y", "ocr")], "document_id string, file_name string, page_number int, page_text string, extraction_method string")
    reports = spark.createDataFrame([("d", 2, False)], "document_id string, page_number int, is_usable boolean")
    documents = spark.createDataFrame([("d", "low")], "document_id string, quality_tier string")
    got = {r.page_number: (r.is_usable, r.extraction_method, r.page_quality_tier) for r in rt.page_rows(pages, reports, documents).collect()}
    assert got == {1: (True, "native", "low"), 2: (False, "ocr", "low")}


def test_retrieval_scores(spark):
    ranked = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "query_id string, rank int, doc string")
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    got = {r.query_id: (r.hit, r.reciprocal_rank, r.precision_at_k) for r in rt.retrieval_scores(ranked, questions, F.col("doc") == "y").collect()}
    assert got == {"a": (1, 0.5, 0.5), "b": (0, 0.0, 0.0), "c": (0, 0.0, 0.0)}
