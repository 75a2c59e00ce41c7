"""Deduplication, search, fusion, metrics, prompts, budgets, experiments and review."""

import hashlib
import json
import random
import urllib.error
from io import BytesIO

import numpy as np
import pytest

from corvane.config import Settings
from corvane.functions import ids
from corvane.operators import dedupe, experiments, generate, index, metrics, retrieve, review


def fingerprint(t):
    import re

    w = re.findall(r"\w+", t.lower())
    sh = {"\x1f".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({"\x1f".join(w)} if w else set())
    if not sh:
        return 0
    hs = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))


def greedy(docs, threshold):
    limit, kept, out = max(1, round((1 - threshold) * 64)), [], {}
    for source, t in docs:
        f = fingerprint(t)
        exact = next((s for s, x, _ in kept if x == t), None)
        near = next((s for s, _, g in kept if (f ^ g).bit_count() <= limit and any((f >> 8 * b & 255) == (g >> 8 * b & 255) for b in range(8))), None)
        out[source] = (exact, "exact") if exact else (near, "near") if near else (None, None)
        if not exact and not near:
            kept.append((source, t, f))
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.92), (2, 0.7)])
def test_deduplicate(spark, seed, threshold):
    rng = random.Random(seed)
    docs = []
    for i in range(40):
        t = " ".join(f"w{rng.randrange(4)}" for _ in range(rng.choice([2, 5, 6, 40]))) if i % 4 else rng.choice(["", "!!", "?"])
        docs.append((f"s{i:03d}", t))
    docs += [(f"t{i:03d}", docs[rng.randrange(40)][1]) for i in range(10)]
    df = spark.createDataFrame(docs, "source string, text string").selectExpr("*", "sha2(text, 256) AS doc_hash")
    got = {r.source: (r.matched, r.kind) for r in dedupe.deduplicate(df, ("source",), threshold).collect()}
    assert got == greedy(docs, threshold)
    with pytest.raises(ValueError):
        dedupe.max_distance(1.5)


def test_bm25(spark):
    texts = ["the cat sat", "the dog ran far", "cat cat dog", "", "zebra"]
    queries = [(0, "cat zebra"), (1, "  "), (2, "!!"), (3, "the the dog")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    built = index.bm25_build(df)
    got = {(r.query_id, r["rank"]): (r.key, r.score) for r in index.bm25_search(built, spark.createDataFrame(queries, "query_id long, text string"), 3).collect()}
    docs = [t.split() for t in texts]
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    df_ = {t: sum(t in d for d in docs) for d in docs for t in d}
    raw = {t: np.log(n - c + 0.5) - np.log(c + 0.5) for t, c in df_.items()}
    idf = {t: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for t, x in raw.items()}
    for q, t in queries:
        want = [] if not t.strip() else sorted(((round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in t.split()), 6), i) for i, d in enumerate(docs)), key=lambda x: (-x[0], x[1]))[:3]
        assert [(round(got[q, k + 1][1], 6), got[q, k + 1][0]) for k in range(len(want))] == want
        assert (q, len(want) + 1) not in got


def test_dense_and_mmr(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])], "key long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, embedding array<float>")
    rank = lambda df: [r.key for r in df.orderBy("rank").collect()]
    assert rank(index.dense_search(vectors, asked, 3)) == [3, 1, 2] == rank(index.dense_search_blocks(vectors, asked, 3))
    assert rank(index.dense_search(vectors, asked, 4, "cosine")) == [1, 2, 3, 4]
    hits = index.dense_search(vectors, asked, 3).join(vectors, "key").join(asked.withColumnRenamed("embedding", "query"), "query_id")
    assert rank(retrieve.mmr(hits, 2)) == [1, 3] and retrieve.mmr(hits, 0).count() == 0


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame([(0, k, s, r) for k, s, r in rows], "query_id long, key string, score double, rank int")
    fused = retrieve.fuse(hits([("a", 0.9, 1), ("b", 0.8, 2)]), hits([("b", 5.0, 1), ("c", 4.0, 2), ("a", 3.0, 3)]), 3).orderBy("rank").collect()
    assert [r.key for r in fused] == ["b", "a", "c"] and abs(fused[0].score - (1 / 61 + 1 / 62)) < 1e-12
    tie = retrieve.fuse(hits([("z", 0.9, 1)]), hits([("y", 9.0, 1)]), 2).orderBy("rank").collect()
    assert [r.key for r in tie] == ["z", "y"]
    staged = retrieve.staged(hits([("a", 0.9, 1), ("b", 0.1, 2), ("c", 0.5, 3)]), 3, 2, 0.4)
    assert [(r.key, r["rank"]) for r in staged.orderBy("rank").collect()] == [("a", 1), ("c", 2)]


def test_metrics(spark):
    hits = spark.createDataFrame([(0, "x", 1), (0, "a", 2), (0, "b", 4), (1, "q", 1)], "query_id long, key string, rank int")
    gold = spark.createDataFrame([(0, "a"), (0, "b"), (1, "z")], "query_id long, key string")
    rows = {r.query_id: r for r in metrics.retrieval_metrics(hits, gold).collect()}
    assert (rows[0].recall_at_1, rows[0].recall_at_3, rows[0].recall_at_5, rows[0].hit_at_1, rows[0].mrr) == (0.0, 0.5, 1.0, 0.0, 0.5) and rows[1].mrr == 0.0
    assert abs(rows[0].ndcg_at_5 - (1 / np.log2(3) + 1 / np.log2(5)) / (1 + 1 / np.log2(3))) < 1e-12
    flags = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "abstained boolean, unanswerable boolean")
    assert tuple(metrics.abstention_metrics(flags).head()) == (0.5, 0.5)
    labels = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")
    assert abs(metrics.cohens_kappa(labels, "a", "b").head().kappa - 0.5) < 1e-12
    assert metrics.cohens_kappa(labels.where("a = 0"), "a", "b").head().kappa == 1.0
    values = np.arange(10.0)
    low, high = metrics.bootstrap_interval(values, seed=17)
    assert low < values.mean() < high
    df = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "g string, i long, v double")
    row = metrics.bootstrap_ci(df.repartition(4), "g", "v", "i").head()
    assert (row.low, row.high, row.n) == (low, high, 10)
    assert metrics.permutation_p(values, values) == 1.0 and metrics.permutation_p(values + 5, values) < 0.01
    judged = spark.createDataFrame([(1, 1, "no"), (1, 2, '{"score": 3.7, "rationale": "ok"}'), (2, 1, '{"score": 9}'), (2, 2, "")], "id long, attempt int, raw string")
    assert {r.id: (r.score, r.error) for r in metrics.judgements(judged).collect()} == {1: (3, None), 2: (None, "judge_error")}


def test_support(spark):
    from pyspark.sql import functions as F

    answers = spark.createDataFrame([(1, "cats purr [1]. dogs fly [2] [9]."), (2, "not found in the provided documents"), (3, "no marks")], "id long, answer string")
    sources = spark.createDataFrame([(1, 1, "cats purr"), (1, 2, "dogs bark")], "id long, number int, text string")
    scorer = lambda t, c: F.when(c.contains(t), 1.0).otherwise(0.0)
    rows = {r.id: tuple(r)[1:] for r in metrics.support_metrics(answers, sources, scorer).collect()}
    assert rows == {1: (0.5, 0.5, 0.5), 2: (None, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_prompts_and_answers(spark):
    asked = spark.createDataFrame([(0, "Why?"), (1, "How?")], "query_id long, question string")
    hits = spark.createDataFrame([(0, 1, "short"), (0, 2, "x" * 900), (0, 3, "tiny")], "query_id long, rank int, text string")
    rows = {r.query_id: r for r in generate.pack_prompts(asked, hits, len(generate.HEADER) + 500).collect()}
    assert rows[0].packed == 1 and "tiny" not in rows[0].prompt and rows[1].packed == 0
    done = generate.answer(generate.pack_prompts(asked, hits).selectExpr("query_id", "packed AS n_hits", "prompt"), generate.FixedProvider)
    got = {r.query_id: r for r in done.collect()}
    assert got[0].cited == [1] and got[0].valid and got[1].abstained and not got[0].abstained


def test_budget_and_provider():
    budget = generate.Budget(1.0)
    budget.reserve(0.6)
    with pytest.raises(generate.BudgetExceeded):
        budget.reserve(0.5)
    budget.settle(0.4, 0.6)
    assert abs(budget.left_usd - 0.6) < 1e-12
    with pytest.raises(generate.BudgetExceeded):
        generate.Budget(0.0).reserve(0.0)
    calls = []

    def open_url(request, timeout):
        calls.append(request)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, BytesIO())
        return BytesIO(json.dumps({"choices": [{"message": {"content": " hi "}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode())

    local = generate.HttpProvider("http://localhost/v1", "m", open_url=open_url, pause=lambda s: None)
    assert local.generate("x").text == "hi" and len(calls) == 3

    def refuse(request, timeout):
        calls.append(request)
        raise urllib.error.HTTPError(request.full_url, 401, "no", {}, BytesIO())

    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        generate.HttpProvider("http://localhost/v1", "m", open_url=refuse).generate("x")
    assert len(calls) == 1


def test_settings():
    assert Settings.from_env({"CORVANE_TOP_K": "3", "CORVANE_SCORE_FLOOR": "0.5"}).score_floor == 0.5
    for bad in ({"top_k": 30}, {"retriever": "x"}, {"provider": "anthropic"}, {"max_spend_usd": -1.0}, {"provider": "openai-compatible", "base_url": "http://far.example"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_experiments(spark, tmp_path):
    assert experiments.grid_configs(spark).count() == 5184 == len(experiments.configs())
    runs = experiments.Runs(spark, str(tmp_path))
    assert runs.run({"a": 1}, lambda c: {"mrr": 0.5}) == ({"mrr": 0.5}, False)
    assert runs.run({"a": 1}, lambda c: {"mrr": 0.9}) == ({"mrr": 0.5}, True)
    with pytest.raises(ZeroDivisionError):
        runs.run({"a": 2}, lambda c: {"x": 1 / 0})
    assert runs.run({"a": 2}, lambda c: {"mrr": 1.0}) == ({"mrr": 1.0}, False)
    assert {r.config_hash for r in runs.table().collect()} == {ids.config_hash({"a": 1}), ids.config_hash({"a": 2})}
    points = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 3.0, 0.9)], "config_hash string, latency_ms double, mrr double")
    assert {r.config_hash for r in experiments.pareto(points).where("on_front").collect()} == {"a", "c"}


def test_seed_validation(spark):
    schema = "ord int, id string, question string, gold_answer string, question_type string, answerable boolean, gold_chunk_ids array<string>"
    chunks = spark.createDataFrame([("c1", "The engine holds forty two shards of data")], "id string, text string")
    good = "How many shards does the engine hold?"
    items = [
        (0, "a", good, "forty two shards", "factoid", True, ["c1"]), (1, "b", good.upper(), "forty two shards", "factoid", True, ["c1"]), (2, "c", "Short?", "purple elephants", "numeric", True, ["c1", "zz"]),
        (3, "d", "Source: what colour is the engine here?", "not found in the provided documents", "unanswerable", False, []), (4, "e", "What else is there in the engine?", "purple elephants", "factoid", True, ["c1"]),
    ]
    rows = {r.id: r.reasons for r in review.validate_seed(spark.createDataFrame(items, schema), chunks).collect()}
    assert rows["a"] == [] and rows["b"] == ["duplicate_question"] and rows["d"] == ["question_prompt_leakage"] and rows["e"] == ["answer_low_evidence_overlap"]
    assert rows["c"] == ["missing_gold_chunk", "numeric_without_number", "question_length", "question_too_trivial"]


def test_rereview_and_gate(spark):
    rows = [("APPROVED", "approved", "2026-01-01", "2026-01-09", "A  b", "a B", "x|y", "y|x"), ("APPROVED", "REJECTED", "2026-01-01", "2026-01-03", "a", "b", "x", "y"), ("REJECTED", "", "", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "first_status string, second_status string, first_review_date string, rereview_date string, first_answer string, second_answer string, first_gold_chunk_ids string, second_gold_chunk_ids string")
    got = review.rereview_score(df).head()
    assert (got.n, got.least_gap_days, got.too_soon, got.exact_answer_agreement, got.gold_chunk_set_agreement) == (2, 2, 1, 0.5, 0.5)
    gate = review.release_gate(spark, {"x": True}, {}, {}, {}, {}, {}, "", 0)
    assert gate.where("passed").count() == 1


def test_bm25_zero_rows_before_negative_scores(spark):
    rows = [(i, "aa bb") for i in range(40)] + [(40 + i, "") for i in range(20)]
    built = index.bm25_build(spark.createDataFrame(rows, "id long, text string"))
    asked = spark.createDataFrame([(1, "aa bb"), (2, "zz"), (3, "zz aa")], "query_id long, text string")
    found = index.bm25_search(built, asked, 5).collect()
    keys = {q: [r.key for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert keys == {1: [40, 41, 42, 43, 44], 2: [0, 1, 2, 3, 4], 3: [40, 41, 42, 43, 44]}
    assert all(r.score == 0 for r in found)
