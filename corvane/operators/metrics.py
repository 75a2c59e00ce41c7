"""Retrieval, agreement and generation metrics as aggregates; resampling tests in NumPy for the sake of its generator."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text

KS = (1, 3, 5, 10, 20)
CATEGORIES = ("retrieval_miss", "wrong_abstention", "unsupported_claim", "citation_failure", "judge_error")


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


def retrieval_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Of each query with gold keys: recall, hit and ndcg at each k, and mrr. Queries without hits score 0; hits that
    repeat a key count each time. ``gold``: query_id, key."""
    gold = gold.distinct()
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    good = hits.join(gold, ["query_id", "key"]).select("query_id", "rank", (1.0 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    within = [f(k) for k in ks for f in (lambda k: F.count(F.when(F.col("rank") <= k, 1)).alias(f"found{k}"), lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain")).otherwise(0.0)).alias(f"dcg{k}"))]
    joined = sizes.join(good.groupBy("query_id").agg(F.min("rank").alias("first"), *within), "query_id", "left")

    def ideal(k: int) -> Column:
        gains = np.cumsum(1 / np.log2(np.arange(2, k + 2)))
        return F.element_at(F.array(*[F.lit(float(g)) for g in gains]), F.least(F.col("n"), F.lit(k)).cast("int"))

    found = lambda k: F.coalesce(F.col(f"found{k}"), F.lit(0))
    out = [c for k in ks for c in (
        (found(k) / F.col("n")).alias(f"recall_at_{k}"), (found(k) > 0).cast("double").alias(f"hit_at_{k}"), (F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal(k)).alias(f"ndcg_at_{k}"))]
    return joined.select("query_id", *out, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def citation_metrics(cited: Column, supported: Column, claims: Column) -> Column:
    both = F.size(F.array_intersect(cited, supported))
    return F.struct(ratio(both, F.size(F.array_distinct(cited))).alias("precision"), ratio(both, claims).alias("recall"))


def abstention_metrics(rows: DataFrame, abstained: str = "abstained", unanswerable: str = "unanswerable") -> DataFrame:
    p, g = F.col(abstained), F.col(unanswerable)
    counts = rows.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    return counts.select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("abstention_precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("abstention_recall"))


def bootstrap_interval(values: np.ndarray, confidence: float = 0.95, samples: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Quantiles of resampled means. The draws are those of NumPy's default generator, sample by sample."""
    if not len(values):
        raise ValueError("values must not be empty")
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(values, size=len(values), replace=True).mean() for _ in range(samples)])
    tail = (1.0 - confidence) / 2
    return float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))


def bootstrap_ci(rows: DataFrame, by: str, value: str, order: str, confidence: float = 0.95, samples: int = 2000, seed: int = 17) -> DataFrame:
    """(by, n, mean, low, high) for each group, its values in order of ``order``. A group is one metric of one run."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("_order")["_value"].dropna().to_numpy(dtype=float)
        low, high = bootstrap_interval(values, confidence, samples, seed) if len(values) else (np.nan, np.nan)
        return pd.DataFrame({by: group[by].iloc[:1], "n": [len(values)], "mean": [values.mean() if len(values) else np.nan], "low": [low], "high": [high]})

    held = rows.select(by, F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    done = held.groupBy(by).applyInPandas(one, f"{by} {dict(rows.dtypes)[by]}, n long, mean double, low double, high double")
    return done.select(by, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mean", "low", "high")])


def permutation_p(one: np.ndarray, two: np.ndarray, samples: int = 5000, seed: int = 0) -> float:
    """Two-sided p of a paired sign-flip test."""
    if len(one) != len(two) or not len(one):
        raise ValueError("paired samples must be non-empty and of equal length")
    apart = np.asarray(one, dtype=float) - np.asarray(two, dtype=float)
    rng, seen = np.random.default_rng(seed), abs(float(apart.mean()))
    flips = (rng.choice(np.array([-1.0, 1.0]), size=len(apart)) for _ in range(samples))
    return (sum(abs(float((apart * f).mean())) >= seen for f in flips) + 1) / (samples + 1)


def paired_permutation(one: DataFrame, two: DataFrame, key: str, value: str, samples: int = 5000, seed: int = 0) -> DataFrame:
    """One row (n, difference, p) of the pairs that share a key. The pairs of one comparison meet in one task."""
    pairs = one.select(key, F.col(value).alias("x")).join(two.select(key, F.col(value).alias("y")), key).select(F.lit(1).alias("g"), F.col(key).alias("k"), F.col("x").cast("double"), F.col("y").cast("double"))

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        x, y = group["x"].to_numpy(), group["y"].to_numpy()
        return pd.DataFrame({"n": [len(x)], "difference": [float((x - y).mean())], "p": [permutation_p(x, y, samples, seed)]})

    return pairs.groupBy("g").applyInPandas(test, "n long, difference double, p double")


def cohens_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) from the contingency table; 1 if chance alone would agree."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    left, right = cells.groupBy("a").agg(F.sum("c").alias("ca")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("chance"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    both = total.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("expected"))
    return both.withColumn("kappa", F.when(F.col("expected") == 1.0, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1.0 - F.col("expected"))))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg((F.abs(F.col(a) - F.col(b)) <= 1).cast("double")).alias("within_one"))


def has_marker(output: Column, markers: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.lower(output).contains(m.lower()) for m in markers], F.lit(False))


def injection_rate(outputs: DataFrame, column: str, markers: list[str]) -> DataFrame:
    """One row (total, successes, rate): outputs that hold any marker."""
    counts = outputs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(has_marker(F.col(column), markers), F.lit(False))).alias("successes"))
    return counts.withColumn("rate", ratio(F.col("successes"), F.col("total")))


def judgements(attempts: DataFrame) -> DataFrame:
    """(id, score, rationale, error) from raw answers (id, attempt, raw): the first of two attempts that is JSON with a
    score from 0 to 4, cut to a whole number; else the error judge_error."""
    read = F.from_json("raw", "score string, rationale string")
    score = F.coalesce(F.try_to_number(read["score"], F.lit("9999999999.999999")).cast("double"), F.when(F.lower(read["score"]) == "true", 1.0).when(F.lower(read["score"]) == "false", 0.0))
    whole = F.floor(score).cast("int")
    good = attempts.where(F.col("attempt") <= 2).select("id", F.when(whole.between(0, 4), F.struct(F.col("attempt"), whole.alias("score"), F.coalesce(read["rationale"], F.lit("")).alias("rationale"))).alias("x"))
    best = good.groupBy("id").agg(F.min("x").alias("x"))
    return best.select("id", F.col("x.score").alias("score"), F.coalesce("x.rationale", F.lit("")).alias("rationale"), F.when(F.col("x").isNull(), "judge_error").alias("error"))


def support_metrics(answers: DataFrame, sources: DataFrame, scorer, threshold: float = 0.5) -> DataFrame:
    """(id, faithfulness, citation_precision, citation_recall) of answers (id, answer) against sources (id, number, text):
    each claim against each validly cited source, supported from ``threshold``. Without claims faithfulness is null."""
    own = answers.select("id", text.claims(F.col("answer")).alias("claims"), F.array_distinct(text.citations(F.col("answer"))).alias("cited"))
    cited = own.select("id", F.explode("cited").alias("number")).join(sources, ["id", "number"])
    pairs = own.select("id", F.posexplode("claims").alias("c", "claim")).join(cited, "id")
    held = pairs.where(scorer(F.col("text"), F.col("claim")) >= threshold)
    yes = held.groupBy("id").agg(F.count_distinct("c").alias("claims_held"), F.count_distinct("number").alias("sources_held"))
    valid = cited.groupBy("id").agg(F.count(F.lit(1)).alias("valid"))
    joined = own.select("id", F.size("claims").alias("n")).join(valid, "id", "left").join(yes, "id", "left").na.fill(0, ["valid", "claims_held", "sources_held"])
    share = ratio(F.col("claims_held"), F.col("n"))
    return joined.select(
        "id", F.when(F.col("n") > 0, share).alias("faithfulness"),
        F.when(F.col("n") > 0, ratio(F.col("sources_held"), F.col("valid"))).otherwise(0.0).alias("citation_precision"), share.alias("citation_recall"),
    )


def failure_categories(answerable: Column, recall: Column, abstained: Column, faithfulness: Column, valid: Column, citation_recall: Column, judge_failed: Column) -> Column:
    flags = (answerable & (recall == 0), answerable == abstained, faithfulness < 1.0, ~valid | (citation_recall < 1.0), judge_failed)
    return F.array_compact(F.array(*[F.when(flag, name) for flag, name in zip(flags, CATEGORIES, strict=True)]))


def failure_report(rows: DataFrame, known: tuple[str, ...], examples: int = 3) -> DataFrame:
    """(category, n, examples) for each known category, also those without rows. ``rows``: id, categories."""
    flat = rows.select("id", F.explode("categories").alias("category"))
    counts = flat.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    first = flat.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("id"))).where(F.col("r") <= examples)
    shown = first.groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in known], "category string")
    joined = wanted.join(counts, "category", "left").join(shown, "category", "left")
    return joined.select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast(f"array<{dict(rows.dtypes)['id']}>")).alias("examples"))


def run_totals(rows: DataFrame) -> DataFrame:
    stages = ("retrieval_ms", "rerank_ms", "generation_ms", "preprocess_ms")
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(c), F.lit(0.0)) for c in stages if c in rows.columns], F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg(total).alias("mean_ms"),
    )
