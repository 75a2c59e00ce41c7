"""Evaluation sets and human review: building, checking, re-reviewing, and the release gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids, text
from corvane.operators.metrics import agreement, cohens_kappa, has_marker

# What a generated item must not leak.
LEAKS = ("passage", "question", "answer", "return only", "source")
QUESTION_TYPES = ("single_hop", "multi_hop", "numeric", "factoid", "list", "unanswerable")
SPLITS = ("synthetic", "human_verified")
ITEM_SCHEMA = "id string, question string, question_type string, answerable boolean, split string, gold_chunk_ids array<string>, gold_sources array<string>, gold_answer string, ambiguous boolean, notes string"


def eligible_chunks(chunks: DataFrame, low: int = 80, high: int = 500, most_chars: int = 3500, seed: int = 0) -> DataFrame:
    """Chunks that items may be made from, in a seeded order (``place``) that no sort of one partition is needed for."""
    n = F.size(text.tokens(F.col("text")))
    return chunks.where(n.between(low, high) & (F.length("text") <= most_chars)).withColumn("place", F.xxhash64(F.col("id"), F.lit(seed)))


def item_kind(body: Column, place: Column) -> Column:
    """numeric where a chunk has a number, list where it has a bullet, else factoid and single_hop in turn."""
    return F.when(body.rlike("[0-9]"), "numeric").when(body.rlike(r"(?m)^\s*[-*] "), "list").when(place % 2 == 0, "factoid").otherwise("single_hop")


def absent(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (id, phrase) whose phrase no chunk holds, in any case. The candidates are few; they travel."""
    held = chunks.join(F.broadcast(candidates), F.lower("text").contains(F.lower("phrase"))).select(candidates["id"]).distinct()
    return candidates.join(held, "id", "left_anti")


def check_items(items: DataFrame) -> DataFrame:
    """Items with ``problem``: the first constraint of the schema that an item breaks, else null."""
    return items.withColumn("problem", F.when(F.col("id").isNull() | F.col("question").isNull(), "missing field").when(~F.col("question_type").isin(*QUESTION_TYPES), "question_type").when(~F.col("split").isin(*SPLITS), "split"))


def validate_seed(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (ord, id, question, gold_answer, question_type, answerable, gold_chunk_ids) with ``reasons``, sorted; items
    without reasons are accepted. A question that an accepted item before it asks is a duplicate."""
    question, reply = text.strip(F.coalesce("question", F.lit(""))), text.strip(F.coalesce("gold_answer", F.lit("")))
    asked, replied = text.plain_words(question), text.plain_words(reply)
    wanted = items.select("ord", F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id"))
    met = wanted.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id", "left")
    evidence = met.groupBy("ord").agg(F.bool_or(F.col("text").isNull()).alias("lost"), F.array_distinct(F.flatten(F.collect_list(text.content_words(F.col("text"))))).alias("evidence"))
    rows = items.join(evidence, "ord", "left")
    size = F.size(F.coalesce("gold_chunk_ids", F.array().cast("array<string>")))
    missing = (size == 0) | F.coalesce("lost", F.lit(False))
    own = text.content_words(reply)
    low = (F.size(own) > 0) & (F.size(F.array_intersect(own, F.col("evidence"))) / F.when(F.size(own) > 0, F.size(own)) < 0.35)
    leads = reduce(lambda a, b: a | b, [F.lower(question).startswith(f"{m}:") for m in LEAKS])
    leaks = F.array_join(replied, " ").isin(*LEAKS) | has_marker(reply, [f"{m}:" for m in LEAKS])
    yes = F.coalesce("answerable", F.lit(False))
    flags = (
        (~question.endswith("?"), "question_missing_question_mark"),
        (~F.size(asked).between(5, 36), "question_length"),
        (F.size(F.array_distinct(asked)) < 4, "question_too_trivial"),
        (leads, "question_prompt_leakage"),
        (yes & ~F.size(replied).between(1, 80), "answer_length"),
        (yes & leaks, "answer_prompt_leakage"),
        (yes & missing, "missing_gold_chunk"),
        (yes & ~missing & F.coalesce(low, F.lit(False)), "answer_low_evidence_overlap"),
        (yes & (F.col("question_type") == "numeric") & ~reply.rlike(r"\p{Nd}"), "numeric_without_number"),
        (~yes & (size > 0), "unanswerable_has_gold_chunk"),
        (~yes & ~text.abstains(reply), "unanswerable_bad_gold_answer"),
    )
    rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(flag, name) for flag, name in flags]))).withColumn("_key", F.array_join(asked, " "))
    clean = F.when(F.size("reasons") == 0, F.col("ord"))
    first = F.min(clean).over(Window.partitionBy("_key"))
    again = F.when(F.col("ord") > first, F.array(F.lit("duplicate_question"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_again", again).withColumn("reasons", F.array_sort(F.concat("reasons", "_again"))).drop("_key", "_again", "lost", "evidence")


def rejection_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def review_queue(items: DataFrame, n: int = 120) -> DataFrame:
    """The first ``n`` items as the rows of a review sheet, their ids joined by a pipe."""
    blank = ["human_status", "human_corrected_question", "human_gold_answer", "human_gold_chunk_ids", "human_gold_sources", "human_answer_score_0_4", "reviewer_notes", "first_review_date"]
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|").alias(c)
    first = items.orderBy("ord").limit(n)
    return first.select("id", "question", "question_type", F.col("gold_answer").alias("generated_answer"), joined("gold_chunk_ids"), joined("gold_sources"), F.coalesce(F.col("ambiguous").cast("string"), F.lit("")).alias("ambiguous"), *[F.lit("").alias(c) for c in blank])


def finalise_gold(sheet: DataFrame) -> DataFrame:
    """Approved and corrected rows of a sheet with what the reviewer put in place of the generated values, and
    ``problem``: what is missing, else null."""
    first = lambda a, b: F.coalesce(F.nullif(text.strip(F.col(a)), F.lit("")), text.strip(F.col(b)))
    listed = lambda a, b: F.when(F.size(text.pipe_list(F.col(a))) > 0, text.pipe_list(F.col(a))).otherwise(text.pipe_list(F.col(b)))
    rows = sheet.where(F.upper(text.strip(F.col("human_status"))).isin("APPROVED", "CORRECTED"))
    answerable = F.col("question_type") != "unanswerable"
    done = rows.select(
        "id", first("human_corrected_question", "question").alias("question"), "question_type", answerable.alias("answerable"), F.lit("human_verified").alias("split"),
        listed("human_gold_chunk_ids", "gold_chunk_ids").alias("gold_chunk_ids"), listed("human_gold_sources", "gold_sources").alias("gold_sources"),
        first("human_gold_answer", "generated_answer").alias("gold_answer"), F.lower(text.strip(F.col("ambiguous"))).isin("1", "true", "yes").alias("ambiguous"),
        F.nullif(text.strip(F.col("reviewer_notes")), F.lit("")).alias("notes"), text.strip(F.col("generated_answer")).alias("candidate_answer"),
        F.expr("try_cast(trim(human_answer_score_0_4) AS int)").alias("human_score"), F.expr("try_cast(trim(first_review_date) AS date)").alias("first_review_date"),
    )
    bare = F.col("answerable") & (F.size("gold_chunk_ids") == 0) & (F.size("gold_sources") == 0)
    problem = (
        F.when(F.col("first_review_date").isNull(), "first_review_date").when(~F.coalesce(F.col("human_score").between(0, 4), F.lit(False)), "human_answer_score_0_4")
        .when((F.col("question") == "") | (F.col("gold_answer") == "") | bare, "incomplete approved row")
    )
    return done.withColumn("problem", problem)


def human_subset(items: DataFrame, least: int = 100) -> DataFrame:
    """One row (verified, incomplete, ok): whether there are enough verified items, each with an answer and evidence."""
    empty = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    lacks = (F.coalesce("gold_answer", F.lit("")) == "") | (F.col("answerable") & empty("gold_chunk_ids") & empty("gold_sources"))
    verified = F.col("split") == "human_verified"
    counts = items.agg(F.count_if(verified).alias("verified"), F.count_if(verified & lacks).alias("incomplete"))
    return counts.withColumn("ok", (F.col("verified") >= least) & (F.col("incomplete") == 0))


def dataset_report(items: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
    return ids.dataset_checksum(items.select(*columns), columns).join(human_subset(items))


def rereview_sample(sheet: DataFrame, n: int = 30, seed: int = 17) -> DataFrame:
    """``n`` of the reviewed rows, by a seeded hash of the id."""
    return sheet.where(text.strip(F.col("human_status")) != "").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def rereview_score(rows: DataFrame) -> DataFrame:
    """One row (n, least_gap_days, too_soon, status_kappa, exact_answer_agreement, gold_chunk_set_agreement) of the rows that
    were reviewed twice. A gap under seven days counts as too soon."""
    ok = lambda c: F.upper(text.strip(F.col(c))).isin("APPROVED", "CORRECTED").cast("int")
    sets = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.col(c), r"\|", -1), lambda x: x != "")))
    done = rows.where(text.strip(F.col("second_status")) != "").select(
        ok("first_status").alias("a"), ok("second_status").alias("b"), F.datediff(F.to_date("rereview_date"), F.to_date("first_review_date")).alias("gap"),
        (text.squeezed(F.col("first_answer")) == text.squeezed(F.col("second_answer"))).alias("same_answer"), (sets("first_gold_chunk_ids") == sets("second_gold_chunk_ids")).alias("same_chunks"),
    )
    totals = done.agg(
        F.min("gap").alias("least_gap_days"), F.count_if(F.col("gap") < 7).alias("too_soon"), F.avg(F.col("same_answer").cast("double")).alias("exact_answer_agreement"), F.avg(F.col("same_chunks").cast("double")).alias("gold_chunk_set_agreement")
    )
    return cohens_kappa(done, "a", "b").select("n", F.col("kappa").alias("status_kappa")).join(totals)


def judge_validation(labels: DataFrame, scores: DataFrame, least: int = 30) -> DataFrame:
    """One row (n, errors, kappa, exact, within_one, ok) of a judge's scores (id, score) against human ones (id, human_score)."""
    both = labels.select("id", "human_score").join(scores.select("id", "score"), "id", "left")
    good = both.where(F.col("score").isNotNull())
    errors = both.agg(F.count_if(F.col("score").isNull()).alias("errors"))
    return cohens_kappa(good, "human_score", "score").select("n", "kappa").join(errors).join(agreement(good, "human_score", "score")).withColumn("ok", F.col("n") >= least)


def injection_cases(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """Outputs (id, output) with whether each holds its own case's marker and any case's. The cases are few."""
    markers = cases.agg(F.collect_set(F.lower("marker")).alias("markers"))
    joined = outputs.join(F.broadcast(cases.select("id", "marker")), "id").join(F.broadcast(markers))
    low = F.lower("output")
    return joined.select("id", low.contains(F.lower("marker")).alias("own_marker"), F.exists("markers", lambda m: low.contains(m)).alias("any_marker"))


def release_gate(spark: SparkSession, artifacts: dict[str, bool], metrics: dict, experiments: dict, judge: dict, injection: dict, rereview: dict, failure_text: str, compact_rows: int) -> DataFrame:
    """(ord, name, passed): the gate's checks of a release's artifacts; it opens when all passed."""
    human = metrics.get("human_verified") or {}

    def measured(part: str, name: str) -> bool:
        m = (human.get(part) or {}).get(name) or {}
        return int(m.get("n") or 0) > 0 and isinstance(m.get("ci95"), list) and len(m["ci95"]) == 2

    full = int(experiments.get("configs_expected_full", -1))
    checks = [(f"artifact {name}", there) for name, there in artifacts.items()]
    checks += [("100 human questions", int(human.get("question_count") or 0) >= 100), ("synthetic results apart", bool(metrics.get("synthetic_retrieval")))]
    checks += [(f"{part} {name}", measured(part, name)) for part, name in (("retrieval", "mrr"), ("retrieval", "recall@5"), ("generation", "correctness"), ("generation", "faithfulness"), ("generation", "citation_precision"), ("generation", "citation_recall"))]
    checks += [
        ("grid complete", bool(experiments.get("complete")) and int(experiments.get("configs_completed", 0)) == full), ("compact results complete", compact_rows == full),
        ("judge validated", int(judge.get("n", 0)) >= 30 and "cohens_kappa" in judge), ("injection measured", int(injection.get("total", 0)) > 0 and "attack_success_rate" in injection),
        ("30 re-reviews", int(rereview.get("n", 0)) >= 30), ("re-reviews after 7 days", int(rereview.get("minimum_gap_days", 0)) >= 7), ("failure cases shown", "Representative cases" in failure_text),
    ]
    return spark.createDataFrame([(i, n, bool(p)) for i, (n, p) in enumerate(checks)], "ord int, name string, passed boolean")
