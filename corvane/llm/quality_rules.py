"""Quality rules as a short-circuit cascade.

A hashed sample gives each rule's cost (work units: characters, words or lines that it touches) and selectivity; the rules then
stand in one CASE in falling order of rejection per cost, so a text stops at the first rule that rejects it. Which
texts are kept doesn't depend on the order. All features come from the text of one row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, pinned, text_or_empty, words_of

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5


def text_features(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds ``_text``, ``_words`` and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Null counts as the empty text, for which all counts are 0. Windows are compared by hash first; only texts in which
    two hashes agree compare the windows themselves, so the count is exact.
    """
    text, words = F.col("_text"), F.col("_words")
    df = df.withColumn("_text", text_or_empty(text_column)).withColumn("_words", words_of(text))
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    df = df.withColumn("_hashes", F.when(F.size(words) >= WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    window = lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("gram"), i.alias("at"))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.array_sort(F.transform(at, window))))
    grams = F.col("_sorted")
    same = lambda a, b: F.coalesce(F.get(grams, a)["gram"] == F.get(grams, b)["gram"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    places = F.array_sort(F.transform(twice, lambda k: F.get(grams, k)["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n")),
        lambda s: s["n"],
    )
    df = df.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)))
    return df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_again"), covered).otherwise(0).cast("long"),
    })


@dataclass(frozen=True)
class Rule:
    """``rejects``: whether a row fails; null counts as passing. ``work``: the units of work that its
    feature takes, in words (times the window for repetition) or characters."""

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column]


def _shouts() -> Column:
    letters = F.length(F.regexp_replace("_text", "[^A-Za-z]+", ""))
    return F.length(F.regexp_replace("_text", "[^A-Z]+", "")) * 2 > letters


#: base: fixed by contract. The rest are this operator's own, with thresholds far from what plain prose reaches.
BASE_RULES = (
    Rule("few_words", lambda: F.col("n_words") < 10, lambda: F.col("n_words")),
    Rule("repetition", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"), lambda: WINDOW * F.col("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words"), lambda: F.length("_text")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")), lambda: F.col("word_chars")),
    Rule("same_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"), lambda: F.length("_text")),
    Rule("shouting", _shouts, lambda: 2 * F.length("_text")),
    Rule("giant_word", lambda: F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0)) > 500, lambda: F.size("_words")),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    selectivity: float

    @property
    def worth(self) -> float:
        return self.selectivity / max(self.cost, 1e-9)


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, one_in: int = 64) -> list[Estimate]:
    """Each rule's mean cost and share of rejected rows over the rows, one in ``one_in``, that a hash of the id picks.

    It sets the order of the rules only. The scan is whole, but only picked rows compute features, and nothing is
    shuffled but one row a task. Without rows all shares are 0."""
    features = text_features(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0))
    made = [F.avg(r.work().cast("double")).alias(f"c{i}") for i, r in enumerate(rules)] + [F.avg(F.coalesce(r.rejects(), F.lit(False)).cast("double")).alias(f"s{i}") for i, r in enumerate(rules)]
    row = features.agg(*made).head()
    return [Estimate(r.name, row[f"c{i}"] or 1.0, row[f"s{i}"] or 0.0) for i, r in enumerate(rules)]


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, one_in: int = 64) -> DataFrame:
    """Adds the features, ``rejected_by`` (the first rule in cascade order that rejects the row, else null) and ``kept``.

    ``df``: doc_id and text, and columns of other names than the features'."""
    worth = {e.name: e.worth for e in estimate(df.select("doc_id", "text"), rules, one_in)}
    verdict = None
    for rule in sorted(rules, key=lambda r: (-worth[r.name], [x.name for x in rules].index(r.name))):
        verdict = (F.when if verdict is None else verdict.when)(F.coalesce(rule.rejects(), F.lit(False)), rule.name)
    return text_features(df).withColumn("rejected_by", pinned(verdict)).withColumn("kept", F.col("rejected_by").isNull())


def quality_digest(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``. Short and empty texts fail the base rule on words."""
    judged = cascade(documents.select("doc_id", "text"))
    failed = BASE_RULES[0].rejects() | BASE_RULES[1].rejects()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with their own columns. Columns that clash with the features' names are kept as they are."""
    own = documents.select("doc_id", "text", F.struct(*[documents[c] for c in documents.columns]).alias("_row"))
    return cascade(own).where("kept").select("_row.*")
