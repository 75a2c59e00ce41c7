"""Text scalars as Catalyst expressions. Character classes follow Python's str methods and ``re``, as Java spells them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and marks.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
ABSTENTION = "not found in the provided documents"
CLAIM_END = r"(?<=[.!?])[" + SPACE + r"]+|\n+"
STOP_WORDS = (
    "the a an and or to of in on for is are was were does do did what which how when where python with from by this that it be as at"
).split()
MAX_TOKENS = 100_000


def nfkc(text: Column) -> Column:
    """NFKC, which Spark has no function for."""

    @F.pandas_udf("string")
    def normalise(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return normalise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often ``body`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column, normalise: bool = True) -> Column:
    """Compatibility forms, no invisible or control characters, words joined over hyphens at line ends, single blanks,
    lines trimmed on the right, one empty line at most. ``normalise=False`` keeps it all in the JVM, for text in NFKC."""
    out = nfkc(text) if normalise else text
    out = F.regexp_replace(out, r"[\x{200b}\x{200c}\x{200d}\x{feff}]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, rf"(?<={WORD})-\n(?={WORD})", "")
    tidy = lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), rf"[{SPACE}]+$", "")
    out = F.array_join(F.transform(F.split(out, LINE_BREAK, -1), tidy), "\n")
    return F.regexp_replace(strip(out), r"\n{3,}", "\n\n")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def alphabetic_ratio(text: Column) -> Column:
    """Letters among characters that aren't blank; 0 without any."""
    solid = F.length(F.regexp_replace(text, rf"[{SPACE}]+", ""))
    return F.when(solid > 0, _letters(text) / solid).otherwise(0.0)


def looks_like_broken_table(text: Column, threshold: float = 0.25) -> Column:
    return (F.length(text) >= 40) & (alphabetic_ratio(text) < threshold) & text.rlike(r"\p{Nd}")


def probable_language(text: Column) -> Column:
    letters, plain = _letters(text), F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    return F.when(letters == 0, "unknown").when(plain / letters > 0.85, "en_or_latin").otherwise("non_latin_or_mixed")


def quality_warnings(raw: Column, cleaned: Column) -> Column:
    """Names of what is odd about a text, in a fixed order."""
    longest = F.coalesce(F.array_max(F.transform(F.split(cleaned, LINE_BREAK, -1), F.length)), F.lit(0))
    flags = (
        (raw.contains("�"), "encoding_replacement_character"),
        (cleaned == "", "empty_document"),
        (F.length(cleaned) > 2_000_000, "extremely_long_document"),
        (longest > 20_000, "very_long_line"),
        (looks_like_broken_table(cleaned), "possible_broken_table"),
        (probable_language(cleaned) == "non_latin_or_mixed", "non_english_or_mixed"),
    )
    return F.array_compact(F.array(*[F.when(flag, name) for flag, name in flags]))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Runs of characters that aren't blank: the default token codec."""
    return F.regexp_extract_all(text, F.lit(rf"([^{SPACE}]+)"), F.lit(1))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def subword_count(path: str):
    """A pandas UDF that counts the ids of a tokenizer file; the file must be readable on every executor."""

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in model.encode_batch(text.fillna("").tolist(), add_special_tokens=False)])

    return count


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark and blanks, or at empty lines; blank parts dropped."""
    parts = F.split(text, rf"(?<=[.!?])[{SPACE}]+|\n{{2,}}", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def preprocess_query(query: Column, mode: str = "none", max_chars: int = 8000, normalise: bool = True) -> Column:
    """struct(original, processed, truncated). Expansion needs a provider: see ``operators.generate.expand_queries``."""
    if mode not in ("none", "lowercase"):
        raise ValueError(f"unsupported query preprocessing mode: {mode}")
    whole = strip(nfkc(query) if normalise else query)
    short = strip(F.substring(whole, 1, max_chars))
    return F.struct(query.alias("original"), (F.lower(short) if mode == "lowercase" else short).alias("processed"), (F.length(whole) > max_chars).alias("truncated"))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\p{Nd}+)\]"), F.lit(1)), lambda x: x.cast("int"))


def citation_check(answer: Column, sources: Column) -> Column:
    """struct(cited, invalid, valid): numbers outside 1 to ``sources`` are invalid."""
    cited = citations(answer)
    invalid = F.array_sort(F.array_distinct(F.filter(cited, lambda i: (i < 1) | (i > sources))))
    return F.struct(cited.alias("cited"), invalid.alias("invalid"), (F.size(invalid) == 0).alias("valid"))


def abstains(answer: Column) -> Column:
    return F.lower(answer).contains(ABSTENTION)


def normalised_answer(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9.]+)"), F.lit(1)), " ")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)))


def exact_match(question_type: Column, gold: Column, answer: Column) -> Column:
    """1.0 or 0.0: all numbers of a numeric answer, or the whole of a factoid, stand in the answer; null for other types."""
    gold, answer = F.coalesce(gold, F.lit("")), F.coalesce(answer, F.lit(""))
    numeric = (F.size(numbers(gold)) > 0) & (F.size(F.array_except(numbers(gold), numbers(answer))) == 0)
    factoid = (normalised_answer(gold) != "") & normalised_answer(answer).contains(normalised_answer(gold))
    return F.when(question_type == "numeric", numeric.cast("double")).when(question_type == "factoid", factoid.cast("double"))


def claims(answer: Column) -> Column:
    """Parts between sentence ends or lines, without citation marks, blank parts and abstentions."""
    parts = F.transform(F.split(F.regexp_replace(answer, r"\[\p{Nd}+\]", ""), CLAIM_END, -1), strip)
    return F.filter(parts, lambda p: (p != "") & ~abstains(p))


def word_ngrams(words: Column, n: int, separator: str = " ") -> Column:
    """Distinct windows of ``n`` words; none where there are fewer."""

    def of(own: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.array_join(F.slice(own, i + 1, n), separator))
        return F.when(F.size(own) >= n, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def share_four_words(one: Column, two: Column) -> Column:
    return F.arrays_overlap(word_ngrams(plain_words(one), 4), word_ngrams(plain_words(two), 4))


def content_words(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(plain_words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def token_upper_bound(prompt: Column) -> Column:
    return F.octet_length(prompt) + 256


def cost_usd(tokens_in: Column, tokens_out: Column, usd_in: float, usd_out: float) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * F.lit(float(usd_in)) + tokens_out * F.lit(float(usd_out))) / 1_000_000.0


def judge_score(raw: Column) -> Column:
    """The first digit from 0 to 4 that stands alone, else null."""
    found = F.regexp_extract(raw, rf"(?<!{WORD})([0-4])(?!{WORD})", 1)
    return F.when(found != "", found.cast("int"))


def pipe_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, r"\|", -1), strip), lambda x: x != "")


def squeezed(value: Column) -> Column:
    return strip(F.regexp_replace(F.lower(value), rf"[{SPACE}]+", " "))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.2f%%", value * 100))


def interval(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "n/a").otherwise(F.format_string("%.2f–%.2f", low * 100, high * 100))
