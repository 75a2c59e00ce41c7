"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words adjust a score.

Everything runs as Catalyst expressions in one pass without a shuffle. Each kind is searched only in texts that hold a
character it can't do without, so most texts cost two scans for single characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_or_empty


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; it is possessive where that changes no match, so long runs stay linear. ``needs``: what any
    match contains, a character or a class. ``score`` without and ``context_score`` with one of the ``context`` words in the text just before."""

    name: str
    pattern: str
    needs: str
    score: float
    context_score: float
    context: str
    base: bool = True


# The kinds in the order in which they are listed at equal starts.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 1.0, "mail|contact|write"),
    Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", 0.7, 0.9, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.8, 1.0, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.95, "tel|phone|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[0-9]", 0.8, 1.0, "iban|account|bank", base=False),
    Kind("secret", r"[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{20,}+", "[=:]", 0.2, 0.9, "token|secret|passw|api.?key|access.?key|private.?key", base=False),
)
#: Spans that the method adds are kept from this score on; those of the base kinds always.
KEEP_FROM = 0.5
#: Code points before a span in which context words are looked for.
CONTEXT = 40

_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod_97(hit: Column) -> Column:
    """Whether an IBAN's check digits hold: the first four characters go last, letters count as 10 to 35."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 1 << 20), F.substring(plain, 1, 4)), "(?!^)(?!$)")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    fold = lambda rest, c: F.when(value(c) < 10, (rest * 10 + value(c)) % 97).otherwise((rest * 100 + value(c)) % 97)
    return F.aggregate(moved, F.lit(0), fold) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return _mod_97(hit)
    return F.lit(True)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind. ``split`` gives the texts between the matches, and so each match's place."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(hits.alias("hit"), F.split(text, kind.pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        hit, gap = F.coalesce(pair["hit"], F.lit("")), pair["gap"]
        begin = state["at"] + F.length(gap)
        shown = F.regexp_extract(hit, "[A-Za-z0-9+/_-]{20,}$", 0) if kind.name == "secret" else hit
        score = F.when(F.lower(F.substring(gap, -CONTEXT, CONTEXT)).rlike(kind.context), kind.context_score).otherwise(kind.score)
        span = F.struct(
            (begin + F.length(hit) - F.length(shown)).alias("start"), F.lit(rank).alias("rank"), (begin + F.length(hit)).alias("end"),
            F.lit(kind.name).alias("kind"), score.cast("double").alias("score"),
        )
        keep = (hit != "") & _confirmed(kind.name, hit) & (F.lit(kind.base) | (score >= KEEP_FROM))
        return F.struct((begin + F.length(hit)).alias("at"), F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.aggregate(pairs, start, step)["found"]


def find_pii(df: DataFrame, text_column: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``spans`` (start, rank, end, kind, score by start, then kind as listed; code points, end exclusive).

    Null texts count as empty and have no spans. Columns of ``df`` stay, but for a column named ``spans``, which is
    replaced. Repeated rows give the same spans each.
    """
    text, none = text_or_empty(text_column), F.array().cast(_FOUND)
    has = {need: text.rlike(need) if need.startswith("[") else F.contains(text, F.lit(need)) for need in {k.needs for k in kinds}}
    found = [F.when(has[k.needs], _spans(text, k, rank)).otherwise(none) for rank, k in enumerate(kinds)]
    return df.withColumn("spans", F.array_sort(F.concat(*found)))


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Replaces each found span by its kind in angle brackets; of overlapping spans the first is replaced."""
    at = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = text_or_empty(text_column)

    def step(state: Column, span: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit("<"), span["kind"], F.lit(">"))
        free = span["start"] >= state["at"]
        return F.struct(F.when(free, span["end"]).otherwise(state["at"]).alias("at"), F.when(free, piece).otherwise(state["out"]).alias("out"))

    done = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, 1 << 30))
    return df.withColumn(text_column, F.aggregate(F.col("spans"), at, step, done))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` with the counts and joined spans. Without rows: no rows."""
    base_kinds = [k.name for k in KINDS if k.base]
    found = find_pii(documents.select("doc_id", "text"))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    is_base = lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in base_kinds])
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base_kinds],
        F.sha2(_joined(F.filter("spans", is_base)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
