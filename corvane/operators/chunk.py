"""Chunkers as Catalyst expressions over arrays: no Python runs on the executors.

Tokens are runs of characters that aren't blank, joined by one space. Token counts add up over joined parts, so packing is
a fold over (part, count) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import ids, text

STRATEGIES = ("fixed", "recursive", "sentence", "structure")


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "recursive"
    size: int = 256
    overlap: int = 0
    prepend_section: bool = False
    max_tokens: int = text.MAX_TOKENS

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        if self.size < 8 or self.overlap < 0:
            raise ValueError("size must be at least 8 and overlap not negative")
        if self.overlap >= self.effective_size:
            raise ValueError(f"overlap ({self.overlap}) must be smaller than the effective chunk size ({self.effective_size})")

    @property
    def effective_size(self) -> int:
        return min(self.size, self.max_tokens)


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _nothing(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Texts of the token windows that start every ``size - overlap`` tokens."""

    def of(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - 1, F.lit(size - overlap))
        return F.when(F.size(own) > 0, F.transform(starts, lambda i: _joined(F.slice(own, i + 1, size)))).otherwise(_nothing())

    return text.let(tokens, of)


def paragraphs(value: Column) -> Column:
    """Paragraphs, with fenced code kept whole: from a line that starts with three backticks or tildes to the next one
    that starts with the same mark, or to the end."""
    lines = F.split(value, text.LINE_BREAK, -1)
    start = F.struct(_nothing().alias("done"), _nothing().alias("open"), F.lit("").alias("fence"))

    def closed(state: Column, more: Column) -> Column:
        block = text.strip(F.array_join(more, "\n"))
        return F.when(block != "", F.concat(state["done"], F.array(block))).otherwise(state["done"])

    def to(done: Column, open_: Column, fence: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), fence.alias("fence"))

    def step(state: Column, line: Column) -> Column:
        bare, longer, empty = text.strip(line), F.concat(state["open"], F.array(line)), _nothing()
        outside = state["fence"] == ""
        opens = F.regexp_extract(bare, "^(```|~~~)", 1)
        return (
            F.when(outside & (opens != ""), to(closed(state, state["open"]), F.array(line), opens))
            .when(outside & (bare == ""), to(closed(state, state["open"]), empty, F.lit("")))
            .when(~outside & bare.startswith(state["fence"]), to(closed(state, longer), empty, F.lit("")))
            .otherwise(to(state["done"], longer, state["fence"]))
        )

    return F.aggregate(lines, start, step, lambda state: closed(state, state["open"]))


def packed(parts: Column, size: int, overlap: int, separator: str) -> Column:
    """Parts joined up to ``size`` tokens. What doesn't fit opens a new chunk, which begins with the last ``overlap``
    tokens of the one before if both fit. A part above ``size`` becomes windows and carries nothing."""
    start = F.struct(_nothing().alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def to(done: Column, open_: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

    def closed(state: Column) -> Column:
        return F.when(state["open"] != "", F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    def step(state: Column, part: Column) -> Column:
        own = F.size(text.tokens(part))
        before = text.tokens(state["open"])
        carried = F.least(F.lit(overlap), F.size(before))
        tail = _joined(F.slice(before, F.size(before) - carried + 1, carried))
        return (
            F.when(own > size, to(F.concat(closed(state), windows(text.tokens(part), size, overlap)), F.lit(""), F.lit(0)))
            .when(state["open"] == "", to(state["done"], part, own))
            .when(state["n"] + own <= size, to(state["done"], F.concat(state["open"], F.lit(separator), part), state["n"] + own))
            .when((carried > 0) & (carried + own <= size), to(closed(state), F.concat(tail, F.lit(separator), part), carried + own))
            .otherwise(to(closed(state), part, own))
        )

    return F.aggregate(parts, start, step, closed)


def sections(value: Column) -> Column:
    """array<struct<heading, body>>: what stands under each line of one to six # signs. Empty sections vanish."""
    kind = "array<struct<heading:string,body:string>>"
    start = F.struct(_nothing(kind).alias("done"), F.lit(None).cast("string").alias("heading"), _nothing().alias("body"))

    def closed(state: Column) -> Column:
        body = text.strip(F.array_join(state["body"], "\n"))
        return F.when(body != "", F.concat(state["done"], F.array(F.struct(state["heading"].alias("heading"), body.alias("body"))))).otherwise(state["done"])

    def step(state: Column, line: Column) -> Column:
        heading = F.regexp_extract(text.strip(line), rf"^#{{1,6}}[{text.SPACE}]+(.+)$", 1)
        return F.when(
            heading != "", F.struct(closed(state).alias("done"), text.strip(heading).alias("heading"), _nothing().alias("body"))
        ).otherwise(F.struct(state["done"].alias("done"), state["heading"].alias("heading"), F.concat(state["body"], F.array(line)).alias("body")))

    return F.aggregate(F.split(value, text.LINE_BREAK, -1), start, step, closed)


def parts(value: Column, config: ChunkConfig) -> Column:
    """array<struct<section, text>> of one document's text."""
    size, overlap = config.effective_size, config.overlap
    bare = lambda array: F.transform(array, lambda t: F.struct(F.lit(None).cast("string").alias("section"), t.alias("text")))
    if config.strategy == "fixed":
        return bare(windows(text.tokens(value), size, overlap))
    if config.strategy == "sentence":
        return bare(packed(text.sentences(value), size, overlap, " "))
    if config.strategy == "recursive":
        return bare(packed(paragraphs(value), size, overlap, "\n\n"))
    under = lambda s: F.transform(packed(paragraphs(s["body"]), size, overlap, "\n\n"), lambda t: F.struct(s["heading"].alias("section"), t.alias("text")))
    return F.flatten(F.transform(sections(value), under))


def chunk_documents(documents: DataFrame, config: ChunkConfig) -> DataFrame:
    """id, doc_hash, source, text, position, page, section, token_count; none for blank documents.

    ``documents``: source and text; doc_hash and page are made where they are missing. Chunks above the codec's longest
    input are windowed again, and positions count what comes out.
    """
    if "doc_hash" not in documents.columns:
        documents = documents.withColumn("doc_hash", ids.doc_hash(F.col("text")))
    if "page" not in documents.columns:
        documents = documents.withColumn("page", F.lit(None).cast("int"))
    made = documents.where(text.strip(F.col("text")) != "").select("doc_hash", "source", "page", parts(F.col("text"), config).alias("_parts"))

    def rendered(part: Column) -> Column:
        body = text.strip(part["text"])
        if config.prepend_section:
            body = F.when(F.coalesce(part["section"], F.lit("")) != "", F.concat(part["section"], F.lit("\n\n"), body)).otherwise(body)
        whole = F.size(text.tokens(body)) <= config.max_tokens
        pieces = F.when(whole, F.array(body)).otherwise(windows(text.tokens(body), config.max_tokens, 0))
        return F.transform(pieces, lambda t: F.struct(part["section"].alias("section"), t.alias("text")))

    pieces = F.filter(F.flatten(F.transform("_parts", rendered)), lambda p: p["text"] != "")
    flat = made.select("doc_hash", "source", "page", F.posexplode(pieces).alias("position", "_piece"))
    flat = flat.select("doc_hash", "source", "page", "position", F.col("_piece.section").alias("section"), F.col("_piece.text").alias("text"))
    return flat.select(
        ids.chunk_id(F.col("doc_hash"), F.col("position"), F.col("text")).alias("id"), "doc_hash", "source", "text", "position", "page", "section", F.size(text.tokens(F.col("text"))).alias("token_count")
    )
