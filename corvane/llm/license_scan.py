"""License notices in texts: exact phrases, and short notices with errors.

A notice that may hold k errors is split into k + 2 pieces; by the pigeonhole principle two of them stand in the text
exactly, with at most k characters more or less between them than in the notice. The pieces are the seeds that locate
candidate windows; in these the ``regex`` library's bounded-error matching verifies the edits and reports the spans.
Texts without two seeds (nearly all) cost a few substring searches.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The base phrases with their labels, in words.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
)
#: A notice may hold one error for so many characters.
CHARS_PER_ERROR = 10
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,errors:int>>"

#: A-Z lower-cased; what no word holds becomes a blank. Bytes from 128 on are parts of words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    errors: int
    seeds: tuple[tuple[int, bytes], ...]
    crumbs: tuple[bytes, ...]
    pattern: regex.Pattern
    best: regex.Pattern


def compiled(notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Notice]:
    out = []
    for label, words in notices:
        text = words.encode()
        k = max(1, len(text) // CHARS_PER_ERROR)
        cut = [len(text) * i // (k + 2) for i in range(k + 3)]
        seeds = tuple((a, text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
        crumbs = tuple(text[len(text) * i // (3 * k) : len(text) * (i + 1) // (3 * k)] for i in range(3 * k))
        pattern = b"(?:" + regex.escape(text, literal_spaces=True) + b"){e<=%d}" % k
        out.append(Notice(label, text, k, seeds, crumbs, regex.compile(pattern), regex.compile(b"(?b)" + pattern)))
    return out


def _places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def find_notice(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, errors) in ``text`` (words joined by blanks) of each match, by start; of matches that overlap, the one
    with fewer errors, then the first. Begins that lie close together share a window, which is too short for two matches,
    so a text of many notices costs its length. The best match is looked for only where there is one."""
    hits = [(at - offset, i) for i, (offset, seed) in enumerate(notice.seeds) if seed in text for at in _places(text, seed)]
    k, windows, last = notice.errors, [], {}
    for begin, i in sorted(hits):  # where the notice would begin by each seed
        near = [b for j, b in last.items() if j != i and begin - b <= k]
        last[i] = begin
        if near and windows and begin - windows[-1][0] <= 2 * k:
            windows[-1][1] = begin
        elif near:
            windows.append([min(near), begin])
    found = []
    for low, high in windows:
        a = max(0, low - k)
        window = text[a : high + len(notice.text) + k]
        # Of 3 k pieces, k errors leave 2 k: cheap to count, and few windows go on to the matcher.
        if sum(c in window for c in notice.crumbs) >= len(notice.crumbs) - k and notice.pattern.search(window):
            m = notice.best.search(window)
            found.append((a + m.start(), a + m.end(), sum(m.fuzzy_counts)))
    kept: list[tuple[int, int, int]] = []
    for span in sorted(found, key=lambda s: (s[2], s[0])):
        at = bisect(kept, span)
        if (not at or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
            kept.insert(at, span)
    return kept


def scan(text: str | None, notices: list[Notice]) -> tuple:
    """The row of one text, without doc_id. Null and empty texts have no words, places, labels or score."""
    words = (text or "").encode("utf-8", "replace").translate(_PLAIN).split()
    plain = b" " + b" ".join(words) + b" "
    starts = None

    def word_at(place: int) -> int:
        """The word that holds the byte, or the next one if it is a blank."""
        nonlocal starts
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        return int(np.searchsorted(starts, place, side="left")) - 1 if plain[place] != 32 else int(np.searchsorted(starts, place))

    base, base_labels = [], set()
    for phrase, label in PHRASES:
        if phrase in plain:
            own = [word_at(at) for at in _places(plain, b" " + phrase + b" ")]
            base += own
            base_labels |= {label} if own else set()
    spans, score = [], 1.0 if base else 0.0
    for notice in notices:
        for start, end, errors in find_notice(plain, notice):
            spans.append((notice.label, word_at(start), word_at(end - 1) if plain[end - 1] != 32 else word_at(end - 1) - 1, errors))
            score = max(score, 1.0 - errors / len(notice.text))
    labels = base_labels | {s[0] for s in spans}
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def license_digest(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = compiled()
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [scan(x.as_py(), notices) for x in part.column("text")]
                as_dicts = [[dict(zip(("label", "first_word", "last_word", "errors"), s, strict=True)) for s in r[7]] for r in rows]
                columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(7)] + [pa.array(as_dicts, span)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
