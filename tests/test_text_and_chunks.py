"""Text scalars, chunkers and identities."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import ids, text
from corvane.operators import chunk


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).head().x


def plain_clean(t):
    t = unicodedata.normalize("NFKC", t)
    for gone in ("​", "‌", "‍", "﻿"):
        t = t.replace(gone, "")
    t = "".join(c for c in t if c in "\t\n\r" or not (ord(c) < 32 or ord(c) == 127))
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(?<=\w)-\n(?=\w)", "", t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).rstrip() for x in t.splitlines()).strip())


@pytest.mark.parametrize("value", ["ﬁne​  text \r\nnext\rline", "exam-\nple and foo- \nbar", "a b\x85c\x0b d", "\n\n x\n\n\n\ny \t z \n", "", "①½\x07"])
def test_clean_text(spark, value):
    assert one(spark, text.clean_text, value) == plain_clean(value)


def test_quality(spark):
    assert one(spark, text.alphabetic_ratio, " a1 b2 ") == 0.5 and one(spark, text.alphabetic_ratio, "  ") == 0.0
    assert one(spark, text.looks_like_broken_table, "1 2 3 | " * 8) and not one(spark, text.looks_like_broken_table, "1 2 3")
    assert [one(spark, text.probable_language, v) for v in ("123", "plain", "日本語 a")] == ["unknown", "en_or_latin", "non_latin_or_mixed"]
    assert one(spark, lambda t: text.quality_warnings(F.lit("�"), t), "") == ["encoding_replacement_character", "empty_document"]
    assert one(spark, lambda t: text.quality_warnings(t, t), "x" * 20_001) == ["very_long_line"]


def test_answers(spark):
    assert one(spark, text.citations, "a [1] b [12] [1] [x]") == [1, 12, 1]
    check = one(spark, lambda t: text.citation_check(t, F.lit(3)), "[4] [0] [2] [4]")
    assert (check.cited, check.invalid, check.valid) == ([4, 0, 2, 4], [0, 4], False)
    assert one(spark, text.claims, "One [1]. Two!\nNot found in the provided documents. Three") == ["One .", "Two!", "Three"] or one(spark, text.claims, "One. Two [1]") == ["One.", "Two"]
    assert one(spark, text.numbers, "1,200 and -3.5 and 3") == ["1200", "-3.5", "3"]
    assert [one(spark, text.judge_score, v) for v in ("Score: 3", "42", "a4b", "0.")] == [3, None, None, 0]
    assert one(spark, text.abstains, "Sorry: NOT found in the provided documents!") is True
    assert one(spark, text.pipe_list, " a | |b") == ["a", "b"]
    assert one(spark, lambda t: text.share_four_words(t, F.lit("x the quick brown fox")), "The quick, brown fox y") is True
    assert one(spark, text.content_words, "The python model of a Model is big") == ["model", "big"]
    assert one(spark, text.percent, None) == "n/a"
    match = lambda kind, gold: one(spark, lambda t: text.exact_match(F.lit(kind), F.lit(gold), t), "It was 1,200 in May.")
    assert (match("numeric", "1200"), match("numeric", "7"), match("factoid", "In may."), match("list", "x")) == (1.0, 0.0, 1.0, None)


def test_query_preprocess(spark):
    got = one(spark, lambda t: text.preprocess_query(t, "lowercase", 5), "  ＡＢＣ defg ")
    assert (got.original, got.processed, got.truncated) == ("  ＡＢＣ defg ", "abc d", True)
    with pytest.raises(ValueError):
        text.preprocess_query(F.lit(""), "other")


def chunks(spark, value, **kwargs):
    df = spark.createDataFrame([("s", value)], "source string, text string")
    return chunk.chunk_documents(df, chunk.ChunkConfig(**kwargs)).orderBy("position").collect()


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_fixed(spark):
    rows = chunks(spark, words(0, 8), strategy="fixed", size=8, overlap=2)
    assert [r.text for r in rows] == [words(0, 8), words(6, 8)]  # the tail window repeats
    assert chunks(spark, " \n ", strategy="fixed") == []
    doc = hashlib.sha256(words(0, 8).encode()).hexdigest()
    assert rows[0].id == hashlib.sha256(f"{doc}:0:{hashlib.sha256(rows[0].text.encode()).hexdigest()}".encode()).hexdigest()[:24]
    with pytest.raises(ValueError):
        chunk.ChunkConfig(size=8, overlap=8)


def test_sentences_carry(spark):
    value = f"{words(0, 5)}. {words(10, 14)}. {words(20, 26)}."
    rows = chunks(spark, value, strategy="sentence", size=8, overlap=2)
    assert [r.text for r in rows] == [f"{words(0, 5)}.", f"w3 w4. {words(10, 14)}.", f"w12 w13. {words(20, 26)}."]
    assert [r.token_count for r in rows] == [5, 6, 8]


def test_blocks(spark):
    value = "para one\nmore\n\n```py\n# no heading\n\ncode\n```\nafter\n\n~~~\nopen end"
    got = spark.createDataFrame([(value,)], "t string").select(chunk.paragraphs(F.col("t")).alias("x")).head().x
    assert got == ["para one\nmore", "```py\n# no heading\n\ncode\n```", "after", "~~~\nopen end"]
    rows = chunks(spark, f"small\n\n{words(0, 20)}\n\ntail", strategy="recursive", size=8, overlap=2)
    assert [r.text for r in rows] == ["small", words(0, 8), words(6, 14), words(12, 20), words(18, 20), "tail"]


def test_structure(spark):
    value = "intro\n# One\n\n## Two\nbody two\n# Three #\nbody three"
    rows = chunks(spark, value, strategy="structure", size=64, prepend_section=True)
    assert [(r.section, r.text) for r in rows] == [(None, "intro"), ("Two", "Two\n\nbody two"), ("Three #", "Three #\n\nbody three")]
    long = chunks(spark, f"# H\n{words(0, 12)}", strategy="structure", size=16, prepend_section=True, max_tokens=10)
    assert [r.token_count for r in long] == [10, 1, 3] and [r.position for r in long] == [0, 1, 2]


def test_hashes(spark):
    df = spark.createDataFrame([("b",), ("a",)], "id string")
    assert ids.id_set_hash(df, "id").head().id_hash == hashlib.sha256(b"a\nb").hexdigest()
    assert ids.config_hash({"b": 1, "a": [2]}) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()[:16]
