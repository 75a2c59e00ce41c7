"""The Jaccard join and its components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import hashing, jaccard_join
from corvane.llm.components import components


def shingle_set(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 12, 40, 90]))]
        if g % 2:
            base = shared[: rng.randrange(20, 40)] + base
        for _ in range(rng.choice([1, 2, 5, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows + rows[6:9]


@pytest.mark.parametrize(("seed", "direct", "frequent"), [(1, 48, 16), (2, 0, 16), (3, 0, 2)])
def test_components_of_texts(spark, monkeypatch, seed, direct, frequent):
    monkeypatch.setattr(jaccard_join, "DIRECT", direct)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect()) == brute(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7)], "doc_id long, text string, node int")
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard_join.first_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def near_copies(seed, copies, edits):
    """Copies of one text, each with words of its own at some places: similar pair by pair only where places agree."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(50)]
    rows = []
    for i in range(copies):
        own = list(base)
        for at in rng.sample(range(50), edits):
            own[at] = f"e{seed}x{i}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("direct", [48, 0])
def test_near_copies_that_are_not_similar_pair_by_pair(spark, monkeypatch, direct):
    monkeypatch.setattr(jaccard_join, "DIRECT", direct)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    rows = near_copies(1, 150, 2) + [(1000 + d, t) for d, t in near_copies(2, 60, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect()) == brute(rows)


def test_first_of_each_keeps_one_row_a_component(spark):
    far = "p q r s t u v"
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "A b c d e f", "z"), (1, far, "u"), (2, far, "w"), (None, "g h i j k l", "n"), (None, "g h i j k l", "m"), (None, far, "k"), (5, " ", "e"), (5, None, "f")]
    kept = jaccard_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "g h i j k l"), (1, "a b c d e f"), (1, far), (5, ""), (5, " ")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert len(found) == len(rows) and sum(r.component_id is None for r in found) == 2


def test_few_files_for_few_sets(spark):
    rows = [(i, f"a b c d e f{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20, "doc_id")
    sets = jaccard_join._wanted_sets(docs, docs.select("doc_id"))
    assert len(sets.inputFiles()) == 1
    assert sorted((r.node, tuple(t % 2**64 for t in r.tokens)) for r in sets.collect()) == sorted((jaccard_join._node(x), tuple(x.tolist())) for _, x in hashing.texts_shingles(pa.array([t for _, t in rows])))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (4, 5), (6, 7), (5, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [(2, 1), (3, 1), (5, 4), (6, 4), (7, 4), (9, 1)]


def test_word_hashes(monkeypatch):
    texts = ["A b", "a  B\n", None, "", "é ab", "ab", "x" * 50 + " ab " + "y" * 50, "ab c"]
    def words(ts):
        out = [None] * len(ts)
        for first, hashes, bounds in hashing.texts_words(pa.array(ts)):
            for k in range(len(bounds) - 1):
                out[first + k] = hashes[bounds[k] : bounds[k + 1]].tolist()
        return out
    whole = words(texts)
    assert whole[0] == whole[1] and whole[2] == whole[3] == [] and len(whole[6]) == 3 and whole[6][1] == whole[5][0] == whole[4][1] == whole[7][0]
    monkeypatch.setattr(hashing, "SLICE", 16)
    assert words(texts) == whole
    assert words(["q"] + texts)[1:] == whole


def test_prefix_is_complete():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 80 * (len(x) + len(y) - both):
            often = np.unique(jaccard_join._ids(x[rng.random(len(x)) < 0.5], 4, 24))
            px, py = (jaccard_join._prefix(s, often, np.full(len(often), 20), 4) for s in (x, y))
            assert len(np.intersect1d(px, py))
