"""Sharding, mixing, the classifier, token counts, license scans and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm import license_scan, mixing, quality_model, sharding, token_counts


def test_sharding(spark):
    rng = random.Random(3)
    texts = [None, ""] + ["copy " * 40] * 300 + [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_digest(df).collect()
    assert len(rows) == len(texts)
    sizes = np.zeros(24)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        sizes[r.shard] += r["size"]
    assert sizes.max() / sizes.mean() < 1.05
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_digest(df.limit(0)).count() == 0


def test_packing_balances_each_dimension():
    rng = np.random.Generator(np.random.PCG64(2))
    sizes = rng.integers(1, 100, (5000, 3)).astype(float)
    shard = sharding.pack(sizes, 10)
    for d in range(3):
        loads = np.bincount(shard, weights=sizes[:, d], minlength=10)
        assert loads.max() / loads.mean() < 1.02


def test_schedule_stays_within_a_block():
    parts = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 100)
    slots = mixing.one_cycle(parts)
    assert sorted(x for own in slots.values() for x in own) == list(range(100))
    for s, own in slots.items():
        done = np.cumsum(np.isin(np.arange(100), own))
        assert np.abs(done - (np.arange(100) + 1) * parts[s] / 100).max() < 1


def test_mixing(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(9000, None), (9001, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    done = mixing.mix(df, {"hot": 2.0}, block=4, cycle=60).toPandas()
    assert sorted(done.doc_id) == sorted(r[0] for r in rows)
    blocks = done.groupby("slot")
    assert sorted(done.slot.unique()) == list(range(done.slot.nunique()))
    assert blocks.source.nunique(dropna=False).max() == 1 and blocks.size().max() == 4
    order = done.drop_duplicates("slot").sort_values("slot").source.fillna("-").tolist()
    first = min(i for i in range(len(order)) if order[: i + 1].count("-") == 1)
    share = mixing.shares({s: 2.0 if s == "hot" else 1.0 for s in set(order)}, 60)["hot"] / 60
    for t in range(first):
        assert abs(order[: t + 1].count("hot") - (t + 1) * share) < 1
    assert mixing.mix(df.limit(0)).count() == 0
    laid = mixing.in_mix_order(df.selectExpr("doc_id", "source", "1 AS slot"), block=4)
    assert laid.columns == ["doc_id", "source", "slot"] and laid.count() == len(rows)


def test_mixing_follows_exact_weights(spark):
    sizes = {"big": 4000, "rare": 9} | {f"s{i}": 800 + 37 * i for i in range(6)}
    weights = {s: n**0.5 for s, n in sizes.items()} | {"rare": 0.01}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(rows)], "doc_id long, source string")
    done = mixing.mix(df, weights, block=1).select("slot", "source", "source_block").toPandas().sort_values("slot")
    assert done.slot.tolist() == list(range(len(rows)))
    left, total = dict(sizes), sum(weights.values())
    counts = dict.fromkeys(sizes, 0)
    for t, (s, own) in enumerate(zip(done.source, done.source_block, strict=True)):
        assert own == counts[s]
        counts[s] += 1
        assert max(abs(n - (t + 1) * weights[x] / total) for x, n in counts.items()) < 1
        if counts[s] == left[s]:
            break
    assert t > 3000
    again = mixing.mix(df, weights, block=1, cycle=500).select("slot", "source", "source_block").toPandas().sort_values("slot")
    assert (again.values == done.values).all()


def test_mixing_of_weight_zero(spark):
    df = spark.createDataFrame([(i, "none" if i % 4 else "some") for i in range(200)], "doc_id long, source string")
    done = mixing.mix(df, {"none": 0.0}, block=2).toPandas()
    assert done[done.source == "some"].slot.max() < done[done.source == "none"].slot.min() and done.slot.nunique() == 100
    with pytest.raises(ValueError):
        mixing.mix(df, {"none": -1.0})


def plain_count(vocabulary, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * vocabulary.byte_score, best[end - 1][1] + n)]
        options += [(best[s][0] + vocabulary.scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in vocabulary.scores]
        best.append(min(options, key=lambda x: (-x[0], x[1])))
    return best[-1][1]


def test_token_counts(spark):
    vocabulary = token_counts.Vocabulary.ranked(["▁", "▁the", "the", "re", "t", "h", "e", "▁there", "r", "fore", "o", "f"])
    texts = [None, "", "there therefore  the\ntheory 日本 there", "the " * 5000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens) for r in token_counts.count_tokens(df, vocabulary).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i] == (len(words), sum(plain_count(vocabulary, "▁" + w) for w in words))
    counter = token_counts.TrieCounter(vocabulary)
    counter.add({"▁there", "▁therefore", "▁the"})
    assert counter.computed == len("▁therefore")
    assert token_counts.count_tokens(df.limit(0), vocabulary).count() == 0


def test_license_scan(spark):
    texts = [None, "", "MIT License. The (mit) license; mit license", "x Licensd under the Apache Licence, Version 2.0. y", "permission is hereby granted, free of charge to any persn obtaining a copy of this software", "Émit license", "mit licenses", "clean text of no kind"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.license_digest(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [k for k in range(len(words)) for p in ("mit license", "apache license", "general public license") if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert 0 <= r.score <= 1
    assert rows[2].base_labels == "mit" and rows[3].labels == "apache" and rows[3].base_labels == "" and rows[4].labels == "mit" and rows[7].labels == ""
    assert rows[3].spans[0].errors == 2 and (rows[3].spans[0].first_word, rows[3].spans[0].last_word) == (1, 8)


@pytest.mark.parametrize("kind", ["both", "one", "none"])
def test_quality_model(spark, kind, monkeypatch):
    monkeypatch.setattr(quality_model, "EPOCHS", 20)
    rng = random.Random(1)
    good = lambda: " ".join(f"word{rng.randrange(200)}" for _ in range(60))
    bad = lambda: " ".join(f"w{rng.randrange(200)}###" for _ in range(60))
    texts = [good() if i % 3 else bad() for i in range(600)] + [None, ""]
    labels = [(i, 1 if kind == "one" else int(i % 3 > 0), 0) for i in range(600)] if kind != "none" else []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_model.quality_model_digest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    if kind == "both":
        held = [r for r in rows if r.held_out and r.doc_id < 600]
        assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = prose(30)
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", prose(50) + " " + item + " " + prose(50), "short text", "sym## " * 40, None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_groups_lighter_than_a_shard_stay_whole(spark):
    texts = ["hot text " * 40] * 300 + [f"group {i % 40} " * 20 for i in range(400)] + [f"single {i} text" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_digest(df, 4).collect()
    fair = sum(r["size"] for r in rows) / 4
    groups, loads, slots = {}, [0] * 4, {}
    for r in rows:
        groups.setdefault(texts[r.doc_id], []).append(r)
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values() if sum(r["size"] for r in g) <= fair)
    assert len({r.shard for r in groups[texts[0]]}) > 1 and max(loads) < 1.05 * fair
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_notices_back_to_back_are_all_found():
    notice = license_scan.compiled()[0]
    text = b"releasd under the mit license released under the mit license"
    assert license_scan.find_notice(text, notice) == [(0, 29, 1), (30, 60, 0)]
