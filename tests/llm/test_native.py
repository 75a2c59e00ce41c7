"""Personal data, quality rules, URL filters and decontamination against plain Python."""

import hashlib
import itertools
import re

import pytest

from corvane.llm import decontaminate, pii, quality_rules, url_filter

TEXTS = [
    None, "", "a", "mail x@y.org, X.y+z@a-b.co.uk.", "a@b.c_x@d.e", "ip 1.2.3.4 and 300.1.1.1 and 001.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "call +1 (017) 555-7713 now", "+12 34", "é😀 x@y.zz é", "iban GB82 WEST 1234 5698 7654 32 end", 'api token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "x" * 5000 + "@a.b", "1." * 300,
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(t):
    t = t or ""
    out = []
    for k, (name, p) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 12 <= len(d) <= 19 and luhn(d) or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, name, m.end()))
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(out)]


def test_pii(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.pii_digest(df).collect():
        want = base_spans(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert set(want) <= set(r.spans.split(",")) | {""} or not want
        assert r.n_email == sum(x.startswith("email") for x in want)
    spans = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert "iban" in spans[10] and "secret" in spans[11]
    assert pii.pii_digest(df.limit(0)).count() == 0
    redacted = pii.redact(pii.find_pii(df.where("doc_id = 3"))).head().text
    assert redacted == "mail <email>, <email>."  # a domain ends before a full stop that nothing follows


def test_secrets_without_digits(spark):
    texts = ["api_key: abcdefghijklmnopqrstuvwxyz", "api_key=abcdefghijklmnopqrstuvwxyz x@y.org", "api_key abcdefghijklmnopqrstuvwxyz", "see: abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.pii_digest(df).orderBy("doc_id").collect()] == ["secret:9:35", "secret:8:34,email:35:42", "", ""]


def repeats(words):
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({p for places in grams.values() if len(places) > 1 for i in places for p in range(i, i + 5)})


def test_quality_rules(spark):
    texts = [None, "", "a b c", "one two three four five " * 4, "a b c d e f\na b c d e f\n\n x y z q r s t", "word## " * 12, "aa " * 11, "é\x85ü " * 20, "plain words of some kind that say this and that and more"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(8, texts[8])], "doc_id long, text string")
    rows = quality_rules.quality_digest(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeats(words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} == {8}
    clash = df.selectExpr("doc_id", "text", "1 AS n_words", "'x' AS kept")
    assert quality_rules.keep_good(clash).columns == clash.columns and quality_rules.keep_good(clash).count() == 2
    assert quality_rules.quality_digest(df.limit(0)).count() == 0


def test_cost_follows_the_work(spark):
    df = spark.createDataFrame([(i, "some plain words " * n) for i, n in enumerate((10, 20))], "doc_id long, text string")
    cost = {e.name: e.cost for e in quality_rules.estimate(df, one_in=1)}
    assert cost == {"few_words": 45, "repetition": 225, "symbols": 255, "word_length": 210, "same_lines": 255, "shouting": 510, "giant_word": 45}


@pytest.mark.parametrize("literal", [1 << 17, 0])
def test_decontamination(spark, literal):
    words = [f"w{i}" for i in range(400)]
    bench = [(1, " ".join(words[:20])), (2, " ".join(words[100:160])), (3, "one two"), (4, None), (5, "")]
    part = words[100:160]
    part[30] = "zzz"  # breaks five of 56 shingles
    docs = [(0, "x y " + " ".join(words[:20]).upper() + " end"), (1, " ".join(part)), (2, " ".join(words[:10])), (3, "One, two!"), (4, None), (5, ""), (6, " ".join(f"v{i}" for i in range(3000)) + " " + " ".join(words[:20])), (6, "again " + " ".join(words[:20]))]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_items(d, b, literal_hashes=literal)
    assert sorted((r.doc_id, x.item_id, x.matched) for r in found.collect() for x in r.leaks) == [(0, 1, 16), (1, 2, 51), (3, 3, 1), (6, 1, 16), (6, 1, 16)]
    assert found.count() == len(docs)
    assert sorted(r.doc_id for r in decontaminate.without_items(d.selectExpr("doc_id", "text", "1 AS leaks"), b).collect()) == [2, 4, 5]
    assert decontaminate.find_items(d, b.limit(0)).where("size(leaks) > 0").count() == 0


@pytest.mark.parametrize("literal", [1 << 17, 0])
def test_short_items_in_long_documents(spark, literal):
    bench = [(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "one two three four five"), (5, "")]
    docs = [(0, "a b c d e f beta, GAMMA g h"), (1, "gamma beta one two three 4 four alpha"), (2, "0 one two three four 5 6"), (3, "beta gamma"), (4, "one two three four five"), (5, "beta"), (6, None)]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_items(d, b, literal_hashes=literal)
    assert sorted((r.doc_id, x.item_id, x.matched, x.size) for r in found.collect() for x in r.leaks) == [(0, 2, 1, 1), (1, 1, 1, 1), (2, 3, 1, 1), (3, 2, 1, 1), (4, 3, 1, 1), (4, 4, 1, 1)]


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://A.Example.NET/en/x?y#z", "http://b.example.com/de/1", "https://c.org/fr/", "x://net", "http://notnet/a", "http://sub.net/a", "ftp://h?q=1/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(df, []).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(10)] == [("", "")] * 3 + [("a.example.net", "/en/x"), ("b.example.com", "/de/1"), ("c.org", "/fr/"), ("net", ""), ("notnet", "/a"), ("sub.net", "/a"), ("h", "")]
    assert [rows[i].rule for i in range(10)] == [None] * 3 + ["example.net/en/", "example.com/de/", "org/fr/", None, None, "net/", None]
    assert [rows[i].verdict for i in (0, 3, 4, 5, 7, 8)] == ["allow", "allow", "block", "allow", "allow", "block"]


def test_mined_urls(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.example.com/{'buy' if i % 2 else 'read'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i % 3 == 0 and i % 2)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    mined = url_filter.mine(url_filter.labelled_urls(pages, labels))
    assert any(set(m.tokens) == {"h:spam", "p:buy"} for m in mined)
    blocked = {r.page_id for r in url_filter.url_digest(pages, labels).where("verdict = 'block'").collect()}
    assert blocked == {i for i in range(300) if i % 3 == 0 and i % 2}
    assert url_filter.mine(url_filter.labelled_urls(pages, labels.limit(0))) == []


def test_rules_of_few_rows_in_a_large_table(spark):
    tokens = "CASE WHEN id % 19000 = 7 THEN array('h:org', 'p:rare') ELSE array('h:org', concat('p:', id % 5)) END AS tokens"
    labelled = spark.range(400_000).selectExpr("id", tokens, "id % 19000 = 7 OR id % 4 = 0 AS bad")
    assert labelled.where("array_contains(tokens, 'p:rare')").count() == 22
    assert [m.tokens for m in url_filter.mine(labelled)] == [("p:rare",)]


def test_subset_rules_push_out_no_rule(spark):
    hot = [f"p:{c}" for c in "abcdefghij"]  # always together
    also = [f"q:{c}" for c in "uvwx"]  # with those, and in other rows
    rows = [(["h:hot", *hot, *also], True)] * 40 + [(["h:other", "p:buy"], i > 3) for i in range(30)] + [(["h:other", "p:read"], False)] * 60
    rows += [([t, "h:other"], False) for t in also for _ in range(60)] + [(["h:two", "p:x"], True)] * 25 + [(["h:two"], False)] * 20 + [(["p:x"], False)] * 20
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, tokens array<string>, bad boolean")
    mined = url_filter.mine(labelled)
    alone = {frozenset([t]) for t in ["h:hot", *hot]}
    pairs = {frozenset(x) for x in itertools.combinations(also, 2)}
    assert {frozenset(m.tokens) for m in mined} == alone | pairs | {frozenset(["p:buy"]), frozenset(["h:two", "p:x"])}
    pages = spark.createDataFrame([(1, "http://hot/x"), (2, "http://two/x"), (3, "http://two/y"), (4, "http://other/buy"), (5, "http://other/?u=1&v=2&w")], "page_id long, url string")
    got = [{r.page_id: (r.mined, r.verdict) for r in url_filter.judge(pages, mined, literal_rules=n).collect()} for n in (1000, 0)]
    assert got[0] == got[1] and [got[0][i][1] for i in range(1, 6)] == ["block", "block", "allow", "block", "block"] and len(got[0][5][0]) == 3


def test_rules_where_most_rows_are_bad(spark):
    rows = [(["h:spam"], True)] * 90 + [(["h:mixed"], i > 5) for i in range(60)] + [(["h:good"], i % 3 == 0) for i in range(60)]
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, tokens array<string>, bad boolean")
    assert {(m.tokens, m.confidence) for m in url_filter.mine(labelled)} == {(("h:spam",), 1.0), (("h:mixed",), 0.9)}
