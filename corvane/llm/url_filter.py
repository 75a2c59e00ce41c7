"""URL filters: fixed host and path rules, then association rules that Spark's FP-growth mines from labelled URLs.

A transaction is the set of a labelled URL's tokens with its label; all of them count. Rules that conclude the bad label and
pass the confidence and support bounds, without a more general rule that does as well, are kept in an inverted index from token to rule,
which every URL is matched against inside its row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER, sql_literal, written

# The rules that always hold; the longest that fits wins.
BASE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD = "=bad"
#: Bad labelled rows that a rule must hold in, at any size of the table.
MIN_ROWS = 20
#: Up to so many rules the index travels in the plan; more are joined.
LITERAL_RULES = 1000


def with_parts(df: DataFrame, url_column: str = "url") -> DataFrame:
    """Adds host and path; null or a URL without ``://`` has both empty."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return df.withColumns({"host": F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(url, pattern, 2)})


def base_rule(rules: tuple[tuple[str, str], ...] = BASE_RULES) -> Column:
    """The longest rule that fits, else null."""
    chosen = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        chosen = (F.when if chosen is None else chosen.when)(fits, rule)
    return chosen if chosen is not None else F.lit(None).cast("string")


def tokens(url_column: str = "url") -> Column:
    """Distinct tokens of host labels, path parts, query keys and the fragment; numbers are one token."""
    part = lambda text, cut, mark: F.transform(F.filter(F.split(text, cut, -1), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    url = F.coalesce(F.col(url_column), F.lit(""))
    query = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&", -1), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    query = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(part(F.col("host"), r"\.", "h:"), part(F.col("path"), "/", "p:"), query))


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def _merged(rows: DataFrame, min_rows: int) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rows (row, items) without the tokens that stand in the very rows of a smaller token, and those by the smaller one:
    a rule of one is a rule of the other, and a rule of both says nothing new. Without this, k tokens that always come
    together make 2**k item sets. Tokens are told apart by their rows' count and sum of 64-bit hashes."""
    places = rows.select(F.xxhash64("row").cast("decimal(20,0)").alias("h"), F.explode("items").alias("t")).where(F.col("t") != BAD)
    places = places.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("n") >= min_rows)
    same = places.groupBy("n", "h").agg(F.array_sort(F.collect_list("t")).alias("same")).where(F.size("same") > 1)
    groups = {r.same[0]: list(r.same) for r in same.select("same").collect()}  # of the frequent tokens, which FP-growth collects too
    if not groups:
        return rows, groups
    gone = rows.sparkSession.createDataFrame([(t,) for g in groups.values() for t in g[1:]], "t string")
    left = rows.select("row", F.explode("items").alias("t")).join(F.broadcast(gone), "t", "left_anti")
    return left.groupBy("row").agg(F.collect_list("t").alias("items")), groups


def _needed(rules: DataFrame, min_confidence: float) -> DataFrame:
    """Of all rules (tokens, hits, confidence) those of the confidence without a more general one that is as sure. Level by
    level, a set learns the best confidence below it from its subsets that are smaller by one token."""
    longest = rules.where(F.col("confidence") >= min_confidence).agg(F.max(F.size("tokens"))).head()[0] or 1
    level = rules.where(F.size("tokens") == 1).withColumn("top", F.col("confidence"))
    kept = level.where(F.col("confidence") >= min_confidence).drop("top")
    for size in range(2, longest + 1):
        parts = rules.where(F.size("tokens") == size).withColumn("_t", F.explode("tokens")).withColumn("_part", F.array_remove("tokens", F.col("_t")))
        below = parts.join(level.select(F.col("tokens").alias("_part"), "top"), "_part").groupBy("tokens", "hits", "confidence").agg(F.max("top").alias("below"))
        level = written(below.withColumn("top", F.greatest("confidence", "below")), "url-rules")
        kept = kept.union(level.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("below"))).drop("below", "top"))
    return kept


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = 0.8) -> list[Mined]:
    """Rules from rows (id, tokens, bad): all that hold in ``min_rows`` bad rows or more, with the confidence. Rows with a
    null ``bad`` don't count. What is kept after pruning comes to the driver."""
    labelled = labelled.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")
    marked = F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    rows = written(labelled.select("row", marked.alias("items")).where(F.size("items") > 0), "url-labelled")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BAD))).head()
    if n_bad < min_rows:
        return []
    items, groups = _merged(rows, min_rows)
    # FP-growth rounds support times rows up; half a row less keeps that from passing min_rows.
    sets = FPGrowth(minSupport=(min_rows - 0.5) / n).fit(items).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("tokens"), "freq"), "url-sets")
    hits = sets.where(F.array_contains("tokens", BAD) & (F.size("tokens") > 1)).select(F.array_remove("tokens", BAD).alias("tokens"), F.col("freq").alias("hits"))
    rules = written(hits.join(sets, "tokens").select("tokens", "hits", (F.col("hits") / F.col("freq")).alias("confidence")), "url-rules")
    kept = _needed(rules, min_confidence).collect()
    out = [Mined(tuple(sorted(t)), r.confidence, r.hits / n) for r in kept for t in itertools.product(*(groups.get(x, [x]) for x in r.tokens))]
    return sorted(out, key=lambda r: (len(r.tokens), -r.confidence, -r.support, r.tokens))


def matched_rules(rules: list[Mined], tokens: Column) -> Column:
    """Indices of the rules all of whose tokens a row has, by an inverted index from token to rules."""
    none = F.array().cast("array<int>")
    if not rules:
        return none
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for t in r.tokens:
            index.setdefault(t, []).append(i)
    by_token = F.expr(f"map_from_arrays({sql_literal(list(index))}, {sql_literal(list(index.values()), long=False)})")
    sizes = F.expr(sql_literal([len(r.tokens) for r in rules], long=False))
    hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(by_token, t), none)))
    whole = lambda i: F.size(F.filter(hits, lambda x: x == i)) == F.get(sizes, i)
    return F.array_sort(F.filter(F.array_distinct(hits), whole))


def _joined(df: DataFrame, rules: list[Mined]) -> DataFrame:
    """``mined`` by a join of the distinct token sets with the index, with the same result as ``matched_rules``."""
    index = df.sparkSession.createDataFrame([(t, i, len(r.tokens)) for i, r in enumerate(rules) for t in r.tokens], "_token string, _rule int, _size int")
    met = df.select("_tokens").distinct().withColumn("_token", F.explode("_tokens")).join(F.broadcast(index), "_token")
    whole = met.groupBy("_tokens", "_rule", "_size").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("_size"))
    found = whole.groupBy("_tokens").agg(F.array_sort(F.collect_list("_rule")).alias("mined"))
    return df.join(found, "_tokens", "left").withColumn("mined", F.coalesce("mined", F.array().cast("array<int>")))


def judge(pages: DataFrame, rules: list[Mined], url_column: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """Adds host, path, rule, mined (indices of the matching mined rules) and verdict. A fixed rule goes before mined ones;
    a URL that nothing fits is allowed."""
    df = with_parts(pages, url_column).withColumn("rule", base_rule()).withColumn("_tokens", tokens(url_column))
    df = _joined(df, rules) if len(rules) > literal_rules else df.withColumn("mined", matched_rules(rules, F.col("_tokens")))
    df = df.drop("_tokens")
    verdict = F.when(F.size("mined") > 0, "block").otherwise("allow")
    for rule, what in BASE_RULES:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    return df.withColumn("verdict", verdict)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, tokens, bad) of the pages whose id has labels: bad where quality is 0 or toxic is 1."""
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return with_parts(pages.select("page_id", "url")).withColumn("tokens", tokens()).join(marks, "page_id").select(F.col("page_id").alias("id"), "tokens", "bad")


def url_digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, n_mined."""
    judged = judge(pages.select("page_id", "url"), mine(labelled_urls(pages, labels)))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("mined").alias("n_mined"))
