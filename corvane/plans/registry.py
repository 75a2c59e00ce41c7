"""Registered queries: each over its whole tables, beside the DuckDB SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids, text
from corvane.operators import chunk, dedupe, experiments, generate, index, ingest, metrics, retrieve
from corvane.sources import files
from corvane.sources.shared import materialised
from corvane.streaming import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Markers that injected instructions ask for, as the test tables have words for them.
MARKERS = ["attack_success", "the the", "est qui"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_LETTERS = "len(regexp_replace(text, '[^\\p{L}]+', '', 'g'))"
_SOLID = "len(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', '', 'g'))"
_POSTINGS = f"""terms AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, len({_TERMS}) AS length FROM documents), totals AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), raws AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, totals),
idfs AS (SELECT term, df, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raws) END AS idf FROM raws)"""
_BM25 = f"""{_POSTINGS}, wanted AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id AS key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 9) AS score
  FROM postings JOIN idfs USING (term) JOIN wanted USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL),
everything AS (SELECT q.item_id AS query_id, d.doc_id AS key, coalesce(score, 0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = q.item_id AND s.key = d.doc_id WHERE trim(q.text) <> ''),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM everything) WHERE rank <= 20)"""
_OVERLAP = f"""shared AS (SELECT query_id, doc_id AS key, CAST(count(*) AS DOUBLE) AS score FROM postings JOIN wanted USING (term) GROUP BY ALL),
by_overlap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM shared) WHERE rank <= 20)"""
_GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    built = index.bm25_build(_documents(spark, sf_dir), "doc_id")
    return index.bm25_search(built, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _overlap(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The second list for fusion: documents by the number of distinct terms that they share with the question."""
    texts = _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    return index.overlap_search(texts.where(F.col("text").isNotNull()), _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _with_text(spark: SparkSession, sf_dir: str, hits: DataFrame, column: str = "text") -> DataFrame:
    """Hits of the stated questions, few, with a column of their documents, which stay where they are."""
    hits = materialised(hits, "hits")
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), column).join(F.broadcast(hits), "key")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text: the questions are a stated set that travels to all rows."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return _documents(spark, sf_dir).join(F.broadcast(asked), F.col("text").contains(F.col("passage"))).select("query_id", F.col("doc_id").alias("key"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_metrics_at_k(spark, sf_dir)


@query(f"""SELECT doc_id, round(coalesce({_LETTERS} / nullif({_SOLID}, 0), 0), 6) AS ratio,
len(text) >= 40 AND coalesce({_LETTERS} / nullif({_SOLID}, 0), 0) < 0.25 AND regexp_matches(text, '[0-9]') AS broken_table,
CASE WHEN {_LETTERS} = 0 THEN 'unknown' WHEN len(regexp_replace(text, '[^A-Za-z]+', '', 'g')) / {_LETTERS} > 0.85 THEN 'en_or_latin' ELSE 'non_latin_or_mixed' END AS language FROM documents""")
def text_quality_flags(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.round(text.alphabetic_ratio(t), 6).alias("ratio"), text.looks_like_broken_table(t).alias("broken_table"), text.probable_language(t).alias("language"))


@query(f"WITH {_POSTINGS} SELECT doc_id, term, tf FROM postings")
def term_frequencies(spark, sf_dir):
    return index.bm25_build(_documents(spark, sf_dir), "doc_id").postings.withColumnRenamed("key", "doc_id")


@query(f"WITH {_POSTINGS} SELECT doc_id, CAST(length AS BIGINT) AS length FROM lengths")
def doc_lengths(spark, sf_dir):
    return index.bm25_build(_documents(spark, sf_dir), "doc_id").lengths.withColumnRenamed("key", "doc_id")


@query(f"WITH {_POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def idf_table(spark, sf_dir):
    return index.bm25_build(_documents(spark, sf_dir), "doc_id").idf.withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


def _dense_sql(score: str) -> str:
    return f"""SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id AS key, {score} AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _vectors(spark, sf_dir):
    every = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return every, every.where("key % 20 = 0").select(F.col("key").alias("query_id"), "embedding")


@query(_dense_sql(_DOT.format("q.embedding", "v.embedding")))
def dense_dot_topk(spark, sf_dir):
    return index.dense_search(*_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(_dense_sql(f"{_DOT.format('q.embedding', 'v.embedding')} / sqrt({_DOT.format('q.embedding', 'q.embedding')}) / sqrt({_DOT.format('v.embedding', 'v.embedding')})"))
def dense_cosine_topk(spark, sf_dir):
    return index.dense_search(*_vectors(spark, sf_dir), 10, "cosine").withColumn("score", F.round("score", 6))


@query(_dense_sql(_DOT.format("q.embedding", "v.embedding")))
def dense_block_topk(spark, sf_dir):
    return index.dense_search_blocks(*_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


_FUSED = f"""WITH {_BM25}, {_OVERLAP}, both_lists AS (SELECT query_id, key, rank, score AS dense FROM by_overlap UNION ALL SELECT query_id, key, rank, NULL FROM bm25),
fused AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best, max(dense) AS dense FROM both_lists GROUP BY ALL),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, dense DESC NULLS LAST, key) AS rank FROM fused) WHERE rank <= 10)"""


@query(f"{_FUSED} SELECT query_id, key, round(score, 6) AS score, rank FROM hybrid")
def hybrid_rrf(spark, sf_dir):
    return retrieve.hybrid(_overlap(spark, sf_dir), _bm25(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT query_id, key, rank FROM bm25 WHERE score >= 20")
def score_floor(spark, sf_dir):
    return retrieve.score_floor(_bm25(spark, sf_dir), 20.0).select("query_id", "key", "rank")


@query(f"WITH {_BM25} SELECT query_id, key, rank, source FROM bm25 JOIN documents ON doc_id = key WHERE contains(lower(source), 'src1')")
def metadata_filter(spark, sf_dir):
    hits = _with_text(spark, sf_dir, _bm25(spark, sf_dir), "source")
    return retrieve.metadata_filter(hits, "SRC1").select("query_id", "key", "rank", "source")


@query(f"""WITH {_BM25} SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank FROM
(SELECT query_id, source, min(rank) AS first FROM bm25 JOIN documents ON doc_id = key GROUP BY ALL)""")
def unique_sources(spark, sf_dir):
    hits = _with_text(spark, sf_dir, _bm25(spark, sf_dir), "source")
    return retrieve.first_of_source(hits)


@query(f"""WITH {_BM25} SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, score FROM (
SELECT query_id, key, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+')), regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]+'))) / len(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+'))), 6) AS score
FROM bm25 JOIN documents d ON doc_id = key JOIN benchmark b ON item_id = query_id) QUALIFY rank <= 5""")
def rerank_topk(spark, sf_dir):
    hits = _with_text(spark, sf_dir, _bm25(spark, sf_dir)).join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    scorer = lambda q, t: F.round(retrieve.overlap_scorer(q, t), 6)
    return retrieve.rerank(hits, 5, scorer).select("query_id", "key", "score", "rank")


@query()
def mmr_select(spark, sf_dir):
    every, asked = _vectors(spark, sf_dir)
    hits = index.dense_search(every, asked, 20).join(every, "key").join(asked.withColumnRenamed("embedding", "query"), "query_id")
    return retrieve.mmr(hits, 5)


@query("""SELECT doc_id, sha256(text) AS doc_hash, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept FROM documents""")
def exact_dedupe(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", ids.doc_hash(F.col("text")).alias("doc_hash"))
    firsts = rows.groupBy("doc_hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(firsts, "doc_hash").select("doc_id", "doc_hash", "first_id", (F.col("doc_id") == F.col("first_id")).alias("kept"))


_SHINGLES = f"""shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31)))
  WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS s FROM (SELECT doc_id, {_TERMS} AS w FROM documents)))"""


@query(f"""WITH {_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
SELECT a, b, round(both_ / (na.n + nb.n - both_), 6) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL)
JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE both_ / (na.n + nb.n - both_) >= 0.5""")
def jaccard_pairs(spark, sf_dir):
    return dedupe.jaccard_pairs(_documents(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query()
def simhash_near_dedupe(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.format_string("%012d", "doc_id").alias("source"), "doc_id", "text", ids.doc_hash(F.col("text")).alias("doc_hash"))
    return dedupe.deduplicate(docs).select("doc_id", "kept", "matched", "kind")


def _chunks(spark, sf_dir, **kwargs):
    return chunk.chunk_documents(_documents(spark, sf_dir).select("source", "text"), chunk.ChunkConfig(**kwargs))


_FIXED = """windows AS (SELECT source, sha256(text) AS doc_hash, unnest(list_transform(range(0, len(w), 224), lambda i: struct_pack(position := i // 224, t := array_to_string(w[i + 1:i + 256], ' ')))) AS x
FROM (SELECT source, text, regexp_extract_all(text, '[^\\s\\x1c-\\x1f\\x{85}\\p{Z}]+') AS w FROM documents)),
chunks AS (SELECT left(sha256(doc_hash || ':' || x.position || ':' || sha256(x.t)), 24) AS id, doc_hash, source, x.t AS text, CAST(x.position AS INT) AS position, CAST(len(string_split(x.t, ' ')) AS INT) AS token_count FROM windows)"""


@query(f"WITH {_FIXED} SELECT id, source, position, token_count, sha256(text) AS text_hash FROM chunks")
def fixed_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, strategy="fixed", size=256, overlap=32).select("id", "source", "position", "token_count", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {_FIXED} SELECT source, count(*) AS chunks, count(DISTINCT doc_hash) AS documents, sum(token_count)::BIGINT AS tokens, max(position) AS last_position FROM chunks GROUP BY source")
def chunk_stats(spark, sf_dir):
    made = _chunks(spark, sf_dir, strategy="fixed", size=256, overlap=32)
    return made.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_hash").alias("documents"), F.sum("token_count").alias("tokens"), F.max("position").alias("last_position"))


@query()
def sentence_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, strategy="sentence", size=128, overlap=16)


@query()
def recursive_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, strategy="recursive", size=128, overlap=16)


@query()
def structure_chunks(spark, sf_dir):
    pages = files.html_documents(_table(spark, sf_dir, "pages"))
    return chunk.chunk_documents(pages, chunk.ChunkConfig("structure", 128, 16, prepend_section=True))


@query()
def ingest_html_pages(spark, sf_dir):
    return files.html_documents(_table(spark, sf_dir, "pages"))


_IDEAL = "list_sum(list_transform(range(1, least(n, {0}) + 1), lambda i: 1 / log2(i + 1)))"
_METRICS = ", ".join(
    f"round(count(*) FILTER (rank <= {k}) / n, 6) AS recall_at_{k}, CAST(count(*) FILTER (rank <= {k}) > 0 AS DOUBLE) AS hit_at_{k}, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / {_IDEAL.format(k)}, 6) AS ndcg_at_{k}"
    for k in metrics.KS
)


@query(f"""WITH {_BM25}, {_GOLD}, sizes AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id)
SELECT query_id, {_METRICS}, round(coalesce(1 / min(rank), 0), 6) AS mrr FROM sizes LEFT JOIN (SELECT query_id, rank FROM bm25 JOIN gold USING (query_id, key)) USING (query_id) GROUP BY query_id, n""")
def retrieval_metrics_at_k(spark, sf_dir):
    done = metrics.retrieval_metrics(_bm25(spark, sf_dir), _gold(spark, sf_dir))
    return done.select("query_id", *[F.round(c, 6).alias(c) for c in done.columns[1:]])


@query()
def bootstrap_ci(spark, sf_dir):
    lists = {"bm25": _bm25(spark, sf_dir), "overlap": _overlap(spark, sf_dir)}
    rows = [metrics.retrieval_metrics(hits, _gold(spark, sf_dir)).select(F.lit(name).alias("retriever"), "query_id", "mrr") for name, hits in lists.items()]
    return metrics.bootstrap_ci(rows[0].unionByName(rows[1]), "retriever", "mrr", "query_id")


@query()
def paired_permutation(spark, sf_dir):
    one, two = (metrics.retrieval_metrics(hits, _gold(spark, sf_dir)) for hits in (_bm25(spark, sf_dir), _overlap(spark, sf_dir)))
    return metrics.paired_permutation(one, two, "query_id", "mrr")


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY ALL), t AS (SELECT sum(c) AS n, sum(c) FILTER (a = b) AS same FROM c),
e AS (SELECT sum(x.ca * y.cb) AS chance FROM (SELECT a, sum(c) AS ca FROM c GROUP BY a) x JOIN (SELECT b, sum(c) AS cb FROM c GROUP BY b) y ON a = b)
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, round(chance / (n * n), 6) AS expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t, e""")
def cohens_kappa(spark, sf_dir):
    return metrics.cohens_kappa(_table(spark, sf_dir, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS exact, round(avg(CAST(abs(quality - toxic) <= 1 AS DOUBLE)), 6) AS within_one FROM labels")
def agreement_rates(spark, sf_dir):
    return metrics.agreement(_table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("exact", 6).alias("exact"), F.round("within_one", 6).alias("within_one"))


@query("""SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS abstention_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS abstention_recall FROM
(SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM (SELECT len(text) % 3 = 0 AS p, turn % 2 = 0 AS g FROM conversations))""")
def abstention_pr(spark, sf_dir):
    flags = _table(spark, sf_dir, "conversations").select((F.length("text") % 3 == 0).alias("abstained"), (F.col("turn") % 2 == 0).alias("unanswerable"))
    done = metrics.abstention_metrics(flags)
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


_CITED = "text || ' [' || turn || '] [' || conv_id % 7 || '] [3]'"


def _cited(spark, sf_dir):
    t = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] ["), (F.col("conv_id") % 7).cast("string"), F.lit("] [3]"))
    return _table(spark, sf_dir, "conversations").withColumn("answer", t)


@query(f"""SELECT conv_id, turn, array_to_string(c, ',') AS cited, coalesce(array_to_string(list_sort(list_distinct(list_filter(c, lambda i: i < 1 OR i > 4))), ','), '') AS invalid, len(list_filter(c, lambda i: i < 1 OR i > 4)) = 0 AS valid FROM
(SELECT conv_id, turn, list_transform(regexp_extract_all({_CITED}, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INT)) AS c FROM conversations)""")
def citation_validate(spark, sf_dir):
    done = _cited(spark, sf_dir).withColumn("c", text.citation_check(F.col("answer"), F.lit(4)))
    return done.select("conv_id", "turn", F.array_join("c.cited", ",").alias("cited"), F.array_join("c.invalid", ",").alias("invalid"), F.col("c.valid").alias("valid"))


@query(f"""WITH {_BM25}, blocks AS (SELECT query_id, rank, '<source id=' || rank || '>' || chr(10) || d.text || chr(10) || '</source>' || chr(10) AS block, b.text AS question
FROM bm25 JOIN documents d ON doc_id = key JOIN benchmark b ON item_id = query_id),
used AS (SELECT *, {len(generate.HEADER)} + len(question) + sum(len(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blocks),
packs AS (SELECT query_id, count(*) AS packed, string_agg(block, chr(10) ORDER BY rank) AS s FROM used WHERE used <= 24000 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(packed, 0) AS packed, CAST({len(generate.HEADER)} + 9 + 1 + len(text) + 11 + len(coalesce(s, '')) AS INT) AS prompt_chars, sha256(coalesce(s, '')) AS sources_hash FROM benchmark LEFT JOIN packs ON query_id = item_id""")
def prompt_pack(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = _with_text(spark, sf_dir, _bm25(spark, sf_dir))
    done = generate.pack_prompts(asked, hits).join(asked, "query_id")
    sources = F.substring("prompt", F.length("question") + len(generate.HEADER) + len("QUESTION:\n\n\nSOURCES:\n") + 1, 1 << 30)
    return done.select("query_id", "packed", F.length("prompt").alias("prompt_chars"), F.sha2(sources, 256).alias("sources_hash"))


@query()
def ask_batch(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = _with_text(spark, sf_dir, _bm25(spark, sf_dir, 5))
    packed = generate.pack_prompts(asked, hits).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")), "query_id", "left").na.fill(0, ["n_hits"])
    return generate.answer(packed, generate.FixedProvider)


@query(f"""SELECT count(*) AS total, count(*) FILTER ({' OR '.join(f"contains(lower(text), '{m}')" for m in MARKERS)}) AS successes,
round(count(*) FILTER ({' OR '.join(f"contains(lower(text), '{m}')" for m in MARKERS)}) / count(*), 6) AS rate FROM conversations""")
def injection_rate(spark, sf_dir):
    return metrics.injection_rate(_table(spark, sf_dir, "conversations"), "text", MARKERS).withColumn("rate", F.round("rate", 6))


_NUMBERS = "list_distinct(regexp_extract_all(replace({0}, ',', ''), '[-+]?[0-9]+(?:\\.[0-9]+)?'))"
_NORMAL = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9.]+'), ' ')"


@query(f"""SELECT doc_id, CAST(len({_NUMBERS.format('gold')}) > 0 AND len(list_filter({_NUMBERS.format('gold')}, lambda x: NOT list_contains({_NUMBERS.format('text')}, x))) = 0 AS DOUBLE) AS numeric_match,
CAST({_NORMAL.format('gold')} <> '' AND contains({_NORMAL.format('text')}, {_NORMAL.format('gold')}) AS DOUBLE) AS factoid_match FROM (SELECT doc_id, text, right(text, 40) AS gold FROM documents)""")
def answer_exact_match(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", "text", F.substring("text", -40, 40).alias("gold"))
    match = lambda kind: text.exact_match(F.lit(kind), F.col("gold"), F.col("text")).alias(f"{kind}_match")
    return rows.select("doc_id", match("numeric"), match("factoid"))


@query("""SELECT category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN answerable AND recall = 0 THEN 'retrieval_miss' END, CASE WHEN answerable = abstained THEN 'wrong_abstention' END,
CASE WHEN faithfulness < 1 THEN 'unsupported_claim' END, CASE WHEN NOT valid OR citation_recall < 1 THEN 'citation_failure' END, CASE WHEN judge_failed THEN 'judge_error' END], lambda x: x IS NOT NULL)) AS category
FROM (SELECT turn % 2 = 0 AS answerable, CAST(conv_id % 3 AS DOUBLE) AS recall, len(text) % 5 = 0 AS abstained, CASE WHEN turn > 0 THEN (len(text) % 4) / 3 END AS faithfulness, len(text) % 7 <> 0 AS valid, (len(text) % 3) / 2 AS citation_recall, conv_id % 11 = 0 AS judge_failed FROM conversations)) GROUP BY category""")
def failure_categories(spark, sf_dir):
    n = F.length("text")
    found = metrics.failure_categories(
        F.col("turn") % 2 == 0, (F.col("conv_id") % 3).cast("double"), n % 5 == 0, F.when(F.col("turn") > 0, (n % 4) / 3), n % 7 != 0, (n % 3) / 2, F.col("conv_id") % 11 == 0
    )
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), found.alias("categories"))
    return metrics.failure_report(rows, metrics.CATEGORIES).select("category", "n")


_MANIFESTS = """now AS (SELECT CAST(doc_id AS VARCHAR) AS source, sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS digest FROM documents WHERE doc_id % 7 <> 0),
old AS (SELECT CAST(doc_id AS VARCHAR) AS source, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 0)"""


@query(f"""WITH {_MANIFESTS} SELECT source, CASE WHEN now.digest IS NULL THEN 'deleted' WHEN old.digest IS NULL THEN 'added' ELSE 'changed' END AS change
FROM now FULL JOIN old USING (source) WHERE now.digest IS DISTINCT FROM old.digest""")
def manifest_diff(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("source", F.col("doc_id").cast("string"))
    now = docs.where("doc_id % 7 <> 0").select("source", F.sha2(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")), 256).alias("digest"))
    return ingest.manifest_diff(now, docs.where("doc_id % 10 <> 0").select("source", F.sha2("text", 256).alias("digest")))


@query(f"WITH {_FIXED}, known AS (SELECT DISTINCT sha256(text) AS doc_hash FROM documents WHERE doc_id % 2 = 0) SELECT CAST(sum(CAST(doc_hash IN (SELECT doc_hash FROM known) AS INT)) AS BIGINT) AS reused, CAST(count(*) AS BIGINT) AS chunks FROM (SELECT DISTINCT ON (doc_hash, position) * FROM chunks)")
def chunk_reuse(spark, sf_dir):
    config = chunk.ChunkConfig("fixed", 256, 32)
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text", ids.doc_hash(F.col("text")).alias("doc_hash"), F.lit(None).cast("int").alias("page"))
    firsts = docs.groupBy("doc_hash").agg(F.min("source").alias("source"), F.first("text").alias("text"), F.first("page").alias("page"))
    old = chunk.chunk_documents(docs.where("doc_id % 2 = 0").dropDuplicates(["doc_hash"]), config)
    done = ingest.reuse_chunks(firsts, old, True, config)
    return done.agg(F.sum(F.col("reused").cast("long")).alias("reused"), F.count(F.lit(1)).alias("chunks"))


_DIMENSIONS = " CROSS JOIN ".join(f"(SELECT unnest({values!r}) AS {name})".replace("True", "true").replace("False", "false") for name, values in experiments.GRID.items())
_GRID = f"grid AS (SELECT * FROM {_DIMENSIONS} CROSS JOIN (VALUES (false, NULL), (true, 20), (true, 50)) r(reranker, rerank_top_n))"
_MRR = "chunk_size / 4096.0::DOUBLE + overlap_fraction / 3 + top_k / 40.0::DOUBLE + CASE WHEN retriever = 'hybrid' THEN 0.1::DOUBLE ELSE 0 END + coalesce(rerank_top_n, 0) / 1000.0::DOUBLE"


def _runs(spark):
    mrr = F.col("chunk_size") / 4096.0 + F.col("overlap_fraction") / 3 + F.col("top_k") / 40.0 + F.when(F.col("retriever") == "hybrid", 0.1).otherwise(0.0) + F.coalesce("rerank_top_n", F.lit(0)) / 1000.0
    return experiments.grid_configs(spark).withColumn("mrr", mrr)


@query(f"WITH {_GRID} SELECT chunk_strategy, chunk_size, overlap_fraction::DOUBLE AS overlap_fraction, retriever, top_k, embedding_model, metadata_prepend, reranker, rerank_top_n FROM grid")
def grid_configs(spark, sf_dir):
    return experiments.grid_configs(spark)


@query(f"""WITH {_GRID}, runs AS (SELECT *, {_MRR} AS mrr FROM grid), means AS ({' UNION ALL '.join(f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, avg(mrr) AS mean FROM runs GROUP BY {f}" for f in experiments.FACTORS)})
SELECT factor, round(max(mean) - min(mean), 6) AS effect, count(*) AS n_levels FROM means GROUP BY factor""")
def factor_effects(spark, sf_dir):
    return experiments.factor_effects(_runs(spark)).withColumn("effect", F.round("effect", 6))


@query(f"WITH {_GRID}, runs AS (SELECT *, {_MRR} AS mrr FROM grid) SELECT overlap_fraction::DOUBLE AS overlap_fraction, {', '.join(f'round(avg(mrr) FILTER (chunk_size = {n}), 6) AS s{n}' for n in experiments.GRID['chunk_size'])} FROM runs GROUP BY overlap_fraction")
def effect_pivot(spark, sf_dir):
    made = experiments.heatmap(_runs(spark), levels=experiments.GRID["chunk_size"])
    return made.select("overlap_fraction", *[F.round(F.col(f"`{n}`"), 6).alias(f"s{n}") for n in experiments.GRID["chunk_size"]])


@query("SELECT sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS id_hash, count(*) AS n FROM documents")
def id_set_hash(spark, sf_dir):
    return ids.id_set_hash(_documents(spark, sf_dir), "doc_id")


@query("SELECT doc_id, sha256('hashing-64' || chr(0) || 'v1' || chr(0) || text) AS cache_key FROM documents")
def embedding_cache_keys(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", ids.embedding_key("hashing-64", "v1", F.col("text")).alias("cache_key"))


@query("""SELECT event_id, user_id, round(spent, 4) AS spent, spent <= 500 AS fits FROM (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def running_budget(spark, sf_dir):
    done = generate.running_budget(_table(spark, sf_dir, "events"), 500.0, "user_id", ("ts", "event_id"), "value")
    return done.select("event_id", "user_id", F.round("spent", 4).alias("spent"), "fits")


@query("SELECT conv_id, turn, octet_length(encode(text)) + 256 AS tokens, round((octet_length(encode(text)) + 256) * 3.0::DOUBLE / 1e6 + 512 * 15.0::DOUBLE / 1e6, 9) AS usd FROM conversations")
def prompt_cost(spark, sf_dir):
    bound = text.token_upper_bound(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", bound.alias("tokens"), F.round(text.cost_usd(bound, F.lit(512), 3.0, 15.0), 9).alias("usd"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return event_counts(_table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
