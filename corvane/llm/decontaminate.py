"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

An item of q shingles of which a share c is asked for may miss (1 - c) q of them, so one of its (1 - c) q + 1 lowest
hashes is in any document that holds it. Items are partitioned by the power of two of q, and each partition keeps that
many lowest hashes for its largest size: a bottom-k MinHash signature whose length follows the size, which finds short
items in documents of any length and misses none. A document's hashes are held against the signatures' index; the items
found are verified by counting shared shingles. An item of fewer words than a shingle is one hash, which is looked for among
the documents' windows of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import pinned, sql_literal

#: After lower-casing: runs of digits, letters and all that is not ASCII, so punctuation and case don't hide an item.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 5
CONTAINMENT = 0.8
#: Up to so many hashes the items travel as literals in the plan; more are joined.
LITERAL_HASHES = 1 << 17


def shingle_hashes(text: Column) -> Column:
    """Hashes of the windows of five words; of one to four words, one hash of them all; of none or null, none."""
    return _item_windows(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def _windows(words: Column, length: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, length)))).otherwise(F.array().cast("array<bigint>"))


def _item_windows(words: Column) -> Column:
    return F.when((F.size(words) > 0) & (F.size(words) < WINDOW), F.array(F.xxhash64(words))).otherwise(_windows(words, WINDOW))


def _with_words(df: DataFrame, text_column: str) -> DataFrame:
    return df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text_column), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def _shingled(df: DataFrame, text_column: str, short: list[int]) -> DataFrame:
    """``_hashes``: of the windows of five words, and of those of the lengths ``short``, which the short items have."""
    hashes = [_windows(F.col("_words"), n) for n in (WINDOW, *short)]
    return _with_words(df, text_column).withColumn("_hashes", F.concat(*hashes) if short else hashes[0]).drop("_words")


def signatures(benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, size, hashes (sorted, distinct), signature, short (the words of an item with fewer than five, else 0). Items without words have none and match nothing.
    Repeated item ids with one text count once; with several texts each text is an item of that id."""
    words = F.col("_words")
    short = F.when(F.size(words) < WINDOW, F.size(words)).otherwise(0).alias("short")
    items = _with_words(benchmark.select("item_id", "text"), "text").select("item_id", F.array_sort(F.array_distinct(_item_windows(words))).alias("hashes"), short)
    items = items.where(F.size("hashes") > 0).distinct().withColumn("size", F.size("hashes"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size"))) + 1) - 1
    length = F.least(F.floor(largest * F.lit(1 - containment) + 1e-9).cast("int") + 1, F.col("size"))
    return items.withColumn("signature", F.slice("hashes", F.lit(1), length))


def _needed(containment: float, size: Column) -> Column:
    return F.ceil(size * F.lit(containment) - 1e-9)


def find_items(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, text_column: str = "text", literal_hashes: int = LITERAL_HASHES) -> DataFrame:
    """Adds ``leaks``: an array of (item_id, matched, size), sorted, of the items of which a document holds ``containment`` or more.

    With few enough items everything happens inside the row, without a shuffle. More items than ``literal_hashes`` hold
    are found by joins on the hash, with the same result.
    """
    items = signatures(benchmark, containment)
    held, lengths = items.agg(F.sum("size"), F.array_sort(F.collect_set("short"))).head()
    kind = "array<struct<item_id:bigint,matched:int,size:int>>"
    if not held:
        return documents.withColumn("leaks", F.array().cast(kind))
    short = [n for n in lengths if n]
    if held > literal_hashes:
        return _joined(documents, items, containment, text_column, kind, short)
    rows = [r.asDict() for r in items.select("item_id", "size", "hashes", "signature").orderBy("item_id", "hashes").collect()]
    index: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for h in r["signature"]:
            index.setdefault(h, []).append(i)
    hashes_of = F.expr(sql_literal([r["hashes"] for r in rows]))
    id_of, size_of = F.expr(sql_literal([r["item_id"] for r in rows])), F.expr(sql_literal([r["size"] for r in rows], long=False))
    by_hash, keys = F.expr(f"map_from_arrays({sql_literal(list(index))}, {sql_literal(list(index.values()), long=False)})"), F.expr(sql_literal(list(index)))
    df = _shingled(documents, text_column, short).withColumn("_met", F.array_intersect("_hashes", keys))
    places = F.array_distinct(F.flatten(F.transform("_met", lambda h: F.try_element_at(by_hash, h))))

    def verified(i: Column) -> Column:
        return F.struct(F.get(id_of, i).alias("item_id"), F.size(F.array_intersect(F.get(hashes_of, i), F.col("_hashes"))).alias("matched"), F.get(size_of, i).alias("size"))

    found = F.filter(F.transform(places, verified), lambda x: x["matched"] >= _needed(containment, x["size"]))
    leaks = F.when(F.size("_met") > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast(kind))
    return df.withColumn("leaks", pinned(leaks)).drop("_hashes", "_met")


def _joined(documents: DataFrame, items: DataFrame, containment: float, text_column: str, kind: str, short: list[int]) -> DataFrame:
    """The join form: rows get an id, and only hashes travel."""
    rows = documents.withColumn("_id", F.xxhash64("doc_id", F.coalesce(F.col(text_column), F.lit(""))))
    hashes = _shingled(rows.select("_id", text_column), text_column, short).select("_id", F.explode(F.array_distinct("_hashes")).alias("h")).distinct()
    items = items.withColumn("_item", F.xxhash64("item_id", "hashes"))
    met = hashes.join(items.select("_item", F.explode("signature").alias("h")), "h").select("_id", "_item").distinct()
    wanted = met.join(items.select("_item", "item_id", "size", F.explode("hashes").alias("h")), "_item")
    counts = wanted.join(hashes, ["_id", "h"]).groupBy("_id", "_item", "item_id", "size").agg(F.count(F.lit(1)).cast("int").alias("matched"))
    counts = counts.where(F.col("matched") >= _needed(containment, F.col("size")))
    leaks = counts.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("item_id", "matched", "size"))).cast(kind).alias("leaks"))
    return rows.join(leaks, "_id", "left").drop("_id").withColumn("leaks", F.coalesce("leaks", F.array().cast(kind)))


def decontamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, matched, item_size, containment."""
    found = find_items(documents.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("x"))
    return found.select(
        "doc_id", F.col("x.item_id").alias("item_id"), F.col("x.matched").cast("long").alias("matched"),
        F.col("x.size").cast("long").alias("item_size"), (F.col("x.matched") / F.col("x.size")).alias("containment"),
    )


def without_items(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows that hold no item, with their own columns."""
    held = documents.select(documents["text"].alias("text"), documents["doc_id"].alias("doc_id"), F.struct(*[documents[c] for c in documents.columns]).alias("_row"))
    return find_items(held, benchmark, containment).where(F.size("leaks") == 0).select("_row.*")
