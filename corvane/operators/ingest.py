"""Incremental ingest: what changed, what stays, which chunks can be used again."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.operators.chunk import ChunkConfig, chunk_documents
from corvane.operators.dedupe import deduplicate
from corvane.sources import files as io
from corvane.sources.shared import materialised

ORDER = ("source", "page", "doc_hash")


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(source, change) with added, changed or deleted; unchanged files have no row. Both: source, digest."""
    joined = current.select("source", F.col("digest").alias("now")).join(previous.select("source", F.col("digest").alias("before")), "source", "full")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNull(), "added").when(F.col("now") != F.col("before"), "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select("source", "change")


def retained(documents: DataFrame, diff: DataFrame) -> DataFrame:
    return documents.join(diff.select("source"), "source", "left_anti").select(*documents.columns)


def reuse_chunks(documents: DataFrame, chunks: DataFrame, same_config: bool, config: ChunkConfig) -> DataFrame:
    """Chunks of ``documents`` with ``reused``. Known documents keep their chunks, with the source and page that they have
    now; the others are chunked. One row of each hash is chunked, as documents were deduplicated."""
    known = chunks.select("doc_hash").distinct() if same_config else chunks.select("doc_hash").limit(0)
    place = documents.select("doc_hash", "source", "page")
    old = chunks.drop("source", "page").join(place, "doc_hash").select(*chunks.columns).withColumn("reused", F.lit(True))
    new = chunk_documents(documents.join(known, "doc_hash", "left_anti"), config).select(*chunks.columns).withColumn("reused", F.lit(False))
    return old.unionByName(new) if same_config else new


def ingest(spark: SparkSession, root: str, store: str, config: ChunkConfig, tokenizer: str = "whitespace") -> dict[str, int]:
    """Brings ``store`` (documents, chunks, manifest) up to the files below ``root``; the counts of what was done.

    All documents are stored with ``is_canonical``, so a copy comes back when the document that it repeated is deleted.
    """
    found = io.file_list(spark, root)
    current = materialised(found.select("source", "digest"), "files")
    before, before_config = io.read_manifest(spark, f"{store}/manifest")
    first = before_config is None
    fingerprint = ids.chunk_fingerprint(asdict(config), tokenizer, config.max_tokens)
    diff = materialised(manifest_diff(current, before), "diff")
    fresh = io.load_documents(found.join(diff.where("change <> 'deleted'").select("source"), "source", "left_semi"))
    if not first:
        stored = materialised(spark.read.parquet(f"{store}/documents"), "stored")
        fresh = retained(stored.drop("is_canonical"), diff).unionByName(fresh)
    fresh = materialised(fresh, "documents")
    judged = materialised(deduplicate(fresh, ORDER), "judged")
    canonical = judged.where("kept").drop("kept", "matched", "kind")
    if first:
        chunks = chunk_documents(canonical, config).withColumn("reused", F.lit(False))
    else:
        chunks = reuse_chunks(canonical, materialised(spark.read.parquet(f"{store}/chunks"), "chunks"), before_config == fingerprint, config)
    chunks = materialised(chunks, "chunks")
    judged.withColumn("is_canonical", F.col("kept")).drop("kept", "matched", "kind").write.mode("overwrite").parquet(f"{store}/documents")
    chunks.drop("reused").repartitionByRange("source", "page", "position", "id").sortWithinPartitions("source", "page", "position", "id").write.mode("overwrite").parquet(f"{store}/chunks")
    io.write_manifest(current, fingerprint, f"{store}/manifest")
    return counters(current, diff, judged, chunks).head().asDict()


def counters(current: DataFrame, diff: DataFrame, judged: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with the eight counts of a run."""
    files = current.agg(F.count(F.lit(1)).alias("files_seen"))
    changes = diff.agg(F.count_if(F.col("change") != "deleted").alias("files_changed"), F.count_if(F.col("change") == "deleted").alias("files_deleted"))
    documents = judged.agg(F.count_if("kept").alias("documents"), F.count_if(~F.col("kept")).alias("duplicates_removed"))
    made = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("reused").alias("chunks_reused"), F.count_if(~F.col("reused")).alias("chunks_rebuilt"))
    return files.join(changes).join(documents).join(made)
