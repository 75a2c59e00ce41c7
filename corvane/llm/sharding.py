"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups (equal texts) stay whole. Light ones are hashed to a bounded number of bundles; one that outweighs half a fair bundle
is an item of its own; only one that outweighs a fair shard is dealt over the bundles by row. Bundles and heavy groups, a
bounded table, are packed on the driver: the heaviest first, each where the dot product of its sizes with the shards'
residual capacities is highest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, text_or_empty, written

#: Bytes that each row takes besides its text.
ROW_BYTES = 8
#: Bundles per shard: a bound on what the driver packs (and on how finely split groups are dealt).
BUNDLES_PER_SHARD = 512
#: Slots inside an item are numbered in so many parts, so a heavy group isn't sorted in one task.
PARTS = 64


def sized(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds size (UTF-8 bytes and ROW_BYTES), text_crc32 (null as empty), tokens (words) and group (equal texts)."""
    text = text_or_empty(text_column)
    return df.withColumns({
        "size": (F.octet_length(text) + ROW_BYTES).cast("long"),
        "text_crc32": F.crc32(text),
        "tokens": F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long"),
        "group": F.xxhash64(text),
    })


def pack(sizes: np.ndarray, shards: int, weights: Sequence[float] = (1.0, 0.25, 0.25)) -> np.ndarray:
    """The shard of each item (a row of ``sizes`` with one column a dimension). Heaviest first, each into the shard with
    the highest dot product of the item's sizes and the residual capacities; ties go to the lowest shard.

    A dimension's capacity is its fair share. ``weights`` says how much each dimension counts in the product.
    """
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * shards * np.asarray(weights)
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), dtype=np.int64)
    unit = share / np.asarray(weights)
    for i in np.argsort(-share[:, 0], kind="stable"):
        best = int(np.argmax(residual @ share[i]))
        out[i] = best
        residual[best] -= unit[i]
    return out


def assign(df: DataFrame, shards: int, chunk: Column | None = None, order_by: Sequence[Column] = (), key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``df``: a table (it is read several times) with the columns of ``sized``. A group stays in one shard unless it
    outweighs a fair shard. Slots follow ``chunk`` (by default parts of the items; a column with many values of bounded row
    counts), then ``order_by``, then the key. Empty input gives no rows; repeated rows get slots of their own. Columns
    ``shard`` and ``slot`` of the input are replaced.
    """
    bundles = shards * BUNDLES_PER_SHARD
    total = df.agg(F.sum("size")).head()[0] or 0
    heavy = F.col("group_size") * 2 * bundles > F.lit(float(total))
    # At most 2 * bundles groups can weigh more than half a fair bundle, so this broadcast is bounded.
    split = F.col("group_size") * shards > F.lit(float(total))
    hot = df.groupBy("group").agg(F.sum("size").alias("group_size")).where(heavy).select("group", split.alias("_split"))
    dealt = df.drop("shard", "slot").join(F.broadcast(hot), "group", "left")
    salt = F.when(F.col("_split"), F.xxhash64(F.col("group"), F.col(key))).otherwise(F.xxhash64(F.col("group"), F.lit(0)))
    whole = F.coalesce(~F.col("_split"), F.lit(False))
    dealt = dealt.withColumn("_bundle", F.when(whole, -1).otherwise(F.pmod(salt, F.lit(bundles))).cast("int"))
    dealt = dealt.withColumn("_own", F.when(whole, F.col("group")).otherwise(0).cast("long")).drop("_split")
    item = ["_bundle", "_own"]
    sums = dealt.groupBy(*item).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sums = sums.toPandas().sort_values(item, ignore_index=True)
    shard = pack(sums[["size", "tokens", "rows"]].to_numpy(dtype=float), shards)
    spark, schema = df.sparkSession, "_bundle int, _own long, shard int"
    packed = pd.DataFrame({"_bundle": sums["_bundle"].astype("int32"), "_own": sums["_own"].astype("int64"), "shard": shard.astype("int32")})
    place = spark.createDataFrame(packed, schema) if len(sums) else spark.createDataFrame([], schema)
    part = F.pmod(F.xxhash64("_bundle", "_own", F.when(F.col("_bundle") < 0, F.col(key))), F.lit(PARTS * BUNDLES_PER_SHARD))
    placed = dealt.join(F.broadcast(place), item).withColumn("_chunk", part if chunk is None else chunk)
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(*order_by, key, "text_crc32")) - 1
    return placed.join(offsets, ["shard", "_chunk"]).withColumn("slot", F.col("_before") + inside).drop("_bundle", "_own", "_chunk", "_before")


def shard_digest(documents: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``documents``. The law that holds is ``bytes``: the shards' sizes are near equal."""
    narrow = written(sized(documents.select("doc_id", "text")).drop("text"), "sized")
    return assign(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
