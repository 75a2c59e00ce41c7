"""Identities: hashes that must agree between runs and engines."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc: Column, position: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc, position.cast("string"), F.sha2(text, 256)), 256), 1, 24)


def embedding_key(model: str, version: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0{version}\0"), text), 256)


def id_set_hash(df: DataFrame, column: str) -> DataFrame:
    """One row: the hash of the sorted ids, by lines. The ids meet in one row, as a hash of a whole set must."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), "\n")
    return df.agg(F.sha2(ids, 256).alias("id_hash"), F.count(F.lit(1)).alias("n"))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:16]


def chunk_fingerprint(config: dict, tokenizer: str, max_length: int) -> str:
    return hashlib.sha256(canonical({**config, "tokenizer_id": tokenizer, "max_sequence_length": max_length}).encode()).hexdigest()


def dataset_checksum(items: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One row: the hash of the items' canonical JSON, ordered by id."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), line.alias("line")))), lambda x: x["line"])
    return items.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"), F.count(F.lit(1)).alias("n"))
