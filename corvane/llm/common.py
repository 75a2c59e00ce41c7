"""What several of the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java, RE2 and Python character class body.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` is used where it can be (a text without other letters that it would change)."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="corvane-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows doesn't compute it again, and lost executors lose none of it.

    With ``by`` the rows are first dealt by these columns into files of the size that Spark advises, however many tasks
    made them. A file costs its executor several processes where Hadoop sets permissions by calling chmod."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance", *by) if by else df).write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # Spark's cleaner then removes the shuffle files of the steps that nothing refers to
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded by bytes for what is run inside, so that long texts don't fill an executor."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {k: spark.conf.get(k, None) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def salted_join(rows: DataFrame, small: DataFrame, key: str, weight: str, total: int, *spread: str) -> DataFrame:
    """Inner join of ``rows`` with ``small`` (one row a key; ``weight`` says how many of the ``total`` rows the key has).

    Keys with over a thousandth of all rows, fewer than a thousand, are broadcast as a list; their rows are dealt over 64
    tasks by a hash of ``spread``, so no key's rows land in one task."""
    heavy = F.col(weight) * 1000 > F.lit(total)
    listed = small.where(heavy).select(key, F.lit(True).alias("_heavy"))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(64)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(listed), key, "left").withColumn("_salt", salt).drop("_heavy")
    right = small.withColumn("_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def sql_literal(value, long: bool = True) -> str:
    """SQL text of nested lists and string- or integer-keyed dicts of them. As an expression Spark folds it to one constant."""
    if isinstance(value, dict):
        return f"map({', '.join(f'{sql_literal(k, long)}, {sql_literal(v, long)}' for k, v in value.items())})"
    if isinstance(value, list | tuple):
        return f"array({', '.join(sql_literal(v, long) for v in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{int(value)}{'L' if long else ''}"


def pinned(value: Column) -> Column:
    """``value``, held where it is computed: a later filter on it isn't pushed below and so doesn't compute it again,
    once per element of an array inside a lambda."""
    return F.when(F.monotonically_increasing_id() >= 0, value)
