"""Configuration grids, resumable runs and what is read off them."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.operators.metrics import paired_permutation

# The grid's dimensions.
GRID = {
    "chunk_strategy": ["fixed", "recursive", "sentence", "structure"],
    "chunk_size": [128, 256, 512, 1024],
    "overlap_fraction": [0.0, 0.1, 0.2],
    "retriever": ["dense", "bm25", "hybrid"],
    "top_k": [3, 5, 10],
    "embedding_model": ["BAAI/bge-small-en-v1.5", "sentence-transformers/all-MiniLM-L6-v2"],
    "metadata_prepend": [False, True],
}
RERANK_TOP_N = [20, 50]
BASELINE = {"chunk_strategy": "fixed", "chunk_size": 256, "overlap_fraction": 0.1, "retriever": "hybrid", "reranker": False, "top_k": 5, "metadata_prepend": False}
FACTORS = ("chunk_strategy", "chunk_size", "overlap_fraction", "retriever", "reranker", "rerank_top_n", "top_k", "embedding_model", "metadata_prepend")


def grid_configs(spark: SparkSession, grid: dict[str, list] | None = None, depths: list[int] | None = None) -> DataFrame:
    """Every combination, once without reranking and once for each rerank depth. Driver literals only."""
    rows = spark.range(1)
    for name, values in (grid or GRID).items():
        rows = rows.withColumn(name, F.explode(F.lit(values)))
    depths = F.array(F.lit(None).cast("int"), *[F.lit(n) for n in (RERANK_TOP_N if depths is None else depths)])
    return rows.withColumn("rerank_top_n", F.explode(depths)).withColumn("reranker", F.col("rerank_top_n").isNotNull()).drop("id")


def configs(grid: dict[str, list] | None = None, depths: list[int] | None = None) -> list[dict]:
    grid, depths = grid or GRID, RERANK_TOP_N if depths is None else depths
    variants = [{"reranker": False, "rerank_top_n": None}, *({"reranker": True, "rerank_top_n": n} for n in depths)]
    return [dict(zip(grid, values, strict=True)) | v for values in itertools.product(*grid.values()) for v in variants]


def pending(wanted: DataFrame, runs: DataFrame, key: str = "config_hash") -> DataFrame:
    """Configurations without a run that ended well: failed ones are tried again."""
    return wanted.join(runs.where(F.col("status") == "ok").select(key), key, "left_anti")


class Runs:
    """Runs as one table with a folder for each configuration; a run that ended well is not done again."""

    SCHEMA = "config string, result string, status string"

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.directory}/config_hash={key}"

    def done(self, key: str) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = self.spark.read.schema(self.SCHEMA).parquet(self._path(key)).head()
        return json.loads(row["result"]) if row and row["status"] == "ok" else None

    def run(self, config: dict, work: Callable[[dict], dict]) -> tuple[dict, bool]:
        """(result, whether it was there already). A failure is recorded, then raised."""
        key = ids.config_hash(config)
        if (known := self.done(key)) is not None:
            return known, True
        try:
            result, status = work(config), "ok"
        except Exception as error:
            self._write(key, config, {"error": repr(error)}, "failed")
            raise
        self._write(key, config, result, status)
        return result, False

    def _write(self, key: str, config: dict, result: dict, status: str) -> None:
        row = [(ids.canonical(config), ids.canonical(result), status)]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._path(key))

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, config_hash string").parquet(self.directory)


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(low_a, low_b) <= F.least(high_a, high_b)


def best_and_baseline(runs: DataFrame, baseline: dict | None = None) -> DataFrame:
    """Two rows (role, config_hash, mrr): the best by mean MRR, ties to the first hash; the baseline configuration, or the
    first by hash. ``runs``: config_hash, mrr and the factors' columns."""
    is_base = F.lit(True)
    for k, v in (BASELINE if baseline is None else baseline).items():
        is_base = is_base & F.col(k).eqNullSafe(F.lit(v))
    best = runs.orderBy(F.desc("mrr"), "config_hash").limit(1).select(F.lit("best").alias("role"), "config_hash", "mrr")
    base = runs.withColumn("_b", is_base).orderBy(F.desc("_b"), "config_hash").limit(1).select(F.lit("baseline").alias("role"), "config_hash", "mrr")
    return best.unionByName(base)


def compare(questions: DataFrame, best: str, baseline: str, value: str = "mrr") -> DataFrame:
    """The paired test of two configurations over their shared questions (config_hash, question_id, value)."""
    of = lambda h: questions.where(F.col("config_hash") == h).select("question_id", value)
    return paired_permutation(of(best), of(baseline), "question_id", value)


def factor_effects(runs: DataFrame, value: str = "mrr", factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """(factor, levels, effect, n_levels): the range of the mean over a factor's levels, the largest first."""
    sides = ", ".join(f"'{f}', cast({f} AS string)" for f in factors)
    long = runs.selectExpr(value, f"stack({len(factors)}, {sides}) AS (factor, level)")
    means = long.groupBy("factor", "level").agg(F.avg(value).alias("mean"))
    return means.groupBy("factor").agg((F.max("mean") - F.min("mean")).alias("effect"), F.count(F.lit(1)).alias("n_levels")).orderBy(F.desc("effect"), "factor")


def heatmap(runs: DataFrame, rows: str = "overlap_fraction", columns: str = "chunk_size", value: str = "mrr", levels: list | None = None) -> DataFrame:
    return runs.groupBy(rows).pivot(columns, levels).agg(F.avg(value)).orderBy(rows)


def pareto(points: DataFrame, cost: str = "latency_ms", value: str = "mrr", key: str = "config_hash") -> DataFrame:
    """The points with ``on_front``: no point is as cheap and better, or cheaper and as good. One row a configuration."""
    before = Window.orderBy(F.asc(cost), F.desc(value), F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("on_front", F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True)))


def completeness(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    done = runs.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    return wanted.agg(F.count(F.lit(1)).alias("expected")).join(done).withColumn("complete", F.col("expected") == F.col("ok"))
