"""Commands: doctor, ingest, search, ask, eval, report. Output is JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.operators import experiments, ingest, review
from corvane.operators.chunk import STRATEGIES, ChunkConfig
from corvane.plans import pipeline
from corvane.session import session
from corvane.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor")
    one = commands.add_parser("ingest")
    one.add_argument("root")
    one.add_argument("store")
    one.add_argument("--strategy", choices=STRATEGIES, default="fixed")
    one.add_argument("--size", type=int, default=256)
    one.add_argument("--overlap", type=int, default=32)
    one.add_argument("--prepend-section", action="store_true")
    for name in ("search", "ask"):
        one = commands.add_parser(name)
        one.add_argument("store")
        one.add_argument("question")
        one.add_argument("--top-k", type=int, default=5)
        one.add_argument("--retriever", choices=("dense", "bm25", "hybrid"), default="hybrid")
    one = commands.add_parser("eval")
    one.add_argument("dataset")
    one = commands.add_parser("report")
    one.add_argument("runs")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    given = parser().parse_args(args)
    spark = spark or session("corvane")
    if given.command == "doctor":
        result = {"spark": spark.version, "settings": {k: v for k, v in vars(Settings.from_env()).items() if k != "api_key"}}
    elif given.command == "ingest":
        result = ingest.ingest(spark, given.root, given.store, ChunkConfig(given.strategy, given.size, given.overlap, given.prepend_section))
    elif given.command in ("search", "ask"):
        chunks = spark.read.parquet(f"{given.store}/chunks")
        questions = spark.createDataFrame([(0, given.question)], "query_id long, question string")
        settings = Settings(retriever=given.retriever, top_k=given.top_k, retrieve_top_n=max(given.top_k, 20))
        rows = pipeline.search(chunks, questions, settings).orderBy("rank") if given.command == "search" else pipeline.ask(chunks, questions, settings)
        result = [r.asDict(recursive=True) for r in rows.collect()]
    elif given.command == "eval":
        result = review.dataset_report(files.read_jsonl(spark, given.dataset, review.ITEM_SCHEMA)).head().asDict()
    else:
        result = experiments.Runs(spark, given.runs).table().agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")).head().asDict()
    return json.dumps(result, indent=2, sort_keys=True, default=str)


if __name__ == "__main__":
    print(main())
