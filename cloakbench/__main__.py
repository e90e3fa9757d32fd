"""python -m cloakbench run | status | reset | generate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import lexicon as L
from .operators import corpus
from .plans import runner
from .sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cloakbench", description="How well detectors of personal data hold up under manipulated text.")
    parser.add_argument("command", choices=["run", "status", "reset", "generate"])
    parser.add_argument("folder", help="where dataset, predictions and evaluations are stored")
    parser.add_argument("--input", help="folder with customer.parquet and documents.parquet")
    parser.add_argument("--models", nargs="*", choices=L.MODELS)
    parser.add_argument("--stage", type=int, choices=range(5))
    parser.add_argument("--skip-gen", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--full", action="store_true", help="detect on all rows instead of the quota sample")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cloakbench").getOrCreate()
    inputs = {n: spark.read.parquet(f"{a.input}/{n}.parquet") for n in ("customer", "documents")} if a.input else {}
    if a.command == "run":
        runner.run(spark, a.folder, **inputs, models=a.models, stage=a.stage, skip_generation=a.skip_gen, force=a.force, quotas=None if a.full else L.QUOTAS)
    elif a.command == "generate":
        corpus.bulk(**inputs).write.mode("overwrite").parquet(f"{a.folder}/dataset")
    elif a.command == "reset":
        tables.Manifest(f"{a.folder.removeprefix('file://')}/progress.json").clear()
    if a.command in ("run", "status"):
        runner.status(spark, a.folder).show(100, truncate=False)


if __name__ == "__main__":
    main()
