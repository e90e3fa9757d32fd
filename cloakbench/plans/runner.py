"""The whole run in five stages over stored tables: baseline, character attacks, context attacks, detection, evaluation."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import backends, corpus, evaluation, sampling
from ..sources import tables

STAGES = ["baseline", "character attacks", "context attacks", "detection", "evaluation"]


def _predicted(spark: SparkSession, path: str) -> DataFrame | None:
    store, where = tables._files(spark, path)
    return tables.read_predictions(spark, path) if store.exists(where) and len(store.listStatus(where)) else None


def run_detection(spark: SparkSession, dataset: DataFrame, path: str, models: list[str], manifest: tables.Manifest | None = None, loaders: dict[str, Callable] | None = None, quotas: dict[str, int | None] | None = None) -> dict[str, str]:
    """Each model predicts the rows it lacks and its part is appended; model -> reason of those that failed.

    A model with a failed batch is skipped with its first error; its rows that were predicted stay.
    """
    rows = dataset if quotas is None else sampling.quota_sample(dataset, quotas)
    skipped: dict[str, str] = {}
    for model in models:
        if manifest is not None and model in manifest.state["detection"]["completed"]:
            continue
        have = _predicted(spark, path)
        left = rows if have is None else evaluation.remaining(rows, have, model)
        if manifest is not None:
            manifest.begin_model(model, 0 if have is None else have.where(F.col("model") == model).count())
        got = backends.detect_with(left, model, (loaders or {}).get(model), keep_errors=True).persist()
        tables.append_predictions(got.where("error is null").drop("error"), path)
        failed = backends.skipped_models(got).first()
        got.unpersist()
        if failed is not None:
            skipped[model] = failed.reason
        if manifest is not None:
            manifest.skip_model(model, failed.reason) if failed is not None else manifest.finish_model(model)
    return skipped


def run(spark: SparkSession, folder: str, customer: DataFrame | None = None, documents: DataFrame | None = None, models: list[str] | None = None, stage: int | None = None, skip_generation: bool = False, force: bool = False, quotas: dict[str, int | None] | None = None, progress: str | None = None, level: str = "both", method: str = "subsequence") -> tables.Manifest:
    """Stages that the progress file has are left out; stage runs that one again; force archives the tables first.

    skip_generation takes the stored dataset without its derived rows and attacks it anew. The progress file lies on the driver's disk.
    """
    at = lambda n: f"{folder.rstrip('/')}/{n}"
    manifest = tables.Manifest(progress or os.path.join(folder.removeprefix("file://"), "progress.json"))
    models = models or L.MODELS
    if force:
        tables.archive(spark, folder, manifest)
    if skip_generation:
        store, where = tables._files(spark, at("dataset"))
        if not store.exists(where):
            raise FileNotFoundError(f"no dataset in {folder}")
        if manifest.state["stage"] > 0:
            _replace(spark, corpus.strip_derived(spark.read.parquet(at("dataset"))), at("dataset"))
        manifest.state["stage"] = 0
        manifest.save()
    if stage is not None:
        manifest.rewind(stage)

    def baseline() -> None:
        corpus.bulk(customer, documents).write.mode("overwrite").parquet(at("dataset"))

    def detection() -> None:
        run_detection(spark, spark.read.parquet(at("dataset")), at("predictions"), models, manifest, quotas=quotas)

    def evaluate() -> None:
        evaluation.evaluate(tables.read_predictions(spark, at("predictions")), spark.read.parquet(at("dataset")), models, level, method).write.mode("overwrite").parquet(at("evaluations"))

    steps = [
        baseline,
        lambda: _replace(spark, corpus.with_fuzzy(spark.read.parquet(at("dataset"))), at("dataset")),
        lambda: _replace(spark, corpus.with_content(spark.read.parquet(at("dataset"))), at("dataset")),
        detection,
        evaluate,
    ]
    for n in range(len(steps)) if stage is None else [stage]:
        if n <= manifest.state["stage"]:
            continue
        steps[n]()
        # A run of some models ends the stage only when all models are done or skipped.
        if n != 3 or manifest.all_done(L.MODELS if set(models) != set(L.MODELS) else models):
            manifest.finish_stage(n)
    return manifest


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write a table that is made from itself: beside it first, then in its place."""
    rows.write.mode("overwrite").parquet(f"{path}-new")
    store, old = tables._files(spark, path)
    store.delete(old, True)
    store.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}-new"), old)
    spark.catalog.refreshByPath(path)


def status(spark: SparkSession, folder: str, progress: str | None = None) -> DataFrame:
    """name, state: each stage, and each model with its predictions or the reason why it was skipped."""
    manifest = tables.Manifest(progress or os.path.join(folder.removeprefix("file://"), "progress.json"))
    done = manifest.state["detection"]
    rows = [(s, "done" if n <= manifest.state["stage"] else "open") for n, s in enumerate(STAGES)]
    rows += [(m, "completed") for m in done["completed"]] + [(m, f"skipped: {why}") for m, why in done["skipped"].items()]
    if done["in_progress"]:
        rows.append((done["in_progress"]["model"], f"in progress, {done['in_progress']['processed_count']} rows"))
    return spark.createDataFrame(rows, "name string, state string")
