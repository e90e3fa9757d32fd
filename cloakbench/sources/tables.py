"""Tables in and out: Parquet is the store, CSV with JSON columns the exchange format, a JSON manifest the checkpoint."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import SPAN

#: A column holds JSON if its name contains one of these.
JSON_NAMES = ("span", "prediction", "techniques", "result", "attack_target")
TARGET = "struct<pii:array<string>,context:array<string>>"
DATASET_CSV = "uid long, input_id long, category string, attack_target string, llm_input string, pii_spans string"
PREDICTIONS_CSV = "uid long, model string, prediction string, perplexity double, latency_ms double"
TYPES = {"attack_target": TARGET, "pii_spans": f"array<{SPAN}>", "prediction": f"array<{SPAN}>"}


def is_json_name(name: str) -> bool:
    return any(x in name for x in JSON_NAMES)


def read_csv(spark: SparkSession, path: str, schema: str, keep_raw: bool = False) -> DataFrame:
    """CSV with embedded line feeds and doubled quotes; JSON columns are parsed, malformed ones become null.

    keep_raw adds `<name>_raw` with the text of each JSON column.
    """
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False)
    for c in rows.columns:
        if is_json_name(c) and c in TYPES:
            if keep_raw:
                rows = rows.withColumn(f"{c}_raw", F.col(c))
            rows = rows.withColumn(c, F.from_json(c, T._parse_datatype_string(TYPES[c])))
    return rows


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested columns as JSON."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, quote='"', escape='"', mode=mode)


def append_csv(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """One more batch into a CSV folder; each file carries the header once. An empty batch writes nothing."""
    if not rows.isEmpty():
        write_csv(rows, path, mode="append")


def append_predictions(rows: DataFrame, path: str) -> None:
    """One folder a model; an empty batch writes nothing."""
    rows.write.mode("append").partitionBy("model").parquet(path)


def replace_models(rows: DataFrame, path: str) -> None:
    """Only the folders of the models in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Damaged files are skipped and named in the log. schema: of the columns beside model."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    return (reader.schema(T.StructType([*schema.fields, T.StructField("model", T.StringType())])) if schema is not None else reader).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def rename_suffix(spark: SparkSession, folder: str, old: str, new: str) -> None:
    store, where = _files(spark, folder)
    for f in store.listStatus(where):
        name = f.getPath().getName()
        if name.endswith(old):
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.removesuffix(old)}{new}"))


def drop_parts(spark: SparkSession, folder: str, manifest: Manifest, models: list[str]) -> bool:
    """Delete the folder of single-model parts once every model is completed or skipped."""
    if not manifest.all_done(models):
        return False
    store, where = _files(spark, folder)
    return bool(store.delete(where, True))


class Manifest:
    """Stage, model and batch progress in a JSON file, replaced atomically. It lies beside the driver, not in the store."""

    def __init__(self, path: str):
        self.path = path
        self.state = self.fresh()
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.state |= json.load(f)
            self._migrate()

    @staticmethod
    def fresh() -> dict:
        return {"stage": -1, "detection": {"completed": [], "skipped": {}, "in_progress": None}}

    def _migrate(self) -> None:
        """An older file lists the uids of a model that is under way; their number is kept."""
        now = self.state["detection"].get("in_progress")
        if now and "processed_uids" in now:
            now["processed_count"] = len(now.pop("processed_uids"))

    def save(self) -> None:
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        fd, part = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(self.state, f)
        os.replace(part, self.path)

    def clear(self) -> None:
        self.state = self.fresh()
        self.save()

    def finish_stage(self, stage: int) -> None:
        self.state["stage"] = max(stage, self.state["stage"])
        if stage >= 3:
            self.state["detection"] = self.fresh()["detection"]
        self.save()

    def rewind(self, stage: int) -> None:
        """The stage and those after it count as not done."""
        self.state["stage"] = min(self.state["stage"], stage - 1)
        self.save()

    def begin_model(self, model: str, processed: int) -> None:
        self.state["detection"]["in_progress"] = {"model": model, "processed_count": processed}
        self.save()

    def finish_model(self, model: str) -> None:
        done = self.state["detection"]
        done["completed"] = sorted({*done["completed"], model})
        done["in_progress"] = None
        self.save()

    def skip_model(self, model: str, reason: str) -> None:
        self.state["detection"]["skipped"][model] = reason[:80]
        self.state["detection"]["in_progress"] = None
        self.save()

    def all_done(self, models: list[str]) -> bool:
        done = self.state["detection"]
        return set(models) <= {*done["completed"], *done["skipped"]}


def archive(spark: SparkSession, folder: str, manifest: Manifest | None = None, names: tuple[str, ...] = ("dataset", "predictions", "evaluations")) -> str:
    """Move a run's tables below archive/<time>, in whatever store they are, and clear its progress."""
    to = f"{folder.rstrip('/')}/archive/{time.strftime('%Y%m%d-%H%M%S')}"
    store, where = _files(spark, to)
    store.mkdirs(where)
    for n in names:
        _, at = _files(spark, f"{folder.rstrip('/')}/{n}")
        if store.exists(at):
            store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{to}/{n}"))
    if manifest is not None:
        manifest.clear()
    return to
