"""Shared pieces of the corpus operators: word rule, durable stashes, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what counts as a word everywhere in this package (bytes.split() cuts at the same six characters).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hadoop's key for the class that serves file: paths.
FILE_SYSTEM, RAW_FILES = "fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem"

_roots: dict[str, str] = {}


def stash_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: below spark.checkpoint.dir, which all executors share; a temporary folder only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "cloakbench-stash")
        _roots[app] = f"{base.rstrip('/')}/stash-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fewer_children(spark: SparkSession) -> None:
    """From now on this session's file: paths and stashes are written with few `chmod` processes, which Hadoop starts where its native library is missing.

    Until such a child runs its program it shares the executor's memory and counts as a second JVM of the same size. The raw
    local file system writes no .crc file beside each file, which saves one of a writing task's three; `in_few_tasks` saves
    tasks. A file system that the user has chosen stays, and other stores are not affected.
    """
    chosen = spark.conf.get(FILE_SYSTEM, None) or spark.sparkContext._jsc.hadoopConfiguration().get(FILE_SYSTEM)
    if chosen is None and not spark._jvm.org.apache.hadoop.util.NativeCodeLoader.isNativeCodeLoaded():
        spark.conf.set(FILE_SYSTEM, RAW_FILES)
        spark.conf.set(f"{FILE_SYSTEM}.disable.cache", "true")  # else the one that an executor has opened before is used


def in_few_tasks(df: DataFrame, task_mb: int = 64) -> DataFrame:
    """After fewer_children: df in a task for each `task_mb` of the files it comes from, or two a core if that is more; no rows move."""
    spark = df.sparkSession
    if spark.conf.get(FILE_SYSTEM, None) != RAW_FILES:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return df.coalesce(min(1 << 20, max(2 * spark.sparkContext.defaultParallelism, size // (task_mb << 20))))


def stash(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    release=True also lets Spark delete the shuffle files of finished steps, which it does when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{stash_root(spark)}/{name}-{uuid.uuid4().hex}"
    in_few_tasks(df).write.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of texts this small for the jobs run inside: both sides of the pipe hold several at once."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    had = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """At the end of a Python task: return free memory to the system, for idle workers stay alive beside the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def summed(parts: DataFrame, pieces: int) -> dict[int, tuple[np.ndarray, int]]:
    """k -> (sum of the float64 arrays in `total`, sum of n) over rows (k int below `pieces`, total binary, n long), added up on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                had = sums.setdefault(k, [0.0, 0])
                sums[k] = [had[0] + np.frombuffer(x.as_buffer(), np.float64), had[1] + n]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["k", "total", "n"])

    got = parts.select("k", "total", "n").repartition(pieces, "k").mapInArrow(add, "k int, total binary, n long").toArrow()
    return {r["k"]: (np.frombuffer(r["total"], np.float64), r["n"]) for r in got.to_pylist()}


def ascii_lower(text):
    """Lower-case A-Z only.

    lower() works on whole strings at memory speed but also maps letters beyond ASCII, so it is taken only
    where no such upper-case letter occurs; translate() does the rest.
    """
    other_upper = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other_upper, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node reachable.

    Alternating large-star and small-star steps on (a, b) longs, each a min() aggregate and an equi-join, so a
    hub's neighbours are never gathered in one task (aggregates combine map-side, AQE splits the skewed join).
    Every round is written to the shared folder; it ends when a round changes nothing.
    """
    cur = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    print_of = lambda d: d.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    seen = print_of(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        new = stash(small.distinct(), "cc")
        now = print_of(new)
        drop_stash(cur)
        cur = new
        if now == seen:
            break
        seen = now
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
