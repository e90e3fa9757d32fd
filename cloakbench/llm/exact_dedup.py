"""Exact dedup by content sort, in DataFrame operations only.

Texts are lower-cased in A-Z. Rows are dealt to ranges of (first characters, hash, salt) at splitters that Spark samples and
sorted externally by whole text within their range, so equal texts are neighbours. Each row is compared with the one before it on
the whole text: where they differ a run begins. A run's first identifier is the one that stays, its length the size of the group; the
text is digested once a run. Only narrow rows leave that stage.

A text that holds more than `hot_share` of the rows is dealt over `salts` ranges by its salt, so no task gets all its copies; the
runs of those few texts alone (at most salts / hot_share rows) meet again by SHA-256.

Defined cases: null text counts as empty; empty texts equal each other; a null doc_id never wins against another and is
kept only where its whole group has none; of rows that repeat both doc_id and text one is kept; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, stash

HEAD = 32
RANGE_CHARS = 128 << 20  # text of a range, about


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hot_share: float = 0.002, salts: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. keep: 'max' or 'min' identifier stays."""
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))

    # At most 1 / hot_share hashes can be hot, so the list is bounded whatever the input.
    counts = stash(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.length("norm")).alias("chars")), "counts")
    total, chars = (x or 0 for x in counts.agg(F.sum("n"), F.sum("chars")).first())
    hot = counts.where(F.col("n") > F.lit(max(100.0, hot_share * total))).select("h", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(salts))).otherwise(F.lit(0)))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    dealt = rows.select(F.substring("norm", 1, HEAD).alias("head"), "h", "salt", "hot", "id", "norm").repartitionByRange(parts, "head", "h", "salt")
    # The range partitioning already clusters (head, h, salt): the windows sort within the ranges and add no exchange.
    place = ["head", "h", "salt"]
    order = Window.partitionBy(*place).orderBy("norm", F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last())
    near = dealt.withColumn("first", ~F.col("norm").eqNullSafe(F.lag("norm").over(order)))
    near = near.withColumn("run", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = near.select(*place, "run", "hot", "id", "first", F.when(F.col("first"), F.sha2("norm", 256)).alias("digest"))
    whole = Window.partitionBy(*place, "run")
    own = F.struct("id", "digest")
    begin = F.max(F.when(F.col("first"), own)).over(whole)
    runs = near.select("id", "hot", "first", begin.alias("begin"), F.count("*").over(whole).alias("n"))
    marked = stash(runs.select("id", "hot", "first", F.col("begin.id").alias("best"), F.col("begin.digest").alias("text_sha256"), "n"), "runs")

    best = F.min("best") if keep == "min" else F.max("best")
    met = marked.where("hot AND first").groupBy("text_sha256").agg(best.alias("met_best"), F.sum("n").alias("met_n"), F.lit(True).alias("hot"))
    out = marked.join(F.broadcast(met), ["text_sha256", "hot"], "left")
    keep_id = F.when(F.col("hot"), F.col("met_best")).otherwise(F.col("best"))
    # Equal ids of a group share their salt and so their run: only one run can begin with keep_id.
    kept = F.col("first") & F.col("id").eqNullSafe(keep_id)
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("met_n", "n").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts stays."""
    return groups(documents(spark, sf_dir))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
