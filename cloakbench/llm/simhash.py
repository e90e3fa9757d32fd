"""SimHash near-dedup: byte-position inverted index, count filter, verification.

Fingerprints: the 64-bit majority of XXH64 over word shingles (repeats included), one pass in Python over Arrow batches.
Linking (DataFrame operations): two fingerprints within two bits differ in at most two of their eight bytes, so they
share at least six positional bytes and at least two of the four byte pairs. Distinct fingerprints are posted under each
of the six combinations of two byte pairs (each posting key holds four byte positions with their values); within a posting
list the shared positional bytes of each pair are tallied, pairs with fewer than six are dropped, the rest verified by XOR.

A posting list longer than `longest` is not paired: all its fingerprints go the exact other way. Each is posted under
itself and its 64 one-bit neighbours; two fingerprints are within two bits exactly if they share such a neighbour, the
at most 65 fingerprints under one neighbour are all linked, and a star from the least of them keeps that. That is 65 rows
a fingerprint whatever the length of the list.

Exact copies meet as one distinct fingerprint before any of that; groups are components of the links.

Defined cases: null text has no words; a text without words has fingerprint 0 and is linked like any other; fewer words
than a shingle give one shingle of all; null ids keep their rows and are the component id only where the whole component
has none; repeated rows share their component; extra columns are ignored by `components`; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, documents, give_back, small_batches, stash

BITS = 2  # linked at so many differing bits or fewer
LEAST_BYTES = 8 - BITS
ALL_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), ALL_AT_ONCE):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[k : k + ALL_AT_ONCE], ends[k : k + ALL_AT_ONCE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp is a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("fp", T.LongType())]))


def _posting_keys(fp: Column) -> Column:
    pair = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(pair[i], 16)).bitwiseOR(pair[j]) for n, (i, j) in enumerate(combinations(range(4), 2))])


def _shared_bytes(x: Column, y: Column) -> Column:
    """The tally: at how many of the eight byte positions x and y hold the same byte."""
    d = x.bitwiseXOR(y)
    return sum((F.when(F.shiftrightunsigned(d, 8 * p).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(distinct: DataFrame, longest: int = 64) -> DataFrame:
    """(a, b) fingerprints whose components are those of all pairs within two bits; distinct has a column fp."""
    posted = distinct.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = stash(posted.join(counts, "key"), "postings")

    lists = posted.where(F.col("n") <= longest).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (_shared_bytes(x, y) >= LEAST_BYTES)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = lists.select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)

    crowded = posted.where(F.col("n") > longest).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = crowded.select("fp", F.explode(around).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, longest: int = 64) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    with small_batches(docs.sparkSession):
        fps = stash(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    reps = stash(fps.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    whole = connected_components(links(reps, longest), "a", "b")
    member = whole.join(reps, F.col("node") == F.col("fp")).select("fp", "component", "rep")
    member = stash(member, "members")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = member.join(least, "component").select("fp", "component_id")
    owner = stash(reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "owners")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(owner, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the component_id that groups gives it, all columns; of rows that repeat that id one stays.

    Documents without id cannot be told apart by it and all stay.
    """
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    stay = docs.join(kept, F.col(id_col) == F.col("__keep"), "left_semi")
    # The join has dealt the rows by id, so this only sorts within partitions.
    once = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    first = stay.withColumn("__rank", F.row_number().over(once)).where("__rank = 1").select(*docs.columns)
    return first.unionByName(docs.where(F.col(id_col).isNull()))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of each component, as keep_least keeps them."""
    return keep_least(docs, components(docs, id_col, text_col, **how), id_col, text_col)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))
