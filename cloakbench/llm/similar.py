"""Near-dedup by verified similarity: documents whose sets of five-word shingles have a Jaccard similarity of `least` or more are linked.

A bound on differing SimHash bits cannot promise those pairs (at similarity 0.8 a 64-bit fingerprint differs at about ten bits), so
candidates come from a prefix filter, which misses none: under any one order of all shingles, two sets that are similar enough share one of their
first n - ceil(least n) + 1. The order puts shingles seen often last, so lists stay short; which ones count as often changes the cost, not the result.

Equal sets meet first. All sets of a list are compared with its least one; then only sets that are still in different components are,
those outside a list's largest component with all others. Each set carries bits, `PARITY` of them and as many more as it has shingles, each the parity
of the shingles that fall on it: two sets differ in at least as many shingles as bits, which rules out most pairs without loss. Every candidate
left is verified on the whole sets. Groups are components of the links, so a group of m similar sets costs about m comparisons, not m squared.

Defined cases: as in simhash (null text has no words, texts without words are equal, fewer words than a shingle give one of all).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import connected_components, drop_stash, give_back, small_batches, stash
from .simhash import keep_least

MULTIPLIER, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
PARITY = 1024
SIEVE = 1 << 23  # bits of a broadcast bitmap of the texts that verification needs
SLACK = 1e-9  # of products of the bound and a size


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = (x ^ h[k : k + n]) * MULTIPLIER
        x ^= x >> SHIFT
    return np.unique(x)


def parity(x: np.ndarray, width: int = PARITY) -> np.ndarray:
    """width is a power of two; halves of the result xor to the result for half the width."""
    odd = np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def wide_parity(x: np.ndarray) -> np.ndarray:
    """A bit or more for each shingle; empty where PARITY bits are that many."""
    return parity(x, 1 << (len(x) - 1).bit_length()) if len(x) > PARITY else np.zeros(0, np.int64)


def _may_be(size, other_size, bits, other_bits, least: float):
    """Lossless: the smaller size and the bits that differ allow the similarity."""
    differ = sum((F.bit_count(bits[k].bitwiseXOR(other_bits[k])) for k in range(PARITY // 64)), F.lit(0))
    return (F.least(size, other_size) >= F.lit(least) * F.greatest(size, other_size) - SLACK) & (differ <= F.lit((1 - least) / (1 + least)) * (size + other_size) + SLACK)


def _may_be_wide(size, other_size, wide, other_wide, least: float):
    """As _may_be for the wide bits. Sizes near enough have widths of a factor of two at most: the wider is folded."""

    def folded(w, n):
        half = F.size(w) / 2
        return F.when(F.size(w) > n, F.zip_with(F.slice(w, 1, half.cast("int")), F.slice(w, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseXOR(q))).otherwise(w)

    n = F.least(F.size(wide), F.size(other_wide))
    bits = F.zip_with(folded(wide, n), folded(other_wide, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return (n == 0) | (F.aggregate(bits, F.lit(0), lambda a, b: a + b) <= F.lit((1 - least) / (1 + least)) * (size + other_size) + SLACK)


def _often(texts: DataFrame, shingle: int, least_rows: int = 32, most: int = 100_000) -> np.ndarray:
    """Shingles that many documents hold, rarest first; only those seen twice in one batch are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.concatenate([shingle_set(t.as_py(), shingle) for t in b.column(0)] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["h", "n"])
        give_back()

    got = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows)
    got = got.orderBy(F.desc("n"), "h").limit(most).orderBy("n", "h").toArrow()
    return got.column("h").to_numpy().astype(np.int64).view(np.uint64)


def _prefixes(rows: DataFrame, often: np.ndarray, shingle: int, least: float) -> DataFrame:
    """(id, text_key, bit, set, size, bits, wide, prefix) for every row."""
    order = np.argsort(often)
    shared = rows.sparkSession.sparkContext.broadcast((often[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, place = shared.value
        for b in batches:
            names, sizes, odd, wide, prefixes = [], [], [], [], []
            for t in b.column(3):
                x = shingle_set(t.as_py(), shingle)
                rank = np.full(len(x), -1, np.int64)
                if len(known) and len(x):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, place[at], -1)
                first = x[np.argsort(rank, kind="stable")[: len(x) - ceil(least * len(x) - SLACK) + 1]]
                names.append(xxhash.xxh64_intdigest(x.tobytes()))
                sizes.append(len(x))
                odd.append(parity(x))
                wide.append(wide_parity(x))
                prefixes.append(first.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), made], ["id", "text_key", "bit", "set", "size", "bits", "wide", "prefix"])
        give_back()

    long = T.LongType()
    made = [("id", rows.schema[0].dataType), ("text_key", T.StringType()), ("bit", long), ("set", long), ("size", T.IntegerType()), ("bits", T.ArrayType(long)), ("wide", T.ArrayType(long)), ("prefix", T.ArrayType(long))]
    return rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in made]))


def _verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of (a, b) whose whole sets are similar enough."""
    own = lambda n: sets.select(F.col("set").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "bits", "wide")])
    sizes = F.col("size_a"), F.col("size_b")
    pairs = pairs.distinct().join(own("a"), "a").join(own("b"), "b").where(_may_be(*sizes, F.col("bits_a"), F.col("bits_b"), least))
    pairs = stash(pairs.where(_may_be_wide(*sizes, F.col("wide_a"), F.col("wide_b"), least)).select("a", "b"), "candidates", release=True)
    needed = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(sets.select("set", "text_key", "bit"), "set")
    needed = stash(needed, "needed")

    # SIEVE bits whatever the input: texts that they rule out are not cut into shingles nor moved.
    sieve = np.zeros(SIEVE, bool)
    for r in needed.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b")).collect():
        part = np.unpackbits(np.frombuffer(r.b, np.uint8), bitorder="little")
        sieve[(r.k - 1) * len(part) : r.k * len(part)] = part[: SIEVE - (r.k - 1) * len(part)]
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            own = b.filter(pa.array(some[b.column(1).to_numpy() - 1]))
            x = [shingle_set(t.as_py(), shingle).view(np.int64) for t in own.column(2)]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(x, pa.list_(pa.int64()))], ["text_key", "x"])
        give_back()

    with small_batches(texts.sparkSession):
        cut = texts.select("text_key", "bit", "text").mapInArrow(run, "text_key string, x array<long>").dropDuplicates(["text_key"])
        whole = stash(cut.join(needed, "text_key").select("set", "x"), "sets", release=True)
    a, b = (whole.select(F.col("set").alias(n), F.col("x").alias("x" + n)) for n in "ab")
    both = F.size(F.array_intersect("xa", "xb"))
    joined = pairs.join(b, "b").join(a, "a").where(both >= F.lit(least) * (F.size("xa") + F.size("xb") - both) - SLACK)
    out = stash(joined.select("a", "b"), "similar", release=True)
    for table in (whole, pairs, needed):
        drop_stash(table)
    return out


def links(rows: DataFrame, sets: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) sets whose components are those of all pairs similar enough; rows has text and text_key, sets one row a set."""
    texts = rows.select("text", "text_key", "bit")
    near = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - SLACK
    posted = sets.select("set", "size", F.explode("prefix").alias("key"))
    leaders = posted.groupBy("key").agg(F.min(F.struct("set", "size")).alias("l"), F.count("*").alias("n")).where("n > 1").select("key", "l")
    posted = stash(posted.join(leaders, "key"), "shingle-postings", release=True)

    stars = posted.where((F.col("set") > F.col("l.set")) & near(F.col("size"), F.col("l.size"))).select(F.col("l.set").alias("a"), F.col("set").alias("b"))
    found = _verified(stars, texts, sets, shingle, least)
    whole = connected_components(found, "a", "b")
    part = posted.join(whole, F.col("set") == F.col("node"), "left").select("key", "set", "size", F.coalesce("component", "set").alias("c"))
    part = stash(part, "parts", release=True)
    drop_stash(posted)
    parts = part.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("most")).where("parts > 1")
    mixed = stash(part.join(parts.select("key", F.col("most.c").alias("main")), "key").join(sets.select("set", "bits"), "set"), "mixed", release=True)
    drop_stash(part)
    few = mixed.where("c <> main").select("key", F.col("set").alias("s"), F.col("size").alias("n"), F.col("c").alias("d"), F.col("bits").alias("other"))
    # A pair outside the main component meets in both orders: one is enough.
    once = (F.col("c") == F.col("main")) | (F.col("set") > F.col("s"))
    more = few.join(mixed, "key").where((F.col("c") != F.col("d")) & once & _may_be(F.col("size"), F.col("n"), F.col("bits"), F.col("other"), least)).select(F.least("s", "set").alias("a"), F.greatest("s", "set").alias("b"))
    out = stash(found.union(_verified(more, texts, sets, shingle, least)), "set-links")
    drop_stash(mixed)
    drop_stash(found)
    return out


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: id, component_id (smallest id reachable; null only where the whole component has none)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"text_key": F.coalesce(F.md5("text"), F.lit("")), "bit": F.pmod(F.xxhash64("text"), F.lit(SIEVE)) + 1})
    with small_batches(docs.sparkSession):
        often = _often(rows.select("text"), shingle)
        made = stash(_prefixes(rows.select("id", "text_key", "bit", "text"), often, shingle, least), "prefixes")
    sets = stash(made.groupBy("set").agg(F.min("id").alias("rep"), F.min(F.struct("text_key", "bit")).alias("t"), *[F.first(c).alias(c) for c in ("size", "bits", "wide", "prefix")]).select("set", "rep", "t.text_key", "t.bit", "size", "bits", "wide", "prefix"), "shingle-sets", release=True)
    named = stash(made.select("id", "set"), "named")
    drop_stash(made)
    whole = connected_components(links(rows, sets, shingle, least), "a", "b")
    member = stash(whole.join(sets.select("set", "rep"), F.col("node") == F.col("set")).select("set", "component", "rep"), "set-members")
    linked = member.join(member.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set", "component_id")
    owner = sets.join(linked, "set", "left").select("set", F.coalesce("component_id", "rep").alias("component_id"))
    out = stash(named.join(owner, "set").select(F.col("id").alias(id_col), "component_id"), "near-groups", release=True)
    for table in (sets, named, member):
        drop_stash(table)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of each component, as simhash.dedup keeps them."""
    return keep_least(docs, components(docs, id_col, text_col, **how), id_col, text_col)


def with_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """As components, for the links of SimHash (simhash.components: fingerprints within two bits) and those of similarity together.

    Both group texts, so the groups meet by the text's 64-bit hash: rows without identifier link others like any row.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    bits = simhash.components(texts, "key").select("key", F.col("component_id").alias("a")).distinct()
    sets = components(texts, "key", **how).select("key", F.col("component_id").alias("b")).distinct()
    both = stash(bits.join(sets, "key"), "both-groups", release=True)
    whole = connected_components(both.select("a", "b"), "a", "b")
    owner = both.join(whole, F.col("a") == F.col("node"), "left").select("key", F.coalesce("component", "a").alias("c"))
    named = stash(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key")).join(owner, "key").select("id", "c"), "both-named", release=True)
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    return named.join(least, "c").select(F.col("id").alias(id_col), "component_id")


def dedup_with_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of each component of with_simhash."""
    return keep_least(docs, with_simhash(docs, id_col, text_col, **how), id_col, text_col)
