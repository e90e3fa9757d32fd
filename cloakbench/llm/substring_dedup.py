"""Substring dedup: winnowed anchors, extension both ways, removal of what repeats over `length` words.

Each window of `length` words has one seed, the least hash of its runs of `seed_words` words, so equal windows have equal
seeds at equal places; the places that some window chose, about a seventh of the words, are the document's anchors. Seeds are counted over the
corpus; the anchors of seeds that occur twice go, with the words around them, to a join by seed. There each anchor meets the earliest one of
its seed and the match is extended word by word to both sides, as far as a window around the anchor can reach. A match of `length` words or more
is a repeat; the union of the overlapping matches of one passage is the maximal repeat, and its words are removed from the later
document. No pairs are formed: each anchor meets one other, so a passage that a third of the documents share costs a row for each
occurrence.

Windows around an anchor that do not match the earliest one may still match another. They can only match windows that do not match the earliest
either, so these few are grouped by their whole content (two 64-bit hashes), and all but the earliest of a group are removed as well.

Texts of equal word sequence are settled before that: all but the earliest lose every word if they have `length` words.

Defined cases: null text has no words; texts under `length` words lose nothing; a null identifier is before all others; of
rows that share an identifier the order is by a hash of the text; rows that repeat both are one document and get the same
result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop_stash, give_back, small_batches, stash

#: Odd multipliers of the two rolling hashes.
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _runs(h: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """Hash of each run of n: a polynomial in `by` over h modulo 2**64, by doubling."""
    out, have, step, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = step, size
            else:
                count = len(h) - have - size + 1
                out = step[:count] * _power(by, have) + out[size : size + count]
                have += size
        size *= 2
        if size > n:
            return out
        step = step[: len(step) - size // 2] * _power(by, size // 2) + step[size // 2 :]


def _power(by: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(by), n, 1 << 64))


def _slide(pick, x: np.ndarray, n: int) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each n neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - n + size], x[n - size :]) if size < n else x


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _seeds(h: np.ndarray, length: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of seed_words, seed of each window)."""
    grams = _mixed(_runs(h[:, 0], seed_words, MULTIPLY[0]))
    return grams, _slide(np.minimum, grams, length - seed_words + 1)


def anchors(words: list[bytes], length: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed hash) for each place that some window of the document chose."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, least = _seeds(_word_hashes(words), length, seed_words)
    wide = length - seed_words
    edge = np.zeros(wide, np.uint64)
    # Windows over a place have a seed no greater than its hash: it was chosen if the greatest of them equals it.
    most = _slide(np.maximum, np.concatenate((edge, least, edge)), wide + 1)
    at = np.flatnonzero(most == grams)
    return at, grams[at].view(np.int64)


def _windows(h: np.ndarray, length: int) -> np.ndarray:
    """The two hashes of each window."""
    return np.stack([_runs(h[:, c], length, MULTIPLY[c]) for c in (0, 1)], 1)


def _repeated(w: np.ndarray) -> np.ndarray:
    """True for rows that an earlier row equals."""
    order = np.lexsort((w[:, 1], w[:, 0]))  # stable: equal rows stay in their order
    out = np.zeros(len(w), bool)
    out[order[1:]] = (w[order[1:]] == w[order[:-1]]).all(1)
    return out


def removed(n_words: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the words that some range [begin, end) covers."""
    delta = np.zeros(n_words + 1, np.int64)
    np.add.at(delta, begins, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def extended(words: list[bytes], at: int, other: list[bytes], other_at: int, seed_words: int) -> tuple[int, int] | None:
    """The range of words around the seed at `at` that equal those around the other's; None if not even the seeds do."""
    if words[at : at + seed_words] != other[other_at : other_at + seed_words]:
        return None
    low, shift = at, other_at - at
    while low and low + shift and words[low - 1] == other[low - 1 + shift]:
        low -= 1
    high, end = at + seed_words, min(len(words), len(other) - shift)
    while high < end and words[high] == other[high + shift]:
        high += 1
    return low, high


def uncovered(lines: list[list[bytes]], low: np.ndarray, high: np.ndarray, at: np.ndarray, before: np.ndarray, length: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start in its document, two hashes) of the windows that chose the line's anchor and do not lie in [low, high).

    The anchor is word `at` of the document and `before` of the line. All lines are hashed as one; windows across two are not asked for.
    """
    size = np.array(list(map(len, lines)), np.int64)
    low, high, at, before = (x.astype(np.int64) for x in (low, high, at, before))
    first = np.maximum(0, before - (length - seed_words))
    n = np.maximum(0, np.minimum(before, size - length) - first + 1)
    own = np.repeat(np.arange(len(lines)), n)
    if not len(own):
        return own, own, np.zeros((0, 2), np.uint64)
    h, begins = _word_hashes(list(chain.from_iterable(lines))), np.cumsum(size) - size
    grams, least = _seeds(h, length, seed_words)
    s = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
    start = s + (at - before)[own]
    keep = least[begins[own] + s] == grams[(begins + before)[own]]
    keep &= (start < low[own]) | (start + length > high[own])
    own, s, start = own[keep], s[keep], start[keep]
    return own, start, _windows(h, length)[begins[own] + s]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, seed_words: int = 8) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, or null where all do), kept_sha256."""
    if not 0 < seed_words <= length:
        raise ValueError("a seed has between 1 and `length` words")
    # key only chooses which seeds a document is given: documents that share one get each other's as well. name tells documents apart.
    name = F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("null")), F.lit(":"), F.coalesce(F.xxhash64(text_col), F.lit(0)).cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, seeds = [], [], []
            for t in b.column(3):
                words = (t.as_py() or "").encode().split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                seeds.append(anchors(words, length, seed_words)[1])
            ends = np.cumsum([0, *map(len, seeds)])
            flat = pa.array(np.concatenate(seeds) if seeds else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "name", "key", "n_words", "sha", "seeds"])
        give_back()

    made = T.StructType([T.StructField("id", id_type), T.StructField("name", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("seeds", T.ArrayType(T.LongType()))])
    with small_batches(docs.sparkSession):
        scanned = stash(rows.mapInArrow(scan, made), "seeds")
    meta = stash(scanned.select("id", "name", "key", "n_words", "sha"), "meta")

    place = F.struct("id", "name")
    # Sequences of equal words: all but the earliest are copies.
    firsts = stash(meta.where(F.col("n_words") >= length).groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = stash(meta.select("id", "name", "sha").join(firsts, "sha").where(~place.eqNullSafe(F.col("first"))).select("name").distinct(), "copies")

    each = scanned.select("key", F.explode("seeds").alias("seed"))
    twice = stash(each.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeated", release=True)
    own = each.join(twice, "seed", "left_semi").groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    # The joins by key and by copies come before the texts: those move once.
    own = meta.select("key", "name").distinct().join(own, "key").join(copies, "name", "left_anti").select("name", "seeds")
    found = rows.select("id", "name", "text").join(own, "name")
    # An identifier names its document but where it is shared; only there the name goes along.
    shared = stash(meta.groupBy(F.col("id").alias("other")).agg(F.count("*").alias("n")).where("n > 1").select("other", F.lit(True).alias("many")), "shared")
    found = found.join(shared, F.col("id").eqNullSafe(F.col("other")), "left")
    found = found.select("id", F.when(F.col("many"), F.col("name")).otherwise(F.lit("")).alias("tie"), "name", "text", "seeds").dropDuplicates(["id", "name"])
    found = stash(found, "seeded", release=True)
    drop_stash(scanned)
    drop_stash(twice)
    wide = length - seed_words

    def place_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = b.column(2)[k].as_py().encode().split()
                at, seeds = anchors(words, length, seed_words)
                once: dict[tuple, int] = {}
                for p, s in zip(*(x[np.isin(seeds, np.array(b.column(3)[k].values, np.int64))].tolist() for x in (at, seeds))):
                    low = max(0, p - wide)
                    # The same anchor among the same words, later in the document, needs no search.
                    once.setdefault((s, p - low, b" ".join(words[low : p + seed_words + wide])), p)
                for part in range(0, len(once), 5_000):
                    own = list(once.items())[part : part + 5_000]
                    cols = [pa.array([x[0][0] for x in own], pa.int64()), pa.array([b.column(0)[k].as_py()] * len(own), b.schema.field(0).type), pa.array([b.column(1)[k].as_py()] * len(own), pa.string()), pa.array([x[1] for x in own], pa.int32()), pa.array([x[0][1] for x in own], pa.int32()), pa.array([x[0][2].decode() for x in own], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["seed", "id", "tie", "at", "before", "line"])
        give_back()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, tie, low, high, line, at): the range that repeats (empty if none does), and the line where windows around the anchor stay open."""
        for b in batches:
            lows, highs, open_lines = [], [], []
            for at, before, line, other_before, other in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                words = line.encode().split()
                got = extended(words, before, other.encode().split(), other_before, seed_words)
                low, high = got if got and got[1] - got[0] >= length else (0, 0)
                lows.append(at - before + low)
                highs.append(at - before + high)
                # All windows over the anchor lie in the line: they are settled if all of it matches.
                open_lines.append(None if high - low == len(words) else line)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), b.column(2), b.column(3), pa.array(open_lines, pa.string())], ["id", "tie", "low", "high", "at", "before", "line"])
        give_back()

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(w1, w2, id, tie, low) of the windows that chose the anchor and do not lie in the range."""
        for b in batches:
            rows_of, starts, w = uncovered([x.encode().split() for x in b.column(6).to_pylist()], *(b.column(c).to_numpy() for c in range(2, 6)), length, seed_words)
            if len(rows_of):
                take, w = pa.array(rows_of), w.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32())], ["w1", "w2", "id", "tie", "low"])
        give_back()

    doc_fields = [T.StructField("id", id_type), T.StructField("tie", T.StringType())]
    ints = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    doc = F.struct("id", "tie").alias("doc")
    with small_batches(docs.sparkSession, 10_000):
        # Made twice rather than stored: once for the earliest of each seed, once for the join.
        placed = found.select("id", "tie", "text", "seeds").mapInArrow(place_anchors, T.StructType([*longs("seed"), *doc_fields, *ints("at", "before"), T.StructField("line", T.StringType())]))
        where = F.struct("id", "tie", "at")
        leaders = placed.groupBy("seed").agg(F.min(F.struct("id", "tie", "at", "before", "line")).alias("l"), F.count("*").alias("n")).where("n > 1").select("seed", "l")
        leaders = stash(leaders, "leaders", release=True)
        met = placed.join(leaders, "seed").where(~where.eqNullSafe(F.struct("l.id", "l.tie", "l.at")))
        met = met.select("id", "tie", "at", "before", "line", F.col("l.before").alias("other_before"), F.col("l.line").alias("other"))
        ranges = stash(met.mapInArrow(extend, T.StructType([*doc_fields, *ints("low", "high", "at", "before"), T.StructField("line", T.StringType())])), "ranges", release=True)
        drop_stash(leaders)

        place = F.struct("id", "tie", "low")
        rest = ranges.where("line is not null").mapInArrow(open_windows, T.StructType([*longs("w1", "w2"), *doc_fields, *ints("low")]))
        earliest = stash(rest.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "earliest", release=True)
        later = rest.join(earliest, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first"))).select(doc, "low", (F.col("low") + length).alias("high"))
        every = ranges.where("high > low").select(doc, "low", "high").union(later)
        marks = stash(every.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "marks", release=True)
        drop_stash(earliest)
        drop_stash(ranges)
    marked = found.select(doc, "name", "text").join(marks, "doc", "left").select("name", "text", "ranges.low", "ranges.high")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, kept, digests = [], [], []
            for k in range(b.num_rows):
                words = b.column(1)[k].as_py().encode().split()
                low, high = (np.array(x[k].values if x[k].is_valid else [], np.int64) for x in (b.column(2), b.column(3)))
                # What repeats inside the document.
                own = np.flatnonzero(_repeated(_windows(_word_hashes(words), length))) if len(words) >= length else np.zeros(0, np.int64)
                gone = removed(len(words), np.concatenate((low, own)), np.concatenate((high, own + length)))
                line = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                counts.append(int(gone.sum()))
                kept.append(line.decode())
                digests.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["name", "n_removed", "kept", "kept_sha256"])
        give_back()

    changed = marked.mapInArrow(cut, "name string, n_removed long, kept string, kept_sha256 string")
    none = copies.select("name", F.lit(None).cast("long").alias("n_removed"), F.lit("").alias("kept"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    with small_batches(docs.sparkSession):
        changed = stash(changed.union(none), "changed", release=True)
    out = meta.join(changed.withColumn("hit", F.lit(True)), "name", "left")
    n_removed = F.when(F.col("hit"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_removed.alias("n_removed"), "kept", F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir), length=20).drop("kept")
