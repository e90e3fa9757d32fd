"""Toxicity: non-negative positive-unlabelled learning of a linear classifier.

Positives are confirmed toxic texts; unlabelled are all texts of the learning fold, taken without looking at
labels, so they follow the corpus. With class prior pi and logistic loss l the risk is
pi E_pos[l(f)] + max(0, E_unl[l(-f)] - pi E_pos[l(-f)]): the second part estimates the loss on true negatives from unlabelled
text and, where it turns negative (overfitting), its gradient is reversed. The bias is then set so that unlabelled text has the mean
score pi. pi is the share of toxic among labelled rows of
the fold, or a parameter.
A text's features are the presence of its distinct words (letters only, lower case) and of their first 4, 5 and 6 letters,
hashed; only features clearly commoner among positives than in unlabelled text carry weight. Labelled positives are at most about
`most_positive` rows; shares and losses of unlabelled text are summed over every row of the fold, on the executors: a pass reduces texts
to the features that matter, equal ones are counted together, and each step of the fit adds up their gradients. In the shares, rows of
equal features count once together where they are more than one in `HEAVY` rows (so at most that many groups are listed). The driver
holds a number for each feature and the positives alone. Every document is scored by its whole text.

Defined cases: null or empty text has no features and gets the score of the bias; labelled rows without a label are not used;
without positives every score is the prior; repeated rows get equal scores; a null identifier counts as empty text for
the fold; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop_stash, give_back, small_batches, stash, summed
from .features import Adam, crc, sampled, sigmoid

BUCKETS = 1 << 20
HEADS = (4, 5, 6)
CACHE = 200_000
HEAVY = 1 << 16
PIECES = 16  # parts in which shares are summed
_letters = re.compile(r"[^\W\d_]+").findall


class Model(NamedTuple):
    bias: float
    w: np.ndarray


class WordFeatures(dict):
    """A word's feature numbers as bytes; emptied when full."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        keys = [f"{k}{part[:k] if k else part}" for part in _letters(word.lower()) for k in (0, *HEADS) if len(part) > k or not k]
        self[word] = got = np.array([zlib.crc32(x.encode()) % BUCKETS for x in keys], "<i4").tobytes()
        return got


_cache = WordFeatures()


def featurize(text: str | None) -> np.ndarray:
    """Distinct feature numbers of the text."""
    return np.unique(np.frombuffer(b"".join(map(_cache.__getitem__, set((text or "").split()))), "<i4"))


def squeezed(index: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit steps; a wider step takes several, all but its last full."""
    steps = np.diff(index.astype(np.int64), prepend=-1) - 1
    full = steps // 0xFFFF
    out = np.full(len(index) + int(full.sum()), 0xFFFF, "<u2")
    out[np.cumsum(full + 1) - 1] = steps % 0xFFFF
    return out.tobytes()


def unsqueezed(data) -> np.ndarray:
    steps = np.frombuffer(data, "<u2").astype(np.int64)
    last = steps != 0xFFFF
    return (np.cumsum(steps + last) - 1)[last]


def hashes(index: np.ndarray) -> tuple[int, int]:
    """Rows that agree in both have the same features."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(index.tobytes()), "<i8").tolist())


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f, m1, m2) of every document, stored: its features, squeezed, and two hashes of them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = [featurize(t.as_py()) for t in b.column(1)]
            both = np.array(list(map(hashes, index)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(squeezed, index)), pa.binary()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["id", "f", "m1", "m2"])
        give_back()

    with small_batches(docs.sparkSession):
        return stash(rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("f", T.BinaryType()), T.StructField("m1", T.LongType()), T.StructField("m2", T.LongType())])), "features")


def _places(chosen: np.ndarray) -> np.ndarray:
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return place


def _reduced(feats: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(c): the places in chosen of each row's features."""
    shared = feats.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(shared.value)
        for b in batches:
            at = [place[unsqueezed(x.as_buffer())] for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in at], pa.binary())], ["c"])

    return feats.select("f").mapInArrow(run, "c binary")


def _rows_of(cells) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows in turn, row of each number)."""
    each = [np.frombuffer(x.as_buffer(), np.int32) for x in cells]
    return np.concatenate(each) if each else np.zeros(0, np.int32), np.repeat(np.arange(len(each)), list(map(len, each)))


def unlabelled_shares(feats: DataFrame, candidates: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows that hold each candidate, rows), over all rows; rows of equal features, if many, count once together."""
    many = feats.groupBy("m1", "m2").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") > F.lit(feats.count() / HEAVY)))
    shared = feats.sparkSession.sparkContext.broadcast((candidates, {(r.m1, r.m2): 1 / r.n for r in many.collect()}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, part = shared.value
        place, total, rows = _places(chosen), np.zeros(len(chosen) + 1), 0
        for b in batches:
            for x, m1, m2 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, weight = place[unsqueezed(x.as_buffer())], part.get((m1, m2), 1.0)
                total[at[at >= 0]] += weight
                total[-1] += weight
            rows += b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, PIECES)], pa.binary()), pa.array([rows] * PIECES, pa.int64())], ["k", "total", "n"])

    parts = summed(feats.select("f", "m1", "m2").mapInArrow(count, "k int, total binary, n long"), PIECES)
    # Each group adds up to 1, so whole numbers are due.
    total = np.rint(np.concatenate([parts[k][0] for k in range(PIECES)])) if parts else np.zeros(len(candidates) + 1)
    return total[:-1], int(total[-1])


def stands_out(in_pos: np.ndarray, n_pos: int, in_unl: np.ndarray, n_unl: int, least_z: float = 5.0) -> np.ndarray:
    """Features whose share among positives is above that in unlabelled text by `least_z` standard errors.

    The unlabelled share is the marginal one, so this needs no negatives; other features would only be learnt by heart.
    """
    q = (in_unl + 1) / (n_unl + 2)
    return in_pos - n_pos * q > least_z * np.sqrt(n_pos * q * (1 - q))


class Unlabelled:
    """Sums over all unlabelled rows, made on the executors from their distinct sets of chosen features."""

    def __init__(self, feats: DataFrame, chosen: np.ndarray):
        self.size = len(chosen)
        self.rows = stash(_reduced(feats, chosen).groupBy("c").agg(F.count("*").alias("n")), "patterns")

    def _sums(self, make, width: int) -> tuple[np.ndarray, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, many = np.zeros(width), 0
            for b in batches:
                at, row = _rows_of(b.column(0))
                n = b.column(1).to_numpy()
                total += make(at, row, n)
                many += int(n.sum())
            if many:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([many], pa.int64())], ["k", "total", "n"])

        return summed(self.rows.mapInArrow(run, "k int, total binary, n long"), 1).get(0, (np.zeros(width), 0))

    def risk(self, bias: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        """(mean loss as negatives, its gradient by the bias, by the weights)."""

        def make(at: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
            f = np.bincount(row, w[at], len(n)) + bias
            g = n * sigmoid(f)
            return np.concatenate(([(n * np.logaddexp(0, f)).sum(), g.sum()], np.bincount(at, g[row], len(w))))

        total, n = self._sums(make, self.size + 2)
        return total[0] / n, total[1] / n, total[2:] / n

    def spread(self, w: np.ndarray, low: float = -60.0, high: float = 60.0, bins: int = 24_000) -> tuple[np.ndarray, np.ndarray]:
        """(weight sums, rows): a fine histogram of the rows' sums without bias."""

        def make(at: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
            f = np.clip(np.bincount(row, w[at], len(n)), low, high)
            return np.bincount(np.minimum(((f - low) / (high - low) * bins).astype(np.int64), bins - 1), n, bins)

        return low + (np.arange(bins) + 0.5) * (high - low) / bins, self._sums(make, bins)[0]

    def drop(self) -> None:
        drop_stash(self.rows)


def nnpu(positives: list[np.ndarray], unlabelled: Unlabelled, prior: float, steps: int = 40, rate: float = 0.1, decay: float = 1e-4, start: float = 1.0) -> tuple[float, np.ndarray]:
    """(bias, weights); positives are sets of places in the chosen features. Each step sees all rows of both sides."""
    base = float(np.log(prior / (1 - prior)))
    at = np.concatenate(positives) if positives else np.zeros(0, np.int64)
    row, n = np.repeat(np.arange(len(positives)), list(map(len, positives))), len(positives)
    p, opt = [np.full(1, base), np.full(unlabelled.size, start)], Adam([(1,), (unlabelled.size,)], rate)
    for step in range(steps):
        opt.rate = rate * (1 - 0.9 * step / steps)
        f = np.bincount(row, p[1][at], n) + p[0][0]
        up, down = -prior * sigmoid(-f) / n, prior * sigmoid(f) / n  # gradients of pi E_pos[l(f)] and pi E_pos[l(-f)]
        loss, by_bias, by_weight = unlabelled.risk(float(p[0][0]), p[1])
        # Below 0 the estimate of the loss on negatives is overfitted: go back up its gradient.
        g, sign = (up - down, 1) if loss - prior * np.logaddexp(0, f).mean() >= 0 else (down, -1)
        opt.step(p, [np.array([g.sum() + sign * by_bias]), np.bincount(at, g[row], unlabelled.size) + sign * by_weight + decay * p[1]])
    # The mean score of unlabelled text is the prior: that sets the bias.
    sums, rows = unlabelled.spread(p[1])
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (rows * sigmoid(sums + mid)).sum() < prior * rows.sum() else (low, mid)
    return mid, p[1]


def train_on(feats: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", label_col: str = "toxic", prior: float | None = None, most_positive: int = 4_000, least_docs: int = 3) -> Model:
    """feats as featured() gives them. fold: a condition on the identifier that names the rows to learn from, in labels by their own names."""
    known = labels.where(fold).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    if prior is None:
        prior = known.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    none = Model(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS, np.float32))
    marked = sampled(known.where("y = 1").select(F.col(id_col).alias("__id")), "__id", most_positive, "toxic")
    # At most about most_positive identifiers are broadcast and so many rows collected, each at most BUCKETS numbers.
    got = feats.join(F.broadcast(marked), F.col("id") == F.col("__id")).select("f").collect()
    if not got:
        return none
    positives = [unsqueezed(r.f) for r in sorted(got, key=lambda r: bytes(r.f))]
    once = {hashes(x): x for x in positives}.values()
    in_pos = np.bincount(np.concatenate(list(once)), minlength=BUCKETS)
    candidates = np.flatnonzero(in_pos >= least_docs)
    own = feats.withColumnRenamed("id", id_col).where(fold)
    in_unl, n_unl = unlabelled_shares(own, candidates)
    chosen = candidates[stands_out(in_pos[candidates], len(once), in_unl, n_unl)]
    if not n_unl or not len(chosen):
        return none
    place = _places(chosen)
    unlabelled = Unlabelled(own, chosen)
    bias, weights = nnpu([place[x][place[x] >= 0] for x in positives], unlabelled, prior, start=0.0)
    unlabelled.drop()
    w = np.zeros(BUCKETS, np.float32)
    w[chosen] = weights
    return Model(bias, w)


def score_on(feats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [float(sigmoid(np.float64(m.bias + m.w[unsqueezed(x.as_buffer())].sum(dtype=np.float64)))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    rows = feats.select("id", "f")
    out = rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), "score")


def train(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> Model:
    return train_on(featured(docs, id_col, text_col), labels, fold, id_col=id_col, **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_on(featured(docs, id_col, text_col), model, id_col)


def op9_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    fold = crc("doc_id") % 4 != 2
    feats = featured(documents(spark, sf_dir))
    model = train_on(feats, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold)
    return score_on(feats, model).select("doc_id", (~fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
